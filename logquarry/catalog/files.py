"""Files written from the tables and read back: lines, loads, exports, lifecycle."""

from pyspark.sql import functions as F

from logquarry.catalog.base import (EV, FORMS, TEXT, W3C_COLUMNS, event_lines, event_rows,
                                    events, query, rows_cte, table, text_lines)
from logquarry.operators import filters
from logquarry.operators.filters import FilterSpec
from logquarry.plans.load import Admission, load_files
from logquarry.session import scratch_folder
from logquarry.sinks import audit, commits, exports, skipping, tables
from logquarry.sources import archives, lines, listing, results

PER_FILE = 2500
BUCKETS = f"""b AS (SELECT *, event_id // {PER_FILE} AS bucket,
  row_number() OVER (PARTITION BY event_id // {PER_FILE} ORDER BY event_id) - 1 AS line_no FROM ev)"""


def bucket_of():
    return F.regexp_extract("file", r"bucket=(\d+)", 1).cast("bigint")


def write_buckets(spark, text, folder: str, codec: str | None = None, per_file: int = PER_FILE) -> str:
    """One text file per 2,500 events, or as many as are asked for. `text`: event_id, value."""
    buckets = text.select(F.expr(f"event_id div {per_file}").alias("bucket"), "event_id", "value")
    placed = buckets.repartition("bucket").sortWithinPartitions("bucket", "event_id").drop("event_id")
    writer = placed.write.partitionBy("bucket").option("lineSep", "\n")
    (writer.option("compression", codec) if codec else writer).text(folder)
    return folder


def paths_of(spark, folder: str) -> list[str]:
    return [r["path"] for r in listing.list_files(spark, folder).toLocalIterator()]


def form_text(spark, sf, form="generic"):
    return event_lines(spark, sf, form).select(F.col("line_no").alias("event_id"), "value")


LINES = f"WITH {EV}, {BUCKETS} SELECT CAST(bucket AS BIGINT) AS bucket, line_no, {{0}} AS value FROM b"


@query("line_numbers", LINES.format(TEXT["generic"]))
def line_numbers(spark, sf):
    folder = write_buckets(spark, form_text(spark, sf), scratch_folder(spark, "lines"))
    return lines.read_lines(spark, paths_of(spark, folder)).select(bucket_of().alias("bucket"), "line_no", "value")


@query("read_text_roundtrip", "SELECT text AS value FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)")
def read_text_roundtrip(spark, sf):
    """Document lines, CRLF-ended on disk, come back as they were."""
    folder = scratch_folder(spark, "docs")
    text_lines(spark, sf).select(F.concat("value", F.lit("\r"))).write.option("lineSep", "\n").text(folder)
    return lines.read_lines(spark, paths_of(spark, folder)).select("value")


@query("decode_cp1252", LINES.format("'café “' || event_type || '” ' || event_id"))
def decode_cp1252(spark, sf):
    raw = F.encode(F.concat(F.lit("café \u0093"), "event_type", F.lit("\u0094 "), "event_id"), "ISO-8859-1")
    text = events(spark, sf).select("event_id", raw.cast("string").alias("value"))
    folder = write_buckets(spark, text, scratch_folder(spark, "cp1252"))
    return lines.read_lines(spark, paths_of(spark, folder)).select(bucket_of().alias("bucket"), "line_no", "value")


def _pack(kind: str, folder: str):
    """Write one bucket (at most 2,500 lines) as an xz, zip or misnamed gzip file."""
    def run(part):
        import gzip
        import io
        import lzma
        import zipfile

        import pandas as pd

        from logquarry.streaming.tail import resolve
        data = "".join(v + "\n" for v in part.sort_values("event_id")["value"]).encode()
        if kind == "zip":
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("__MACOSX/a.log", "no")
                z.writestr("notes.md", "no")
                z.writestr("logs/app.log", data)
            data = raw.getvalue()
        else:
            data = lzma.compress(data) if kind == "xz" else gzip.compress(data)
        filesystem, path = resolve(f"{folder}/bucket={part['bucket'].iloc[0]}")
        filesystem.create_dir(path, recursive=True)
        with filesystem.open_output_stream(f"{path}/part.{'log' if kind == 'gzip' else kind}") as f:
            f.write(data)
        return pd.DataFrame({"n": [len(part)]})
    return run


def by_bucket(text):
    return text.select(F.expr(f"event_id div {PER_FILE}").alias("bucket"), "event_id", "value").groupBy("bucket")


def packed_folder(spark, sf, kind: str) -> str:
    folder = scratch_folder(spark, kind)
    by_bucket(form_text(spark, sf)).applyInPandas(_pack(kind, folder), "n long").agg(F.sum("n")).collect()
    return folder


def _compressed(kind: str, codec: str | None) -> None:
    @query(f"read_{kind}", LINES.format(TEXT["generic"]))
    def run(spark, sf):
        if codec:
            folder = write_buckets(spark, form_text(spark, sf), scratch_folder(spark, kind), codec)
            found = lines.read_lines(spark, paths_of(spark, folder))
        else:
            files = listing.classify_files(listing.list_files(spark, packed_folder(spark, sf, kind)))
            seen = archives.readable(archives.inspect_archives(files))
            found = archives.read_archives(seen.join(files.select("file", "compressed"), "file"))
        return found.select(bucket_of().alias("bucket"), "line_no", "value")


for _kind, _codec in (("gzip", "gzip"), ("bzip2", "bzip2"), ("xz", None), ("zip", None)):
    _compressed(_kind, _codec)


@query("classify_files", f"""WITH {EV} SELECT DISTINCT CAST(event_id // {PER_FILE} AS BIGINT) AS bucket, k AS compressed,
  CASE k WHEN '' THEN 'text' ELSE 'archive' END AS via FROM ev, (VALUES (''), ('gzip'), ('xz'), ('zip')) f(k)""")
def classify_files(spark, sf):
    """Plain, misnamed gzip, xz and zip files, told apart by their first bytes."""
    folders = [write_buckets(spark, form_text(spark, sf), scratch_folder(spark, "plain"))]
    folders += [packed_folder(spark, sf, k) for k in ("gzip", "xz", "zip")]
    return listing.classify_files(listing.list_files(spark, *folders)).select(
        bucket_of().alias("bucket"), "compressed", "via")


@query("admit_files", """SELECT url AS path, CAST(length(html) AS BIGINT) * 10000 AS size,
  CASE WHEN length(html) * 10000 > 524288000 THEN 'too_large,' ELSE '' END ||
  CASE WHEN lower(regexp_extract(url, '[^/.][^/]*(\\.[^./]*)$', 1)) NOT IN
   ('.log', '.txt', '.csv', '.json', '.gz', '.bz2', '.xz', '.zip') THEN 'unsupported_extension,' ELSE '' END ||
  CASE WHEN (SELECT sum(length(html)) * 10000 FROM pages) > 1073741824 THEN 'batch_too_large' ELSE '' END AS reasons,
  false AS admitted FROM pages
  UNION ALL SELECT page_id || '.log', CAST(length(html) AS BIGINT), '', true FROM pages""")
def admit_files(spark, sf):
    """Page addresses as file names, page sizes blown up to meet the limits; and a batch
    of as many small log files, which is admitted."""
    pages, size = table(spark, sf, "pages"), F.char_length("html").cast("bigint")
    judged = listing.admit_files(pages.select(F.col("url").alias("path"), (size * 10000).alias("size")))
    judged = judged.unionByName(listing.admit_files(pages.select(
        F.concat(F.col("page_id").cast("string"), F.lit(".log")).alias("path"), size.alias("size"))))
    has = lambda r: F.array_contains("reasons", r)
    text = F.concat(F.when(has("too_large"), "too_large,").otherwise(""),
                    F.when(has("unsupported_extension"), "unsupported_extension,").otherwise(""),
                    F.when(has("batch_too_large"), "batch_too_large").otherwise(""))
    return judged.select("path", "size", text.alias("reasons"), "admitted")


@query("dataset_names", """SELECT page_id, CASE WHEN k = 1 THEN base ELSE base || '_' || (k - 1) END AS dataset FROM (
  SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) AS k FROM (
  SELECT page_id, 'log' || (page_id % 7) || '.txt' AS base FROM pages))""")
def dataset_names(spark, sf):
    files = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("/in/"), "page_id", F.lit("/log"), F.col("page_id") % 7, F.lit(".txt")).alias("path"))
    return listing.assign_names(files, order="page_id").select("page_id", "dataset")


# --- a whole load ----------------------------------------------------------

LOADED = " UNION ALL ".join(
    f"SELECT '{f}' AS format, CAST(bucket AS BIGINT) AS bucket, line_no + {int(f == 'w3c')} AS line_no,"
    f" {'exact' if f in ('generic', 'syslog', 'json') else 'whole'} AS ts_norm, ip FROM b" for f in FORMS)


def _loaded(spark, sf):
    root = scratch_folder(spark, "load")
    for form in FORMS:
        text = form_text(spark, sf, form)
        if form == "w3c":
            first = F.struct(F.lit(0).alias("k"), F.lit("#Fields: " + " ".join(W3C_COLUMNS)).alias("value"))
            own = F.struct(F.lit(1).alias("k"), F.col("value"))
            head = F.col("event_id") % PER_FILE == 0
            text = (text.select("event_id", F.inline(F.when(head, F.array(first, own)).otherwise(F.array(own))))
                    .select("event_id", "k", "value"))
            placed = (text.withColumn("bucket", F.expr(f"event_id div {PER_FILE}")).repartition("bucket")
                      .sortWithinPartitions("bucket", "event_id", "k").select("bucket", "value"))
            placed.write.partitionBy("bucket").text(f"{root}/{form}")
        else:
            write_buckets(spark, text, f"{root}/{form}")
    return load_files(spark, [root], "u0")


@query("load_rows", f"WITH {EV}, {BUCKETS} {LOADED}")
def load_rows(spark, sf):
    """Files of five formats: list, classify, number, decode, detect, parse, enrich."""
    return _loaded(spark, sf).rows.select("format", bucket_of().alias("bucket"), "line_no", "ts_norm", "ip")


@query("load_manifest", f"""WITH {EV}, {BUCKETS} SELECT form AS format, 'utf-8' AS encoding, '' AS compressed,
  CAST(bucket AS BIGINT) AS bucket, count(*) + CAST(form = 'w3c' AS INTEGER) AS total, count(*) AS parsed,
  CAST(form = 'w3c' AS BIGINT) AS rejected FROM b, (VALUES {', '.join(f"('{f}')" for f in FORMS)}) f(form)
  GROUP BY form, bucket""")
def load_manifest(spark, sf):
    return _loaded(spark, sf).files.select("format", "encoding", "compressed", bucket_of().alias("bucket"),
                                           "total", "parsed", "rejected")


@query("load_admitted", f"""WITH {EV}, {BUCKETS}, s AS (SELECT CAST(bucket AS BIGINT) AS bucket, count(*) AS n,
    sum(strlen({TEXT['generic']}) + 1) AS size FROM b GROUP BY bucket)
  SELECT 'loaded' AS kind, bucket, n, '' AS reason FROM s UNION ALL
  SELECT 'refused', bucket, CAST(size AS BIGINT), CASE WHEN size > 10000 THEN 'too_large' ELSE 'batch_refused' END FROM s""")
def load_admitted(spark, sf):
    """A batch judged before it is loaded: admitted by the usual bounds, refused by a small one."""
    folder = write_buckets(spark, form_text(spark, sf), scratch_folder(spark, "admitted"))
    loaded = load_files(spark, [folder], admission=Admission()).rows
    got = load_files(spark, [folder], admission=Admission(max_file=10_000))
    sizes = listing.list_files(spark, folder).select("file", "size")
    refused = got.refused.join(sizes, "file").select(F.lit("refused").alias("kind"), bucket_of().alias("bucket"),
                                                     F.col("size").alias("n"), "reason").unionByName(
        got.rows.select(F.lit("rows of a refused batch").alias("kind"), bucket_of().alias("bucket"), "line_no",
                        F.lit("").alias("reason")).withColumnRenamed("line_no", "n"))
    return loaded.groupBy(F.lit("loaded").alias("kind"), bucket_of().alias("bucket")).agg(F.count("*").alias("n")).withColumn(
        "reason", F.lit("")).unionByName(refused)


# --- exports and the rows table --------------------------------------------

CELLS = ", ".join(["ts", "level", "ip", "host", "app", "pid", "method", "path", "code", "bytes", "msg"])


@query("export_csv_roundtrip", f"WITH {rows_cte('apache')} SELECT {CELLS} FROM r WHERE code = '500'")
def export_csv_roundtrip(spark, sf):
    path = scratch_folder(spark, "csv")
    exports.export_csv(event_rows(spark, sf, "apache"), path, FilterSpec(code="500"))
    return exports.read_csv_export(spark, path)


@query("export_csv_text", """SELECT CASE WHEN left(text, 1) IN ('=', '+', '-', '@', chr(9), chr(13), chr(10))
  THEN '''' || text ELSE text END AS msg FROM conversations""")
def export_csv_text(spark, sf):
    """Free text with quotes, commas and line ends through CSV and back."""
    path = scratch_folder(spark, "csvtext")
    blank = {c: F.lit("") for c in ("ts", "level", "ip", "host", "app", "pid", "method", "path", "code", "bytes")}
    exports.export_csv(table(spark, sf, "conversations").withColumns(blank).withColumn("msg", F.col("text")), path)
    return exports.read_csv_export(spark, path).select("msg")


@query("export_jsonl_roundtrip", f"WITH {rows_cte('syslog')} SELECT {CELLS}, raw FROM r WHERE app = 'signup'")
def export_jsonl_roundtrip(spark, sf):
    path = scratch_folder(spark, "jsonl")
    exports.export_jsonl(event_rows(spark, sf, "syslog"), path, FilterSpec(q="signup"), rows_per_file=5000)
    return spark.read.schema(exports.EXPORT_SCHEMA + ", raw string").json(path)


COUNTS = f"WITH {rows_cte('generic')} "


def _stored(spark, sf):
    path = scratch_folder(spark, "rows")
    tables.append_rows(event_rows(spark, sf), path)
    return path


def _sizes(spark, path):
    return tables.read_rows(spark, path).groupBy("owner", "dataset").agg(F.count("*").alias("n"))


@query("append_rows", COUNTS + "SELECT owner, dataset, count(*) * 2 AS n FROM r GROUP BY owner, dataset")
def append_rows(spark, sf):
    path = _stored(spark, sf)
    tables.append_rows(event_rows(spark, sf), path)
    return _sizes(spark, path)


@query("dataset_replace", COUNTS + """SELECT owner, dataset, CASE WHEN owner = 'u1' THEN
  count(*) FILTER (WHERE level = 'ERR') ELSE count(*) END AS n FROM r GROUP BY owner, dataset""")
def dataset_replace(spark, sf):
    path = _stored(spark, sf)
    tables.replace_datasets(event_rows(spark, sf).filter("owner = 'u1' AND level = 'ERR'"), path)
    return _sizes(spark, path)


@query("dataset_remove", COUNTS + "SELECT owner, dataset, count(*) AS n FROM r WHERE owner <> 'u2' GROUP BY owner, dataset")
def dataset_remove(spark, sf):
    path = _stored(spark, sf)
    tables.remove_dataset(spark, path, "u2", "generic")
    return _sizes(spark, path)


@query("skipping_filters", f"""WITH {rows_cte('apache')}, f AS (
    SELECT 'time' AS kind, * FROM r WHERE ts_norm >= '2024-01-10T00:00:00' AND ts_norm <= '2024-01-10T23:59:59'
    UNION ALL SELECT 'code and ip', * FROM r WHERE code = '500' AND ip = '10.1.1.5' UNION ALL SELECT 'ip', * FROM r WHERE ip = '10.2.3.9')
  SELECT kind, line_no, ip, code, (SELECT true) AS fewer_read FROM f""")
def skipping_filters(spark, sf):
    """Filters on a clustered table, and whether its scan gave out fewer rows than it holds."""
    path = scratch_folder(spark, "clustered")
    skipping.write_clustered(event_rows(spark, sf, "apache"), path, ranges=24)
    rows = tables.read_rows(spark, path)
    total, out = rows.count(), None
    for kind, found in (("time", filters.apply_filter(rows, FilterSpec(dt_from="2024-01-10", dt_to="2024-01-10T23:59:59"))),
                        ("code and ip", rows.filter("code = '500' AND ip = '10.1.1.5'")), ("ip", rows.filter("ip = '10.2.3.9'"))):
        part = found.select(F.lit(kind).alias("kind"), "line_no", "ip", "code",
                            F.lit(skipping.rows_read(found)[1] < total).alias("fewer_read"))
        out = part if out is None else out.unionByName(part)
    return out


KEPT = "owner, dataset, line_no, level, raw"


@query("commit_lifecycle", COUNTS + f"""SELECT 'now' AS at, {KEPT} FROM r WHERE owner = 'u0' OR (owner = 'u1' AND level = 'ERR')
  UNION ALL SELECT 'before', {KEPT} FROM r""")
def commit_lifecycle(spark, sf):
    """Rows after an append, a replacement and a removal, and those of a reader that was
    pinned before the last two."""
    rows, shape = event_rows(spark, sf), event_rows(spark, sf).schema
    table = commits.RowsTable(spark, scratch_folder(spark, "commits"))
    table.append(rows.filter("owner = 'u0'"))
    table.append(rows.filter("owner <> 'u0'"))
    before = table.read(shape)
    table.replace(rows.filter("owner = 'u1' AND level = 'ERR'"))
    table.remove("u2", "generic")
    columns = KEPT.split(", ")
    return table.read(shape).select(F.lit("now").alias("at"), *columns).unionByName(
        before.select(F.lit("before").alias("at"), *columns))


@query("audit_trail", f"""WITH {EV}, k AS (SELECT day || ' ' || tm AS ts, event_id AS seq, event_type AS action,
    'user' || user_id AS user, ip FROM ev
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day || ' ' || tm DESC, event_id DESC) <= 500)
  SELECT ts, seq, action, "user", ip, CASE WHEN action = 'error' THEN 'bytes' ELSE '' END AS detail
  FROM k WHERE "user" IN ('user7', 'user77', 'user107')""")
def audit_trail(spark, sf):
    path = scratch_folder(spark, "audit")
    e = events(spark, sf)
    entries = e.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("action"), F.concat(F.lit("user"), "user_id").alias("user"), "ip",
        F.when(F.col("event_type") == "error", F.create_map(F.lit("bytes"), F.col("bytes").cast("string")))
        .alias("details"))
    audit.append_audit(entries, path)
    trail = audit.read_audit(spark, path)
    shown = audit.audit_for(trail, "user7").unionByName(audit.audit_for(trail, "user77")).unionByName(
        audit.audit_for(trail, "user107"))
    return shown.select("ts", "seq", "action", "user", "ip", F.coalesce(
        F.array_join(F.map_keys("details"), ","), F.lit("")).alias("detail"))


@query("import_results", f"""WITH {EV} SELECT line_no, ts, ts_norm, ip, host, app, msg, {{0}} AS template FROM (
  SELECT event_id AS line_no, CAST(epoch(date_trunc('second', ts)) AS BIGINT)::VARCHAR AS ts, whole AS ts_norm, ip,
  'h' || (user_id % 5) AS host, event_type AS app, CASE WHEN event_id % 2 = 0 THEN 'line ' || event_id
  ELSE 'host=h' || (user_id % 5) || ' sourcetype=' || event_type || ' src_ip=' || ip END AS msg FROM ev)""".replace(
      "{0}", "regexp_replace(regexp_replace(msg, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b', '*', 'g'), '\\b\\d+\\b', '*', 'g')"))
def import_results(spark, sf):
    e = events(spark, sf)
    obj = F.struct(
        F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(".5")).alias("_time"),
        F.lit("x").alias("_raw"), F.concat(F.lit("h"), F.col("user_id") % 5).alias("host"),
        F.col("event_type").alias("sourcetype"), F.col("ip").alias("src_ip"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("line "), "event_id")).alias("line"))
    exported = e.select(F.lit("u").alias("owner"), F.lit("results").alias("dataset"), F.lit("r").alias("file"),
                        F.col("event_id").alias("line_no"), F.to_json(obj).alias("value"))
    return results.rows_from_results(exported, limit=None).select(
        "line_no", "ts", "ts_norm", "ip", "host", "app", "msg", "template")
