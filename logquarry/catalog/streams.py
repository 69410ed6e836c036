"""Streams over files written from `events`, run until all is read."""

from pyspark.sql import functions as F

from logquarry.catalog.base import EV, PARSE, event_lines, query, rows_cte, table
from logquarry.catalog.files import BUCKETS, PER_FILE, bucket_of, form_text, write_buckets
from logquarry.operators import parsers
from logquarry.session import scratch_folder
from logquarry.streaming import bursts, following, landing, live, tail


MOST_FILES = 40


def _landed(spark, sf, form="generic", per_file=PER_FILE):
    return write_buckets(spark, form_text(spark, sf, form), scratch_folder(spark, "landing"), per_file=per_file)


def _events_per_file(spark, sf):
    """2,500, or more where that would make over MOST_FILES files: a micro-batch takes its
    fixed time whatever is in it, so files of one size would make the time of a whole run
    grow with their number. Only where no result names a file."""
    ends = table(spark, sf, "events").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    return PER_FILE if ends["lo"] is None else max(PER_FILE, (ends["hi"] - ends["lo"]) // (MOST_FILES - 1) + 1)


def _numbered_rows(batch):
    lines = landing.number_batch(batch).select(
        F.lit("local").alias("owner"), F.lit("landed").alias("dataset"), "file", "line_no", "value")
    return parsers.parse_generic(lines)


def _run_landing(spark, folder, max_files=16, sketches=False):
    tables = live.LiveTables(spark, scratch_folder(spark, "live"), sketches)
    with landing.few_listing_tasks(spark):
        stream = landing.watch_folder(spark, folder, max_files)
        live.run_available(stream, lambda b, i: tables.write(_numbered_rows(b), i), tables.path + "/checkpoint")
    return tables


LANDED = f"""WITH {EV}, {BUCKETS} SELECT CAST(bucket AS BIGINT) AS bucket, line_no, level, ip, exact AS ts_norm FROM b"""


@query("stream_landing_parse", LANDED)
def stream_landing_parse(spark, sf):
    folder = _landed(spark, sf)
    rows = _run_landing(spark, folder, landing.files_per_batch(spark, folder, 16)).rows()
    return rows.select(bucket_of().alias("bucket"), "line_no", "level", "ip", "ts_norm")


@query("stream_incremental_tops", f"""WITH {EV} (SELECT 'ip' AS kind, ip AS value, count(*) AS n FROM ev GROUP BY ip
  ORDER BY n DESC, value LIMIT 30) UNION ALL (SELECT 'level', level, count(*) FROM ev GROUP BY level)
  UNION ALL SELECT 'distinct', 'ip', count(DISTINCT ip) FROM ev
  UNION ALL SELECT 'minutes', '', count(DISTINCT substr(exact, 1, 16)) FROM ev""")
def stream_incremental_tops(spark, sf):
    tables = _run_landing(spark, _landed(spark, sf, per_file=_events_per_file(spark, sf)), 10)
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "value", "n")
    kpis = tables.kpis()
    return (kind(tables.top("ip", 30), "ip").unionByName(kind(tables.top("level", 30), "level"))
            .unionByName(kpis.filter("field = 'ip'").select(
                F.lit("distinct").alias("kind"), F.col("field").alias("value"), F.col("distinct_values").alias("n")))
            .unionByName(kpis.filter("field = 'minute'").select(
                F.lit("minutes").alias("kind"), F.lit("").alias("value"), F.col("distinct_values").alias("n"))))


@query("stream_sketched_panel", f"""WITH {EV}, top AS (SELECT ip AS value, count(*) AS n FROM ev GROUP BY ip ORDER BY n DESC, value LIMIT 20)
  SELECT 'ip' AS kind, value, n, true AS holds FROM top UNION ALL
  SELECT 'level', level, count(*), true FROM ev GROUP BY level UNION ALL
  SELECT 'distinct', 'ips', count(DISTINCT ip), true FROM ev UNION ALL SELECT 'distinct', 'levels', count(DISTINCT level), true FROM ev""")
def stream_sketched_panel(spark, sf):
    """Tops and distinct counts of a stream from levelled sketches, one batch per landed file;
    `holds`: a top is certain, the exact distinct count lies in the interval."""
    tables = _run_landing(spark, _landed(spark, sf, per_file=_events_per_file(spark, sf)), 1, sketches=True)
    exact = tables.kpis().select(F.element_at(F.create_map(F.lit("ip"), F.lit("ips"), F.lit("level"), F.lit("levels")),
                                              F.col("field")).alias("kpi"), F.col("distinct_values").alias("n"))
    distinct = tables.kpis_sketched().join(exact, "kpi").select(
        F.lit("distinct").alias("kind"), F.col("kpi").alias("value"), "n", F.col("n").between(F.col("low"), F.col("high")).alias("holds"))
    tops = tables.top_sketched(20).filter("field IN ('ip', 'level')")
    return tops.select(F.col("field").alias("kind"), "value", "n", F.col("certain").alias("holds")).unionByName(distinct)


def _write_files(spark, text, folder):
    """Each bucket's lines (bucket, event_id, value) as the whole content of its file, put in
    place at once: a task that runs again leaves the same file."""
    def write(part):
        import uuid

        import pandas as pd

        from logquarry.streaming.tail import resolve
        filesystem, path = resolve(f"{folder}/{part['bucket'].iloc[0]:06d}.log")
        filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
        unfinished = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        with filesystem.open_output_stream(unfinished) as f:
            f.write("".join(v + "\n" for v in part.sort_values("event_id")["value"]).encode())
        filesystem.move(unfinished, path)
        return pd.DataFrame({"n": [len(part)]})
    text.groupBy("bucket").applyInPandas(write, "n long").agg(F.sum("n")).collect()


def _bucketed(spark, sf):
    return form_text(spark, sf).withColumn("bucket", F.expr(f"event_id div {PER_FILE}"))


def _tail_once(spark, folder, tables):
    stream = live.parse_stream(tail.follow(spark, folder, "grown", statePath=tables.path + "/state.json",
                                           maxPartitionBytes="65536"), "generic")
    live.run_available(stream, tables.write, tables.path + "/checkpoint")


@query("stream_tail_append", f"""WITH {EV} SELECT CAST(event_id // {PER_FILE} AS BIGINT) AS bucket, level, ip, exact AS ts_norm FROM ev""")
def stream_tail_append(spark, sf):
    """Files with their first half, then grown to all of it; each line once."""
    folder, tables = scratch_folder(spark, "tail"), live.LiveTables(spark, scratch_folder(spark, "live"))
    for keep in (F.col("event_id") % PER_FILE < PER_FILE / 2, F.lit(True)):
        _write_files(spark, _bucketed(spark, sf).filter(keep), folder)
        _tail_once(spark, folder, tables)
    bucket = F.regexp_extract("file", r"(\d{6})\.log", 1).cast("bigint")
    return tables.rows().select(bucket.alias("bucket"), "level", "ip", "ts_norm")


@query("stream_tail_truncate", f"""WITH {EV} SELECT CAST(event_id // {PER_FILE} AS BIGINT) AS bucket, 0 AS generation, ip FROM ev
  UNION ALL SELECT CAST(event_id // {PER_FILE} AS BIGINT), 1, ip FROM ev WHERE event_type = 'error'""")
def stream_tail_truncate(spark, sf):
    """The files are replaced by shorter ones, which are read anew as generation 1."""
    folder, tables = scratch_folder(spark, "tail"), live.LiveTables(spark, scratch_folder(spark, "live"))
    for keep in (F.lit(True), F.col("value").contains(" error from ")):
        _write_files(spark, _bucketed(spark, sf).filter(keep), folder)
        _tail_once(spark, folder, tables)
    bucket = F.regexp_extract("file", r"(\d{6})\.log", 1).cast("bigint")
    generation = F.when(F.col("file").contains("#1"), 1).otherwise(0)
    return tables.rows().select(bucket.alias("bucket"), generation.alias("generation"), "ip")


def _two_forms(spark, sf):
    """bucket, event_id, value: of every 2,500 events, the even ones as a W3C file whose second
    half renames a column, the odd ones as a plain one."""
    even = F.col("event_id") % 2 == 0
    plain, w3c = (event_lines(spark, sf, f).select(F.col("line_no").alias("event_id"), "value") for f in ("generic", "w3c"))
    at = F.col("event_id") % PER_FILE
    head = (F.when(at == 0, "#Fields: date time c-ip x cs-uri-stem sc-status sc-bytes\n")
            .when(at == PER_FILE // 2, "#Fields: date time c-ip x cs-uri-stem cs-method sc-bytes\n").otherwise(""))
    both = w3c.filter(even).withColumn("value", F.concat(head, "value")).unionByName(plain.filter(~even))
    return both.select((F.expr(f"event_id div {PER_FILE}") * 2 + F.col("event_id") % 2).alias("bucket"), "event_id", "value")


@query("stream_follow_formats", f"""WITH {EV}, f AS (SELECT *, CAST(event_id // {PER_FILE} * 2 + event_id % 2 AS BIGINT) AS bucket,
    event_id % 2 = 0 AS w3c, event_id % {PER_FILE} >= {PER_FILE // 2} AS later FROM ev)
  SELECT bucket, CASE WHEN w3c THEN 'w3c' ELSE 'generic' END AS format, ip,
  row_number() OVER (PARTITION BY bucket ORDER BY event_id) - 1 + CASE WHEN NOT w3c THEN 0 WHEN later THEN 2 ELSE 1 END AS line_no,
  CASE WHEN w3c AND NOT later THEN code ELSE '' END AS code, CASE WHEN w3c AND later THEN code ELSE '' END AS method,
  CASE WHEN w3c THEN '' ELSE level END AS level FROM f""")
def stream_follow_formats(spark, sf):
    """Files of two formats followed by one stream, stopped half-way and started again."""
    folder, tables = scratch_folder(spark, "follow"), live.LiveTables(spark, scratch_folder(spark, "live"))
    text = _two_forms(spark, sf)
    for keep in (F.col("event_id") % PER_FILE < PER_FILE // 2, F.lit(True)):
        _write_files(spark, text.filter(keep), folder)
        lines = tail.follow(spark, folder, "grown", statePath=tables.path + "/state.json", maxPartitionBytes="65536")
        live.run_available(following.follow_rows(lines, formats=["w3c", "generic"]), tables.write, tables.path + "/checkpoint")
    bucket = F.regexp_extract("file", r"(\d{6})\.log", 1).cast("bigint")
    return tables.rows().select(bucket.alias("bucket"), "format", "ip", "line_no", "code", "method", "level")


def _row_stream(spark, sf, form="generic", twice=False):
    """Parsed rows, stored and streamed back as Parquet files."""
    path = scratch_folder(spark, "rows")
    rows = PARSE[form](event_lines(spark, sf, form))
    for _ in range(1 + twice):
        rows.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _to_table(spark, stream, mode="append"):
    """Run a stream into a table of its own and give that table."""
    path = scratch_folder(spark, "out")
    if mode == "append":
        query = (stream.writeStream.format("parquet").option("path", path).outputMode("append")
                 .option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start())
    else:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", path + "-checkpoint")
                 .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(path))
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(path)


def _stamp(c="start"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm").alias("t")


@query("stream_histogram_complete", f"WITH {EV} SELECT substr(exact, 1, 13) || ':00' AS t, level, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_histogram_complete(spark, sf):
    counts = live.window_counts(_row_stream(spark, sf), "1 hour", by=("level",))
    return _to_table(spark, counts, "complete").select(_stamp(), "level", "n")


@query("stream_histogram_watermark", f"""WITH {EV} SELECT t, n FROM (SELECT date_trunc('hour', ts) AS w,
  substr(min(exact), 1, 13) || ':00' AS t, count(*) AS n FROM ev GROUP BY 1)
  WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE""")
def stream_histogram_watermark(spark, sf):
    """Closed windows only: the last one waits for its delay to pass."""
    counts = live.window_counts(_row_stream(spark, sf), "1 hour", delay="10 minutes")
    return _to_table(spark, counts).select(_stamp(), "n")


@query("stream_error_rate", f"""WITH {EV}, w AS (SELECT date_trunc('hour', ts) - s * INTERVAL 1 HOUR AS st, level
    FROM ev, (VALUES (0), (1)) v(s))
  SELECT strftime(st, '%Y-%m-%dT%H:%M') AS t, count(*) AS total, count(*) FILTER (WHERE level IN ('ERR', 'CRIT')) AS errors,
  count(*) FILTER (WHERE level IN ('ERR', 'CRIT')) / count(*) AS rate FROM w GROUP BY st""")
def stream_error_rate(spark, sf):
    rate = live.error_rate(_row_stream(spark, sf), "2 hours", "1 hour")
    return _to_table(spark, rate, "complete").select(_stamp(), "total", "errors", "rate")


# Twelve copies of every event of one hour in a hundred, by the hour's number.
BURSTS = f"""WITH RECURSIVE {EV}, c AS (SELECT owner, date_trunc('hour', ts) AS st,
    CAST(sum(CASE WHEN epoch(date_trunc('hour', ts)) // 3600 % 100 = 57 THEN 12 ELSE 1 END) AS BIGINT) AS n FROM ev GROUP BY 1, 2),
  k AS (SELECT owner, min(st) AS lo, max(st) AS hi FROM c {{closed}} GROUP BY owner),
  h AS (SELECT owner, st, row_number() OVER (PARTITION BY owner ORDER BY st) AS i, coalesce(n, 0) AS n FROM
    (SELECT owner, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS st FROM k) LEFT JOIN c USING (owner, st)),
  w AS (SELECT owner, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS st, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS mean,
    0.0::DOUBLE AS cusum, 0.0::DOUBLE AS score, false AS burst FROM k
    UNION ALL SELECT owner, i, st, n, CASE WHEN i <= 8 THEN mean + (n - mean) / i WHEN s > 8 THEN mean ELSE mean + 0.05::DOUBLE * (n - mean) END,
      CASE WHEN s > 8 THEN 0.0::DOUBLE ELSE s END, s, s > 8 FROM (SELECT w.owner, h.i, h.st, h.n, w.mean,
        CASE WHEN h.i <= 8 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, w.cusum + (h.n - w.mean) / sqrt(greatest(w.mean, 1.0::DOUBLE)) - 0.5::DOUBLE) END AS s
      FROM w JOIN h ON h.owner = w.owner AND h.i = w.i + 1))
  SELECT owner, strftime(st, '%Y-%m-%dT%H:%M') AS t, n, round(score, 6) AS score FROM w WHERE burst"""
CLOSED = "WHERE st + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE"


def _with_bursts(rows):
    hour = F.expr("unix_seconds(date_trunc('HOUR', event_time)) div 3600 % 100")
    return rows.select("owner", "event_time", F.explode(F.array_repeat(F.lit(1), F.when(hour == 57, 12).otherwise(1))).alias("_")).drop("_")


def _shown_bursts(found):
    return found.select("owner", _stamp(), "n", F.round("score", 6).alias("score"))


@query("bursts", BURSTS.format(closed=""))
def bursts_of_rows(spark, sf):
    """Hours whose counts rise against the owner's baseline."""
    rows = PARSE["generic"](event_lines(spark, sf, "generic"))
    return _shown_bursts(bursts.find_bursts(_with_bursts(rows), "1 hour", ("owner",)))


@query("stream_bursts", BURSTS.format(closed=CLOSED))
def stream_bursts(spark, sf):
    """The same as the windows of a stream close."""
    rows = _with_bursts(_row_stream(spark, sf))
    return _shown_bursts(_to_table(spark, bursts.stream_bursts(rows, "1 hour", "10 minutes", ("owner",))))


@query("stream_dedup", f"WITH {rows_cte('generic')} SELECT line_no, ip, level FROM r")
def stream_dedup(spark, sf):
    """Lines delivered twice, over two runs on one checkpoint, each kept once. Some have no
    time; those of one kind come in the second run only, long after younger ones."""
    source, out = scratch_folder(spark, "rows"), scratch_folder(spark, "out")
    rows = PARSE["generic"](event_lines(spark, sf, "generic")).withColumn(
        "event_time", F.when(F.col("level") != "WRN", F.col("event_time")))
    for part in (rows.filter("level <> 'ERR'"), rows):
        part.write.mode("append").parquet(source)
        kept = live.without_replays(spark.readStream.schema(rows.schema).parquet(source), "1 hour")
        (kept.select("line_no", "ip", "level").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)
