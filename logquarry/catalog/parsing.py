"""Parsing, detection and quality."""

from pyspark.sql import functions as F

from logquarry.catalog.base import (EV, FORMS, TEXT, W3C_COLUMNS, event_lines, event_rows,
                                    lines_cte, marked_w3c_lines, query, rows_cte, text_lines)
from logquarry.operators import parsers
from logquarry.operators.detect import detect_format
from logquarry.session import settle

SHOWN = ("line_no", "ts", "ts_norm", "level", "ip", "host", "app", "pid", "method", "path",
         "code", "bytes", "msg", "raw", "template")


def _register(form: str) -> None:
    name = {"apache": "parse_clf", "json": "parse_jsonl"}.get(form, f"parse_{form}")

    @query(name, f"WITH {rows_cte(form)} SELECT {', '.join(SHOWN)} FROM r")
    def run(spark, sf):
        return event_rows(spark, sf, form).select(*SHOWN)


for _form in FORMS:
    _register(_form)


@query("parse_raw", f"WITH {lines_cte()} SELECT file, line_no, 'RAW' AS level, value AS msg FROM ln")
def parse_raw(spark, sf):
    return parsers.parse_raw(text_lines(spark, sf)).select("file", "line_no", "level", "msg")


@query("parse_generic_text", f"""WITH {lines_cte()} SELECT file, line_no, 'RAW' AS level,
  regexp_extract(value, '(\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}})', 1) AS ip FROM ln""")
def parse_generic_text(spark, sf):
    """Free text through the levelled parser: nothing is refused, ips are still found."""
    return parsers.parse_generic(text_lines(spark, sf)).select("file", "line_no", "level", "ip")


# Access-log lines damaged in three ways, by event id.
@query("parse_clf_variants", f"""WITH {EV} SELECT event_id AS line_no,
  CASE event_id % 4 WHEN 0 THEN 'strict' WHEN 3 THEN 'open_quote' ELSE 'loose' END AS variant,
  ip, path, CASE WHEN event_id % 4 = 2 THEN '' ELSE code END AS code,
  CASE WHEN event_id % 4 = 2 THEN '' ELSE CAST(bytes AS VARCHAR) END AS bytes, whole AS ts_norm FROM ev""")
def parse_clf_variants(spark, sf):
    good = event_lines(spark, sf, "apache")
    v, kind = F.col("value"), F.col("line_no") % 4
    broken = (F.when(kind == 0, v).when(kind == 1, F.replace(v, F.lit(" HTTP/1.1"), F.lit("")))
              .when(kind == 2, F.regexp_replace(F.replace(v, F.lit(" - - "), F.lit(" - ")), r' HTTP/1.1".*$', '"'))
              .otherwise(F.replace(v, F.lit(' HTTP/1.1"'), F.lit(""))))
    lines = good.withColumn("value", broken)
    variant = parsers.clf_variant(parsers.CLF.capture(F.col("raw")))
    return parsers.parse_clf(lines).select("line_no", variant.alias("variant"), "ip", "path", "code",
                                           "bytes", "ts_norm")


def mixed_lines(spark, sf):
    """Five files, one per form; the W3C one starts with its header."""
    out = None
    for form in FORMS:
        lines = event_lines(spark, sf, form)
        out = lines if out is None else out.unionByName(lines)
    header = spark.createDataFrame(
        [("u0", "w3c", "w3c.log", -1, "#Fields: " + " ".join(W3C_COLUMNS))],
        "owner string, dataset string, file string, line_no long, value string")
    docs = text_lines(spark, sf).withColumn("file", F.concat(F.lit("doc/"), "file"))
    return out.unionByName(header).unionByName(docs).withColumn("line_no", F.col("line_no") + 1)


def mixed_detected(spark, sf):
    lines = mixed_lines(spark, sf)
    return lines, settle(detect_format(lines))


DOC_FILES = "SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS file, 'raw' AS format FROM documents WHERE regexp_matches(text, '\\S')"
FORM_FILES = " UNION ALL ".join(f"SELECT '{f}.log' AS file, '{f}' AS format" for f in FORMS)


@query("detect_format", f"{FORM_FILES} UNION ALL {DOC_FILES}")
def detect(spark, sf):
    return mixed_detected(spark, sf)[1].select("file", "format")



@query("parse_auto", f"""WITH {EV}, {lines_cte()}, al AS (
  SELECT file, level, ip, event_id FROM (
    SELECT 'generic.log' AS file, level, ip, event_id FROM ev UNION ALL
    SELECT 'json.log', level, ip, event_id FROM ev UNION ALL
    SELECT 'syslog.log', '', ip, event_id FROM ev UNION ALL
    SELECT 'w3c.log', '', ip, event_id FROM ev UNION ALL
    SELECT 'apache.log', '', ip, event_id FROM ev))
  SELECT file, event_id + 1 AS line_no, level, ip FROM al UNION ALL
  SELECT 'doc/' || file, line_no + 1, 'RAW', '' FROM ln""")
def parse_auto(spark, sf):
    lines, found = mixed_detected(spark, sf)
    return parsers.parse_auto(lines, found).select("file", "line_no", "level", "ip")


# Damaged JSON: every seventh event's line loses its end.
@query("parse_quality", f"""WITH {EV} SELECT owner, 'json' AS dataset, 'json.log' AS file, 'json' AS format,
  count(*) AS total, count(*) FILTER (WHERE event_id % 7 <> 0) AS parsed,
  count(*) FILTER (WHERE event_id % 7 = 0) AS rejected FROM ev GROUP BY owner""")
def parse_quality(spark, sf):
    return parsers.parse_quality(_damaged(spark, sf))


@query("parse_rejects", f"""WITH {EV} SELECT owner, 'json' AS dataset, 'json.log' AS file, event_id AS line_no,
  'json' AS format, {TEXT['json']} || '}}' AS value, 'no_match' AS reason FROM ev WHERE event_id % 7 = 0""")
def parse_rejects(spark, sf):
    return parsers.reject_rows(_damaged(spark, sf))


def _damaged(spark, sf):
    lines = event_lines(spark, sf, "json")
    bad = F.when(F.col("line_no") % 7 == 0, F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    return parsers.tag_lines(lines.withColumn("value", bad).withColumn("format", F.lit("json")), ["json"])


@query("w3c_header", f"""WITH {EV} SELECT DISTINCT day || '.log' AS file,
  '{",".join(W3C_COLUMNS)}' AS columns FROM ev""")
def w3c_header(spark, sf):
    found = parsers.w3c_header(marked_w3c_lines(spark, sf))
    return found.select("file", F.array_join("w3c_fields", ",").alias("columns"))


@query("parse_w3c_headers", f"WITH {EV} SELECT day || '.log' AS file, event_id AS line_no, ip, path, code,"
       " whole AS ts_norm FROM ev")
def parse_w3c_headers(spark, sf):
    """Columns taken from each file's own header."""
    return parsers.parse_w3c(marked_w3c_lines(spark, sf)).select(
        "file", "line_no", "ip", "path", "code", "ts_norm")


@query("w3c_repeated_header", f"""WITH {EV} SELECT event_id AS line_no,
  CASE WHEN event_id < 5000 THEN code ELSE '' END AS code,
  CASE WHEN event_id < 5000 THEN '' ELSE code END AS method FROM ev""")
def w3c_repeated_header(spark, sf):
    """A second header half-way renames a column; later lines follow it."""
    lines = event_lines(spark, sf, "w3c").withColumn("line_no", F.col("line_no") * 2 + 1)
    first = "#Fields: date time c-ip x cs-uri-stem sc-status sc-bytes"
    later = "#Fields: date time c-ip x cs-uri-stem cs-method sc-bytes"
    heads = spark.createDataFrame([("w3c.log", 0, first), ("w3c.log", 10000, later)],
                                  "file string, line_no long, value string")
    both = lines.unionByName(heads.select(
        F.lit("u0").alias("owner"), F.lit("w3c").alias("dataset"), "file", "line_no", "value"))
    rows = parsers.parse_w3c(both, repeated_headers=True)
    return rows.select(F.expr("(line_no - 1) div 2").alias("line_no"), "code", "method")
