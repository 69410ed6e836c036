"""Registry, and the log lines derived from the given tables.

Every query reads whole tables. `events` rows become log lines in five formats,
`documents` and `conversations` are split at newlines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators import parsers
from logquarry.session import configure, spread, tasks_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SPREAD: dict[tuple[str, str], int | None] = {}     # per application and table


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path)
    key = (spark.sparkContext.applicationId, path)
    if key not in SPREAD:
        SPREAD[key] = tasks_for(found)
    return spread(found, SPREAD[key]) if SPREAD[key] else found


# --- derived lines, Spark side ---------------------------------------------

LEVEL_WORD = {"error": "ERROR", "purchase": "WARN", "signup": "INFO", "click": "DEBUG"}
STATUS = {"error": "500", "purchase": "301", "signup": "201", "click": "200"}
FORMS = ("generic", "apache", "w3c", "syslog", "json")


def _pick(column: str, choices: dict[str, str], other: str):
    out = None
    for k, v in choices.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out.otherwise(other)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event columns plus the parts every log form is made of."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type",
        _pick("event_type", LEVEL_WORD, "info").alias("lvl"),
        _pick("event_type", STATUS, "404").alias("code"),
        F.concat_ws(".", F.lit("10"), F.col("user_id") % 4, F.col("user_id") % 7,
                    F.col("event_id") % 250).alias("ip"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bytes"))


def line_text(form: str):
    day, time = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    fine = F.date_format("ts", "HH:mm:ss.SSSSSS")
    c = F.col
    return {
        "generic": lambda: F.concat_ws(
            " ", day, fine, c("lvl"), F.lit("user"), c("user_id"), c("event_type"), F.lit("from"),
            c("ip"), F.lit("took"), c("bytes")),
        "apache": lambda: F.concat(
            c("ip"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
            F.lit(' +0000] "GET /api/'), c("event_type"), F.lit("/"), c("user_id"),
            F.lit(' HTTP/1.1" '), c("code"), F.lit(" "), c("bytes")),
        "w3c": lambda: F.concat_ws(
            " ", day, time, c("ip"), F.lit("GET"),
            F.concat(F.lit("/api/"), c("event_type"), F.lit("/"), c("user_id")), c("code"), c("bytes")),
        "syslog": lambda: F.concat(
            F.lit("<34>1 "), day, F.lit("T"), fine, F.lit("Z host"), c("user_id") % 5, F.lit(" "),
            c("event_type"), F.lit("["), c("user_id"), F.lit("]: from "), c("ip"), F.lit(" took "),
            c("bytes")),
        "json": lambda: F.concat(
            F.lit('{"ts": "'), day, F.lit("T"), fine, F.lit('", "level": "'), c("lvl"),
            F.lit('", "ip": "'), c("ip"), F.lit('", "msg": "'), c("event_type"), F.lit(" by "),
            c("user_id"), F.lit('"}')),
    }[form]()


def event_lines(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id") % 3).alias("owner"), F.lit(form).alias("dataset"),
        F.lit(f"{form}.log").alias("file"), F.col("event_id").alias("line_no"),
        line_text(form).alias("value"))


PARSE = {"generic": parsers.parse_generic, "apache": parsers.parse_clf, "json": parsers.parse_jsonl,
         "syslog": parsers.parse_syslog}
W3C_COLUMNS = ["date", "time", "c-ip", "cs-method", "cs-uri-stem", "sc-status", "sc-bytes"]


def event_rows(spark: SparkSession, sf_dir: str, form: str = "generic") -> DataFrame:
    lines = event_lines(spark, sf_dir, form)
    return parsers.parse_w3c(lines, W3C_COLUMNS) if form == "w3c" else PARSE[form](lines)


def text_lines(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Lines of a text table; `file` names the document or the turn."""
    t = table(spark, sf_dir, name)
    key = (F.col("doc_id").cast("string") if name == "documents"
           else F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return (t.select(key.alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
            .select(F.lit("local").alias("owner"), F.lit(name).alias("dataset"), "file",
                    F.col("line_no").cast("bigint").alias("line_no"), "value"))


def marked_w3c_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3C lines of each day as a file of its own, with three header lines on top."""
    body = event_lines(spark, sf_dir, "w3c").withColumn("file", F.concat(F.substring("value", 1, 10), F.lit(".log")))
    first = body.groupBy("file").agg(F.min("line_no").alias("_first"))
    heads = first.select("file", F.posexplode(F.array(
        F.lit("#Software: probe"), F.lit("#Version: 1.0"),
        F.lit("#Fields: " + " ".join(W3C_COLUMNS)))).alias("_i", "value"))
    heads = heads.select(F.lit("u0").alias("owner"), F.lit("w3c").alias("dataset"), "file",
                         (F.col("_i") - 3).cast("bigint").alias("line_no"), "value")
    return body.unionByName(heads)


# --- the same in SQL -------------------------------------------------------

EV = """
ev AS (SELECT event_id, ts, user_id, event_type,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO'
    WHEN 'click' THEN 'DEBUG' ELSE 'info' END AS lvl,
  CASE event_type WHEN 'error' THEN 'ERR' WHEN 'purchase' THEN 'WRN' WHEN 'signup' THEN 'INF'
    WHEN 'click' THEN 'DBG' ELSE 'INF' END AS level,
  CASE event_type WHEN 'error' THEN '500' WHEN 'purchase' THEN '301' WHEN 'signup' THEN '201'
    WHEN 'click' THEN '200' ELSE '404' END AS code,
  '10.' || (user_id % 4) || '.' || (user_id % 7) || '.' || (event_id % 250) AS ip,
  CAST(floor(value * 100) AS BIGINT) AS bytes,
  strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS tm, strftime(ts, '%H:%M:%S.%f') AS fine,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS whole,
  CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS exact,
  '/api/' || event_type || '/' || user_id AS path,
  'u' || (user_id % 3) AS owner
  FROM events)"""

TEXT = {
    "generic": "day || ' ' || fine || ' ' || lvl || ' user ' || user_id || ' ' || event_type || ' from '"
               " || ip || ' took ' || bytes",
    "apache": "ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] \"GET ' || path"
              " || ' HTTP/1.1\" ' || code || ' ' || bytes",
    "w3c": "day || ' ' || tm || ' ' || ip || ' GET ' || path || ' ' || code || ' ' || bytes",
    "syslog": "'<34>1 ' || day || 'T' || fine || 'Z host' || (user_id % 5) || ' ' || event_type || '['"
              " || user_id || ']: from ' || ip || ' took ' || bytes",
    "json": "'{\"ts\": \"' || day || 'T' || fine || '\", \"level\": \"' || lvl || '\", \"ip\": \"' || ip"
            " || '\", \"msg\": \"' || event_type || ' by ' || user_id || '\"}'",
}

# What each form's parse must give, straight from the event columns.
FIELDS = {
    "generic": dict(ts="day || ' ' || fine", ts_norm="exact", level="level", ip="ip",
                    msg="'user ' || user_id || ' ' || event_type || ' from ' || ip || ' took ' || bytes"),
    "apache": dict(ts="strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000'", ts_norm="whole", ip="ip",
                   method="'GET'", path="path", code="code", bytes="CAST(bytes AS VARCHAR)",
                   msg="'GET ' || path"),
    "w3c": dict(ts="day || ' ' || tm", ts_norm="whole", ip="ip", method="'GET'", path="path",
                code="code", bytes="CAST(bytes AS VARCHAR)", msg="'GET ' || path"),
    "syslog": dict(ts="day || 'T' || fine || 'Z'", ts_norm="exact", ip="ip",
                   host="'host' || (user_id % 5)", app="event_type", pid="CAST(user_id AS VARCHAR)",
                   msg="'from ' || ip || ' took ' || bytes"),
    "json": dict(ts="day || 'T' || fine", ts_norm="exact", level="level", ip="ip",
                 msg="event_type || ' by ' || user_id"),
}
ROW_TEXT = ("ts", "level", "ip", "host", "app", "pid", "method", "path", "code", "bytes", "msg")


def template_sql(x: str) -> str:
    for pattern in (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b[0-9a-fA-F]{8,}\b", r"\b\d+\b"):
        x = f"regexp_replace({x}, '{pattern}', '*', 'g')"
    return x


def rows_cte(form: str, name: str = "r") -> str:
    """CTEs `ev` and `r`: r has the parsed row of each event plus its raw line."""
    have = FIELDS[form]
    columns = ", ".join(f"{have.get(f, chr(39) * 2)} AS {f}" for f in (*ROW_TEXT, "ts_norm"))
    search = " || ' ' || ".join(f"p.{f}" for f in ROW_TEXT)
    return f"""{EV},
{name} AS (SELECT p.*, lower({search}) AS search, {template_sql('p.raw')} AS template FROM (
  SELECT owner, '{form}' AS dataset, '{form}.log' AS file, event_id AS line_no, '{form}' AS format,
    user_id, event_type, event_id, {TEXT[form]} AS raw, {columns}
  FROM ev) p)"""


def lines_cte(name: str = "documents") -> str:
    key = ("CAST(doc_id AS VARCHAR)" if name == "documents"
           else "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)")
    return f"""ln AS (SELECT file, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS value FROM (
  SELECT {key} AS file, string_split(text, chr(10)) AS parts,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {name}))"""
