"""Counts, tops, KPIs, histograms and template clusters."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.catalog.base import (event_rows, lines_cte, query, rows_cte, template_sql,
                                    text_lines)
from logquarry.operators import rollups, sketches
from logquarry.operators.filters import FilterSpec
from logquarry.operators.parsers import parse_raw
from logquarry.session import scratch_folder

G, A = f"WITH {rows_cte('generic')}", f"WITH {rows_cte('apache')}"
TEMPLATES = """SELECT template, count(*) AS n, min(ts_norm) AS first, max(ts_norm) AS last,
  arg_min(raw, line_no) AS example FROM r {where} GROUP BY template {having}
  ORDER BY n DESC, first, template LIMIT 200"""


@query("templates_by_level", f"{G} " + TEMPLATES.format(where="WHERE level = 'ERR'", having=""))
def templates_by_level(spark, sf):
    return rollups.templates(event_rows(spark, sf), level="ERR")


@query("templates_all", f"{G} " + TEMPLATES.format(where="", having=""))
def templates_all(spark, sf):
    return rollups.templates(event_rows(spark, sf))


@query("templates_min_count", f"WITH {rows_cte('json')} " + TEMPLATES.format(where="", having="HAVING count(*) >= 5"))
def templates_min_count(spark, sf):
    return rollups.templates(event_rows(spark, sf, "json"), min_count=5)


@query("doc_line_templates", f"""WITH {lines_cte()}, r AS (SELECT file, line_no,
    value AS raw FROM ln)
  SELECT template, count(*) AS n, arg_min(raw, file || chr(1) || lpad(CAST(line_no AS VARCHAR), 12, '0')) AS example
  FROM (SELECT *, {template_sql('raw')} AS template FROM r) WHERE template <> '' GROUP BY template""")
def doc_line_templates(spark, sf):
    """All clusters of document lines, no limit."""
    return rollups.templates(parse_raw(text_lines(spark, sf)), limit=None).select("template", "n", "example")


@query("total_rows", f"{G} SELECT count(*) AS n FROM r")
def total_rows(spark, sf):
    return rollups.total_rows(event_rows(spark, sf))


@query("top_values", f"""{A} SELECT path AS value, count(*) AS n FROM r WHERE path <> '' GROUP BY path
  ORDER BY n DESC, value LIMIT 40""")
def top_values(spark, sf):
    return rollups.top_values(event_rows(spark, sf, "apache"), "path", 40)


def _top_sql(field: str, limit: int) -> str:
    return f"""(SELECT '{field}' AS field, CAST(row_number() OVER (ORDER BY count(*) DESC, {field}) AS INTEGER) AS rank,
  {field} AS value, count(*) AS n FROM r WHERE {field} <> '' GROUP BY {field}
  ORDER BY n DESC, value LIMIT {limit})"""


@query("top_many", f"WITH {rows_cte('syslog')} " + " UNION ALL ".join(
    _top_sql(f, n) for f, n in (("level", 100), ("ip", 30), ("host", 30), ("app", 30))))
def top_many(spark, sf):
    return rollups.dashboard_tops(event_rows(spark, sf, "syslog"), "syslog")


@query("level_facet", f"""{G} SELECT level, count(*) AS n,
  CAST(list_position(['INF', 'WRN', 'ERR', 'CRIT', 'DBG', 'RAW'], level) AS INTEGER) AS rank FROM r GROUP BY level""")
def level_facet(spark, sf):
    return rollups.level_facet(event_rows(spark, sf))


@query("kpi_distinct", f"""{A} SELECT count(DISTINCT ip) AS ips, count(DISTINCT path) AS paths,
  count(DISTINCT code) AS codes, CAST(0 AS BIGINT) AS levels FROM r""")
def kpi_distinct(spark, sf):
    return rollups.kpis(event_rows(spark, sf, "apache"))


BOTH = (f"WITH {rows_cte('generic', 'r1')}, " + rows_cte("apache", "r2").split("FROM events),", 1)[1]
        + ", r AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)")


def _in_parts(spark, rows, sketch):
    """Sketches of four parts of the rows, stored part by part and read back."""
    path = scratch_folder(spark, "sketches")
    for part in range(4):
        sketch(rows.filter(F.col("line_no") % 4 == part)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("kpi_approx", f"""{A} SELECT kpi, exact, true AS within, CAST({sketches.distinct_error()!r} AS DOUBLE) AS error FROM (
  SELECT 'ips' AS kpi, count(DISTINCT ip) AS exact FROM r UNION ALL SELECT 'paths', count(DISTINCT path) FROM r
  UNION ALL SELECT 'codes', count(DISTINCT code) FROM r)""")
def kpi_approx(spark, sf):
    """Distinct counts from merged sketches, and whether the exact one, counted beside them,
    lies in the interval they state."""
    rows = event_rows(spark, sf, "apache")
    merged = sketches.merge_distinct(_in_parts(spark, rows, sketches.distinct_sketches))
    exact = rollups.kpis(rows).unpivot([], list(rollups.KPI_COLUMNS), "kpi", "exact")
    return sketches.distinct_estimates(merged).join(exact, "kpi").select(
        "kpi", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("within"),
        F.lit(sketches.distinct_error()).alias("error"))


@query("kpi_sketch_by_dataset", f"""{BOTH} SELECT owner, dataset, kpi, exact, true AS within FROM (
  SELECT owner, dataset, unnest(['ips', 'paths', 'codes', 'levels']) AS kpi, unnest([count(DISTINCT nullif(ip, '')),
    count(DISTINCT nullif(path, '')), count(DISTINCT CASE WHEN code NOT IN ('', '-') THEN code END),
    count(DISTINCT nullif(level, ''))]) AS exact FROM r GROUP BY owner, dataset) WHERE exact > 0""")
def kpi_sketch_by_dataset(spark, sf):
    """The same per dataset."""
    rows, by = both_rows(spark, sf), ["owner", "dataset"]
    parts = _in_parts(spark, rows, lambda part: sketches.distinct_sketches(part, by))
    exact = rollups.kpis(rows, by).unpivot(by, list(rollups.KPI_COLUMNS), "kpi", "exact")
    return sketches.distinct_estimates(sketches.merge_distinct(parts, by)).join(exact, [*by, "kpi"]).select(
        *by, "kpi", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("within"))


@query("top_sketched", f"{A} SELECT *, CAST(0 AS BIGINT) AS error, true AS certain FROM (" + " UNION ALL ".join(
    _top_sql(f, 30) for f in ("ip", "path", "code")) + ")")
def top_sketched(spark, sf):
    """Tops from merged sketches: exact here, as no sketch had to give up a value."""
    fields = ["ip", "path", "code", "level"]
    parts = _in_parts(spark, event_rows(spark, sf, "apache"), lambda part: sketches.top_sketches(part, fields))
    return sketches.top_estimates(sketches.merge_tops(parts), 30)


def _histogram(name: str, gran: str, width: int) -> None:
    @query(name, f"{G} SELECT substr(ts_norm, 1, {width}) AS t, count(*) AS n FROM r GROUP BY 1")
    def run(spark, sf):
        return rollups.histogram(event_rows(spark, sf), gran=gran)


_histogram("histogram_minute", "min", 16)
_histogram("histogram_hour", "hour", 13)


@query("histogram_filtered", f"{G} SELECT substr(ts_norm, 1, 13) AS t, count(*) AS n FROM r WHERE level = 'ERR' GROUP BY 1")
def histogram_filtered(spark, sf):
    return rollups.histogram(event_rows(spark, sf), FilterSpec(level="ERR"), "hour")


@query("histogram_total", f"{G} SELECT count(*) AS total FROM r WHERE level = 'ERR'")
def histogram_total(spark, sf):
    return rollups.histogram_total(rollups.histogram(event_rows(spark, sf), FilterSpec(level="ERR")))


@query("histogram_zero_fill", f"""{G}, h AS (SELECT date_trunc('hour', CAST(ts_norm AS TIMESTAMP)) AS hr, count(*) AS n
  FROM r WHERE level = 'ERR' GROUP BY 1)
  SELECT strftime(s.hr, '%Y-%m-%dT%H') AS t, coalesce(h.n, 0) AS n FROM (SELECT unnest(generate_series(
    (SELECT min(hr) FROM h), (SELECT max(hr) FROM h), INTERVAL 1 HOUR)) AS hr) s LEFT JOIN h ON h.hr = s.hr""")
def histogram_zero_fill(spark, sf):
    return rollups.fill_gaps(rollups.histogram(event_rows(spark, sf), FilterSpec(level="ERR"), "hour"), "hour")


@query("merge_partials", f"{G} SELECT level, ip, count(*) AS n FROM r GROUP BY level, ip")
def merge_partials(spark, sf):
    rows = event_rows(spark, sf)
    slices = [rows.filter(F.col("line_no") % 4 == i).groupBy("level", "ip").agg(F.count("*").alias("n"))
              for i in range(4)]
    return rollups.merge_counts(reduce(DataFrame.unionByName, slices), ["level", "ip"])


def manifest(rows: DataFrame) -> DataFrame:
    """A file manifest as a load would leave it."""
    return rows.groupBy("owner", "dataset", "file").agg(
        F.min("format").alias("format"), F.sum(F.octet_length("raw") + 1).alias("size"),
        F.count("*").alias("total")).withColumns(
        {"encoding": F.lit("utf-8"), "compressed": F.lit("")})


def both_rows(spark, sf):
    return event_rows(spark, sf).unionByName(event_rows(spark, sf, "apache"))


@query("dataset_list", f"""{BOTH} SELECT owner, dataset, min(format) AS format,
  CAST(sum(strlen(raw) + 1) AS BIGINT) AS size, count(*) AS total, 'utf-8' AS encoding, '' AS compressed
  FROM r GROUP BY owner, dataset""")
def dataset_list(spark, sf):
    return rollups.dataset_list(manifest(both_rows(spark, sf)))


@query("dataset_summary", f"""{BOTH} SELECT owner, dataset, min(format) AS format,
  CAST(sum(strlen(raw) + 1) AS BIGINT) AS size, count(*) AS total, 'utf-8' AS encoding, '' AS compressed,
  count(*) AS parsed, count(DISTINCT ip) AS ips,
  CASE WHEN dataset = 'apache' THEN count(DISTINCT path) END AS paths,
  CASE WHEN dataset = 'apache' THEN count(DISTINCT code) END AS codes,
  CASE WHEN dataset = 'generic' THEN count(DISTINCT level) END AS levels FROM r GROUP BY owner, dataset""")
def dataset_summary(spark, sf):
    rows = both_rows(spark, sf)
    return rollups.summary(rows, manifest(rows))


@query("visible_names", """SELECT DISTINCT name FROM (SELECT CASE WHEN user_id % 5 = 0 THEN '_u' ELSE 'u' END || user_id
  AS name FROM events) WHERE NOT starts_with(name, '_')""")
def visible_names(spark, sf):
    names = (spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.when(F.col("user_id") % 5 == 0, "_u").otherwise("u"), "user_id").alias("name")).distinct())
    return rollups.visible_names(names)
