"""Counts, tops, KPIs, histograms and template clustering.

Aggregates keep fixed-width buffers (counts, times, line numbers): with those
Spark aggregates by hash in place, while text buffers would sort every row first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.functions.text import level_rank
from logquarry.functions.times import bucket_label, iso_text
from logquarry.operators.filters import FilterSpec, apply_filter
from logquarry.session import lookup_join, settle


def total_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, field: str, limit: int = V.TOP_DEFAULT) -> DataFrame:
    """(value, n): most frequent non-blank values; an unknown field gives no rows."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    known = field in rows.columns and field in V.TOP_FIELDS
    value = F.col(field) if known else F.lit("")
    return (rows.select(value.alias("value")).filter("value != ''").groupBy("value")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit))


def field_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) for each non-blank field of each row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return rows.select(F.inline(pairs)).filter("value != ''")


def top_many(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Several top lists from one scan: (field, rank, value, n)."""
    counts = field_values(rows, list(limits)).groupBy("field", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    most = max(limits.values())
    allowed = F.create_map(*[x for f, n in limits.items() for x in (F.lit(f), F.lit(n))])
    return (counts.withColumn("rank", rank).filter(F.col("rank") <= most)
            .filter(F.col("rank") <= F.element_at(allowed, F.col("field")))
            .select("field", "rank", "value", "n"))


def dashboard_tops(rows: DataFrame, fmt: str) -> DataFrame:
    return top_many(rows, V.DASHBOARD_TOPS.get(fmt, V.DASHBOARD_TOPS["other"]))


def level_facet(rows: DataFrame) -> DataFrame:
    """Levels with counts, in the fixed order, unknown ones last by count."""
    return (rows.filter("level != ''").groupBy("level").agg(F.count("*").alias("n"))
            .withColumn("rank", level_rank(F.col("level")))
            .orderBy("rank", F.desc("n"), "level"))


KPI_COLUMNS = {"ips": "ip", "paths": "path", "codes": "code", "levels": "level"}


def kpi_value(kpi: str) -> Column:
    c = F.col(KPI_COLUMNS[kpi])
    return F.when(~c.isin("", "-"), c) if kpi == "codes" else F.nullif(c, F.lit(""))


def kpis(rows: DataFrame, by: list[str] | None = None, rsd: float | None = None) -> DataFrame:
    """Distinct non-blank ips, paths, codes, levels; with `rsd` as estimates of that relative
    standard deviation. `sketches` has estimates that can be stored and merged."""
    def count(value: Column) -> Column:
        return F.count_distinct(value) if rsd is None else F.approx_count_distinct(value, rsd)
    return rows.groupBy(*(by or [])).agg(*[count(kpi_value(k)).alias(k) for k in KPI_COLUMNS])


def only_format_kpis(table: DataFrame) -> DataFrame:
    """NULL for the KPIs the row's format does not fill."""
    fmt = F.col("format")
    shown = {k: [f for f, ks in V.KPI_BY_FORMAT.items() if k in ks] for k in KPI_COLUMNS}
    other = ~fmt.isin(*V.KPI_BY_FORMAT)
    return table.select(*[
        F.when(fmt.isin(*shown[c]) | (other & F.lit(c in ("ips", "levels"))), F.col(c)).alias(c)
        if c in KPI_COLUMNS else F.col(c) for c in table.columns])


def summary(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per dataset: its manifest totals, parsed rows and KPIs."""
    per_set = dataset_list(manifest)
    keys = ["owner", "dataset"]
    pairs = F.array(*[F.struct(F.lit(k).alias("kpi"), kpi_value(k).alias("value")) for k in KPI_COLUMNS],
                    F.struct(F.lit("parsed").alias("kpi"), F.lit("").alias("value")))
    seen = (rows.select(*keys, F.inline(pairs)).filter("value IS NOT NULL")
            .groupBy(*keys, "kpi", "value").agg(F.count("*").alias("n")))
    found = seen.groupBy(*keys).agg(
        F.sum(F.when(F.col("kpi") == "parsed", F.col("n"))).alias("parsed"),
        *[F.count_if(F.col("kpi") == k).alias(k) for k in KPI_COLUMNS])
    joined = (per_set.join(found, ["owner", "dataset"], "left").fillna(0, ["parsed", *KPI_COLUMNS]))
    return only_format_kpis(joined)


def dataset_list(manifest: DataFrame) -> DataFrame:
    """One row per dataset from its file manifest."""
    return manifest.groupBy("owner", "dataset").agg(
        F.min("format").alias("format"), F.sum("size").alias("size"), F.sum("total").alias("total"),
        F.min("encoding").alias("encoding"), F.max("compressed").alias("compressed"))


def visible_names(catalog: DataFrame, column: str = "name") -> DataFrame:
    """Names not starting with an underscore, sorted."""
    name = F.trim(F.coalesce(F.col(column), F.lit("")))
    return (catalog.select(name.alias(column)).filter((F.col(column) != "")
            & ~F.col(column).startswith("_")).orderBy(column))


# --- templates -------------------------------------------------------------

def template_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., template, n, first, last, file, line_no): the last two name the example."""
    # Blank templates go after the count, by an aggregate: as a row filter the test
    # would sink to the scan and make every template twice.
    spread = rows.groupBy(*by, "template", "file").agg(
        F.count("*").alias("n"), F.min("event_time").alias("first"),
        F.max("event_time").alias("last"), F.min("line_no").alias("line_no"),
        F.max(F.char_length("template")).alias("_long")).filter("_long > 0")
    at = F.min(F.struct("file", "line_no"))
    return (spread.groupBy(*by, "template")
            .agg(F.sum("n").alias("n"), F.min("first").alias("first"),
                 F.max("last").alias("last"), at.alias("_at"))
            .select(*by, "template", "n", "first", "last", "_at.file", "_at.line_no"))


def with_example(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Fetch the raw line each group points at: the groups are settled and measured, so
    the rows are not shuffled for them unless the groups outgrow a broadcast."""
    lines = rows.select("file", "line_no", F.col("raw").alias("example"))
    return lookup_join(lines, groups, ["file", "line_no"])


def with_few_examples(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for at most TEMPLATE_LIMIT groups: their keys become literals of the scan,
    so that a stored table, sorted by them, reads little more than those lines."""
    groups = settle(groups)
    keys: dict[str, list[int]] = {}
    for r in groups.select("file", "line_no").collect():
        keys.setdefault(r["file"], []).append(r["line_no"])
    wanted = F.lit(False)
    for file, numbers in sorted(keys.items()):
        wanted = wanted | ((F.col("file") == file) & F.col("line_no").isin(sorted(numbers)))
    lines = rows.filter(wanted).select("file", "line_no", F.col("raw").alias("example"))
    return lines.join(F.broadcast(groups), ["file", "line_no"])


TEMPLATE_ORDER = (F.desc, "n"), (F.asc_nulls_first, "first"), (F.asc, "template")


def template_order() -> list[Column]:
    return [f(c) for f, c in TEMPLATE_ORDER]


def templates(rows: DataFrame, level: str | None = None, min_count: int = 1,
              limit: int | None = V.TEMPLATE_LIMIT) -> DataFrame:
    """Clusters of like lines: (template, n, first, last, example), most frequent first.

    `limit=None` gives all of them, unordered.
    """
    # Imported results have no levels, so a level does not restrict them.
    rows = rows if level is None else rows.filter((F.col("level") == level) | (F.col("format") == "results"))
    groups = template_counts(rows).filter(F.col("n") >= min_count)
    if limit is not None:
        groups = groups.orderBy(*template_order()).limit(limit)
    few = limit is not None and limit <= V.TEMPLATE_LIMIT
    shown = with_few_examples(groups, rows) if few else with_example(groups, rows)
    if limit is not None:
        shown = shown.orderBy(*template_order())
    return shown.select("template", "n", iso_text(F.col("first")).alias("first"),
                        iso_text(F.col("last")).alias("last"), "example")


# --- histogram -------------------------------------------------------------

def histogram(rows: DataFrame, spec: FilterSpec = FilterSpec(), gran: str = "min") -> DataFrame:
    """(t, n) per minute or hour of the filtered rows that have a time."""
    buckets = (apply_filter(rows, spec).groupBy(bucket_label(F.col("ts_norm"), gran).alias("t"))
               .agg(F.count("*").alias("n"), F.max(F.char_length("ts_norm")).alias("_long")))
    return buckets.filter("_long > 0").select("t", "n").orderBy("t")


def histogram_total(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def fill_gaps(buckets: DataFrame, gran: str = "min") -> DataFrame:
    """Add empty buckets between the first and the last.

    Days are laid out first and spread over tasks, then each becomes its 24 or
    1,440 buckets, so a stray far-off time does not build one huge array.
    """
    buckets = settle(buckets)
    pad = ":00" if gran == "min" else ":00:00"
    as_time = F.concat(F.col("t"), F.lit(pad)).try_cast("timestamp")
    ends = buckets.agg(F.min(as_time).alias("lo"), F.max(as_time).alias("hi")).filter("lo IS NOT NULL")
    days = (ends.select("lo", "hi", F.explode(F.sequence(
        F.to_date("lo"), F.to_date("hi"), F.expr("INTERVAL 1 DAY"))).alias("day"))
        .repartition("day"))
    step = F.expr("INTERVAL 1 MINUTE" if gran == "min" else "INTERVAL 1 HOUR")
    start = F.col("day").cast("timestamp")
    slots = (days.select("lo", "hi", F.explode(F.sequence(
        start, start + F.expr("INTERVAL 1 DAY") - step, step)).alias("at"))
        .filter("at BETWEEN lo AND hi").select(bucket_label(iso_text(F.col("at")), gran).alias("t")))
    return (slots.join(buckets, "t", "left")
            .select("t", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("t"))


def merge_counts(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of partial counts, as after an append."""
    return partials.groupBy(*keys).agg(F.sum("n").alias("n"))


