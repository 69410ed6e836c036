"""Distinct counts and tops of fixed size: sketches per batch or dataset, merged when read.

A sketch is built once where rows arrive, kept in a table beside them, and merged over any
choice of batches, so an answer reads kilobytes however many rows there were. Answers carry
their error: distinct counts an interval of `SIGMAS` standard deviations, tops the most by
which a count can be too high, and which values are certain to belong to the list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.operators.rollups import KPI_COLUMNS, field_values, kpi_value

LG_K = 15                   # 2 ** LG_K registers, one byte each
SIGMAS = 4
TRACKED = 8192              # values a top sketch is asked to follow


def distinct_error(lg_k: int = LG_K, sigmas: int = SIGMAS) -> float:
    """Relative error of a merged sketch that is exceeded once in some ten thousand cases."""
    return sigmas * 1.04 / math.sqrt(1 << lg_k)


# --- distinct values ---------------------------------------------------------

def distinct_sketches(rows: DataFrame, by: list[str] | None = None, lg_k: int = LG_K) -> DataFrame:
    """by.., kpi, n (rows with a value), sketch."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kpi"), kpi_value(k).alias("value"))
                      for k, c in KPI_COLUMNS.items() if c in rows.columns])
    keys = [*(by or []), "kpi"]
    return (rows.select(*(by or []), F.inline(pairs)).filter("value IS NOT NULL").groupBy(*keys)
            .agg(F.count("*").alias("n"), F.hll_sketch_agg("value", lg_k).alias("sketch")))


def merge_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    return sketches.groupBy(*(by or []), "kpi").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame, lg_k: int = LG_K, sigmas: int = SIGMAS) -> DataFrame:
    """The sketches' rows with estimate, low and high instead of the sketch. No count is
    above the number of rows."""
    error = distinct_error(lg_k, sigmas)
    estimate = F.hll_sketch_estimate("sketch")
    return (sketches.withColumn("estimate", F.least(estimate, F.col("n")))
            .withColumn("low", F.floor(F.col("estimate") / (1 + error)).cast("long"))
            .withColumn("high", F.least(F.ceil(F.col("estimate") / (1 - error)).cast("long"), F.col("n"))).drop("sketch", "n"))


# --- heavy hitters -----------------------------------------------------------

def map_size(tracked: int) -> int:
    """Slots of a top sketch: the next power of two that is at most three quarters full."""
    return 1 << math.ceil(math.log2(tracked / 0.75))


def top_sketches(rows: DataFrame, fields: list[str], by: list[str] | None = None, tracked: int = TRACKED) -> DataFrame:
    """by.., field, n (rows with a value), sketch."""
    keys = by or []
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    values = rows.select(*keys, F.inline(pairs)).filter("value != ''") if keys else field_values(rows, fields)
    return values.groupBy(*keys, "field").agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("sketch"))


def merge_tops(sketches: DataFrame, by: list[str] | None = None, tracked: int = TRACKED) -> DataFrame:
    return sketches.groupBy(*(by or []), "field").agg(
        F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))


def top_estimates(sketches: DataFrame, limit: int = V.TOP_DEFAULT, by: list[str] | None = None,
                  tracked: int = TRACKED) -> DataFrame:
    """by.., field, rank, value, n, error, certain. A value's rows are between n - error and n.
    `certain`: it has at least as many as any value that is not shown."""
    keys = [*(by or []), "field"]
    found = sketches.select(*keys, F.col("n").alias("_rows"), F.expr(
        f"approx_top_k_estimate(sketch, {tracked})").alias("_top"))
    # A sketch that never had to give up a value accounts for every row.
    seen = F.aggregate("_top", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    slack = F.ceil(F.col("_rows") * (3.5 / map_size(tracked))).cast("long")
    found = found.withColumn("error", F.when(seen == F.col("_rows"), 0).otherwise(slack).cast("long"))
    items = found.select(*keys, "error", F.inline("_top")).withColumnsRenamed({"item": "value", "count": "n"})
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    ranked = items.withColumns({"rank": F.row_number().over(order)}).filter(F.col("rank") <= limit + 1)
    beyond = F.max(F.when(F.col("rank") == limit + 1, F.col("n"))).over(Window.partitionBy(*keys))
    ranked = ranked.withColumn("_beyond", F.greatest(F.coalesce(beyond, F.lit(0)), F.col("error")))
    return (ranked.withColumn("certain", F.col("n") - F.col("error") >= F.col("_beyond"))
            .filter(F.col("rank") <= limit).select(*keys, "rank", "value", "n", "error", "certain"))
