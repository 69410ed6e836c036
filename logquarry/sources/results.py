"""Exported search results: one flat JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry import schema
from logquarry.functions.text import make_search, make_template
from logquarry.functions.times import event_time, iso_text, norm_ts


def rows_from_results(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of format `results`. `results`: owner, dataset, file, line_no, value.

    `limit`: only so many rows in line order, at least one; None takes all.
    """
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be 1 or more")
        results = results.orderBy("file", "line_no").limit(limit)
    # The result object is held once; everything below reads it.
    held = results.select(*schema.KEYS, F.from_json("value", "map<string,string>").alias("_all"))
    shown = F.map_filter("_all", lambda k, v: ~k.startswith("_"))
    held = held.filter("_all IS NOT NULL").select("*", shown.alias("_f"))

    def get(key: str):
        return F.coalesce(F.try_element_at(F.col("_f"), F.lit(key)), F.lit(""))
    pairs = F.array_join(F.transform(
        F.array_sort(F.map_entries("_f")),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), " ")
    line = F.trim(get("line"))
    stamp = F.trim(F.coalesce(F.try_element_at(F.col("_all"), F.lit("_time")), F.lit("")))
    number = stamp.try_cast("double")
    whole = F.when(number.isNotNull(), number.try_cast("bigint").cast("string")).otherwise(norm_ts(stamp))
    ip = F.coalesce(*[F.when(F.map_contains_key("_f", k), get(k)) for k in V.RESULT_IP_KEYS], F.lit(""))
    rows = held.select(
        *schema.KEYS, F.lit("results").alias("format"), whole.alias("ts"), F.lit("").alias("level"),
        ip.alias("ip"), get("host").alias("host"), get("sourcetype").alias("app"),
        *[F.lit("").alias(c) for c in ("pid", "method", "path", "code", "bytes")],
        F.when(line != "", line).otherwise(pairs).alias("msg"), F.to_json("_f").alias("raw"))
    rows = rows.filter("msg != ''").withColumn("event_time", event_time(F.col("ts")))
    return rows.select(
        *schema.KEYS, "format", *schema.FIELDS, "raw", make_template(F.col("msg")).alias("template"),
        make_search({f: F.col(f) for f in V.SEARCH_FIELDS}).alias("search"),
        iso_text(F.col("event_time")).alias("ts_norm"), "event_time",
        F.lit(None).cast("int").alias("code_int"), F.lit(None).cast("bigint").alias("bytes_num"))
