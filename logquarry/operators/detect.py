"""Format of a file from its first 100 non-blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.operators.parsers import (CLF_PATTERN, JSONL, LEVELLED_PATTERN, SYSLOG_PATTERN,
                                         header_columns)
from logquarry.session import lookup_join, settle

NOT_BLANK = r"(?U)\S"


def head_bounds(lines: DataFrame, sample: int = V.DETECT_SAMPLE) -> DataFrame:
    """(file, head_to): the sample of each file lies in lines before `head_to`.

    Non-blank lines are counted in power-of-two steps of the line number, at most
    64 groups per file and all combined map-side; nothing is sorted or shuffled
    but these counts. The bound overshoots the sample by at most a factor of two.
    """
    step = F.floor(F.log2(F.col("line_no") + 1)).cast("int")
    counts = (lines.groupBy("file", step.alias("_step"))
              .agg(F.count_if(F.col("value").rlike(NOT_BLANK)).alias("_n")))
    so_far = F.sum("_n").over(Window.partitionBy("file").orderBy("_step"))
    reached = counts.withColumn("_sum", so_far)
    full = F.min(F.when(F.col("_sum") >= sample, F.col("_step")))
    return (reached.groupBy("file")
            .agg(F.coalesce(full, F.max("_step")).alias("_step"), F.max("_sum").alias("non_blank"))
            .select("file", F.pow(F.lit(2), F.col("_step") + 1).cast("long").alias("head_to"),
                    "non_blank"))


def detect_format(lines: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """(file, format, w3c_fields, meta) for every file that has a non-blank line."""
    bounds = settle(head_bounds(lines)) if bounds is None else bounds
    widest = bounds.agg(F.max("head_to")).first()[0] or 0
    near = lines.filter(F.col("line_no") < widest)          # reaches the scan
    near = lookup_join(near, bounds.select("file", "head_to"), ["file"])
    near = near.filter("line_no < head_to").select("file", "line_no", "value")
    shown = near.filter(F.col("value").rlike(NOT_BLANK))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return judge(shown.withColumn("_rank", rank).filter(F.col("_rank") <= V.DETECT_SAMPLE))


def marks(value: Column) -> dict[str, Column]:
    """What a line looks like, by format."""
    return {"apache": value.rlike(CLF_PATTERN), "w3c": value.startswith("#Fields"),
            "json": JSONL.accepts(JSONL.capture(value), value),
            "generic": value.rlike(LEVELLED_PATTERN), "syslog": value.rlike(SYSLOG_PATTERN)}


def judge(sample: DataFrame) -> DataFrame:
    """Verdict per file over its sample: file, line_no, value, at most 100 lines a file."""
    value = F.col("value")
    marked = sample.select("file", "line_no", "value", *[c.alias(m) for m, c in marks(value).items()])
    # Bounded groups: at most 100 lines of a file arrive here.
    notes = F.array_sort(F.collect_list(F.when(value.startswith("#"), F.struct("line_no", "value"))))
    verdicts = marked.groupBy("file").agg(
        F.count("*").alias("_n"), F.max("w3c").alias("_w3c"),
        *[F.count_if(c).alias(f"_{c}") for c in ("apache", "json", "generic", "syslog")],
        F.min_by(F.when(F.col("w3c"), value), F.when(F.col("w3c"), F.col("line_no"))).alias("_header"),
        notes.alias("_notes"))

    def most(name: str):
        return F.col(f"_{name}") > F.col("_n") * V.DETECT_SHARE
    fmt = (F.when(most("apache"), "apache").when(F.col("_w3c"), "w3c").when(most("json"), "json")
           .when(most("generic"), "generic").when(most("syslog"), "syslog").otherwise("raw"))
    is_w3c = F.col("format") == "w3c"
    no_text = F.array().cast("array<string>")
    return verdicts.withColumn("format", fmt).select(
        "file", "format",
        F.when(is_w3c, header_columns(F.col("_header"))).otherwise(no_text).alias("w3c_fields"),
        F.when(is_w3c, F.slice(F.col("_notes").getField("value"), 1, V.META_LINES))
        .otherwise(no_text).alias("meta"))
