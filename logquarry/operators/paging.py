"""Pages of filtered rows in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.functions.text import truncate
from logquarry.operators.filters import FilterSpec, apply_filter
from logquarry.session import settle

ORDER = ("file", "line_no")
CANDIDATE_ROWS = 20_000      # rows up to the end of a page that every task may send to one place
BLOCK_BITS = 17          # lines per counting block: 131,072


def _checked(page: int, size: int) -> None:
    if page < 1 or size < 1:
        raise ValueError("page and size must be 1 or more")


def page(rows: DataFrame, spec: FilterSpec, page: int = 1, size: int = V.PAGE_SIZE) -> DataFrame:
    _checked(page, size)
    start = (page - 1) * size
    found = apply_filter(rows, spec)
    shown = found.drop("search") if "search" in found.columns else found
    if _few_candidates(start + size):
        return shown.orderBy(*ORDER).offset(start).limit(size)
    return _deep_page(shown, start, size)


def _few_candidates(wanted: int) -> bool:
    """A sort with a limit lets every task send its `wanted` first rows to one place.
    Judged by the request alone: asking a plan for its tasks would run its shuffles."""
    return wanted <= CANDIDATE_ROWS


def prefix_sums(table: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows that come before in `order`. Rows are laid
    out by ranges; each task sums its own, and only one total per task meets the others."""
    ranged = settle(table.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_part", F.spark_partition_id()))
    totals, before = [], 0
    for r in ranged.groupBy("_part").agg(F.sum(value).alias("n")).orderBy("_part").collect():
        totals.append((r["_part"], before))
        before += r["n"] or 0
    offsets = table.sparkSession.createDataFrame(totals, "_part int, _offset long")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return (ranged.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_offset") + F.coalesce(inside, F.lit(0))).drop("_part", "_offset"))


def _deep_page(found: DataFrame, start: int, size: int) -> DataFrame:
    """A page far in: count per file, then per block of lines, then rank inside the
    one or few blocks that hold the page. No task ever sorts what lies before it."""
    files = prefix_sums(found.groupBy("file").agg(F.count("*").alias("_n")), ["file"], "_n", "_before")
    hit = files.filter((F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start))
    # A page touches at most as many non-empty files or blocks as it has rows.
    hit = settle(hit)
    block = F.shiftright("line_no", BLOCK_BITS)
    near = found.withColumn("_block", block).join(F.broadcast(hit.drop("_n")), "file")
    blocks = near.groupBy("file", "_block", "_before").agg(F.count("*").alias("_n"))
    inside = F.coalesce(F.sum("_n").over(
        Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    blocks = blocks.withColumn("_from", F.col("_before") + inside).filter(
        (F.col("_from") < start + size) & (F.col("_from") + F.col("_n") > start))
    picked = near.drop("_before").join(
        F.broadcast(blocks.select("file", "_block", "_from")), ["file", "_block"])
    rank = F.row_number().over(Window.partitionBy("file", "_block").orderBy("line_no"))
    at = F.col("_from") + rank - 1
    return (picked.withColumn("_at", at).filter((F.col("_at") >= start) & (F.col("_at") < start + size))
            .drop("_block", "_from", "_at").orderBy(*ORDER).limit(size))


def keyset_page(rows: DataFrame, spec: FilterSpec, after: tuple[str, int] | None,
                size: int = V.PAGE_SIZE) -> DataFrame:
    """The page behind a given row: the same cost at any depth."""
    _checked(1, size)
    found = apply_filter(rows, spec)
    if after is not None:
        file, line_no = after
        found = found.filter((F.col("file") > file)
                             | ((F.col("file") == file) & (F.col("line_no") > line_no)))
    if _few_candidates(size):
        return found.orderBy(*ORDER).limit(size)
    return _deep_page(found, 0, size)


def display(rows: DataFrame, fmt: str, whole: bool = False) -> DataFrame:
    """The columns a format shows; long messages are cut for the eye unless `whole`."""
    shown = V.DISPLAY_COLUMNS.get(fmt, V.DISPLAY_COLUMNS["other"])
    return rows.select(*[truncate(F.col(c)).alias(c) if c == "msg" and not whole else c for c in shown])
