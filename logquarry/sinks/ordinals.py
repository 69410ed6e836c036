"""Ordinal index beside the rows table: any page of a dataset, however far in, from its blocks.

The index has a row per block of lines of a file, with the rows in it and the rows before it
in the dataset, in page order (file, line_no), and is sorted by the latter. A page is found by
its ordinals alone: the index says which blocks hold them, and those blocks' bounds become
filters of the rows' scan. What lies before the page is neither read nor counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.operators.paging import ORDER, prefix_sums
from logquarry.session import settle
from logquarry.sinks.tables import PARTITIONS

BLOCK_BITS = 12             # lines of a block: 4,096
LITERAL_FILES = 100         # files of a page whose bounds are written into the filter one by one
SCHEMA = "file string, block long, n long, before long, owner string, dataset string"


def block_of(line_no: Column) -> Column:
    return F.shiftright(line_no, BLOCK_BITS)


def write_ordinals(rows: DataFrame, path: str) -> None:
    """Index the datasets that rows hold, whole; they replace their earlier index. Only the
    keys of the rows are read."""
    keys = [*PARTITIONS, "file", "block"]
    counts = rows.select(*PARTITIONS, "file", block_of(F.col("line_no")).alias("block")).groupBy(*keys).agg(
        F.count("*").alias("n"))
    counts = settle(counts)
    placed = prefix_sums(counts, keys, "n", "_all")
    first = placed.groupBy(*PARTITIONS).agg(F.min("_all").alias("_first"))
    # Datasets are few beside their blocks; the rows of one are numbered from 0.
    index = placed.join(first, list(PARTITIONS)).withColumn("before", F.col("_all") - F.col("_first"))
    (index.select("file", "block", "n", "before", *PARTITIONS).repartitionByRange(*PARTITIONS, "before")
     .sortWithinPartitions(*PARTITIONS, "before").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path))


def read_ordinals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def page_blocks(index: DataFrame, owner: str, dataset: str, start: int, size: int) -> DataFrame:
    """file, block, before of the blocks that hold rows start .. start + size - 1 of a dataset."""
    return index.filter((F.col("owner") == owner) & (F.col("dataset") == dataset) & (F.col("before") < start + size)
                        & (F.col("before") + F.col("n") > start)).select("file", "block", "before")


def indexed_page(rows: DataFrame, index: DataFrame, owner: str, dataset: str, page: int = 1,
                 size: int = V.PAGE_SIZE) -> DataFrame:
    """The page of a dataset's rows in file order."""
    if page < 1 or size < 1:
        raise ValueError("page and size must be 1 or more")
    start = (page - 1) * size
    # Every block holds a row at least, so there are no more of them than rows of a page.
    hit = settle(page_blocks(index, owner, dataset, start, size))
    spans = hit.groupBy("file").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    near = rows.filter((F.col("owner") == owner) & (F.col("dataset") == dataset) & _inside(spans.collect()))
    near = near.withColumn("_block", block_of(F.col("line_no"))).join(
        F.broadcast(hit.withColumnsRenamed({"block": "_block", "before": "_before"})), ["file", "_block"])
    rank = F.row_number().over(Window.partitionBy("file", "_block").orderBy("line_no")) - 1
    at = near.withColumn("_at", F.col("_before") + rank).filter((F.col("_at") >= start) & (F.col("_at") < start + size))
    return at.select(*rows.columns).orderBy(*ORDER).limit(size)


def _inside(spans: list) -> Column:
    """The blocks' lines as bounds on file and line_no, which statistics of the files answer."""
    if not spans:
        return F.lit(False)
    if len(spans) > LITERAL_FILES:
        return F.col("file").between(min(s["file"] for s in spans), max(s["file"] for s in spans))
    wanted = F.lit(False)
    for s in sorted(spans, key=lambda s: s["file"]):
        lo, hi = s["lo"] << BLOCK_BITS, (s["hi"] + 1) << BLOCK_BITS
        wanted = wanted | ((F.col("file") == s["file"]) & (F.col("line_no") >= lo) & (F.col("line_no") < hi))
    return wanted
