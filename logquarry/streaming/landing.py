"""Stream of whole files landing in a folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.session import settle
from logquarry.sources.lines import file_profile, number_lines, profile_splits

MOST_BATCHES = 16
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Files are listed by four tasks per core, not by a task for each folder or file."""
    before = spark.conf.get(LISTING_TASKS, None)
    spark.conf.set(LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(LISTING_TASKS)
        else:
            spark.conf.set(LISTING_TASKS, before)


def files_per_batch(spark: SparkSession, folder: str, least: int) -> int:
    """`least`, or more where that would make over MOST_BATCHES micro-batches of what has
    landed: a batch takes its fixed time whatever is in it, so batches of as many files each
    would make the time of a whole run grow with the number of files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    landed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getFileCount()
    return max(least, -(-landed // MOST_BATCHES))


def watch_folder(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """(file, _block, value) of files as they appear; `max_files` per micro-batch."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def number_batch(batch: DataFrame) -> DataFrame:
    """Numbered, decoded lines of a micro-batch: a landed file is in one batch whole."""
    raw = batch.withColumn("_id", F.monotonically_increasing_id())
    splits = settle(profile_splits(raw))
    return number_lines(raw, splits, file_profile(splits))
