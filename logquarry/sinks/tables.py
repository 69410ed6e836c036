"""The rows table: Parquet by owner and dataset; replacing and removing datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("owner", "dataset")


def _placed(rows: DataFrame) -> DataFrame:
    """Sort inside each task only: min/max statistics get tight, nothing is shuffled."""
    return rows.sortWithinPartitions(*PARTITIONS, "file", "line_no")


def append_rows(rows: DataFrame, path: str) -> None:
    _placed(rows).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def replace_datasets(rows: DataFrame, path: str) -> None:
    """Write rows; datasets present in them replace their earlier content."""
    (_placed(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(path))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remove_dataset(spark: SparkSession, path: str, owner: str, dataset: str | None = None) -> bool:
    """Drop one dataset's partition folder, or all of an owner's. Data is not read."""
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = f"{path}/owner={escape(owner)}" + (f"/dataset={escape(dataset)}" if dataset else "")
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.delete(target, True))


def without_dataset(manifest: DataFrame, owner: str, dataset: str | None = None) -> DataFrame:
    gone = F.col("owner") == owner
    return manifest.filter(~(gone & (F.col("dataset") == dataset) if dataset else gone))


def write_version(table: DataFrame, path: str) -> str:
    """Write a small keyed table as its next version; readers take the newest complete one."""
    spark = table.sparkSession
    folder = f"{path}/v={_newest(spark, path) + 1:08d}"
    table.write.mode("overwrite").parquet(folder)
    return folder


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={_newest(spark, path):08d}")


def _newest(spark: SparkSession, path: str) -> int:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    done = [int(s.getPath().getName()[2:]) for s in files.listStatus(root)
            if s.getPath().getName().startswith("v=")
            and files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=0)
