"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a lookup may hold to be sent to every executor, measured before the join.
# A million file splits, the largest lookup here (100 TB of text), take about 300 MB.
BROADCAST_BYTES = 512 << 20
LOCAL_ROOTS: dict[str, str] = {}    # application -> folder, local sessions only


def configure(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: UTC rendering and partition-wise overwrite."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if not is_local(spark):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, for the functions that run in Python."""
    if getattr(spark.sparkContext, "_logquarry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="logquarry-"), "logquarry"),
                                 "zip", root, "logquarry")
    spark.sparkContext.addPyFile(packed)
    spark.sparkContext._logquarry_shipped = True


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        application = spark.sparkContext.applicationId
        if application not in LOCAL_ROOTS:
            LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="logquarry-")
        root = LOCAL_ROOTS[application]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared root (created by whoever writes it)."""
    return f"{shared_root(spark).rstrip('/')}/logquarry/{label}-{uuid.uuid4().hex}"


def needs_spreading(scan: DataFrame) -> bool:
    """Whether a scan has fewer tasks than the session has cores."""
    return scan.rdd.getNumPartitions() < scan.sparkSession.sparkContext.defaultParallelism


ROWS_PER_TASK = 250_000     # parsed lines of about 1.5 kB: what a sort of a task's rows holds


def tasks_for(scan: DataFrame) -> int | None:
    """Into how many tasks to spread a scan: one per core at least, and none with many more
    than ROWS_PER_TASK rows. None where its own tasks are as many."""
    bounded = -(-scan.count() // ROWS_PER_TASK)
    if needs_spreading(scan) or scan.rdd.getNumPartitions() < bounded:
        return max(scan.sparkSession.sparkContext.defaultParallelism, bounded)
    return None


def spread(scan: DataFrame, tasks: int) -> DataFrame:
    """A file of one row group is one task, however many cores wait for it, and a small file
    may hold many rows; use this only with `tasks_for`, so a scan that keeps all cores busy
    with tasks of a bounded size is never shuffled."""
    return scan.repartition(tasks)


def settle(df: DataFrame) -> DataFrame:
    """Compute a small derived table once, on reliable storage."""
    shared_root(df.sparkSession)
    done = df.checkpoint(eager=True)
    done._lq_settled = True
    return done


def held_bytes(df: DataFrame) -> int:
    """Bytes of a settled table: its text plus a fixed share per value."""
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns),
              F.lit(16 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a lookup table to a big one; a lookup that is not settled yet is settled first.

    It is broadcast once it is measured to fit `max_bytes`. Beyond that the join is
    shuffled; adaptive execution splits the tasks of a hot key.
    """
    small = small if getattr(small, "_lq_settled", False) else settle(small)
    fits = held_bytes(small) <= max_bytes
    return big.join(F.broadcast(small) if fits else small.hint("merge"), keys, how)
