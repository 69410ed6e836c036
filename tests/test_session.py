from types import SimpleNamespace

import pytest

from logquarry import session


def bare(spark, master):
    """A session without a shared folder set."""
    context = SimpleNamespace(master=master, applicationId="bare-app",
                              getCheckpointDir=lambda: "set", setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context)


def test_shared_folder(spark):
    assert session.shared_root(spark) == spark.conf.get("spark.checkpoint.dir", session.shared_root(spark))
    one, two = (session.scratch_folder(spark, "x") for _ in range(2))
    assert one != two and one.startswith(session.shared_root(spark).rstrip("/") + "/logquarry/x-")


def test_local_session_makes_its_own_folder_once(spark):
    local = bare(spark, "local[2]")
    assert session.shared_root(local) == session.shared_root(local)


def test_cluster_needs_the_shared_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(bare(spark, "spark://host"))


def test_measured_bytes(spark):
    assert session.held_bytes(spark.createDataFrame([("abc", 1), ("é", 22)], "s string, n long")) == 4 * 16 + 3 + 2 + 1 + 2
    assert session.held_bytes(spark.createDataFrame([], "s string")) == 0


def test_spreading_only_small_scans(spark):
    assert session.needs_spreading(spark.range(10, numPartitions=1))
    assert not session.needs_spreading(spark.range(10, numPartitions=64))


def test_tasks_hold_a_bounded_number_of_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.tasks_for(spark.range(10, numPartitions=1)) == cores
    assert session.tasks_for(spark.range(10, numPartitions=64)) is None
    many = spark.range(20 * session.ROWS_PER_TASK + 1, numPartitions=cores)
    assert session.tasks_for(many) == max(cores, 21)


def test_a_large_table_is_read_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """However many rows a file has, a task that parses, sorts and writes them gets a few."""
    from logquarry.catalog import base
    monkeypatch.setattr(session, "ROWS_PER_TASK", 1000)
    spark.range(0, 40_000, numPartitions=2).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    found = base.table(spark, str(tmp_path), "events")
    sizes = [len(p) for p in found.rdd.glom().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 1100
