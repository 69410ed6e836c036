"""Pages from the ordinal index against sorting, and what a far page reads."""

import pytest
from pyspark.sql import functions as F

from logquarry.operators import paging
from logquarry.sinks import ordinals, tables


@pytest.fixture
def stored(spark, tmp_path):
    """Rows of three datasets with gaps in their line numbers, stored and indexed."""
    rows = spark.range(30_000).select(
        F.concat(F.lit("u"), F.col("id") % 2).alias("owner"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("dataset"),
        F.concat(F.lit("f"), F.pmod(F.xxhash64("id"), F.lit(7))).alias("file"), (F.col("id") * 3).alias("line_no"),
        F.col("id").cast("string").alias("raw")).repartition(5)
    tables.append_rows(rows, str(tmp_path / "rows"))
    got = tables.read_rows(spark, str(tmp_path / "rows"))
    ordinals.write_ordinals(got, str(tmp_path / "index"))
    return got, ordinals.read_ordinals(spark, str(tmp_path / "index"))


@pytest.mark.parametrize(("page", "size"), [(1, 10), (3, 700), (7, 1711), (12, 1000), (40, 300), (41, 300), (999, 300), (1, 20_000)])
def test_pages_equal_a_sort(stored, page, size):
    rows, index = stored
    own = sorted((r["file"], r["line_no"]) for r in rows.filter("owner = 'u1' AND dataset = 'b'").collect())
    got = [(r["file"], r["line_no"]) for r in ordinals.indexed_page(rows, index, "u1", "b", page, size).collect()]
    assert got == own[(page - 1) * size:page * size]


def test_many_files_on_a_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordinals, "LITERAL_FILES", 3)
    rows = spark.range(500).select(F.lit("o").alias("owner"), F.lit("d").alias("dataset"), F.format_string("f%03d", "id").alias("file"),
                                   F.lit(0).cast("long").alias("line_no"))
    ordinals.write_ordinals(rows, str(tmp_path))
    got = ordinals.indexed_page(rows, ordinals.read_ordinals(spark, str(tmp_path)), "o", "d", 5, 100).collect()
    assert [r["file"] for r in got] == [f"f{i:03d}" for i in range(400, 500)]
    assert ordinals.indexed_page(rows, ordinals.read_ordinals(spark, str(tmp_path)), "o", "none", 1, 100).count() == 0


def test_a_dataset_is_indexed_anew(stored, spark, tmp_path):
    rows, _ = stored
    ordinals.write_ordinals(rows.filter("owner = 'u0' AND dataset = 'a' AND line_no < 300"), str(tmp_path / "index"))
    index = ordinals.read_ordinals(spark, str(tmp_path / "index"))
    totals = {(r["owner"], r["dataset"]): r["n"] for r in index.groupBy("owner", "dataset").agg(F.sum("n").alias("n")).collect()}
    assert totals[("u0", "a")] == 10 and totals[("u1", "b")] == 12_000


def test_a_far_page_reads_its_blocks_only(spark, tmp_path):
    rows = spark.range(1_200_000).coalesce(1).select(
        F.lit("o").alias("owner"), F.lit("d").alias("dataset"), F.lit("f").alias("file"), F.col("id").alias("line_no"),
        F.sha2(F.col("id").cast("string"), 256).alias("raw"))
    tables.append_rows(rows, str(tmp_path / "rows"))
    got = tables.read_rows(spark, str(tmp_path / "rows"))
    ordinals.write_ordinals(got, str(tmp_path / "index"))
    page = ordinals.indexed_page(got, ordinals.read_ordinals(spark, str(tmp_path / "index")), "o", "d", 2_001, 500)
    assert [r["line_no"] for r in page.collect()] == list(range(1_000_000, 1_000_500))
    plan = page._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    read, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            read += node.metrics().get("numOutputRows").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 500 <= read <= 60_000
    assert "Window" not in plan.toString() or "SinglePartition" not in plan.toString()


def test_prefix_sums(spark):
    table = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(10 ** 6)).alias("k"), (F.col("id") % 7).alias("n"))
    want, before = {}, 0
    for r in sorted(table.collect()):
        want[r["k"]] = before
        before += r["n"]
    assert {r["k"]: r["b"] for r in paging.prefix_sums(table, ["k"], "n", "b").collect()} == want
