"""Sketches: merged ones equal whole ones, stated errors hold; levels of a live table."""

import random

import pytest
from pyspark.sql import functions as F

from logquarry.operators import rollups, sketches
from logquarry.streaming import live


def logs(spark, n, distinct, seed=1):
    return spark.range(n).select(
        F.concat(F.lit("10."), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(distinct))).alias("ip"), F.lit("/p").alias("path"),
        F.when(F.col("id") % 7 == 0, "-").otherwise("200").alias("code"), F.lit("").alias("level"))


@pytest.mark.parametrize("distinct", [3, 5_000, 80_000])
def test_intervals_hold_the_exact_count(spark, distinct):
    parts = [logs(spark, 60_000, distinct, seed) for seed in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    states = [sketches.distinct_sketches(p) for p in parts]
    merged = sketches.merge_distinct(states[0].unionByName(states[1]).unionByName(states[2]))
    got = {r["kpi"]: r for r in sketches.distinct_estimates(merged).collect()}
    exact = rollups.kpis(whole).first().asDict()
    assert set(got) == {"ips", "paths", "codes"} and exact["levels"] == 0
    for kpi, r in got.items():
        assert r["low"] <= exact[kpi] <= r["high"] and r["high"] - r["low"] <= 0.05 * exact[kpi] + 2
    assert abs(rollups.kpis(whole, rsd=0.01).first()["ips"] - exact["ips"]) <= 0.05 * exact["ips"]


def test_state_has_a_fixed_size(spark):
    small, large = (sketches.distinct_sketches(logs(spark, n, n)).filter("kpi = 'ips'").agg(
        F.max(F.length("sketch"))).first()[0] for n in (50_000, 500_000))
    assert large < 1.1 * small


def test_tops_keep_to_their_bound(spark):
    """Skewed values over a sketch far too small for all of them."""
    r = random.Random(2)
    values = [f"v{int(r.paretovariate(0.8))}" for _ in range(60_000)]
    rows = spark.createDataFrame([(v,) for v in values], "ip string").repartition(4, "ip")
    exact = {x["ip"]: x["count"] for x in rows.groupBy("ip").count().collect()}
    parts = [sketches.top_sketches(rows.filter(F.pmod(F.crc32("ip"), F.lit(3)) == i), ["ip"], tracked=256) for i in range(3)]
    merged = sketches.merge_tops(parts[0].unionByName(parts[1]).unionByName(parts[2]), tracked=256)
    top = sketches.top_estimates(merged, 30, tracked=256).orderBy("rank").collect()
    true_top = sorted(exact, key=lambda v: (-exact[v], v))
    assert top[0]["error"] > 0 and len(top) > 5
    for x in top:
        assert x["n"] - x["error"] <= exact[x["value"]] <= x["n"]
    sure = [x["value"] for x in top if x["certain"]]
    assert sure and set(sure) <= set(true_top[:30])


def test_tops_are_exact_while_nothing_was_given_up(spark):
    rows = spark.range(5_000).select(F.concat(F.lit("v"), F.col("id") % 90).alias("ip"), F.lit("a").alias("app"))
    got = sketches.top_estimates(sketches.top_sketches(rows, ["ip", "app"], tracked=256), 10, tracked=256).collect()
    assert all(x["error"] == 0 and x["certain"] for x in got) and len(got) == 11
    assert [x["value"] for x in sorted(got, key=lambda x: x["rank"]) if x["field"] == "ip"][:2] == ["v0", "v1"]


def batch(spark, i):
    return spark.createDataFrame([(f"10.0.0.{i % 5}", "ERR", f"2024-01-01T00:{i % 60:02d}:00")] * 2, "ip string, level string, ts_norm string")


def test_levels_keep_reads_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "FANOUT", 3)
    tables = live.LiveTables(spark, str(tmp_path))
    rows = spark.createDataFrame([("ip", "x", 1)], live.COUNTS).coalesce(1)
    for i in range(31):
        tables._put("counts", rows, i)
        assert tables.counts().first()["n"] == i + 1
        assert len(tables.cover()) <= 2 * 4
    assert sorted(tables.cover()) == [(0, 30), (1, 29), (3, 26)]
    kept = sum(len(tables._complete("counts", level)) for level in range(5))
    assert kept <= 2 * 3 * 4
    tables._put("counts", rows, 30)                                     # the last batch run again
    tables._put("counts", rows, 29)
    assert tables.counts().first()["n"] == 31


def test_a_thousand_batches_are_read_from_few_folders(spark, tmp_path):
    """Only the names matter here, so empty complete folders stand for the merged ones."""
    tables = live.LiveTables(spark, str(tmp_path))
    for level, span in ((2, 256), (1, 16), (0, 1)):
        for upto in range(span - 1, 1000, span):
            folder = tmp_path / "counts" / f"level={level}" / f"upto={upto}"
            folder.mkdir(parents=True)
            (folder / "_SUCCESS").touch()
    cover = tables.cover()
    assert sum(16 ** level for level, _ in cover) == 1000 and len(cover) == 3 + 14 + 8


def test_batches_run_again_do_not_double_sketches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "FANOUT", 2)
    tables = live.LiveTables(spark, str(tmp_path), sketches=True)
    for i in (0, 1, 1, 2, 3, 3, 4):
        tables.write(batch(spark, i), i)
    top = {r["value"]: r["n"] for r in tables.top_sketched(10).filter("field = 'ip'").collect()}
    assert top == {f"10.0.0.{i}": 2 for i in range(5)}
    kpis = {r["kpi"]: r["estimate"] for r in tables.kpis_sketched().collect()}
    assert kpis == {"ips": 5, "levels": 1}
    assert {r["value"]: r["n"] for r in tables.top("level", 3).collect()} == {"ERR": 10}
