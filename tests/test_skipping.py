"""Clustered tables: the same rows, fewer of them read."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logquarry.operators.filters import FilterSpec, apply_filter
from logquarry.sinks import skipping, tables


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """60,000 rows in arrival order, plain and clustered."""
    h = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 30))
    rows = spark.range(60_000).select(
        F.lit("o").alias("owner"), F.concat(F.lit("d"), F.col("id") % 2).alias("dataset"), F.concat(F.lit("f"), h(1) % 5).alias("file"),
        F.col("id").alias("line_no"), F.when(F.col("id") % 50 != 0, F.concat_ws(".", F.lit("10"), h(2) % 4, h(3) % 40, h(4) % 250))
        .otherwise(F.when(F.col("id") % 100 == 0, "").otherwise("fe80::1")).alias("ip"),
        F.when(h(5) % 10 == 0, 500).when(h(5) % 10 == 1, 404).otherwise(200).cast("int").alias("code_int"),
        F.when(F.col("id") % 77 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + h(6) % 2_000_000)).alias("event_time"),
        F.concat(F.lit("tpl "), h(7) % 3000).alias("template"))
    rows = rows.withColumn("code", F.col("code_int").cast("string"))
    folder = tmp_path_factory.mktemp("skipping")
    rows.write.parquet(str(folder / "source"))
    rows = spark.read.parquet(str(folder / "source"))
    tables.append_rows(rows, str(folder / "plain"))
    skipping.write_clustered(rows, str(folder / "clustered"), group_bytes=64 << 10)
    return tables.read_rows(spark, str(folder / "plain")), tables.read_rows(spark, str(folder / "clustered")), folder


FILTERS = {"time": "event_time >= '2023-11-20' AND event_time < '2023-11-21'", "ip range": "ip >= '10.1.2' AND ip < '10.1.3'",
           "one ip": "ip = '10.2.17.9'", "template": "template = 'tpl 17'", "code and time": "code_int = 500 AND event_time < '2023-11-18'"}


@pytest.mark.parametrize("name", FILTERS)
def test_same_rows_and_fewer_read(both, name):
    plain, clustered, _ = both
    want, found = plain.filter(FILTERS[name]), clustered.filter(FILTERS[name])
    assert sorted(r["line_no"] for r in found.collect()) == sorted(r["line_no"] for r in want.collect())
    assert skipping.rows_read(found)[1] < 0.6 * skipping.rows_read(want)[1], (skipping.rows_read(found), skipping.rows_read(want))


def test_nothing_is_lost(both):
    plain, clustered, _ = both
    assert clustered.count() == 60_000 and clustered.select(*plain.columns).exceptAll(plain).isEmpty()
    spec = FilterSpec(code="500", tpl="tpl 5")
    assert apply_filter(clustered, spec).count() == apply_filter(plain, spec).count() > 0


def test_bloom_filters_are_written(both):
    path = glob.glob(f"{both[2]}/clustered/*/*/*.parquet")[0]
    meta = pq.ParquetFile(path).metadata
    at = {meta.row_group(0).column(i).path_in_schema: i for i in range(meta.num_columns)}
    size = {n: meta.row_group(0).column(i).total_compressed_size for n, i in at.items()}
    with open(path, "rb") as f:
        held = len(f.read())
    # Blooms lie between the column chunks and the footer: far more bytes than the columns have.
    assert held > sum(sum(meta.row_group(g).column(i).total_compressed_size for i in range(meta.num_columns))
                      for g in range(meta.num_row_groups)) + size["ip"]


def test_an_empty_table_and_one_value(spark, both, tmp_path):
    plain = both[0]
    skipping.write_clustered(plain.limit(0).unionByName(plain.filter("line_no = 5")), str(tmp_path / "one"))
    assert tables.read_rows(spark, str(tmp_path / "one")).count() == 1
    assert set(skipping.step_bounds(plain.limit(0)).values().__iter__().__next__()) == set()


def test_the_curve_runs_no_lambda_over_the_bounds(spark, both):
    """A row's steps are found by a binary search in compiled code, and are as many bounds as
    its value has reached."""
    rows = both[0].limit(2_000).localCheckpoint()
    bounds = skipping.step_bounds(both[0])
    curve = skipping.with_curve(rows, bounds)
    assert "lambda" not in curve._jdf.queryExecution().optimizedPlan().toString()
    dims = rows.select("line_no", *[c.alias(n) for n, c in skipping.dimensions().items()]).collect()
    names = list(skipping.dimensions())
    steps = {r["line_no"]: [sum(b <= r[n] for b in bounds[n]) for n in names] for r in dims}
    for r in curve.select("line_no", "_z").collect():
        got = [sum((r["_z"] >> (bit * len(names) + k) & 1) << bit for bit in range(skipping.BITS)) for k in range(len(names))]
        assert got == steps[r["line_no"]]
