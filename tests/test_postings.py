"""The posting table against plain phrases, what it reads, and how it is stored."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logquarry.operators import filters
from logquarry.operators.postings import PostingTable

WORDS = ["red", "Green", "blue", "olé", "x1", "the", "the", "the", "漢字"]


@pytest.fixture
def texts(spark):
    r = random.Random(5)
    data = [(f"f{r.randrange(3)}", i, None if i % 97 == 0 else r.choice(["  ", "", ", "]).join(
        r.choice(WORDS) + r.choice([" ", "-", "! "]) for _ in range(r.randrange(12)))) for i in range(4000)]
    return spark.createDataFrame(data, "file string, line_no long, search string").repartition(3)


def keys(df):
    return sorted((r["file"], r["line_no"]) for r in df.collect())


@pytest.mark.parametrize("terms", ["red green", "the the", "the the the,!ole", "OLÉ", "blue-red,x1 漢字,!the red", "green",
                                   "none of these", "!red", "!red,!blue", " , ", "?!", "red red red red,!the"])
def test_same_rows_as_a_scan(spark, texts, tmp_path, terms):
    index = PostingTable(spark, str(tmp_path))
    index.append(texts.filter("line_no < 1700"))
    index.append(texts.filter("line_no >= 1700"))
    parsed = filters.parse_terms(terms)
    want = texts if parsed is None else texts.filter(filters.phrase_terms(F.col("search"), parsed))
    assert keys(index.search(texts, terms)) == keys(want)


def test_a_file_that_was_never_indexed_and_an_empty_part(spark, texts, tmp_path):
    index = PostingTable(spark, str(tmp_path))
    index.append(texts.limit(0))
    assert index.search(texts, "red").count() == 0
    index.append(texts.filter("file = 'f1'"))
    assert {r["file"] for r in index.search(texts, "the").select("file").distinct().collect()} == {"f1"}


def test_only_blocks_of_the_rarest_token_are_looked_at(spark, tmp_path):
    """One rare word in one block of 40: of the frequent one, that block alone."""
    lines = spark.range(40 * 1024).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.when(
        F.col("id") == 20_000, "a rare word").otherwise("a usual word").alias("search"))
    index = PostingTable(spark, str(tmp_path))
    index.append(lines)
    got = index.looked_at("a rare word").first()
    assert (got["rarest"], got["rarest_blocks"], got["all_blocks"], got["read_blocks"]) == ("rare", 1, 81, 3)
    assert keys(index.search(lines, "a rare word")) == [("f", 20_000)]


def test_places_are_stored_as_deltas_and_tokens_in_ranges(spark, tmp_path):
    lines = spark.range(200_000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"),
                                        F.concat(F.lit("w x"), F.col("id") % 50).alias("search"))
    PostingTable(spark, str(tmp_path)).append(lines)
    spans = []
    for path in glob.glob(f"{tmp_path}/postings/*/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["at.list.element"].encodings
            spans.append((columns["token"].statistics.min, columns["token"].statistics.max))
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_the_filter_on_a_token_reaches_the_scan(spark, texts, tmp_path):
    index = PostingTable(spark, str(tmp_path))
    index.append(texts)
    plan = index.blocks("red")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,red)" in plan


def test_postings_are_dealt_out_once(spark, lines, tmp_path, monkeypatch):
    """Lines of a block come from several tasks and batches, some without a number or file; a
    token's places in a block are one ascending row, and one shuffle brings them there."""
    from logquarry.operators import postings as p
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.range(40, numPartitions=4).select(
            F.when(F.col("id") != 7, F.concat(F.lit("f"), F.col("id") % 3)).alias("file"),
            F.when(F.col("id") != 8, F.col("id") * 100).alias("line_no"),
            F.when(F.col("id") != 9, F.concat_ws(" ", F.lit("Ab cd, ab"), F.col("id") % 4)).alias("value"))
        cut = rows.select("file", "line_no", F.posexplode(p.tokens_of("value")).alias("pos", "token")).collect()
        want = {}
        for r in cut:
            none = r["line_no"] is None
            places = want.setdefault((r["token"], r["file"], None if none else r["line_no"] >> 10), [])
            places += [] if none else [((r["line_no"] & 1023) << 40) + r["pos"]]
        index = PostingTable(spark, str(tmp_path / "index"))
        index.append(rows, "value")
        for found in (index.read(), p.postings(rows, "value")):
            got = [((r["token"], r["file"], r["block"]), r["at"]) for r in found.select(*p.SCHEMA.replace(",", "").split()[0:6:2], "at").collect()]
            assert len(got) == len(want) and dict(got) == {k: sorted(v) for k, v in want.items()}
        plan = p.whole(p.gathered(rows, "value").repartitionByRange("token", *p.KEYS))
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert p.postings(rows.limit(0), "value").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
