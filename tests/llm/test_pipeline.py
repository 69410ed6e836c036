"""The pipeline at a small scale: each stage against its operator and against brute force."""

import duckdb
import pytest

import corpus_pipeline as P
from logquarry.llm.common import stored
from test_dedup import groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(ready):
    docs, out = ready.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        out.append((docs, stored(stage(ready, docs, SF), "test-stage")))
        docs = out[-1][1]
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "near duplicates", "decontamination", "mixing"]
    for before, after in stages[:4]:
        assert after.dtypes == before.dtypes


def test_lines(stages):
    before, after = stages[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    holders = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()          # noqa: E731
    for d, t in texts.items():
        for k in {key(x) for x in t.split("\n")} - {b""}:
            holders.setdefault(k, set()).add(d)
    want = {d: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 10) for d, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want


def test_near_duplicates(stages):
    before, after = stages[2]
    found = groups({r["doc_id"]: r["text"] for r in before.collect()}, P.NEAR_WORDS, P.NEAR_PERCENT)
    assert {r["doc_id"] for r in after.collect()} == {d for d, (_, c) in found.items() if c == d}


def test_decontamination(stages):
    from logquarry.llm.decontaminate import SQL
    before, after = stages[3]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL}) WHERE NOT contaminated").fetchall()}
    assert {r["doc_id"] for r in after.collect()} == want


def test_quality_keeps_clean_documents(stages, ready):
    before, after = stages[0]
    clean = ready.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0")
    assert clean.join(after, "doc_id").count() >= 0.98 * clean.count() and after.count() < before.count()


def test_mixture_covers_what_is_left(stages):
    before, after = stages[4]
    assert sorted(r["doc_id"] for r in before.collect()) == sorted(r["doc_id"] for r in after.collect())
