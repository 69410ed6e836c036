"""Every operator and stage on odd and on empty tables: no crash, one row per row, defined results."""

import pytest

import corpus_pipeline as P
from logquarry.llm import (cotraining, decontaminate, jaccard_join, language_id, license_scan, line_dedup, mixing,
                           quality_rules, substring_dedup)

LABELS = [(1, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 0), (6, 0, 0), (7, 1, None)]
BENCH = [(1, "the same few words stand here in this text and in that one too"), (2, None), (None, "another text"), (2, "")]


def operators(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    return {
        "license": license_scan.scan,
        "mixing": lambda d: mixing.mix(d, mixing.labelled_domains(d, labels)),
        "cotraining": lambda d: cotraining.classify(d, labels),
        "language": lambda d: language_id.identify(d, language_id.learn(d)),
        "rules": quality_rules.judge,
        "lines": lambda d: line_dedup.dedup_lines(d, min_docs=2),
        "substrings": substring_dedup.dedup_substrings,
        "jaccard": jaccard_join.jaccard_components,
        "decontamination": lambda d: decontaminate.contamination(d, bench),
    }


NAMES = ["license", "mixing", "cotraining", "language", "rules", "lines", "substrings", "jaccard", "decontamination"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(ready, odd, name):
    rows = operators(ready)[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    null, empty = by_id[3][0], by_id[4][0]
    if name == "language":
        assert (null["lang_pred"], null["score"]) == ("und", 0) and empty["lang_pred"] == "und"
    if name == "rules":
        assert null["n_words"] == 0 and null["base_failed"] and not null["kept"]
    if name == "lines":
        assert (null["text"], null["n_lines"], null["n_dropped"]) == ("", 1, 0)
        assert by_id[2][0]["text"] == "" and by_id[None][0]["text"] == ""      # a null id is a document too
    if name == "substrings":
        assert null["n_words"] == 0 and by_id[2][0]["n_removed"] == by_id[2][0]["n_words"] == 16
        assert [r["n_removed"] for r in by_id[1]] == [0, 0, 0] and by_id[None][0]["n_removed"] == 0
    if name == "jaccard":
        assert by_id[2][0]["component_id"] == 1 and null["component_id"] == 3 and null["n_shingles"] == 0
        assert by_id[None][0]["component_id"] is None and {r["component_id"] for r in by_id[1]} == {1}
    if name == "decontamination":
        assert by_id[2][0]["contaminated"] and by_id[2][0]["items"] == [1] and not null["contaminated"]
        taken = next(r for r in by_id[1] if r["n_words"] == 9)
        assert taken["n_hit"] == 2 and taken["items"] == []                    # an item without id is not listed


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(ready, odd, name):
    assert operators(ready)[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(ready, odd, tmp_path, stage):
    ready.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ready.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.STAGES[stage][1](ready, odd, str(tmp_path))
    if stage < 4:
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert out.count() <= odd.count()
    assert P.STAGES[stage][1](ready, odd.limit(0), str(tmp_path)).count() == 0


def test_nothing_learned(ready, documents, labels):
    docs = documents({1: "some words", 2: None})
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert all(r["kept"] for r in cotraining.classify(docs, labels([])).collect())
    assert {r["rate"] for r in mixing.mix(docs, docs.limit(0).selectExpr("text", "lang AS domain")).collect()} == {1.0}
    assert not any(r["contaminated"] for r in decontaminate.contamination(
        docs, ready.createDataFrame([], "item_id long, text string")).collect())
