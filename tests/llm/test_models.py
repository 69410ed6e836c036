"""Classifiers, language profiles, mixing, rules, counts, licences and the word index."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logquarry.llm import (cotraining, decontaminate, language_id, license_scan, mixing, quality_rules, token_rollup)
from logquarry.llm.common import stored
from logquarry.llm.fm_index import FMIndex
from logquarry.llm.words import NOT_ALNUM, SPACE, words

SF = "/root/testdata/sf0.01"


def test_memory_of_a_worker_does_not_follow_the_batch(prose):
    import tracemalloc

    from logquarry.llm.jaccard_join import Sets
    texts = pa.array([prose(1, 400)] * 3000)
    tracemalloc.start()
    for w in words(texts, lower=True):
        Sets(w, 4).ids()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 4 << 20 and peak < 24 << 20


@pytest.mark.parametrize("separators,pattern", [(SPACE, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_words(separators, pattern, piece):
    r = random.Random(piece)
    texts = [None, "", "a", "ab"] + ["".join(r.choice("ab C\n\t\x0b-9é　\U0001F600") for _ in range(r.randrange(30))) for _ in range(60)]
    got, codes = {i: [] for i in range(len(texts))}, {}
    for w in words(pa.array(texts), separators, lower=True, piece_bytes=piece):
        for k, (row, s, e) in enumerate(zip(w.row, w.start, w.end)):
            word = w.data[s:e].tobytes()
            got[w.first + int(row)].append(word.decode())
            assert codes.setdefault(word, w.code[k]) == w.code[k]
        assert [int(x) for x in np.diff(w.bounds)] == [int((w.row == r).sum()) for r in range(w.rows)]
    ascii_lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert got == {i: re.findall(pattern, t) for i, t in enumerate(ascii_lower)}
    assert len(set(codes.values())) == len(codes)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_what_a_scan_finds(seed):
    r = np.random.default_rng(seed)
    text = np.concatenate([np.append(r.integers(1, 5, r.integers(1, 40)), 0) for _ in range(30)] + [np.array([1, 1, 1, 1, 0])] * 2)
    index = FMIndex(text, 4, sample=3)
    phrases = [text[a:a + n] for a in range(0, len(text) - 4, 3) for n in (1, 2, 4) if (text[a:a + n] > 0).all()]
    phrases += [np.array([4, 4, 4, 4]), np.array([1, 2, 3, 4])]
    grid = np.array([np.append(np.zeros(4 - len(p), int), p) for p in phrases])
    low, high = index.search(grid, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text)) if text[i:i + len(p)].tolist() == p.tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_in_passes_and_shards(ready):
    docs = ready.read.parquet(f"{SF}/documents.parquet")
    bench = ready.read.parquet(f"{SF}/benchmark.parquet")

    def rows(**more):
        return sorted((r["doc_id"], r["n_words"], r["n_hit"], str(r["spans"]), sorted(r["items"]), r["contaminated"])
                      for r in decontaminate.contamination(docs, bench, **more).collect())
    whole = rows()
    assert any(r[-1] for r in whole)
    assert rows(block_words=600) == whole and rows(shard_words=50) == whole


def test_language_of_held_out_documents(ready):
    docs = ready.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.learn(docs.where(~language_id.held_out()))).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in out]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_bundles_by_hand():
    text, size = "Ab, çaß 1 ab", 128
    sequence = [0, *map(ord, "ab"), 0, *map(ord, "çaß"), 0, *map(ord, "ab"), 0]
    vector = lambda p: language_id.letter_vectors(np.array([p]), size)[0].astype(int)     # noqa: E731
    want = sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(sequence, sequence[1:], sequence[2:]))
    found = language_id.Trigrams([text, ""], size)
    got = sum(counts.astype(np.float64) @ vectors for counts, vectors in found.blocks())
    assert (got[0] == want).all() and found.has_letter.tolist() == [True, False]


def test_classifier_on_labels_it_did_not_learn_from(ready):
    sf = "/root/testdata/sf0.1"
    labels = ready.read.parquet(f"{sf}/labels.parquet")
    held = labels.where(cotraining.held_back() & (cotraining.F.col("doc_id") % 2 == 0))
    got = cotraining.classify(ready.read.parquet(f"{sf}/documents.parquet"), labels.join(held, "doc_id", "left_anti"))
    rows = got.join(held, "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in rows if r["quality"] == 0 or r["toxic"] == 1]
    assert len(clean) > 200 and np.mean(clean) > 0.99 and len(bad) > 50 and np.mean(bad) < 0.2


def test_every_label_counts_beside_many_pseudo_labels(ready):
    """40 labels of the text's views beside 4,000 of the page's: the fit over Spark's sums uses them all."""
    r = random.Random(3)
    rows = []
    for i in range(4000):
        good = r.random() < .5
        y = float(good) if i % 100 == 0 else None
        rows.append((i, [int(good), 500], [r.randrange(5) * 2 + good], y, float(good), y, float(good)))
    names = ", ".join(f"{y} double" for y in cotraining.Y.values())
    data = stored(ready.createDataFrame(rows, f"doc_id long, text_tokens array<int>, meta_tokens array<int>, {names}"), "test-views")
    few, all_ = (cotraining.fit(data, 2.0, 64, n) for n in (100, 10_000))
    for a, b in zip(few, all_):
        assert np.abs(b.weights).max() > 1 and np.allclose(a.weights, b.weights, atol=1e-3)


def test_mixture_meets_its_targets(ready):
    docs = ready.read.parquet(f"{SF}/documents.parquet")
    labelled = mixing.labelled_domains(docs, ready.read.parquet(f"{SF}/labels.parquet"))
    domains = mixing.learn_domains(labelled, sorted(mixing.TARGETS))
    members = stored(mixing.memberships(docs, domains), "test-members")
    shares = [mixing.TARGETS.get(d, 0.0) for d in domains.names]
    got = mixing.fit_rates(members, shares, budget=1e6).toPandas()
    for k, s in enumerate(shares):
        assert abs((got["tokens"] * got[f"p{k}"] * got["rate"]).sum() - s * 1e6) <= 1e3 + 1
    assert (got["rate"] >= 0).all()
    want = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    assert dict(zip(got["doc_id"], got["tokens"])) == want


def test_rare_domains_of_a_large_labelled_table(ready):
    rare = [f"rare{k}" for k in range(8)]
    rows = [(" ".join(f"c{(i * j) % 97}" for j in range(1, 9)) + f" x{i}", "common") for i in range(12_000)]
    rows += [(f"r{k}a r{k}b " * 5, name) for k, name in enumerate(rare)]
    domains = mixing.learn_domains(ready.createDataFrame(rows, "text string, domain string"), ["common", *rare])
    assert domains.names == ["common", *rare]
    docs = ready.createDataFrame([(1, "c1 c2 c3 c4 c5"), (2, "r3a r3b r3a"), (3, "c10 c11 c90 c7")], "doc_id long, text string")
    got = {r["doc_id"]: [r[f"p{k}"] for k in range(9)] for r in mixing.memberships(docs, domains).collect()}
    assert [domains.names[int(np.argmax(got[i]))] for i in (1, 2, 3)] == ["common", "rare3", "common"]


def test_rates_of_a_small_case(ready):
    """Two documents of pure domains and one that has both: the totals are what they must be."""
    members = stored(ready.createDataFrame([(1, 100, 1.0, 0.0), (2, 50, 0.0, 1.0), (3, 40, 0.5, 0.5)],
                                           "doc_id long, tokens long, p0 double, p1 double"), "test-members")
    got = mixing.fit_rates(members, [0.25, 0.75], budget=200.0, tolerance=1e-6).toPandas()
    assert abs((got.tokens * got.p0 * got.rate).sum() - 50) < .01 and abs((got.tokens * got.p1 * got.rate).sum() - 150) < .01


def test_native_operators_run_no_python(ready):
    for name in ("op2_mixing", "op6_quality_rules"):
        from logquarry.llm.registry import QUERIES
        plan = QUERIES[name](ready, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_cascade_order_changes_no_verdict(ready, documents):
    docs = documents({1: "a clean text of ten words or more stands in here", 2: "x | y | z | a | b | c | d | e", 3: "NO " * 3 + "SHOUTING HERE PLEASE BUT READ ON AND ON NOW"})
    rules = quality_rules.RULES
    order = quality_rules.cascade_order(docs, rules)
    assert sorted(e.rule.name for e in order) == sorted(r.name for r in rules)
    assert order[0].rejected > 0 and order[-1].rejected == 0        # those that reject come first
    verdicts = [quality_rules.measured(docs).withColumn("ok", quality_rules.passes(o)).select("doc_id", "ok").collect()
                for o in (order, order[::-1])]
    assert sorted(verdicts[0]) == sorted(verdicts[1]) and {r["doc_id"] for r in verdicts[0] if r["ok"]} == {1}


def test_rollup_against_a_ledger_by_hand(ready, tmp_path):
    r, rollup, state = random.Random(5), token_rollup.Rollup(ready, f"{tmp_path}/rollup"), {}
    for batch in range(1, 5):
        changes = []
        for d in r.sample(range(12), 6):
            op = r.choice([token_rollup.INSERT, token_rollup.REVISE, token_rollup.DELETE])
            text = " ".join("w" * r.randrange(1, 3) for _ in range(r.randrange(6))) if r.random() < .9 else None
            changes.append((op, d, r.choice(["a", None]), r.choice(["en", "de"]), text))
            if op == token_rollup.DELETE:
                state.pop(d, None)
            else:
                state[d] = changes[-1][2:]
        rows = ready.createDataFrame(changes, "op string, doc_id long, source string, lang string, text string")
        assert rollup.apply(rows, batch) and not rollup.apply(rows, batch)      # sent twice, counted once
        want = {}
        for source, lang, text in state.values():
            docs, tokens = want.get((source, lang), (0, 0))
            want[source, lang] = docs + 1, tokens + len((text or "").split())
        got = rollup.totals().where("tokenizer = 'words-1'").collect()
        assert {(x["source"], x["lang"]): (x["docs"], x["tokens"]) for x in got} == want
    with pytest.raises(ValueError):
        rollup.apply(rows, 0)
    (tmp_path / "rollup" / "deltas" / "9").mkdir()                              # a batch that was never committed
    assert rollup.committed() == [1, 2, 3, 4]
    assert token_rollup.Rollup(ready, f"{tmp_path}/rollup").totals().count() == rollup.totals().count()


def test_rollup_with_a_public_vocabulary(ready, tmp_path):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    tokenizers = pytest.importorskip("tokenizers")
    rollup = token_rollup.Rollup(ready, f"{tmp_path}/rollup", token_rollup.vocabulary_counter(path, "bpe-50k"))
    texts = ["some plain words", "", None, "<|endoftext|> é"]
    rollup.apply(ready.createDataFrame([("insert", i, "s", "en", t) for i, t in enumerate(texts)],
                                       "op string, doc_id long, source string, lang string, text string"), 1)
    encoder = tokenizers.Tokenizer.from_file(path)
    encoder.encode_special_tokens = True
    want = sum(len(encoder.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert [(r["tokenizer"], r["docs"], r["tokens"]) for r in rollup.totals().collect()] == [("bpe-50k", 4, want)]


MIT = license_scan.TEMPLATES["MIT text"]


@pytest.mark.parametrize("text,license,matches", [
    ("some words before. Released under the MIT License. and some after", "MIT", 1),
    ("Released under the MIT License.\nmore\n" + "filler " * 40 + "Released under the MIT License.", "MIT", 2),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 1),
    (MIT.replace("free of charge", "for a small fee").replace("sublicense", "lend"), "MIT text", 1),
    ("the and of this is under", None, 0), ("license", None, 0), (" ".join(MIT.split()[::-1]), None, 0)])
def test_licences(ready, documents, text, license, matches):
    got = license_scan.scan(documents({1: text})).collect()[0]["matches"]
    assert len(got) == matches and (got[0]["license"] if got else None) == license


def found_in(text):
    known = license_scan.templates(license_scan.TEMPLATES)
    codes = license_scan.codes_of(text).tolist()
    hits = [i for i, c in enumerate(codes) if any(c in t.telling for t in known)]
    return [(m[1], m[0]) for m in license_scan.scan_text(codes, hits, known, license_scan.LEAST_COVERAGE)]


def test_notices_side_by_side_and_interrupted():
    twice = "text. Released under the MIT License. Released under the MIT License. more"
    assert found_in(twice) == [("MIT", 1.0)] * 2
    assert found_in(f"{MIT} {MIT}") == [("MIT text", 1.0)] * 2
    parts = MIT.split()
    (name, coverage), = found_in(" ".join([*parts[:45], *["zz"] * 14, *parts[45:]]))
    assert name == "MIT text" and 0.8 <= coverage < 1


def test_an_inserted_word_names_another_licence():
    for name in ("LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "BSD-3-Clause", "LGPL header"):
        assert found_in(license_scan.TEMPLATES[name]) == [(name, 1.0)]
    (name, coverage), = found_in("This work is licensed under the GNU Sleepy General Public License, version 3.")
    assert name.split("-")[0] in ("GPL", "LGPL", "AGPL") and coverage < 1


def test_alignment_is_ordered_and_longest_runs_are_longest():
    r = random.Random(1)
    for _ in range(200):
        a, b = [r.randrange(9) for _ in range(r.randrange(14))], [r.randrange(9) for _ in range(r.randrange(14))]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:]))
        run = license_scan.longest_increasing(a)
        best = [1] * len(a)
        for i in range(len(a)):
            best[i] += max([best[j] for j in range(i) if a[j] < a[i]], default=0)
        assert len(run) == max(best, default=0) and all(a[p] < a[q] for p, q in zip(run, run[1:]))


def test_no_notice_is_lost_by_the_choice_of_regions(ready):
    """Against an alignment of every window of every document with every template."""
    known = license_scan.templates(license_scan.TEMPLATES)
    docs = ready.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in license_scan.scan(docs).collect()}
    for row in docs.collect():
        codes = license_scan.codes_of(row["text"]).tolist()
        exact = {t.name for t in known for i in range(len(codes)) if codes[i:i + len(t.codes)] == t.codes}
        assert exact <= got[row["doc_id"]] and bool(exact) == bool(got[row["doc_id"]])


def test_labelled_texts_beyond_the_broadcast(ready):
    docs, labels = ready.read.parquet(f"{SF}/documents.parquet"), ready.read.parquet(f"{SF}/labels.parquet")
    few = mixing.labelled_domains(docs, labels).collect()
    assert few and sorted(map(str, few)) == sorted(map(str, mixing.labelled_domains(docs, labels, most=0).collect()))
