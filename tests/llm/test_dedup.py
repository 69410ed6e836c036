"""Line, substring and near-duplicate operators against brute force."""

import random
import re
from collections import defaultdict

import pytest

from logquarry.llm import jaccard_join, line_dedup, substring_dedup
from logquarry.llm.common import stored


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed(docs, length):
    first, out = {}, {}
    for d, t in sorted(docs.items()):
        w = words(t)
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i:i + length]), d)
    for d, t in docs.items():
        w = words(t)
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i:i + length])] < d for j in range(i, i + length)}
        out[d] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def passages(seed, n, prose):
    """Texts made of shared passages, cut and joined at random places."""
    r = random.Random(seed)
    pool = [prose(100 + k, 60, 12) for k in range(6)]
    out = {}
    for d in range(n):
        parts = []
        for _ in range(r.randrange(4)):
            w = r.choice(pool).split()
            a = r.randrange(40)
            parts += w[a:a + r.randrange(1, 25)] + prose(r.random(), r.randrange(6), 9).split()
        out[d * 3] = " ".join(parts)
    return out


@pytest.mark.parametrize("length,seed,most", [(13, 5, 4_000_000), (13, 5, 0), (5, 3, 4_000_000)])
def test_substrings(ready, documents, prose, length, seed, most):
    docs = passages(length + most % 7, 60, prose)
    got = substring_dedup.dedup_substrings(documents(docs), length, seed, most).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got} == removed(docs, length)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def shingles(text, size):
    w = [x.encode().lower() for x in words(text)]
    return {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def groups(docs, size, percent):
    sets = {d: shingles(t, size) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def variants(seed, prose, families=6, members=14):
    """Families of texts at growing distance from each other, so links form chains."""
    r = random.Random(seed)
    out = {}
    for f in range(families):
        w = prose(f"{seed}/{f}", r.choice([3, 12, 40, 90]), 300).split()
        for _ in range(members):
            out[len(out) * 2 + 1] = " ".join(w)
            if r.random() < 0.8:
                for _ in range(r.randrange(1, 3)):
                    w[r.randrange(len(w))] = f"n{r.randrange(99)}"
            if r.random() < 0.3:
                w = w + [f"t{r.randrange(99)}"]
    out[1000], out[1001] = "", None
    return out


@pytest.mark.parametrize("seed,size,percent,most", [(1, 4, 85, 4_000_000), (2, 4, 85, 0), (3, 5, 80, 4_000_000)])
def test_jaccard(ready, documents, prose, seed, size, percent, most):
    docs = variants(seed, prose)
    got = jaccard_join.jaccard_components(documents(docs), size, percent, most).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(docs, size, percent)


def test_jaccard_of_a_large_group_of_near_copies(ready, documents, prose):
    """Distances around the threshold within one group: later leaders are needed."""
    base, docs = prose("base", 60, 5000).split(), {}
    for d in range(150):
        w, r = list(base), random.Random(d)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"x{d}"
        docs[d] = " ".join(w)
    got = jaccard_join.jaccard_components(documents(docs)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: g for d, (_, g) in groups(docs, 4, 85).items()}


@pytest.mark.parametrize("at_once,rounds", [(0, 5), (8, 1)])
def test_jaccard_leads_few_pairs_at_once(ready, documents, prose, monkeypatch, at_once, rounds):
    """Rounds of 1, 2, 4 .. leaders while many pairs are left, else one; the same groups."""
    base, docs, seen = prose("base", 60, 5000).split(), {}, []
    for d in range(40):
        w, r = list(base), random.Random(d)
        for k in range(r.randrange(12)):
            w[r.randrange(60)] = f"x{d}/{k}"
        docs[d] = " ".join(w)
    plain = jaccard_join.candidates
    monkeypatch.setattr(jaccard_join, "candidates", lambda *a: seen.append(a[1:3]) or plain(*a))
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", at_once, raising=False)
    got = jaccard_join.jaccard_components(documents(docs)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: g for d, (_, g) in groups(docs, 4, 85).items()}
    assert 1 <= len(seen) <= rounds


def test_jaccard_lists_and_leaders_in_one_shuffle(ready):
    r = random.Random(4)
    rows = [(t, bytes([s]), n, min(r.randrange(n), r.randrange(n))) for t in range(40) for s in range(r.randrange(1, 5))
            for n in [r.randrange(8, 30)]]
    lists = jaccard_join.led_lists(ready.createDataFrame(rows, "token long, sid binary, n long, i long"), 85)
    got = {(x["token"], bytes(x["sid"])): (bytes(x["leader"]), x["l_n"], x["l_i"]) for x in lists.collect()}

    def meet(x, y):
        (_, _, n, i), (_, _, m, j) = sorted((x, y), key=lambda e: e[2])
        need = -(-85 * (n + m) // 185)
        return 100 * n >= 85 * m and min(n - i, m - j) >= need
    for x in rows:
        others = [y for y in rows if y[0] == x[0] and y[1] != x[1]]
        if any(meet(x, y) for y in others):
            assert x[:2] in got
    for token in {t for t, _ in got}:
        kept = [x for x in rows if x[:2] in got and x[0] == token]
        assert len(kept) > 1 and {got[x[:2]] for x in kept} == {min(x[1:] for x in kept)}
    plan = lists._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_line_runs_are_levelled(ready, documents):
    runs, seen = line_dedup.LineRuns(ready, fanout=2), defaultdict(set)
    for batch in range(5):
        docs = {batch * 10 + i: f"shared\nown {batch}\n{'even' if i % 2 else 'odd'}" for i in range(3)}
        for d, t in docs.items():
            for line in t.split("\n"):
                seen[line].add(d)
        run = runs.add(line_dedup.document_keys(documents(docs)))
        assert run.entries.count() == (4 if not batch else 1) and run.increments.count() == (3 if batch else 0)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    want = {line_dedup.key_hash(k.encode()) for k, ds in seen.items() if len(ds) >= 5}
    assert {(r["h1"], r["h2"]) for r in runs.frequent(5).collect()} == want


def test_lines_keys_and_counts(ready, documents):
    docs = documents({1: "A line \n\nmy É", 2: "\ta LINE\nMY é", 3: "a line\n a line", 4: "other"})
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    assert got[1]["text"] == "\nmy É" and got[2]["text"] == "MY é" and got[3]["text"] == ""
    assert [got[d]["n_dropped"] for d in (1, 2, 3, 4)] == [1, 1, 2, 0]
    again = line_dedup.without_frequent_lines(docs, min_docs=3)
    assert again.columns == docs.columns and {r["n_chars"] for r in again.where("doc_id = 3").collect()} == {0}


def test_components_of_a_long_chain(ready):
    from logquarry.llm.components import components
    links = stored(ready.range(40).selectExpr("(id * 17) % 41 AS a", "((id + 1) * 17) % 41 AS b"), "test-links")
    assert {r["label"] for r in components(links).collect()} == {0}


def test_a_copy_without_id_does_not_part_near_copies(documents, prose):
    first = prose(11, 100)
    near = first.rsplit(" ", 1)[0] + " other"
    got = jaccard_join.jaccard_components(documents([(None, first), (1, first), (2, near), (3, prose(12, 100))])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {None: None, 1: 1, 2: 1, 3: 3}


def test_the_query_compacts_a_level(ready, documents, prose):
    """More batches than the fanout: on the query's own path a level is merged, and a key has one entry."""
    docs = {d: f"shared line\nodd {d % 2}\nown {d}" for d in range(60)}
    keys, frequent, runs = line_dedup.frequent_lines(documents(docs), min_docs=10)
    assert [len(level) for level in runs.levels] == [1, 1]
    entries = line_dedup.united([r.entries for r in runs.runs()])
    assert entries.count() == entries.select("h1", "h2").distinct().count() == keys.select("h1", "h2").distinct().count()
    want = {line_dedup.key_hash(k) for k in (b"shared line", b"odd 0", b"odd 1")}
    assert {(r["h1"], r["h2"]) for r in frequent.collect()} == want


def test_many_frequent_lines_are_joined(documents):
    docs = documents([(1, "a\nb\nc"), (2, "A \nb\nd"), (None, "a\nb"), (3, None), (3, "")])
    sent = line_dedup.dedup_lines(docs, min_docs=3).collect()
    joined = line_dedup.dedup_lines(docs, min_docs=3, most=0).collect()
    assert sorted(map(str, sent)) == sorted(map(str, joined)) and sum(r["n_dropped"] for r in sent) == 6


def test_jaccard_beyond_the_broadcast(ready, documents, prose):
    docs = variants(5, prose)
    got = jaccard_join.jaccard_components(documents(docs), most=0).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(docs, 4, 85)


def test_without_many_keys(ready, documents):
    from logquarry.llm.common import without
    docs = documents([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)])
    for ids, left in (([1, None], ["2", "3"]), ([2], ["1", "1", "3", "None"]), ([], ["1", "1", "2", "3", "None"])):
        dropped = ready.createDataFrame([(i,) for i in ids], "doc_id long")
        for most in (0, 10):
            assert sorted(str(r["doc_id"]) for r in without(docs, dropped, most=most).collect()) == left


@pytest.mark.parametrize("percent", [80, 85, 50])
def test_linked_sets_share_a_segment_early(percent, prose):
    """Any two linked sets meet in a list, no later than what they can differ by; no list is all of a large table."""
    import numpy as np
    import pyarrow as pa
    from logquarry.llm import words as w
    r, texts = random.Random(percent), []
    for f in range(40):
        base = prose(f"{percent}/{f}", r.choice([1, 4, 7, 9, 14, 30, 80, 400]), 5000).split()
        for _ in range(8):
            texts.append(" ".join(base))
            base = base[:r.randrange(1, 4)] + base if r.random() < .3 else list(base)
            for _ in range(r.randrange(3)):
                base[r.randrange(len(base))] = f"n{r.random()}"
    piece, = w.words(pa.array(texts), lower=True, piece_bytes=1 << 30)
    s = jaccard_join.Sets(piece, 4)
    for seeds in (jaccard_join.SEEDS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jaccard_join, "SEEDS", seeds)
            row, token, place = s.segments(percent)
        lists = [dict(zip(token[row == k], place[row == k])) for k in range(len(texts))]
        sets = [set(s.code[a:b].tolist()) for a, b in zip(s.bounds[:-1], s.bounds[1:])]
        assert s.segments(percent)[0].max() > 0 and len(set(map(tuple, np.column_stack([row, token.astype(np.int64)])))) == len(row)
        for x in range(len(sets)):
            for y in range(x):
                o, most = len(sets[x] & sets[y]), len(sets[x]) + len(sets[y])
                if sets[x] != sets[y] and 100 * o >= percent * (most - o):
                    met = [max(lists[x][t], lists[y][t]) for t in lists[x].keys() & lists[y].keys()]
                    assert met and min(met) <= most - 2 * o


def test_sets_with_frequent_shingles_in_common_are_not_listed_together(ready, documents, prose):
    """Every text has some of the same phrases, none is much like another: no list, and nothing to compare."""
    phrases = [prose(k, 8, 10 ** 6) for k in range(30)]
    docs = {}
    for d in range(200):
        r = random.Random(d)
        docs[d] = " ".join(x for _ in range(6) for x in (r.choice(phrases), prose(r.random(), 7, 10 ** 6)))
    entries = jaccard_join.index(documents(docs), 4, 85, 1000)
    assert entries.count() < 40
    one = list(docs.values())[0].split()
    docs[500] = " ".join(one[:-1] + ["other"])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(documents(docs)).collect()} == {
        **{d: d for d in docs}, 500: 0}


def test_lists_of_the_same_sets_are_kept_once(ready):
    byte = 1 << 56
    rows = [(byte + t, bytes([s]), 50, i) for t, i in ((5, 4), (6, 2), (7, 3)) for s in (1, 2)]
    rows += [(byte + 8, bytes([s]), 50, 0) for s in (1, 2, 3)] + [(2 * byte, bytes([s]), 50, 0) for s in (1, 2)]
    kept = jaccard_join.different_lists(stored(ready.createDataFrame(rows, "token long, sid binary, n long, i long"), "test-entries"))
    assert {(r["token"] - byte, bytes(r["sid"])[0]) for r in kept.collect()} == {(6, 1), (6, 2), (8, 1), (8, 2), (8, 3)}


def test_bits_differ_no_more_than_sets(prose):
    import numpy as np
    import pyarrow as pa
    from logquarry.llm import words as w
    texts = ["", None, *(prose(k % 7, 5 + 40 * (k % 3)) + f" e{k}" * (k % 4) for k in range(40))]
    piece, = w.words(pa.array(texts), lower=True)
    s = jaccard_join.Sets(piece, 4)
    sets, bits = [set(s.code[a:b].tolist()) for a, b in zip(s.bounds[:-1], s.bounds[1:])], s.bits()
    assert bits.shape == (len(texts), 4) and not bits[:2].any()
    far = [(bin(int(np.bitwise_xor(x, y).view(np.uint8).astype(object) @ [256 ** k for k in range(32)])).count("1"), len(a ^ b))
           for x, a in zip(bits, sets) for y, b in zip(bits, sets)]
    assert all(d <= n and (d - n) % 2 == 0 for d, n in far) and max(d for d, _ in far) > 40
