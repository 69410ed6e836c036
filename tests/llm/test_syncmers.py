"""Closed syncmers against a plain version, and the follower over run boundaries."""

import hashlib

import pytest
import regex

from logquarry.llm import syncmers as S


def md5(x, n):
    return hashlib.md5(x.encode()).hexdigest()[:n]


def plain_anchors(text):
    pieces = regex.findall(r"[^\x20\x09-\x0D⺀-\U0010FFFF]{1,16}|[⺀-\U0010FFFF]", text or "")
    if len(pieces) < 5:
        return [(i, md5(p, 8)) for i, p in enumerate(pieces)]
    found = []
    for i in range(len(pieces) - 4):
        order = [md5(" ".join(pieces[i + j:i + j + 2]), 16) for j in range(4)]
        if min(order) in (order[0], order[3]):
            found.append((i, md5(" ".join(pieces[i:i + 5]), 8)))
    return found


def plain_rows(docs):
    """docs: (id, text) in order."""
    prints, out = [], []
    for _, text in docs:
        prints.append(sorted({c for _, c in plain_anchors(text)})[:256])
    for at, (key, text) in enumerate(docs):
        text, following = text or "", docs[(at + 1) % len(docs)][1] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + following[:q]
        other = sorted({c for _, c in plain_anchors(edited)})[:256]

        def near(b, a=prints[at]):
            least = sorted({*a, *b})[:256]
            return sum(c in a and c in b for c in least) / len(least) if least else 1.0
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(prints[at]), "".join(other),
                    near(other), near(prints[(at + 1) % len(docs)])))
    return out


@pytest.mark.parametrize("run_rows", [1, 3, 500])
def test_rows_equal_a_plain_version(ready, documents, prose, monkeypatch, run_rows):
    monkeypatch.setattr(S, "RUN_ROWS", run_rows)
    texts = [prose(i, n) for i, n in enumerate([0, 1, 2, 4, 5, 6, 9, 40, 200, 1500, 3])]
    texts += [None, "", "é" * 50, "漢字かな" * 20, "\U0001F600 a", texts[8], texts[8] + " more", " \n\t "]
    docs = [(10 * i, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in S.fingerprints(documents(docs)).collect())
    assert got == plain_rows(docs)
    alike = {r[0]: r for r in got}
    assert alike[80][3] == alike[160][3] and alike[160][6] > 0.95      # a copy, then a text one word longer


def test_edges_of_a_text(ready, documents):
    one = S.fingerprints(documents({5: "only one document here"})).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert one[0]["edited_sha256"] == hashlib.sha256(b"only one documentonly ").hexdigest()
    assert S.fingerprints(documents({1: "x"}).limit(0)).count() == 0


def test_odd_rows(ready, odd, monkeypatch):
    """Null and repeated ids, texts that tie, columns that clash: a row for each row, and
    the order is that of (doc_id, hash of the text) with null ids first."""
    monkeypatch.setattr(S, "RUN_ROWS", 1)
    rows = S.fingerprints(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    keyed = odd.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()
    order = sorted(keyed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    plain = plain_rows([(r["doc_id"], r["t"]) for r in order])
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, plain))


def test_shared_stretches_are_found_by_position(ready, documents, prose):
    shared = prose(1, 60, 5000)
    left = S.anchors(documents({1: prose(2, 30, 5000) + " " + shared, 2: prose(3, 80, 5000)}))
    right = S.anchors(documents({7: prose(4, 11, 5000) + " " + shared + " " + prose(5, 20, 5000)}))
    found = S.matches(left, right).collect()
    assert [(r["left_id"], r["right_id"], r["shift"]) for r in found] == [(1, 7, 11 - 30)]
    assert found[0]["pos_from"] >= 30 and found[0]["pos_to"] <= 85 and found[0]["n"] > 10


def test_only_column_expressions(ready, documents):
    plan = S.fingerprints(documents({1: "a b c"}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
