"""Spelling variants against a plain version; filters that are far too full; edges."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logquarry.llm import spelling_variants as S


def plain_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_rows(docs):
    n, out = plain_words(docs), {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = [w, form, None, n[w], len(near), n[form] if form else None]
    for row in out.values():
        root = row[0]
        while out[root][1]:
            root = out[root][1]
        row[2] = root
    return sorted(map(tuple, out.values()))


def spelled(seed, n_docs=40, words=250):
    """Documents over few words, their misspellings, and misspellings of those."""
    r = random.Random(seed)
    letters = "abcdeéÀß÷xyz"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 12))) for _ in range(6)]

    def typo(w):
        at = r.randrange(len(w))
        return r.choice([w[:at] + w[at + 1:], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1:]])
    once = [typo(w) for w in base for _ in range(3)]
    pool = base * 90 + once * 6 + [typo(w) for w in once for _ in range(2)]
    sep = [" ", "\n", "1", "_", "ā", ", "]
    return [(i, "".join(x for _ in range(words) for x in (r.choice(pool).upper() if r.random() < .02 else r.choice(pool),
                                                          r.choice(sep)))) for i in range(n_docs)]


@pytest.mark.parametrize("most", [S.MOST_BLOCKS, 1])
def test_equals_a_plain_version(documents, most):
    docs = spelled(3)
    got = sorted(tuple(r) for r in S.group_variants(documents(docs), most_blocks=most).collect())
    want = plain_rows(docs)
    assert got == want and sum(r[1] is not None for r in want) > 10
    assert any(r[1] is not None and r[1] != r[2] for r in want)         # a chain of forms


def test_letters_of_two_bytes_are_one_letter(documents):
    docs = [(i, "straße strasse straßen naïveté naivete naïvete Élèves élèves") for i in range(40)]
    got = {r["word"]: r for r in S.group_variants(documents(docs)).collect()}
    assert got["straße"]["n_near"] == 1 and "Élèves" not in plain_words([(0, "élèves")])
    assert got["naïvete"]["n_near"] == 2 and got["Élèves"]["n_near"] == 1
    assert sorted(tuple(r) for r in got.values()) == plain_rows(docs)


def test_a_long_chain_reaches_its_root(documents):
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdewyx"]
    texts = [" ".join(w for w, k in zip(words, (1000, 200, 40, 8), strict=True) for _ in range(k // 8)) for _ in range(8)]
    rows = plain_rows(list(enumerate(texts)))
    assert sorted(tuple(r) for r in S.group_variants(documents(list(enumerate(texts)))).collect()) == rows
    assert {r[2] for r in rows if r[0] in words} == {"abcdefgh"} or len(rows) > 4


def test_filters_hold_every_word_and_stay_within_their_bound():
    words = ["".join(random.Random(i).choice("abcdefghij") for _ in range(8)).encode() for i in range(3000)]
    letters = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, 8)
    assert sum(S.block_counts({8: 10 ** 9, 9: 10 ** 9}).values()) <= S.MOST_BLOCKS
    blocks = S.block_counts({8: len(words)})[8]
    held = np.zeros((blocks, S.LANES), dtype=np.uint64)
    block, mask = S.bits_of(S.word_hash(letters), blocks)
    np.bitwise_or.at(held, block, mask)
    filters = S.Filters({8: held})
    assert filters.holds(8, S.word_hash(letters)).all() and not filters.holds(7, S.word_hash(letters)).any()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert filters.holds(8, others).mean() < 0.02


def test_hashes_of_edits_are_those_of_the_edited_words():
    letters = np.frombuffer(b"aabcde" + "éabbxy".encode("latin-1"), dtype=np.uint8).reshape(2, 6)
    words = [b"aabcde", "éabbxy".encode("latin-1")]
    seen = 0
    for size, word, place, letter, code in S.edits(letters):
        for w, p, c, h in zip(word.tolist(), place.tolist(), letter.tolist(), code, strict=True):
            edited = words[w][:p] + (bytes([c]) if c else b"") + words[w][p + 1:]
            assert len(edited) == size
            assert S.word_hash(np.frombuffer(edited, dtype=np.uint8).reshape(1, -1))[0] == h
            seen += 1
    assert seen > 300


def test_odd_and_empty_tables(odd, documents):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in S.group_variants(odd, least_n=1).collect()) == sorted(
        tuple(r) for r in S.group_variants(documents(docs), least_n=1).collect())
    assert sorted(tuple(r) for r in S.group_variants(odd).collect()) == plain_rows(docs)
    assert S.group_variants(odd.limit(0)).count() == 0
    assert S.group_variants(documents({1: None, 2: "", 3: "12 34 ab"})).count() == 0


def test_letters_by_length(ready):
    words = ready.createDataFrame([("lantern", 5), ("zealous", 7), ("cafés", 9), ("ab", 5)], "word string, n long")
    found = S.letters_of(words)
    assert {size: bytes(held).decode("latin-1") for size, held in found.items()} == {7: "aelnorstuz", 5: "acfsé", 2: "ab"}
