"""Alignment of two tokenizers against a plain version, token by token."""

import hashlib
from collections import Counter

import pytest

from logquarry.llm import token_alignment as T

TEXTS = ["Hello world", "Hello  world\n\ttabs", "", None, "naïve café — 漢字 \U0001F600\u0000", "<s></s><unk><|endoftext|> plain",
         "a▁b", "x" * 5000, "Hello world", " leading and trailing  ", "1234567890 1,000.50 $", "é combining ​ zero",
         "word " * 3000]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(f"{T.FOLDER}/{T.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{T.FOLDER}/{T.PIECES}")
    letters = T.byte_letters()

    def tokens(text):
        """[(id, bytes)] of both, or nothing."""
        if not text:
            return [], []
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
               for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        whole = (" " + text).encode()
        good = b"".join(x for _, x in one) == whole == b"".join(x for _, x in two)
        return (one, two) if good else ([], [])
    return tokens


def ends(tokens):
    at, out = 0, []
    for i, x in tokens:
        at += len(x)
        out.append((at, i))
    return out


def plain_rows(texts, tokens):
    docs, counts = [], Counter()
    for text in texts:
        one, two = map(ends, tokens(text))
        by_end = dict(two)
        links = [(i, by_end[e]) for e, i in one if e in by_end]
        counts.update(links)
        groups, low = [], 0
        for e in [e for e, _ in one if e in by_end]:
            groups.append(",".join(str(i) for x, i in one if low < x <= e) + "|" + ",".join(
                str(i) for x, i in two if low < x <= e))
            low = e
        docs.append((len(one), len(two), groups, links))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(len_a, len_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "", ";".join(groups))
            for len_a, len_b, groups, links in docs]


def test_equals_a_plain_version(documents, plain, monkeypatch):
    docs = documents(list(enumerate(TEXTS)))
    want = plain_rows(TEXTS, plain)
    got = {r["doc_id"]: r for r in T.align(docs).collect()}
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert [tuple(got[i][c] for c in names) for i in range(len(TEXTS))] == [w[:7] for w in want]
    assert got[6]["n_a"] == 0 and got[5]["n_a"] > 10 and got[4]["n_b"] > 5 and got[2]["groups_sha256"] == ""
    groups = {r["doc_id"]: r["groups"] for r in T.encode(docs, with_groups=True).collect()}
    assert [groups[i] for i in range(len(TEXTS))] == [w[7] for w in want]


def test_the_table(ready, plain):
    """The registered query against the plain version over all documents of the smallest table."""
    sf = "/root/testdata/sf0.001"
    rows = ready.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(r["doc_id"], *w[:7]) for r, w in zip(rows, plain_rows([r["text"] for r in rows], plain), strict=True)]
    assert sorted(tuple(r) for r in T.op12_token_alignment(ready, sf).collect()) == sorted(want)


def test_both_ways_to_encode_agree():
    """The faster library gives the ids of the one the file is for, on every code point."""
    path = f"{T.FOLDER}/{T.BYTE_BPE}"
    fast, slow = T.Tokenizers.get(path, f"{T.FOLDER}/{T.PIECES}").encode_a, T.Tokenizers._by_file(path)
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}1{c}{c} {c}b  {c}" for c in points[at:at + 500]) for at in range(0, len(points), 500)]
    assert fast(texts) == slow(texts)


def test_pairs_stay_within_the_bound_of_the_vocabularies(documents):
    encoded = T.encode(documents(list(enumerate(TEXTS))))
    tokenizers = T.Tokenizers.get(f"{T.FOLDER}/{T.BYTE_BPE}", f"{T.FOLDER}/{T.PIECES}")
    size = len(tokenizers.b.data)
    for r in T.pair_counts(encoded).collect():
        a, b = tokenizers.a.data[r["pair"] // size].as_py(), tokenizers.b.data[r["pair"] % size].as_py()
        assert a.endswith(b) or b.endswith(a)


def test_odd_and_empty_tables(odd):
    rows = T.align(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_a"] == by_id[4]["n_a"] == 0 and by_id[3]["groups_sha256"] == by_id[4]["groups_sha256"] == ""
    same = [r for r in rows if r["n_a"] == by_id[2]["n_a"]]
    assert len(same) == 4 and len({r["groups_sha256"] for r in same}) == 1 and by_id[6]["n_links"] > 50_000
    assert T.align(odd.limit(0)).count() == 0
