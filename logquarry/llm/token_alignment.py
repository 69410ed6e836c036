"""Alignment of two tokenizers' tokens over a corpus, in Arrow kernels (operator 12).

A is a byte-level BPE (`tokenizers` JSON) of a blank and the text, B a sentencepiece model of
the text, which puts the blank there itself. Per batch, both token lists are flattened with
their parents; byte lengths, summed within each text, give every token's end; an Acero hash
join of both sides on (text, end) gives the links, and the ends that both have cut the tokens
into groups. `Table.group_by` counts a batch's id pairs and Spark merges the counts.

A text is encoded once: its digest and its links' id pairs are written to the shared folder,
and what the whole corpus decides (counts, the best of a B id) is joined to those in a second
pass. The counts are sent to every task. Their size has a bound that no corpus changes: as two
linked tokens end at the same byte, the shorter one is a suffix of the longer, so there are
at most two pairs (a byte has two B ids) for every byte of every vocabulary entry.

Texts that are null, empty, or whose joined A or B bytes are not the blank and the text have
no tokens: zeros, an empty digest, no links. Special tokens' strings in a text are plain text.
Rows are judged one by one: repeated rows and ids repeat their row and count each time, extra
columns play no part. Batches are cut to about half a megabyte of text; one very long text is
encoded whole in one task, in memory that follows its length.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import query, stored, table

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how byte-level vocabularies of this kind cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART_BYTES = 512 << 10
ENCODED = ("doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<bigint>, groups string")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes get the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@dataclass(frozen=True)
class Vocabulary:
    """`data`: bytes per id; `size`: their lengths; `printed`: `id,` for all ids, then the id
    with the mark that ends a group."""
    data: pa.Array
    size: pa.Array
    printed: pa.Array

    @staticmethod
    def of(entries: list[bytes], mark: str) -> Vocabulary:
        data = pa.array(entries, pa.large_binary())
        return Vocabulary(data, pc.cast(pc.binary_length(data), pa.int64()), pa.array(
            [f"{i}," for i in range(len(entries))] + [f"{i}{mark}" for i in range(len(entries))], pa.large_string()))


class Tokenizers:
    """Both tokenizers of a worker process, from files at the same path on every executor."""
    held: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_bpe, encoding="utf-8") as f:
            read = json.load(f)
        letters = byte_letters()
        special = {t["id"]: t["content"].encode() for t in read["added_tokens"]}
        ranks = {bytes(letters[c] for c in entry): i for entry, i in read["model"]["vocab"].items() if i not in special}
        entries = [b""] * (1 + max([*ranks.values(), *special]))
        for entry, i in [*ranks.items(), *((x, i) for i, x in special.items())]:
            entries[i] = entry
        self.a = Vocabulary.of(entries, "|")
        self.encode_a = self._by_ranks(read, ranks) or self._by_file(byte_bpe)
        n = self.pieces.get_piece_size()
        self.b = Vocabulary.of([
            bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(n))], ";")

    @staticmethod
    def _by_ranks(read: dict, ranks: dict[bytes, int]):
        """The same encoding by a faster library, where ids tell the order of the merges and
        texts are cut by the usual pattern and nothing else."""
        vocab, merges = read["model"]["vocab"], read["model"]["merges"]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        cutting = read["pre_tokenizer"]
        if (any(vocab[m] != 256 + i for i, m in enumerate(joined)) or read["normalizer"] or read["model"].get("ignore_merges")
                or (cutting["type"], cutting["add_prefix_space"], cutting["use_regex"]) != ("ByteLevel", False, True)):
            return None
        import tiktoken
        known = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [known.encode_ordinary(t) for t in texts]

    @staticmethod
    def _by_file(path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        known = Tokenizer.from_file(path)
        known.encode_special_tokens = True
        return lambda texts: [e.ids for e in known.encode_batch_fast(texts, add_special_tokens=False)]

    @classmethod
    def get(cls, byte_bpe: str, pieces: str) -> Tokenizers:
        key = (byte_bpe, pieces)
        if key not in cls.held:
            cls.held[key] = cls(byte_bpe, pieces)
        return cls.held[key]

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Token ids of the texts by A (with the blank) and by B."""
        found = self.encode_a([" " + t for t in texts]), self.pieces.encode(texts, num_threads=1)
        return tuple(pa.array(ids, pa.large_list(pa.int64())) for ids in found)


@dataclass
class Side:
    """Flattened tokens of one tokenizer: per token id, text and end (a byte offset in it)."""
    ids: pa.Array
    text: pa.Array
    end: pa.Array
    counts: np.ndarray          # tokens per text
    exact: np.ndarray           # whether a text's tokens are its bytes


def flattened(tokens: pa.Array, vocabulary: Vocabulary, texts: list[bytes]) -> Side:
    ids, text = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    size = pc.take(vocabulary.size, ids)
    counts = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    total = np.zeros(len(ids) + 1, dtype=np.int64)
    total[1:] = pc.cumulative_sum(size).to_numpy(zero_copy_only=False)
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    first[1:] = np.cumsum(counts)
    start = total[first]                                        # byte at which each text's tokens begin
    end = pc.subtract(pa.array(total[1:]), pc.take(pa.array(start), text))
    joined = pc.take(vocabulary.data, ids).buffers()[2]
    joined = memoryview(joined).cast("B") if joined is not None else memoryview(b"")
    exact = np.fromiter((joined[start[i]:start[i + 1]] == t for i, t in enumerate(texts)), bool, len(texts))
    return Side(ids, text, end, counts, exact)


def kept(side: Side, good: np.ndarray) -> Side:
    """The side without the tokens of texts that have none by definition."""
    if good.all():
        return side
    mask = pc.take(pa.array(good), side.text)
    return Side(side.ids.filter(mask), side.text.filter(mask), side.end.filter(mask),
                np.where(good, side.counts, 0), side.exact)


def cut(side: Side, vocabulary: Vocabulary, linked: pa.Array) -> pa.Array:
    """Printed ids of each group; `linked` tells the tokens that end one."""
    at_end = linked.to_numpy(zero_copy_only=False)
    which = side.ids.to_numpy(zero_copy_only=False) + at_end * (len(vocabulary.printed) // 2)
    printed = pc.take(vocabulary.printed, pa.array(which))
    offsets = np.concatenate([[0], np.flatnonzero(at_end) + 1])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), printed), pa.scalar("", pa.large_string()))


def aligned(texts: list[str | None], tokenizers: Tokenizers, with_groups: bool = False) -> list[pa.Array]:
    """n_a, n_b, n_groups, groups_sha256, pairs, groups of some texts."""
    texts = [t or "" for t in texts]
    data = [(" " + t).encode() for t in texts]
    a_tokens, b_tokens = tokenizers.encode(texts)
    a, b = flattened(a_tokens, tokenizers.a, data), flattened(b_tokens, tokenizers.b, data)
    good = a.exact & b.exact & np.fromiter((t != "" for t in texts), bool, len(texts))
    a, b = kept(a, good), kept(b, good)
    at = pa.array(np.arange(len(a.ids)))
    left = pa.table({"text": a.text, "end": a.end, "a": a.ids, "a_at": at})
    right = pa.table({"text": b.text, "end": b.end, "b": b.ids, "b_at": pa.array(np.arange(len(b.ids)))})
    links = left.join(right, ["text", "end"], join_type="inner", use_threads=False).sort_by("a_at").combine_chunks()
    marks = []
    for n, column in ((len(a.ids), "a_at"), (len(b.ids), "b_at")):
        mark = np.zeros(n, dtype=bool)
        mark[links[column].to_numpy()] = True
        marks.append(pa.array(mark))
    groups = pc.binary_join_element_wise(cut(a, tokenizers.a, marks[0]), cut(b, tokenizers.b, marks[1]),
                                            pa.scalar("", pa.large_string()))
    per_text = np.bincount(links["text"].to_numpy(), minlength=len(texts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64))
    whole = pc.binary_join(pa.LargeListArray.from_arrays(offsets, groups), pa.scalar("", pa.large_string()))
    printed = pc.utf8_rtrim(whole, ";")
    sha = [hashlib.sha256(g.as_py().encode()).hexdigest() if ok else "" for g, ok in zip(printed, good, strict=True)]
    pair = pc.add(pc.multiply(links["a"], len(tokenizers.b.data)), links["b"]).combine_chunks()
    pairs = pa.ListArray.from_arrays(pc.cast(offsets, pa.int32()), pair)
    return [pa.array(a.counts), pa.array(b.counts), pa.array(per_text), pa.array(sha), pairs,
            printed.cast(pa.string()) if with_groups else pa.nulls(len(texts), pa.string())]


def parts(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about PART_BYTES."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    whole = texts.to_pylist()
    at = 0
    while at < len(whole):
        to, held = at + 1, sizes[at]
        while to < len(whole) and held + sizes[to] <= PART_BYTES:
            held += sizes[to]
            to += 1
        yield at, whole[at:to]
        at = to


def encode(docs: DataFrame, folder: str = FOLDER, with_groups: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, groups_sha256, pairs (the id pair of each link, in
    order, as a * size of B + b), groups (`a1,a2|b1;..`, if asked for)."""
    byte_bpe, pieces = f"{folder}/{BYTE_BPE}", f"{folder}/{PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers.get(byte_bpe, pieces)
        for batch in batches:
            for at, texts in parts(batch.column(1)):
                columns = [batch.column(0).slice(at, len(texts)), *aligned(texts, tokenizers, with_groups)]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "groups"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """pair, n: how many links hold each id pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.table({"pair": pc.list_flatten(batch.column(0))})
            counted = flat.group_by("pair", use_threads=False).aggregate([([], "count_all")])
            yield from counted.rename_columns(["pair", "n"]).select(["pair", "n"]).combine_chunks().to_batches()
    partial = encoded.select("pairs").mapInArrow(run, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The digest of every row with n_links, n_best (links whose pair is the most frequent one
    of its B id in the corpus, ties included) and count_sum (of their pairs' counts)."""
    spark = docs.sparkSession
    encoded = stored(encode(docs, folder).drop("groups"), "token-alignment")
    tokenizers = Tokenizers.get(f"{folder}/{BYTE_BPE}", f"{folder}/{PIECES}")
    size_b = len(tokenizers.b.data)
    most = 2 * (pc.sum(tokenizers.a.size).as_py() + pc.sum(tokenizers.b.size).as_py())
    counts = stored(pair_counts(encoded), "token-pairs", rows=most)
    held = counts.count()
    if held > most:
        raise ValueError(f"{held} id pairs, but the vocabularies allow {most}")
    # Bounded by the vocabularies, see above; never by the corpus.
    known = counts.toArrow().sort_by("pair")
    pair, n = known["pair"].to_numpy(), known["n"].to_numpy()
    top = np.zeros(size_b, dtype=np.int64)
    np.maximum.at(top, pair % size_b, n)
    shared = spark.sparkContext.broadcast((pair, n, n == top[pair % size_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            rows = pa.table(batch)
            pairs = rows["pairs"].combine_chunks()
            text = pc.list_parent_indices(pairs).to_numpy(zero_copy_only=False)
            at = np.searchsorted(pair, pc.list_flatten(pairs).to_numpy(zero_copy_only=False))
            count_sum = np.zeros(len(batch), dtype=np.int64)
            np.add.at(count_sum, text, n[at])
            n_links = np.bincount(text, minlength=len(batch))
            n_best = np.bincount(text[best[at]], minlength=len(batch))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], pa.array(n_links), pa.array(n_best),
                 pa.array(count_sum), batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return encoded.mapInArrow(run, RESULT)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between a byte-level BPE and a piece model over all documents."""
    return align(table(spark, sf_dir, "documents"))
