"""Full-text index: a positional posting table beside the rows, and phrases answered from it.

A posting is (token, file, block, at): the places of a token in one block of lines of one
file, ascending, each the line inside the block and the token's number in that line. Parquet
stores `at` as deltas. The table is laid out by ranges of (token, file, block), so a token
that stands in every line is spread over many files, and a token's postings are found by the
files' statistics. A small second table counts each token's blocks.

A phrase starts from its rarest token: only the blocks that hold it are looked at for the
others, and positions are intersected inside those blocks. What is found is joined back to
the rows by (file, line_no).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators.filters import Terms, parse_terms, substring_terms, token_text
from logquarry.session import BROADCAST_BYTES, held_bytes, lookup_join, settle

BLOCK_BITS = 10             # lines of a block: 1,024
PLACE_BITS = 40             # tokens of a line; the line inside the block stands above them
KEYS = ("file", "block")
SCHEMA = "token string, file string, block long, at array<bigint>"
# Deltas instead of a dictionary for the places.
PARQUET = {"parquet.writer.version": "v2", "parquet.enable.dictionary#at.list.element": "false"}


def tokens_of(text: str | Column) -> Column:
    """Tokens of a text column as an array, as `token_text` cuts them."""
    spaced = F.trim(token_text(F.col(text) if isinstance(text, str) else text))
    return F.when(spaced != "", F.split(spaced, " ")).otherwise(F.array().cast("array<string>"))


def moved_back(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def gathered(rows: DataFrame, column: str = "search") -> DataFrame:
    """token, file, block, at of the lines of each Arrow batch. Tokens are gathered where
    they are cut: a task sorts one batch at a time, and what is shuffled has a row per token
    of a block, not per place."""
    block = F.shiftright("line_no", BLOCK_BITS)
    line = F.col("line_no") - F.shiftleft(block, BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _gather(*batch.columns)
    return rows.select("file", block.alias("block"), line.alias("line"), tokens_of(column).alias("tokens")).mapInArrow(run, SCHEMA)


def _gather(file: pa.Array, block: pa.Array, line: pa.Array, tokens: pa.Array) -> pa.RecordBatch:
    n = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    word = tokens.flatten().dictionary_encode()
    known = line.is_valid().to_numpy(zero_copy_only=False)[row]
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (pc.fill_null(line, 0).to_numpy()[row] << PLACE_BITS) + place
    keys = [x.dictionary_encode(null_encoding="encode").indices.to_numpy()[row] for x in (file, block)]
    keys.insert(0, word.indices.to_numpy())
    order = np.lexsort((at, *reversed(keys)))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = order[fresh]
    before = np.append(0, np.cumsum(known[order]))
    ends = before[np.append(np.flatnonzero(fresh), len(order))]
    places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[order][known[order]]))
    return pa.RecordBatch.from_arrays([word.dictionary.take(pa.array(word.indices.to_numpy()[first])), file.take(pa.array(row[first])),
                                       block.take(pa.array(row[first])), places], names=["token", *KEYS, "at"])


def whole(dealt: DataFrame) -> DataFrame:
    """One row per token and block of what batches have gathered, in their order; `dealt`:
    rows of one key are in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None             # the last key so far, which may go on
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows:
                first = _first_rows(batch)
                if len(first) > 1:
                    yield _joined(batch.slice(0, first[-1]), first[:-1])
                held = batch.slice(first[-1])
        if held is not None:
            yield _joined(held, np.zeros(1, np.int64))
    return dealt.sortWithinPartitions("token", *KEYS).mapInArrow(run, SCHEMA)


def _first_rows(batch: pa.RecordBatch) -> np.ndarray:
    """Where another key begins in sorted rows."""
    fresh = np.ones(batch.num_rows, dtype=bool)
    codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in batch.columns[:3]]
    fresh[1:] = np.any([k[1:] != k[:-1] for k in codes], axis=0)
    return np.flatnonzero(fresh)


def _joined(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """The rows of each key, which begin at `first`, as one."""
    if len(first) == batch.num_rows:
        return batch
    at = batch.column(3)
    ends = at.offsets.to_numpy()[np.append(first, batch.num_rows)]
    places, ends = at.values.to_numpy()[ends[0]:ends[-1]], ends - ends[0]
    order = np.lexsort((places, np.repeat(np.arange(len(first)), np.diff(ends))))
    held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places[order]))
    return pa.RecordBatch.from_arrays([*[c.take(pa.array(first)) for c in batch.columns[:3]], held], names=["token", *KEYS, "at"])


def postings(rows: DataFrame, column: str = "search") -> DataFrame:
    """token, file, block, at of all rows (file, line_no, column)."""
    return whole(gathered(rows, column).repartition("token", *KEYS))


class PostingTable:
    """The index of one rows table. Parts are added as rows are appended; a part holds whole
    lines, so a phrase never needs more than one part for a place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, column: str = "search") -> None:
        # Dealt out once: equal keys are in one range, where they are put together.
        found = whole(gathered(rows, column).repartitionByRange("token", *KEYS))
        part = f"{self.path}/postings/part={uuid.uuid4().hex}"
        found.write.options(**PARQUET).parquet(part)
        counts = self.spark.read.schema(SCHEMA).parquet(part).groupBy("token").agg(
            F.count("*").alias("blocks"), F.sum(F.size("at")).alias("n"))
        counts.repartitionByRange("token").sortWithinPartitions("token").write.mode("append").parquet(f"{self.path}/terms")

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/postings")

    def terms(self) -> DataFrame:
        """token, blocks, n over all parts."""
        parts = self.spark.read.schema("token string, blocks long, n long").parquet(f"{self.path}/terms")
        return parts.groupBy("token").agg(F.sum("blocks").alias("blocks"), F.sum("n").alias("n"))

    def phrase_tokens(self, phrase: str) -> list[str]:
        """A phrase's tokens; it is a line of a request, cut the way lines are."""
        return self.spark.range(1).select(tokens_of(F.lit(phrase)).alias("t")).first()["t"]

    def rarest(self, tokens: list[str]) -> list[tuple[str, int]]:
        """(token, blocks) of the phrase's different tokens, the rarest first; 0 for unknown ones."""
        known = {r["token"]: r["blocks"] for r in self.terms().filter(F.col("token").isin(tokens)).collect()}
        return sorted(((t, known.get(t, 0)) for t in set(tokens)), key=lambda x: (x[1], x[0]))

    def blocks(self, phrase: str) -> DataFrame:
        """file, block, t0, t1, ..: places of each different token of the phrase, the rarest
        first, in the blocks that hold all of them."""
        order = self.rarest(self.phrase_tokens(phrase))
        places = [self.read().filter(F.col("token") == t).select(*KEYS, F.col("at").alias(f"t{i}"))
                  for i, (t, _) in enumerate(order)]
        if len(places) == 1:
            return places[0]
        # The blocks of the rarest token decide what goes on of the others.
        first = settle(places[0])
        keys = first.select(*KEYS).distinct()
        keys = F.broadcast(keys) if held_bytes(first) <= BROADCAST_BYTES else keys
        others = [p.join(keys, list(KEYS), "left_semi") for p in places[1:]]
        return reduce(lambda a, b: a.join(b, list(KEYS)), others, first)

    def hits(self, phrase: str) -> DataFrame:
        """file, line_no of the lines that hold the phrase as contiguous whole tokens."""
        tokens = self.phrase_tokens(phrase)
        order = {t: i for i, (t, _) in enumerate(self.rarest(tokens))}
        if not tokens:
            return self.read().select("file", F.col("block").alias("line_no")).limit(0)
        # Every token's places, moved back by its number in the phrase, meet at the phrase's start.
        moved = [moved_back(F.col(f"t{order[t]}"), i) for i, t in enumerate(tokens)]
        starts = reduce(F.array_intersect, moved)
        line = F.shiftleft("block", BLOCK_BITS) + F.shiftright("_at", PLACE_BITS)
        return (self.blocks(phrase).select(*KEYS, F.explode(starts).alias("_at"))
                .select("file", line.alias("line_no")).distinct())

    def search(self, rows: DataFrame, terms: Terms | str, column: str = "search") -> DataFrame:
        """The rows that `phrase_terms` accepts: any wanted phrase and none of the refused.
        Refused terms alone are plain substrings, as an index cannot answer those."""
        terms = parse_terms(terms) if isinstance(terms, str) else terms
        if not terms:
            return rows
        if all(n for n, _ in terms):
            return rows.filter(substring_terms(F.col(column), terms))
        wanted = [self.hits(t) for n, t in terms if not n]
        refused = [self.hits(t) for n, t in terms if n]
        found = reduce(DataFrame.unionByName, wanted).distinct()
        if refused:
            found = found.join(reduce(DataFrame.unionByName, refused), ["file", "line_no"], "left_anti")
        return lookup_join(rows, settle(found), ["file", "line_no"], "left_semi")

    def looked_at(self, phrase: str) -> DataFrame:
        """phrase, rarest, rarest_blocks, all_blocks (postings of all its tokens), read_blocks
        (postings the answer is made of)."""
        order = self.rarest(self.phrase_tokens(phrase))
        read = self.blocks(phrase).agg((F.count("*") * len(order)).alias("read_blocks"))
        return read.select(F.lit(phrase).alias("phrase"), F.lit(order[0][0]).alias("rarest"),
                           F.lit(order[0][1]).cast("long").alias("rarest_blocks"),
                           F.lit(sum(n for _, n in order)).cast("long").alias("all_blocks"), "read_blocks")
