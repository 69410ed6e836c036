"""Substring dedup by seed and extend (operator 8).

A repeat is a run of at least `length` words that also stands in a document with a
smaller id. Seeds are winnowed anchors: of the `length - seed + 1` word groups of `seed`
words in a window of `length` words the one with the least hash, so equal windows have
equal anchors, and neighbouring windows mostly share theirs.

1. Join on anchors: those found in two documents or more are seeds.
2. Extend: the windows around a seed that it anchors are one stretch. Stretches of one
   seed that are equal as a whole match at once; where a seed has different stretches,
   they are compared window by window, so a match reaches left and right as far as the
   words agree. Each stretch and window is compared with its first holder alone, which
   is linear in the number of holders: no pairs within a group of copies.
3. Windows held earlier are put together to maximal spans.

Anchors, stretches and windows are told by 64-bit hashes; a window is only compared with
windows of its own anchor, so two different ones are taken for equal if both hashes agree.

Nulls: a null text has no words. A row with a null id is compared with nothing and keeps
its words. Rows with equal ids are one document: they never count as earlier for each
other, and each keeps its own words. Texts shorter than `length` words stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import few, query, stored, table, text_key, texts_with
from logquarry.llm.words import Words, constants, grams, inside, mixed, powers, words

LENGTH = 13
SEED = 5
# Seeds sent to every task (8 bytes each); beyond that they are joined by document.
BROADCAST_SEEDS = 4_000_000
STRETCH_BASE = int(constants(2, 77)[1])


class Stretches:
    """Runs of neighbouring windows with one anchor, in one piece of texts."""

    def __init__(self, w: Words, length: int, seed: int):
        self.words, self.length = w, length
        group = grams(w.code, seed)
        span = length - seed + 1
        n = len(w.code) - length + 1
        if n <= 0:
            self.at = self.count = self.row = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        least = group[:n].copy()
        for j in range(1, span):
            np.minimum(least, group[j:n + j], out=least)
        at = np.flatnonzero(inside(w.row, length))
        least = least[at]
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(opens)
        self.at, self.count = at[first], np.diff(np.append(first, len(at)))
        self.anchor, self.row = least[first], w.row[at[first]]

    def hashes(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each picked stretch; hashes of all its windows, one after another."""
        at, count = self.at[pick], self.count[pick]
        code = self.words.code
        sums = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(mixed(code) * powers(STRETCH_BASE, len(code)), out=sums[1:])
        end = at + count + self.length - 1
        inverse = powers(pow(STRETCH_BASE, -1, 1 << 64), len(code) + 1)
        whole = mixed((sums[end] - sums[at]) * inverse[at] + count.astype(np.uint64))
        window = grams(code, self.length, seed=1)
        each = np.arange(count.sum()) + np.repeat(at - (np.cumsum(count) - count), count)
        return whole, window[each]


def seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, doc_id), once per document and anchor."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                s = Stretches(w, length, seed)
                order = np.lexsort((s.anchor, s.row))
                anchor, row = s.anchor[order], s.row[order]
                fresh = np.ones(len(row), dtype=bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[fresh].view(np.int64)), batch.column(0).take(pa.array(w.first + row[fresh]))],
                    names=["anchor", "doc_id"])
    return (docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
            .mapInArrow(run, f"anchor long, doc_id {kind}"))


def shared_seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Anchors of two documents or more."""
    found = seeds(docs, length, seed).groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return stored(found.where("low < high").select("anchor"), "seeds")


def stretches(docs: DataFrame, shared: DataFrame, length: int, seed: int,
              broadcast_seeds: int) -> DataFrame:
    """(doc_id, text_key, anchor, stretch, at, windows) wherever a shared seed stands."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, anchor long, stretch long, at long, windows array<long>"
    known = None
    source = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", text_key().alias("text_key"))
    if few(shared, broadcast_seeds):
        values = shared.toArrow().column("anchor").to_numpy().view(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(values))
    else:
        of_doc = (seeds(docs, length, seed).join(shared, "anchor", "left_semi")
                  .groupBy(F.col("doc_id").alias("_lq_id")).agg(F.collect_list("anchor").alias("seeds")))
        source = (source.join(of_doc, source["doc_id"] == of_doc["_lq_id"])
                  .select("doc_id", "text", "text_key", "seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                s = Stretches(w, length, seed)
                if known is not None:
                    values = known.value
                    spot = np.minimum(np.searchsorted(values, s.anchor), max(len(values) - 1, 0))
                    hit = values[spot] == s.anchor if len(values) else np.zeros(len(s.anchor), bool)
                else:
                    mine = batch.column(3).slice(w.first, w.rows)
                    owner = np.repeat(np.arange(w.rows, dtype=np.uint64), mine.value_lengths().to_numpy())
                    pair = mixed(mine.flatten().to_numpy().view(np.uint64) + mixed(owner + np.uint64(1)))
                    hit = np.isin(mixed(s.anchor + mixed(s.row.astype(np.uint64) + np.uint64(1))), pair)
                pick = np.flatnonzero(hit)
                if not len(pick):
                    continue
                whole, window = s.hashes(pick)
                row = pa.array(w.first + s.row[pick])
                offsets = np.append(0, np.cumsum(s.count[pick])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(2).take(row),
                     pa.array(s.anchor[pick].view(np.int64)), pa.array(whole.view(np.int64)),
                     pa.array(s.at[pick] - w.bounds[s.row[pick]]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(window.view(np.int64)))],
                    names=["doc_id", "text_key", "anchor", "stretch", "at", "windows"])
    return source.mapInArrow(run, schema)


def first_holders(found: DataFrame) -> DataFrame:
    """(anchor, stretch, first, firsts): the smallest id that holds the stretch; for
    seeds with several stretches also the smallest id for each window, in order."""
    whole = stored(found.groupBy("anchor", "stretch").agg(
        F.min("doc_id").alias("first"), F.any_value("windows").alias("windows")), "stretches")
    several = whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    windows = stored(whole.join(several, "anchor", "left_semi").select(
        "anchor", "stretch", "first", F.posexplode("windows").alias("i", "window")), "windows")
    earliest = windows.groupBy("anchor", "window").agg(F.min("first").alias("holder"))
    firsts = (windows.join(earliest, ["anchor", "window"])
              .groupBy("anchor", "stretch").agg(F.sort_array(F.collect_list(F.struct("i", "holder"))).alias("f"))
              .select("anchor", "stretch", F.col("f.holder").alias("firsts")))
    return whole.select("anchor", "stretch", "first").join(firsts, ["anchor", "stretch"], "left")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED,
            broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, text_key, starts): first words of the windows held by a smaller id."""
    shared = shared_seeds(docs, length, seed)
    found = stored(stretches(docs, shared, length, seed, broadcast_seeds), "seed-stretches")
    holders = stored(first_holders(found), "holders")
    joined = found.select("doc_id", "text_key", "anchor", "stretch", "at", F.size("windows").alias("n")).join(
        holders, ["anchor", "stretch"])
    all_of_it = F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)
    some = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("at") + i)),
                    lambda x: x.isNotNull())
    starts = F.when(F.col("first") < F.col("doc_id"), all_of_it).otherwise(some)
    return (joined.select("doc_id", "text_key", starts.alias("starts")).where(F.size("starts") > 0)
            .groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts")))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, seed: int = SEED,
                     broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, text (kept words joined by a blank), n_words, n_removed, spans (maximal
    removed runs of words) for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, text string, n_words long, n_removed long, "
              "span_starts array<long>, span_ends array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(2)
            texts, n_words, n_removed, span_starts, span_ends = [], [], [], [], []
            for w in words(batch.column(1)):
                for r in range(w.rows):
                    low, high = w.bounds[r], w.bounds[r + 1]
                    mine = starts[w.first + r].as_py()
                    gone = np.zeros(high - low + 1, dtype=np.int64)
                    if mine:
                        np.add.at(gone, np.asarray(mine), 1)
                        np.add.at(gone, np.asarray(mine) + length, -1)
                    on = (np.cumsum(gone) > 0)[:-1]
                    edges = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
                    keep = np.flatnonzero(~on) + low
                    texts.append(b" ".join([w.data[s:e].tobytes() for s, e in
                                            zip(w.start[keep], w.end[keep], strict=True)]).decode())
                    n_words.append(int(high - low))
                    n_removed.append(int(on.sum()))
                    span_starts.append(edges[0::2].tolist())
                    span_ends.append(edges[1::2].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(span_starts, pa.list_(pa.int64())),
                 pa.array(span_ends, pa.list_(pa.int64()))],
                names=["doc_id", "text", "n_words", "n_removed", "span_starts", "span_ends"])
    joined = texts_with(docs, repeats(docs, length, seed, broadcast_seeds)).select("doc_id", "text", "starts")
    spans = F.transform("span_starts", lambda s, i: F.struct(s.alias("start"), F.get("span_ends", i).alias("end")))
    return joined.mapInArrow(run, schema).select("doc_id", "text", "n_words", "n_removed", spans.alias("spans"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM
  (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS first FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM (SELECT s.doc_id, s.i FROM s JOIN f USING (win)
  WHERE f.first < s.doc_id)),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w),
r AS (SELECT k.doc_id, count(g.j) AS n_removed, string_agg(ws[k.j], ' ' ORDER BY k.j) FILTER (WHERE g.j IS NULL) AS kept
  FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.j = g.j GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)"""


@query("op8_substring_dedup", SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 13 words that an earlier one holds."""
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
