"""Benchmark decontamination with an FM-index per shard of documents (operator 10).

Every task indexes its documents in shards of up to `shard_words` coded words, searches
all benchmark phrases backward in the index, locates the occurrences by sampled suffix
positions and merges them to removal spans. Words are lower-cased ASCII letters, digits
and non-ASCII characters. A phrase is a window of `window` words of an item, or a whole
shorter item. The alphabet of an index is the benchmark's vocabulary: a word outside it
separates, and stretches shorter than the shortest phrase can't hold one and are left out.

The benchmark goes to the tasks in blocks of at most `block_words` words, one pass over
the documents each, so neither driver nor tasks hold more of it than that.

Nulls: a text without words, or null, has no hits and isn't contaminated; an item without
words has no phrases; an item with a null id marks words but isn't counted or listed.
Items with equal ids are one. Rows of documents with equal ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import query, same, table
from logquarry.llm.fm_index import FMIndex
from logquarry.llm.words import NOT_ALNUM, words

WINDOW = 13
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 19


class Phrases:
    """Distinct phrases of some items over their vocabulary."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        codes, owner = [], []
        for w in words(pa.array(texts, pa.string()), NOT_ALNUM, lower=True):
            for r in range(w.rows):
                item = w.code[w.bounds[r]:w.bounds[r + 1]]
                size = min(window, len(item))
                for at in range(len(item) - size + 1 if size else 0):
                    codes.append(item[at:at + size])
                    owner.append(w.first + r)
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
        lengths = np.array([len(c) for c in codes], dtype=np.int64)
        grid = np.zeros((len(codes), window), dtype=np.int64)
        for i, c in enumerate(codes):
            grid[i, window - len(c):] = np.searchsorted(self.vocabulary, c) + 1
        self.grid, which = (np.unique(grid, axis=0, return_inverse=True) if len(codes)
                            else (grid, np.zeros(0, np.int64)))
        self.lengths = np.zeros(len(self.grid), dtype=np.int64)
        which = which.ravel()
        self.lengths[which] = lengths
        order = np.argsort(which, kind="stable")
        self.item = np.array(owner, dtype=np.int64)[order]
        self.item_bounds = np.searchsorted(which[order], np.arange(len(self.grid) + 1))
        self.shortest = int(lengths.min()) if len(lengths) else 0


def phrase_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """The items in blocks; one partition of the table at a time reaches the driver."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        n = len(row["text"]) // 4 + 1               # not fewer than its words, nearly
        if ids and size + n > block_words:
            yield Phrases(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Phrases(ids, texts, window)


class Shard:
    """Stretches of known words of many documents, and where they came from."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.size = phrases, 0
        self.parts: list[np.ndarray] = []
        self.starts, self.docs, self.places = [], [], []

    def add(self, doc: int, place: np.ndarray, codes: list[np.ndarray]) -> None:
        for at, stretch in zip(place, codes, strict=True):
            self.starts.append(self.size)
            self.docs.append(doc)
            self.places.append(int(at))
            self.parts += [stretch, np.zeros(1, np.int64)]
            self.size += len(stretch) + 1

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, phrase) of every occurrence."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        index = FMIndex(np.concatenate(self.parts), len(self.phrases.vocabulary))
        low, high = index.search(self.phrases.grid, self.phrases.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        position = index.locate(rows)
        stretch = np.searchsorted(self.starts, position, side="right") - 1
        return (np.array(self.docs)[stretch],
                np.array(self.places)[stretch] + position - np.array(self.starts)[stretch], phrase)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def hits_of(phrases: Phrases, batches: Iterator[pa.RecordBatch], shard_words: int):
    """Per document, in input order: (key column values, n_words, spans, items)."""
    shard, keys, n_words = Shard(phrases), [], []

    def flush():
        doc, first, phrase = shard.occurrences()
        order = np.argsort(doc, kind="stable")
        doc, first, phrase = doc[order], first[order], phrase[order]
        bounds = np.searchsorted(doc, np.arange(len(keys) + 1))
        for d, key in enumerate(keys):
            a, b = bounds[d], bounds[d + 1]
            found = np.unique(phrase[a:b])
            items = {phrases.ids[i] for p in found
                     for i in phrases.item[phrases.item_bounds[p]:phrases.item_bounds[p + 1]]}
            yield key, n_words[d], merged(first[a:b], first[a:b] + phrases.lengths[phrase[a:b]]), \
                [i for i in items if i is not None]

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for w in words(batch.column(1), NOT_ALNUM, lower=True):
            at = np.minimum(np.searchsorted(phrases.vocabulary, w.code), max(len(phrases.vocabulary) - 1, 0))
            known = (phrases.vocabulary[at] == w.code if len(phrases.vocabulary)
                     else np.zeros(len(w.code), bool))
            code = np.where(known, at + 1, 0)
            opens = known.copy()
            opens[1:] &= ~(known[:-1] & (w.row[1:] == w.row[:-1]))
            start = np.flatnonzero(opens)
            closes = known.copy()
            closes[:-1] &= ~(known[1:] & (w.row[1:] == w.row[:-1]))
            end = np.flatnonzero(closes) + 1
            long = end - start >= phrases.shortest
            start, end = start[long], end[long]
            begin = np.searchsorted(w.row[start], np.arange(w.rows + 1)) if len(start) else np.zeros(w.rows + 1, int)
            for r in range(w.rows):
                a, b = begin[r], begin[r + 1]
                if a < b:
                    shard.add(len(keys), start[a:b] - w.bounds[r],
                              [code[s:e] for s, e in zip(start[a:b], end[a:b], strict=True)])
                keys.append(ids[w.first + r])
                n_words.append(int(w.bounds[r + 1] - w.bounds[r]))
            if shard.size >= shard_words or len(keys) >= 50_000:
                yield from flush()
                shard, keys, n_words = Shard(phrases), [], []
    yield from flush()


def search(docs: DataFrame, key: str, phrases: Phrases, item_type: str, shard_words: int,
           hits_only: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<{item_type}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for k, n, spans, items in hits_of(phrases, batches, shard_words):
            if spans or not hits_only:
                rows.append({key: k, "n_words": n, "items": items,
                             "spans": [{"start": s, "end": e} for s, e in spans]})
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, arrow_schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return docs.select(key, "text").mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
                  least_share: int = 20) -> DataFrame:
    """doc_id, n_words, spans (word positions to remove), items, n_hit, contaminated
    (n_hit > 0 and least_share * n_hit >= n_words) for every row of docs."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    blocks = phrase_blocks(benchmark, window, block_words)
    first = next(blocks, None) or Phrases([], [], window)
    second = next(blocks, None)
    if second is None:
        found = search(docs, "doc_id", first, item_type, shard_words, hits_only=False)
    else:
        found = in_passes(docs, [first, second], blocks, item_type, shard_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (found.withColumn("n_hit", n_hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))))


def in_passes(docs, head, rest, item_type: str, shard_words: int) -> DataFrame:
    """One pass over the documents per block of a large benchmark; hits put together."""
    from itertools import chain

    from logquarry.llm.common import stored
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_lq_text"))
    parts = [stored(search(keyed.select(F.col("_lq_text"), "text"), "_lq_text", p, item_type, shard_words, True)
                    .distinct(), "phrase-hits") for p in chain(head, rest)]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy(F.col("_lq_text").alias("_lq_key")).agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merge = F.aggregate(
        "spans", F.slice("spans", 1, 1),
        lambda done, s: F.when(s["start"] <= F.element_at(done, -1)["end"],
                               F.concat(F.slice(done, 1, F.size(done) - 1),
                                        F.array(F.struct(F.element_at(done, -1)["start"].alias("start"),
                                                         F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))))
    base = search(keyed.select(F.struct("doc_id", "_lq_text").alias("doc"), "text"), "doc",
                  Phrases([], []), item_type, shard_words, False)
    base = base.select("doc.doc_id", "doc._lq_text", "n_words")
    out = base.join(hits.withColumn("spans", merge), same(base["_lq_text"], hits["_lq_key"]), "left")
    empty_spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id", "n_words", F.coalesce("spans", empty_spans).alias("spans"),
                      F.coalesce("items", F.array().cast(f"array<{item_type}>")).alias("items"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM
  (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bi)),
sizes AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM
  (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes)),
h AS (SELECT dw.doc_id, dw.i, dw.n, p.item_id FROM dw JOIN p ON dw.n = p.n AND dw.phrase = p.phrase),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM
  (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op10_decontamination", SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, and which documents are contaminated."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")
