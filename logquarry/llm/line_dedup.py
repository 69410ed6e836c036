"""Line dedup over levelled sorted runs of line hashes (operator 7).

A store keeps, per line key, in how many documents the key was found. Every batch of
documents is counted on its own and merge-anti-joined (both sides sorted by key hash) with
the entries of all runs. The join decides what the batch writes: a key that no run holds
becomes an entry, a known one an increment, so a key has one entry in the whole store and
a later batch is compared with entries alone. Both parts are written as a run of level 0.
When a level holds `fanout` runs they are merged into one run of the next level: entries
as they are, increments summed. The number of runs grows with the logarithm of the number
of batches and every key is rewritten once per level.

A line's key is the line without white space at both ends, ASCII letters lower-cased;
its hash has 128 bits. Nulls: a null text is one empty line; a document with a null id
counts as one document. Rows with equal ids are one document for the count. Empty
tables give empty results. Lines of a text repeated within a document count once. Texts
are split whole, however long; extra columns pass through unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logquarry.llm.common import few, map_texts, query, same, stored, table
from logquarry.llm.words import SPACE
from logquarry.session import lookup_join

KEY = ["h1", "h2"]
LOOKUP_BYTES = 64 << 20
FREQUENT_KEYS = 250_000     # frequent keys sent to every task, about 100 bytes each there


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def key_hash(key: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(key, digest_size=16).digest()
    return (int.from_bytes(digest[:8], "little", signed=True),
            int.from_bytes(digest[8:], "little", signed=True))


def document_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, h1, h2) for every different key of at least min_chars code points."""
    def keys(batch: pa.RecordBatch):
        ids, halves, counts = batch.column(0), [], []
        for text in batch.column(1).to_pylist():
            found = {line_key(x) for x in (text or "").encode().split(b"\n")}
            before = len(halves)
            halves.extend(key_hash(k) for k in found if len(k.decode()) >= min_chars)
            counts.append(len(halves) - before)
        owner = pa.array(np.repeat(np.arange(len(counts)), counts))
        both = np.array(halves, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [ids.take(owner), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", *KEY])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, ["doc_id", "text"], keys, f"doc_id {kind}, h1 long, h2 long")


@dataclass
class Run:
    """Key hashes with documents: `entries` of keys no earlier run held, `increments` of
    known ones. Both are settled and sorted by key within their files."""
    entries: DataFrame
    increments: DataFrame


def united(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class LineRuns:
    """Levelled sorted runs under the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[Run]] = []

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def unseen(self, counted: DataFrame) -> DataFrame:
        """Merge-anti-join: the keys of a batch that no run has an entry for."""
        held = [run.entries.select(*KEY) for run in self.runs()]
        return counted.join(united(held).hint("merge"), KEY, "left_anti") if held else counted

    def add(self, keys: DataFrame) -> Run:
        """Count a batch of (doc_id, h1, h2), write it as a run, compact full levels."""
        counted = keys.distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"))
        if not self.runs():
            run = Run(self._write(counted), self.spark.createDataFrame([], "h1 long, h2 long, docs long"))
        else:
            counted = stored(counted, "line-batch")
            entries = self._write(self.unseen(counted))
            run = Run(entries, self._write(counted.join(entries.select(*KEY).hint("merge"), KEY, "left_anti")))
        self._push(0, run)
        return run

    def _write(self, rows: DataFrame) -> DataFrame:
        return stored(rows.sortWithinPartitions(*KEY), "line-run")

    def _push(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            entries = united([r.entries for r in full]).repartitionByRange(*KEY)
            increments = united([r.increments for r in full]).groupBy(*KEY).agg(F.sum("docs").alias("docs"))
            self._push(level + 1, Run(self._write(entries), self._write(increments)))

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys found in at least min_docs documents of all batches: a key's entry and the
        sum of its increments."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long")
        more = united([r.increments for r in self.runs()]).groupBy(*KEY).agg(F.sum("docs").alias("more"))
        return (united([r.entries for r in self.runs()]).join(more, KEY, "left")
                .where(F.col("docs") + F.coalesce("more", F.lit(0)) >= min_docs).select(*KEY))


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 5,
                   fanout: int = 4) -> tuple[DataFrame, DataFrame, LineRuns]:
    """(keys of all documents, frequent keys, the runs). Documents come in `batches` batches
    dealt by the hash of their id, each added to the runs as a load of its own would be."""
    spark = docs.sparkSession
    keys = document_keys(docs, min_chars).withColumn(
        "batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    keys = stored(keys, "line-keys", "batch")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("doc_id", *KEY))
    return keys.select("doc_id", *KEY), stored(runs.frequent(min_docs), "line-frequent"), runs


def dropped_keys(keys: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, drop: the hashes of the frequent keys of the document)."""
    hits = lookup_join(keys, frequent, KEY, max_bytes=LOOKUP_BYTES).distinct()
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("drop"))


def rebuilt(docs: DataFrame, keys: DataFrame, frequent: DataFrame, most: int = FREQUENT_KEYS) -> DataFrame:
    """docs with the lines that stay as text; adds _lq_lines and _lq_dropped. Up to `most`
    frequent keys go to every task and no text moves; beyond, each document is joined with
    its own frequent keys."""
    at, width = docs.columns.index("text"), len(docs.columns)
    schema = StructType([*docs.schema.fields, StructField("_lq_lines", LongType()), StructField("_lq_dropped", LongType())])
    everywhere = None
    if few(frequent, most):
        everywhere = docs.sparkSession.sparkContext.broadcast({(r["h1"], r["h2"]) for r in frequent.distinct().collect()})
        rows = docs
    else:
        drops = dropped_keys(keys, frequent).withColumnsRenamed({"doc_id": "_lq_id", "drop": "_lq_drop"})
        rows = docs.join(drops, same(docs["doc_id"], drops["_lq_id"]), "left").select(*[docs[c] for c in docs.columns], "_lq_drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            own = [None] * batch.num_rows if everywhere is not None else batch.columns[width].to_pylist()
            for text, drop in zip(batch.column(at).to_pylist(), own, strict=True):
                lines = (text or "").split("\n")
                gone = everywhere.value if everywhere is not None else {(d["h1"], d["h2"]) for d in drop or ()}
                stay = [x for x in lines if key_hash(line_key(x.encode())) not in gone] if gone else lines
                texts.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = list(batch.columns[:width])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             names=schema.names)
    return rows.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, most: int = FREQUENT_KEYS) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped for every row of docs."""
    keys, frequent, _ = frequent_lines(docs, min_docs, min_chars)
    out = rebuilt(docs.select("doc_id", "text"), keys, frequent, most)
    return out.withColumnsRenamed({"_lq_lines": "n_lines", "_lq_dropped": "n_dropped"})


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, most: int = FREQUENT_KEYS) -> DataFrame:
    """All rows and columns of docs, `text` without the frequent lines, n_chars to match."""
    keys, frequent, _ = frequent_lines(docs, min_docs, min_chars)
    out = rebuilt(docs, keys, frequent, most)
    size = F.when(F.col("_lq_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.drop("_lq_lines", "_lq_dropped")


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query("op7_line_dedup", SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave every document."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
