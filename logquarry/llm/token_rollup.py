"""Token counts as delta-maintained rollups (operator 3).

A change is an insert, a delete or a revision of a document. Applied as a batch, changes
become signed rows against what the ledger holds: a delete takes the old counts away, a
revision takes the old and adds the new ones. The signed rows of a batch are summed by
source, language and tokenizer version; totals are the sum over all batches, so no batch
ever reads the corpus again.

A batch is written to folders named by its id and takes effect by one marker file made
without overwriting: a batch that was committed before changes nothing, one that failed
half-way is written anew. Ledger and deltas count only where the marker stands.

The latest entry of a document in batch order is its state. Within a batch the changes of
an id are one: any insert or revision wins over a delete, and of several texts the one
with the greatest text counts, so the order of rows plays no part. Deleting or revising
an unknown id: the delete does nothing, the revision inserts. Inserting a known id
revises it. Null source or language are groups of their own; a null text has no tokens;
rows with a null id are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import query, same, stored, table
from logquarry.session import scratch_folder

WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"
INSERT, REVISE, DELETE = "insert", "revise", "delete"
GROUP = ["source", "lang", "tokenizer"]
Counter = Callable[[DataFrame], DataFrame]


def by_pattern(pattern: str) -> Column:
    """Tokens of `text` as matches of a pattern."""
    return F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")


# Tokenizer version -> what a token is.
PATTERNS = {"words-1": WORD, "pieces-1": PIECE}


def pattern_counter(patterns: dict[str, str] = PATTERNS) -> Counter:
    """Adds `counts`, a map from tokenizer version to tokens."""
    def add(changes: DataFrame) -> DataFrame:
        pairs = [x for name, p in sorted(patterns.items()) for x in (F.lit(name), by_pattern(p))]
        return changes.withColumn("counts", F.create_map(*pairs))
    return add


def vocabulary_counter(path: str, version: str) -> Counter:
    """Counts by a public tokenizer file (the `tokenizers` JSON form) found at the same
    path on every executor; special tokens in a text are ordinary text."""
    def add(changes: DataFrame) -> DataFrame:
        from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType
        schema = StructType([*changes.schema.fields, StructField("counts", MapType(StringType(), LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                counts = []
                for at in range(0, len(texts), 64):
                    some = [t or "" for t in texts[at:at + 64]]
                    counts += [[(version, len(e.ids))] for e in
                               tokenizer.encode_batch(some, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(counts, pa.map_(pa.string(), pa.int64()))],
                    names=[*batch.schema.names, "counts"])
        return changes.mapInArrow(run, schema)
    return add


class Rollup:
    """Ledger, deltas and commit markers in one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, counter: Counter | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.counter = counter or pattern_counter()
        jvm = spark.sparkContext._jvm
        self._file = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Ids of the batches in effect, ascending."""
        folder = self._file("commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder))

    def _read(self, kind: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/{kind}/{b}").withColumn("batch", F.lit(b).cast("long"))
                 for b in self.committed()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def state(self) -> DataFrame | None:
        """The latest ledger entry per document: doc_id, source, lang, counts (null: deleted)."""
        ledger = self._read("ledger")
        if ledger is None:
            return None
        entry = F.struct("batch", "source", "lang", F.map_entries("counts").alias("counts"))
        return (ledger.groupBy("doc_id").agg(F.max_by(entry, "batch").alias("e"))
                .select("doc_id", "e.source", "e.lang", F.map_from_entries("e.counts").alias("counts")))

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Commit changes (op, doc_id, source, lang, text) as a batch; whether it took effect now."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        live = F.col("op") != DELETE
        one = (self.counter(changes).withColumn("counts", F.when(live, F.map_entries("counts")))
               .groupBy("doc_id").agg(F.max(F.struct(
                   F.coalesce(live, F.lit(True)).alias("live"), F.octet_length("text").alias("size"),
                   F.xxhash64("text").alias("text"), "source", "lang", "counts")).alias("c"))
               .select("doc_id", "c.source", "c.lang", F.map_from_entries("c.counts").alias("counts")))
        one.write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        new = self.spark.read.parquet(f"{self.path}/ledger/{batch}")
        signed = [self._signed(new, 1)]
        old = self.state()
        if old is not None:
            touched = new.select(F.col("doc_id").alias("_lq_id"))
            signed.append(self._signed(old.join(touched, same(old["doc_id"], touched["_lq_id"]), "left_semi"), -1))
        (reduce(DataFrame.unionByName, signed).groupBy(*GROUP)
         .agg(F.sum("sign").alias("docs"), F.sum("tokens").alias("tokens"))
         .write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}"))
        self._fs.mkdirs(self._file("commits"))
        try:
            self._fs.create(self._file(f"commits/{batch}"), False).close()
        except Exception:
            if batch in self.committed():       # another writer was first, with the same batch
                return False
            raise
        return True

    @staticmethod
    def _signed(entries: DataFrame, sign: int) -> DataFrame:
        return (entries.where("counts IS NOT NULL")
                .select("source", "lang", F.explode("counts").alias("tokenizer", "n"))
                .select(*GROUP, F.lit(sign).cast("long").alias("sign"), (F.col("n") * sign).alias("tokens")))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        deltas = self._read("deltas")
        if deltas is None:
            return self.spark.createDataFrame(
                [], "source string, lang string, tokenizer string, docs long, tokens long")
        return (deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0 OR tokens <> 0"))


SQL = r"""
WITH first AS (SELECT text, min(doc_id) AS keep FROM documents WHERE text IS NOT NULL GROUP BY text),
d AS (SELECT doc_id, source, lang, CASE WHEN contains(text, '|') THEN replace(text, '|', ' ') ELSE text END AS text
  FROM documents WHERE text IS NULL OR doc_id IN (SELECT keep FROM first)),
c AS (SELECT source, lang, unnest(['words-1', 'pieces-1']) AS tokenizer, unnest([
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')),
  len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]'))]) AS n FROM d)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM c GROUP BY source, lang, tokenizer"""


@query("op3_token_rollup", SQL)
def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in; those with table bars are
    revised without them; exact copies of a document with a smaller id are deleted. The
    second batch is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, scratch_folder(spark, "token-rollup"))
    rollup.apply(docs.withColumn("op", F.lit(INSERT)), 1)
    revised = (docs.where(F.col("text").contains("|"))
               .withColumns({"text": F.replace("text", F.lit("|"), F.lit(" ")), "op": F.lit(REVISE)}))
    rollup.apply(revised, 2)
    rollup.apply(revised, 2)
    slim = docs.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("t"))
    slim = stored(slim, "text-hashes")
    keep = slim.groupBy("t").agg(F.min("doc_id").alias("keep"))
    copies = slim.join(keep, "t").where("doc_id <> keep").select(
        "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
        F.lit(None).cast("string").alias("text"), F.lit(DELETE).alias("op"))
    rollup.apply(copies, 3)
    return rollup.totals()
