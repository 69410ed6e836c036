"""What the operators share: reading a table, settled results, the registry of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.session import configure, scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BATCH_ROWS = 1000
BATCH_BYTES = str(16 << 20)


def prepared(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: small Arrow batches, so that a worker's memory
    does not follow the length of the texts."""
    configure(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")   # a shuffle goes with its query
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) and, where SQL can express it, its equivalent."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_FILE = 50_000
_recording: list[list[DataFrame]] = []


def stored(df: DataFrame, label: str, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
    """Write a table once to the shared folder and go on from its files. Where a bound of
    its rows is known, `rows` keeps a small table from being written as many tiny files."""
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(1 + rows // ROWS_PER_FILE)
    path = scratch_folder(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done._lq_settled, done._lq_path = True, path
    for made in _recording:
        made.append(done)
    return done


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """Collects the tables that `stored` writes meanwhile."""
    made: list[DataFrame] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording[:] = [x for x in _recording if x is not made]


def discard(*tables: DataFrame) -> None:
    """Remove the folders of stored tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lq_path", None)
        if path is not None:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            df._lq_path = None


def map_texts(df: DataFrame, columns: list[str], fn, schema: str) -> DataFrame:
    """fn(batch) -> batches over the named columns only; one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
    return df.select(*columns).mapInArrow(run, schema)


def same(a: Column, b: Column) -> Column:
    """Equality that holds between nulls too."""
    return a.eqNullSafe(b)


BROADCAST_ROWS = 250_000        # ids or pairs sent to every task, under 100 bytes each
FILTER_BITS = 1 << 28           # a filter of ids in every task, 32 MB


def bitmaps(wanted: DataFrame, key: Column) -> DataFrame:
    """One bit per hash of the keys, in maps of 4 kilobytes: FILTER_BITS in all, however
    many keys there are."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    return (wanted.select(place.alias("_lq_spot")).groupBy(F.bitmap_bucket_number("_lq_spot").alias("_lq_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_lq_spot")).alias("_lq_bits")))


def maybe_in(rows: DataFrame, key: Column, maps: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key may be among those of `bitmaps`, without a shuffle of the rows; with
    left_anti those whose key is surely not. None that is there goes missing."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(maps["_lq_bits"], (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = (F.bitmap_bucket_number(place) == maps["_lq_bucket"]) & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    return rows.join(F.broadcast(maps), on, how)


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", most: int = BROADCAST_ROWS) -> DataFrame:
    """All rows and columns of docs but those whose key (null included) is in `dropped`. Up
    to `most` keys go to every task; beyond, only rows that a filter of the keys cannot
    clear are shuffled to them."""
    other = stored(dropped.select(F.col(key).alias("_lq_key")).distinct(), "dropped-keys")
    if few(other, most):
        return docs.join(F.broadcast(other), same(docs[key], other["_lq_key"]), "left_anti")
    maps = stored(bitmaps(other, F.col("_lq_key")), "dropped-filter")
    unclear = maybe_in(docs, F.col(key), maps)
    judged = unclear.join(other.hint("merge"), same(unclear[key], other["_lq_key"]), "left_anti")
    return maybe_in(docs, F.col(key), maps, "left_anti").unionByName(judged)


def few(df: DataFrame, most: int) -> bool:
    """Whether a settled table has no more than `most` rows (its size is then bounded)."""
    return df.count() <= most


def lookup(df: DataFrame) -> DataFrame:
    """A settled table of ids, to be joined to a larger one: sent to every task if it has
    few rows, else shuffled."""
    return F.broadcast(df) if few(df, BROADCAST_ROWS) else df


def texts_with(docs: DataFrame, extra: DataFrame) -> DataFrame:
    """doc_id, text and what `extra` holds for (doc_id, text_key); one row per row of docs."""
    slim = docs.select("doc_id", "text", text_key().alias("_lq_key"))
    other = extra.withColumnsRenamed({"doc_id": "_lq_id", "text_key": "_lq_text"})
    on = same(slim["doc_id"], other["_lq_id"]) & (slim["_lq_key"] == other["_lq_text"])
    return slim.join(other, on, "left").drop("_lq_id", "_lq_text", "_lq_key")


def text_key() -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64("text")
