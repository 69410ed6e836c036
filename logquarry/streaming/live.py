"""Rows and running totals of a stream, and windowed views of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry.functions.times import bucket_label
from logquarry.operators import parsers, sketches
from logquarry.operators.rollups import field_values, merge_counts

LIVE_FIELDS = ["ip", "path", "code", "level", "method", "host", "app", "template"]


def parse_stream(lines: DataFrame, fmt: str, w3c_fields: list[str] | None = None) -> DataFrame:
    """The batch parsers on a stream: they keep no state. Format and W3C columns are
    those of the dataset being followed."""
    lines = lines.withColumn("format", F.lit(fmt))
    if fmt == "w3c":
        lines = lines.withColumn("w3c_fields", F.array(*[F.lit(f) for f in w3c_fields or []]))
    return parsers.enrich(parsers.tag_lines(lines, [fmt]).filter("accepted"))


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what there is and stop; a later call goes on from the checkpoint."""
    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_live(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
             every: str = "2 seconds") -> StreamingQuery:
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).start())


FANOUT = 16
COUNTS = "field string, value string, n long"


class LiveTables:
    """Rows, partial counts and, if asked for, sketches of each micro-batch, in folders named
    by its number.

    A batch that is run again overwrites its own folders, so a restart after a failure neither
    loses nor doubles anything. Every FANOUT batches their counts are merged into one folder
    of the next level, every FANOUT of those into one of the level above; readers take the
    highest levels that are complete, so the folders read grow with the logarithm of the
    batches only. A folder is removed one merge after the one that took it in, so a reader
    that has just listed it still finds it. The exact counts grow with the values that differ;
    sketches (`sketches=True`) have a fixed size and state their error.
    """

    def __init__(self, spark: SparkSession, path: str, sketches: bool = False):
        self.spark, self.path, self.sketches = spark, path, sketches
        jvm = spark.sparkContext._jvm
        self._folder = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._folder("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame, batch_id: int) -> None:
        folder = f"batch={batch_id}"
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{folder}")
        kept = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/{folder}")
        fields = [f for f in LIVE_FIELDS if f in kept.columns]
        minutes = kept.filter("ts_norm != ''").select(
            F.lit("minute").alias("field"), bucket_label(F.col("ts_norm")).alias("value"))
        counts = (field_values(kept, fields).unionByName(minutes)
                  .groupBy("field", "value").agg(F.count("*").alias("n")))
        self._put("counts", counts, batch_id)
        if self.sketches:
            self._put("distinct", sketches.distinct_sketches(kept), batch_id)
            self._put("tops", sketches.top_sketches(kept, fields), batch_id)

    # levels: <kind>/level=<l>/upto=<last batch>, of FANOUT ** l batches

    def _merged(self, kind: str, parts: DataFrame) -> DataFrame:
        return {"counts": lambda p: merge_counts(p, ["field", "value"]), "distinct": sketches.merge_distinct,
                "tops": sketches.merge_tops}[kind](parts)

    def _put(self, kind: str, table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/{kind}/level=0/upto={batch_id}")
        level, span = 1, FANOUT
        while (batch_id + 1) % span == 0:
            below = span // FANOUT
            inputs = [i for i in self._complete(kind, level - 1) if batch_id - span < i <= batch_id]
            if inputs:
                self._merged(kind, self._load(kind, [(level - 1, i) for i in inputs])).write.mode("overwrite").parquet(
                    f"{self.path}/{kind}/level={level}/upto={batch_id}")
            for old in self._complete(kind, level - 1):
                if old <= batch_id - span and self._covered(kind, level, old, below):
                    self._fs.delete(self._folder(f"{kind}/level={level - 1}/upto={old}"), True)
            level, span = level + 1, span * FANOUT

    def _complete(self, kind: str, level: int) -> list[int]:
        """Last batches of the complete folders of a level, ascending."""
        folder = self._folder(f"{kind}/level={level}")
        if not self._fs.exists(folder):
            return []
        jvm = self.spark.sparkContext._jvm
        return sorted(int(s.getPath().getName()[5:]) for s in self._fs.listStatus(folder)
                      if self._fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _covered(self, kind: str, level: int, upto: int, below: int) -> bool:
        """Whether a folder's batches are in a complete one of the given level."""
        span = below * FANOUT
        return (upto // span + 1) * span - 1 in self._complete(kind, level)

    def cover(self, kind: str = "counts") -> list[tuple[int, int]]:
        """(level, last batch) of the folders that hold every batch once, the largest first."""
        root, levels = self._folder(kind), []
        if self._fs.exists(root):
            levels = sorted((int(s.getPath().getName()[6:]) for s in self._fs.listStatus(root)
                             if s.getPath().getName().startswith("level=")), reverse=True)
        chosen, spans = [], []
        for level in levels:
            size = FANOUT ** level
            for upto in self._complete(kind, level):
                if not any(low < upto <= high for low, high in spans):
                    chosen.append((level, upto))
                    spans.append((upto - size, upto))
        return chosen

    def _load(self, kind: str, folders: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/{kind}/level={level}/upto={upto}" for level, upto in folders]
        if kind == "counts":
            return (self.spark.read.schema(COUNTS).parquet(*paths) if paths
                    else self.spark.createDataFrame([], COUNTS))
        if not paths:
            raise ValueError(f"no {kind} sketches under {self.path}")
        return self.spark.read.parquet(*paths)

    def _whole(self, kind: str) -> DataFrame:
        return self._merged(kind, self._load(kind, self.cover(kind)))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("batch")

    def counts(self) -> DataFrame:
        """(field, value, n) over all batches."""
        return self._whole("counts")

    def top(self, field: str, limit: int) -> DataFrame:
        return (self.counts().filter(F.col("field") == field)
                .orderBy(F.desc("n"), "value").limit(limit).select("value", "n"))

    def top_sketched(self, limit: int) -> DataFrame:
        """(field, rank, value, n, error, certain) of all fields, from sketches of fixed size."""
        return sketches.top_estimates(self._whole("tops"), limit)

    def kpis(self) -> DataFrame:
        """Distinct values per field; a code `-` is none, as in the batch KPIs."""
        counted = self.counts().filter("NOT (field = 'code' AND value = '-')")
        return counted.groupBy("field").agg(F.count("*").alias("distinct_values"))

    def kpis_sketched(self) -> DataFrame:
        """(kpi, estimate, low, high), from sketches of fixed size."""
        return sketches.distinct_estimates(self._whole("distinct"))

    def histogram(self) -> DataFrame:
        return self.counts().filter("field = 'minute'").select(F.col("value").alias("t"), "n").orderBy("t")


# --- windows ---------------------------------------------------------------

def window_counts(rows: DataFrame, size: str, delay: str | None = None, slide: str | None = None,
                  by: tuple[str, ...] = ()) -> DataFrame:
    """(start, by.., n) per tumbling or sliding window of event time.

    With `delay`, a window closes once event time passed its end by that much, its
    state is dropped and later lines for it are ignored.
    """
    rows = rows.withWatermark("event_time", delay) if delay else rows
    span = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    return rows.groupBy(span, *by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), *by, "n")


def error_rate(rows: DataFrame, size: str, slide: str, delay: str | None = None,
               levels: tuple[str, ...] = ("ERR", "CRIT")) -> DataFrame:
    """(start, total, errors, rate) per sliding window; compare `rate` to alert on bursts."""
    rows = rows.withWatermark("event_time", delay) if delay else rows
    errors: Column = F.count_if(F.col("level").isin(*levels))
    return (rows.groupBy(F.window("event_time", size, slide))
            .agg(F.count("*").alias("total"), errors.alias("errors"))
            .select(F.col("window.start").alias("start"), "total", "errors",
                    (F.col("errors") / F.col("total")).alias("rate")))


def without_replays(rows: DataFrame, delay: str) -> DataFrame:
    """Each (file, line) once, although a source may deliver it again within the delay.

    The delay is one of arrival, not of the lines' own times: a line without a time, or
    one older than any seen, is new like any other and is never dropped as late.
    """
    arrived = rows.withColumn("_arrived", F.current_timestamp())
    return (arrived.withWatermark("_arrived", delay)
            .dropDuplicatesWithinWatermark(["file", "line_no"]).drop("_arrived"))
