"""Rows laid out so that filters on time, address, code or template skip most of a table.

`write_clustered` orders rows along a space-filling curve of (time, ip, code): each dimension
is cut into steps of about equally many rows, the steps' bits are interleaved, and rows are
dealt out by ranges of that number. So every file and row group spans a small box of all three
dimensions, and its minima and maxima rule it out for most filters. Bloom filters on ip and
template rule row groups out for one address or one template wherever they lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.sinks.tables import PARTITIONS

TIMES = "spark.sql.parquet.outputTimestampType"
BITS = 6                            # steps of a dimension: 64
GROUP_BYTES = 32 << 20              # row groups small enough that skipping one counts
BLOOM_COLUMNS = {"ip": 200_000, "template": 20_000}     # distinct values expected in a row group


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number that keeps its order; other texts by their hash, apart."""
    parts = F.split(ip, r"\.")
    number = reduce(lambda a, i: a * 256 + F.coalesce(F.get(parts, i).try_cast("long"), F.lit(0)), range(4), F.lit(0).cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number).when(ip == "", -1).otherwise(
        F.lit(1 << 32) + F.pmod(F.xxhash64(ip), F.lit(1 << 20)))


def dimensions() -> dict[str, Column]:
    """What the curve runs through, the last one's bits above the others'; a missing value comes first."""
    return {"code": F.coalesce(F.col("code_int").cast("long"), F.lit(-1)), "ip": ip_number(F.coalesce("ip", F.lit(""))),
            "time": F.coalesce(F.unix_micros("event_time"), F.lit(-(1 << 62)))}


def step_bounds(rows: DataFrame) -> dict[str, list[int]]:
    """Values that cut each dimension into at most 2 ** BITS steps, from one pass."""
    shares = F.array(*[F.lit(i / (1 << BITS)) for i in range(1, 1 << BITS)])
    found = rows.select(*[c.alias(name) for name, c in dimensions().items()]).agg(
        *[F.percentile_approx(name, shares, 10_000).alias(name) for name in dimensions()]).first()
    return {name: sorted(set(found[name] or [])) for name in dimensions()}


def with_curve(rows: DataFrame, bounds: dict[str, list[int]]) -> DataFrame:
    """Adds `_z`, the interleaved bits of the three steps."""
    names = list(dimensions())
    rows = rows.withColumns({f"_{n}": value for n, value in dimensions().items()})
    rows = rows.withColumns({f"_{n}_step": F.lit(0).cast("long") for n in names})
    for bit in reversed(range(BITS)):
        rows = rows.withColumns({f"_{n}_step": _further(F.col(f"_{n}"), F.col(f"_{n}_step"), bounds[n], 1 << bit) for n in names})
    z = F.lit(0).cast("long")
    for k, name in enumerate(names):
        for bit in range(BITS):
            one = F.shiftright(F.col(f"_{name}_step"), bit).bitwiseAND(F.lit(1).cast("long"))
            z = z.bitwiseOR(F.shiftleft(one, bit * len(names) + k))
    return rows.withColumn("_z", z).drop(*[f"_{n}{x}" for n in names for x in ("", "_step")])


def _further(value: Column, step: Column, bounds: list[int], by: int) -> Column:
    """A step of the binary search for how many bounds the value has reached: `by` more if
    it has reached those too. Plain columns, which are compiled; a lambda over the bounds
    took longer than all the parsing of the row."""
    held = F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<bigint>")
    return step + F.when(F.get(held, step.cast("int") + (by - 1)) <= value, by).otherwise(0)


def write_clustered(rows: DataFrame, path: str, blooms: dict[str, int] | None = None, group_bytes: int = GROUP_BYTES,
                    ranges: int | None = None) -> None:
    """Write rows as a table of its own, clustered. A step that many rows share is split by
    file and line, so no key gathers in one task. `ranges`: into how many; None lets the
    session's settings for shuffles decide by size."""
    order = [*PARTITIONS, "_z", "file", "line_no"]
    dealt = [*([ranges] if ranges else []), *order]
    placed = with_curve(rows, step_bounds(rows)).repartitionByRange(*dealt).sortWithinPartitions(*order).drop("_z")
    writer = placed.write.mode("overwrite").option("parquet.block.size", group_bytes)
    for name, distinct in (BLOOM_COLUMNS if blooms is None else blooms).items():
        writer = (writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{name}", distinct))
    # The default form of times has no minima and maxima.
    spark, kept = rows.sparkSession, rows.sparkSession.conf.get(TIMES)
    spark.conf.set(TIMES, "TIMESTAMP_MICROS")
    try:
        writer.partitionBy(*PARTITIONS).parquet(path)
    finally:
        spark.conf.set(TIMES, kept)


def rows_read(found: DataFrame) -> tuple[int, int]:
    """(rows of the result, rows its scans gave out), by running it."""
    counted = found.agg(F.count("*").alias("n"))
    n = counted.collect()[0]["n"]
    plan = counted._jdf.queryExecution().executedPlan()
    todo, read = [plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan], 0
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan "):
            read += node.metrics().get("numOutputRows").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return n, read
