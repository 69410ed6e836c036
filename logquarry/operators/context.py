"""Lines around given lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.session import lookup_join, settle


def _checked(n: int) -> None:
    if n < 0:
        raise ValueError("n must be 0 or more")


def context(lines: DataFrame, targets: DataFrame, n: int = V.CONTEXT_DEFAULT) -> DataFrame:
    """n lines before and after each target: (file, target, line_no, shown_line, position, value).

    Each target lists the line numbers it wants, so the range becomes an equality
    on (file, line_no); the join is a broadcast only for a counted set of targets.
    """
    _checked(n)
    want = targets.select("file", F.col("line_no").alias("target")).distinct().select(
        "file", "target",
        F.explode(F.sequence(F.greatest(F.col("target") - n, F.lit(0)), F.col("target") + n))
        .alias("line_no"))
    # (file, line_no) repeats when targets are near each other; that only fans out.
    around = lookup_join(lines.select("file", "line_no", "value"), settle(want), ["file", "line_no"])
    place = (F.when(F.col("line_no") < F.col("target"), "before")
             .when(F.col("line_no") > F.col("target"), "after").otherwise("current"))
    return around.select("file", "target", "line_no", (F.col("line_no") + 1).alias("shown_line"),
                         place.alias("position"), "value")


def context_frame(lines: DataFrame, n: int = V.CONTEXT_DEFAULT, block_bits: int = 14) -> DataFrame:
    """Every line with its neighbours joined by newlines: (file, line_no, before, after).

    Lines are framed per block of 16,384; each block also gets the n lines on
    both sides of it, so a window never spans a file.
    """
    _checked(n)
    own = F.shiftright("line_no", block_bits)
    low, high = (F.shiftright(F.greatest(F.col("line_no") - n, F.lit(0)), block_bits),
                 F.shiftright(F.col("line_no") + n, block_bits))
    spread = lines.select("file", "line_no", "value", own.alias("_own"),
                          F.explode(F.sequence(low, high)).alias("_block"))
    frame = Window.partitionBy("file", "_block").orderBy("line_no")
    joined = spread.select(
        "file", "line_no", "_own", "_block",
        F.array_join(F.collect_list("value").over(frame.rowsBetween(-n, -1)), "\n").alias("before"),
        F.array_join(F.collect_list("value").over(frame.rowsBetween(1, n)), "\n").alias("after"))
    return joined.filter("_own = _block").drop("_own", "_block")
