"""Stateful following: line numbers, format and W3C columns of each growing file.

State is kept per file (and generation): the number of its next line, its format, its last
`#Fields` line, and the marks of its first lines until the format stands. It is saved with the
query's checkpoint, so a restarted query numbers and parses on as if it had never stopped.

A file has the format of its dataset where that is known; else its own first 100 non-blank
lines decide, as they do when a file is loaded. Until that many have come, each micro-batch
goes by the lines seen so far. A `#Fields` line holds from there on, in whichever batch it
comes. The lines of one file in one micro-batch go through one task, which is as much as
`maxBytesPerTrigger` lets in; what follows (parsing) is spread again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logquarry import fixed_values as V
from logquarry.operators import parsers
from logquarry.operators.detect import NOT_BLANK, marks

MARKS = ("apache", "json", "generic", "syslog")
STATE = "next_line long, format string, header string, seen int, w3c boolean, " + ", ".join(f"{m} int" for m in MARKS)
NUMBERED = ("owner string, dataset string, file string, line_no long, byte_pos long, value string, "
            "format string, header string")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def verdict(seen: int, w3c: bool, counts: dict[str, int]) -> str:
    """The format of a file by the marks of its first lines, in the order loads judge by."""
    most = [m for m in MARKS if counts[m] > seen * V.DETECT_SHARE]
    if "apache" in most:
        return "apache"
    return "w3c" if w3c else (most or ["raw"])[0]


class Follower(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values("byte_pos", kind="stable", ignore_index=True)
        held = self.state.get() if self.state.exists() else None
        next_line, fmt, header, seen, w3c, *counts = held or (
            0, None, lines["given_header"].iloc[0], 0, False, *[0] * len(MARKS))
        given = lines["given_format"].iloc[0]
        if seen < V.DETECT_SAMPLE:
            first = lines[lines["shown"]].head(V.DETECT_SAMPLE - seen)
            seen += len(first)
            w3c = bool(w3c or first["w3c"].any())
            counts = [n + int(first[m].sum()) for n, m in zip(counts, MARKS, strict=True)]
            fmt = verdict(seen, w3c, dict(zip(MARKS, counts, strict=True)))
        # The last header at or before each line, or the one held from earlier batches.
        at = np.maximum.accumulate(np.where(lines["w3c"], np.arange(len(lines)), -1))
        values = lines["value"].to_numpy(dtype=object)
        headers = [values[i] if i >= 0 else header for i in at]
        self.state.update((next_line + len(lines), fmt, headers[-1], seen, w3c, *counts))
        yield pd.DataFrame({
            "owner": lines["owner"], "dataset": lines["dataset"], "file": lines["file"],
            "line_no": range(next_line, next_line + len(lines)), "byte_pos": lines["byte_pos"], "value": lines["value"],
            "format": given if isinstance(given, str) else fmt, "header": pd.Series(headers, dtype=object)})

    def close(self) -> None:
        pass


def number_and_judge(lines: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """A stream of followed lines (`tail.follow`) with line numbers from 0, `format` and the
    `#Fields` line in force. `datasets`: dataset, format, w3c_fields of those already known,
    a static table; their header counts from the file's start."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    value = F.col("value")
    marked = lines.select("owner", "dataset", "file", F.col("line_no").alias("byte_pos"), "value",
                          value.rlike(NOT_BLANK).alias("shown"), *[c.alias(m) for m, c in marks(value).items()])
    if datasets is None:
        ready = marked.withColumns({"given_format": F.lit(None).cast("string"), "given_header": F.lit(None).cast("string")})
    else:
        fields = F.when(F.size("w3c_fields") > 0, F.concat(F.lit("#Fields: "), F.array_join("w3c_fields", " ")))
        known = datasets.select("dataset", F.col("format").alias("given_format"), fields.alias("given_header"))
        ready = marked.join(known, "dataset", "left")
    return ready.groupBy("file").transformWithStateInPandas(
        Follower(), outputStructType=NUMBERED, outputMode="Append", timeMode="None")


def follow_rows(lines: DataFrame, datasets: DataFrame | None = None, formats: list[str] | None = None) -> DataFrame:
    """Parsed rows of followed lines of any mix of formats; `formats` narrows what may come."""
    tagged = number_and_judge(lines, datasets).withColumn("w3c_fields", F.when(
        F.col("header").isNotNull(), parsers.header_columns(F.col("header")))).drop("header", "byte_pos")
    return parsers.enrich(parsers.tag_lines(tagged, formats or list(parsers.PARSERS)).filter("accepted"))
