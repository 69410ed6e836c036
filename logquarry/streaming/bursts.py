"""Bursts: windows whose counts rise against their own baseline, found as they close.

Each series (a dataset, a level, any key) has a state of four numbers: windows seen, mean,
cumulative sum, last window. A window's count is compared with the mean in units of the
spread that independent events of that mean would have; what exceeds half a unit adds up,
what falls short takes away, and a sum above the threshold is a burst. A burst restarts the
sum and leaves the mean alone, so it does not raise its own baseline; otherwise the mean
follows slowly. The first windows only teach. Windows without any row count as zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logquarry.streaming.following import ROCKSDB
from logquarry.streaming.live import window_counts

# `last` in nanoseconds: as a number, no time zone touches it on its way through the state.
STATE = "seen long, mean double, cusum double, last long"


@dataclass(frozen=True)
class Settings:
    warm_up: int = 8            # windows that only teach
    slack: float = 0.5          # units a window may exceed the mean
    threshold: float = 8.0
    follow: float = 0.05        # share of a window's difference taken into the mean


def step(seen: int, mean: float, cusum: float, count: int, how: Settings) -> tuple[tuple[int, float, float], float, bool]:
    """One window: (next state, score, whether it is a burst)."""
    if seen < how.warm_up:
        return (seen + 1, mean + (count - mean) / (seen + 1), 0.0), 0.0, False
    score = max(0.0, cusum + (count - mean) / math.sqrt(max(mean, 1.0)) - how.slack)
    if score > how.threshold:
        return (seen + 1, mean, 0.0), score, True
    return (seen + 1, mean + how.follow * (count - mean), score), score, False


def walk(state: tuple | None, windows: pd.DataFrame, size: pd.Timedelta, how: Settings):
    """(state, bursts) over windows (start, n) in order, the empty ones between them included."""
    seen, mean, cusum, last = state or (0, 0.0, 0.0, None)
    found = []
    for start, n in sorted(zip(windows["start"], windows["n"], strict=True)):
        start = pd.Timestamp(start)
        while last is not None and last + size.value < start.value:
            last += size.value
            (seen, mean, cusum), _, _ = step(seen, mean, cusum, 0, how)
        before, last = mean, start.value
        (seen, mean, cusum), score, burst = step(seen, mean, cusum, int(n), how)
        if burst:
            found.append((start, int(n), before, score))
    return (seen, mean, cusum, last), found


class Detector(StatefulProcessor):
    def __init__(self, by: tuple[str, ...], size: str, how: Settings):
        self.by, self.size, self.how = by, pd.Timedelta(size), how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        state, found = walk(held, pd.concat(list(rows)), self.size, self.how)
        self.state.update(state)
        yield _frame(self.by, key, found)

    def close(self) -> None:
        pass


def _frame(by: tuple[str, ...], key: tuple, found: list) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["start", "n", "mean", "score"])
    out["start"] = pd.to_datetime(out["start"])
    for at, name in enumerate(by):
        out.insert(at, name, pd.Series([key[at]] * len(out), dtype=object))
    return out


def _shape(by: tuple[str, ...]) -> str:
    return ", ".join([*(f"{c} string" for c in by), "start timestamp, n long, mean double, score double"])


def stream_bursts(rows: DataFrame, size: str, delay: str, by: tuple[str, ...] = ("dataset",), how: Settings = Settings()) -> DataFrame:
    """(by.., start, n, mean, score) of each burst of a stream of rows, once its window has
    closed: event time has passed its end by `delay`."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return window_counts(rows, size, delay, by=by).groupBy(*by).transformWithStateInPandas(
        Detector(by, size, how), outputStructType=_shape(by), outputMode="Append", timeMode="None")


def find_bursts(rows: DataFrame, size: str, by: tuple[str, ...] = ("dataset",), how: Settings = Settings()) -> DataFrame:
    """The same over stored rows: only the windows' counts reach a series' task."""
    counts = window_counts(rows.filter("event_time IS NOT NULL"), size, by=by)
    width = pd.Timedelta(size)

    def run(key: tuple, windows: pd.DataFrame) -> pd.DataFrame:
        return _frame(by, key, walk(None, windows, width, how)[1])
    return counts.groupBy(*by).applyInPandas(run, _shape(by))
