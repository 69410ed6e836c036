"""Bursts: planted ones found, quiet series silent, a stream in parts equal to the whole."""

import datetime as dt
import random

import pandas as pd

from logquarry.streaming import bursts, live

START = dt.datetime(2024, 1, 1)


def series(seed, hours, mean, planted=()):
    r = random.Random(seed)
    return [sum(r.random() < 0.5 for _ in range(2 * mean)) * (6 if h in planted else 1) for h in range(hours)]


def found(counts, how=bursts.Settings()):
    windows = pd.DataFrame({"start": [START + dt.timedelta(hours=h) for h in range(len(counts))], "n": counts})
    windows = windows[windows["n"] > 0].sample(frac=1, random_state=1)
    return [int((s - pd.Timestamp(START)).total_seconds() // 3600) for s, *_ in
            bursts.walk(None, windows, pd.Timedelta("1 hour"), how)[1]]


def test_planted_bursts_and_quiet_series():
    for seed in range(5):
        assert found(series(seed, 2000, 20)) == []
        assert found(series(seed, 500, 20, (100, 300, 499))) == [100, 300, 499]
    assert found([0] * 50 + [30] + [0] * 20 + [30]) == [71]                 # a series begins with its first row
    assert found([5] * 60 + [9] * 30)[0] < 70                               # a lasting rise adds up
    assert found([20] * 40 + [0] * 40 + [20] * 5) != [] and found([20] * 40 + [0] * 3 + [20] * 40) == []


def test_state_carries_over(spark):
    counts = series(3, 300, 15, (150,))
    windows = pd.DataFrame({"start": [START + dt.timedelta(hours=h) for h in range(300)], "n": counts})
    whole = bursts.walk(None, windows, pd.Timedelta("1 hour"), bursts.Settings())
    state, parts = None, []
    for at in range(0, 300, 37):
        state, more = bursts.walk(state, windows[at:at + 37], pd.Timedelta("1 hour"), bursts.Settings())
        parts += more
    assert (state, parts) == whole and len(parts) == 1


def test_a_stream_in_several_runs(spark, tmp_path):
    """Batches over two restarts find what the stored rows hold, each burst once."""
    counts = {"a": series(1, 60, 20, (30, 45)), "b": series(2, 60, 20)}
    rows = [(d, START + dt.timedelta(hours=h, minutes=i % 60)) for d, ns in counts.items() for h, n in enumerate(ns) for i in range(n)]
    for lo, hi in ((0, 25), (25, 40), (40, 60)):
        part = [r for r in rows if lo <= (r[1] - START).total_seconds() // 3600 < hi]
        spark.createDataFrame(part, "dataset string, event_time timestamp").write.mode("append").parquet(str(tmp_path / "rows"))
        stream = spark.readStream.schema("dataset string, event_time timestamp").parquet(str(tmp_path / "rows"))
        live.run_available(bursts.stream_bursts(stream, "1 hour", "5 minutes"),
                           lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    got = [(r["dataset"], r["start"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = bursts.find_bursts(spark.read.parquet(str(tmp_path / "rows")), "1 hour").collect()
    assert sorted(got) == sorted((r["dataset"], r["start"], r["n"]) for r in want)
    assert [(d, s) for d, s, _ in sorted(got)] == [("a", START + dt.timedelta(hours=h)) for h in (30, 45)]
