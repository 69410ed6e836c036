"""Answers logged as they arrive: nothing is asked twice, the rate is shared."""

import time
from collections import Counter
from pathlib import Path

import pytest

from logquarry.operators import answers


def asker(calls, stop_at=None):
    """Answers with the line in capitals and notes each call; fails at a line while `stop_at` has no file `go`."""
    def ask(line):
        import os
        import uuid
        if line == stop_at and not os.path.exists(f"{calls}/go"):
            raise RuntimeError("executor lost")
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write(line)
        return (line != "bad", line.upper())
    return ask


def called(calls):
    return Counter(p.read_text() for p in Path(calls).iterdir() if p.name != "go")


def misses(spark, lines):
    return spark.createDataFrame([(f"h{x}", x) for x in lines], "hash string, line string")


def test_a_lost_task_asks_nothing_twice(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    table = misses(spark, [f"line {i}" for i in range(40)])
    ask = asker(str(calls), stop_at="line 17")
    with pytest.raises(Exception, match="executor lost"):
        answers.ask_once(table, ask, log, buckets=1).collect()
    before = called(calls)
    assert 0 < sum(before.values()) < 40
    (calls / "go").touch()
    got = answers.ask_once(table, ask, log, buckets=1).collect()
    assert {(r["line"], r["ok"], r["answer"]) for r in got} == {(f"line {i}", True, f"LINE {i}") for i in range(40)}
    assert called(calls) == Counter({f"line {i}": 1 for i in range(40)})


def test_failures_are_asked_again(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    lines = spark.createDataFrame([("bad",), ("good",), ("é\n",), ("good",)], "line string")
    cache = spark.createDataFrame([], "hash string, line string, answer string, created_at string")
    for _ in range(2):
        got, fresh = answers.enrich_answers(lines, cache, asker(str(calls)), log=log)
        assert {(r["line"], r["ok"]) for r in got.collect()} == {("bad", False), ("good", True), ("é\n", True)}
        assert {r["answer"] for r in fresh.collect()} == {"GOOD", "É\n"}
    assert called(calls) == Counter({"bad": 2, "good": 1, "é\n": 1})


def test_rate_is_shared(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    began = time.monotonic()
    got = answers.ask_once(misses(spark, "abcdefghij"), asker(str(tmp_path / "calls")), str(tmp_path / "log"),
                           per_second=10, buckets=1).count()
    assert got == 10 and time.monotonic() - began >= 0.9
    with pytest.raises(ValueError):
        answers.enrich_answers(misses(spark, "a"), None, None, per_second=1)
