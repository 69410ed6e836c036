"""Required texts of patterns, and many patterns against few at a time."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from logquarry import schema
from logquarry.functions.literals import folded, required
from logquarry.operators import runbooks


@pytest.mark.parametrize(("pattern", "want"), [
    (r"error \d+ timeout", {" timeout"}), (r"^fail: .*", {"fail: "}), (r"(abc|def)x", {"abc", "def"}), (r"(abc|d)+", None),
    (r"\d{3,}", None), (r"(?:abcd)?ef", None), (r"(?:abcd)+ef", {"abcd"}), (r"a\bbc", {"abc"}), (r"Err(?=or)XY", {"errxy"}),
    (r"(?i)straße", {"stra"}), (r"[Tt]imeout", {"imeout"}), (r"(?:abc|abd)efgh", {"efgh"}), (r"([", None), ("", None),
    (r"(?s)^(?:.*purchase.*took ..)\z", {"purchase"}), (r"a.b.c", None), (r"x*?yyyy{2}", {"yyy"})])
def test_required(pattern, want):
    assert required(pattern) == (None if want is None else frozenset(want))


def test_what_matches_holds_a_required_text():
    """Random patterns over few letters against random texts."""
    r = random.Random(4)

    def make(depth=0):
        kind = r.randrange(9 if depth < 3 else 4)
        if kind < 4:
            return "".join(r.choice("abcK") for _ in range(r.randrange(1, 5)))
        if kind == 4:
            return f"({make(depth + 1)}|{make(depth + 1)})"
        if kind == 5:
            return f"(?:{make(depth + 1)}){r.choice(['?', '*', '+', '{2}', '{0,2}'])}"
        if kind == 6:
            return r.choice([".", "[ab]", r"\w", r"\b", "^", "(?=a)"])
        return make(depth + 1) + make(depth + 1)
    tried = 0
    for _ in range(3000):
        pattern = r.choice(["", "(?i)"]) + make()
        needed = required(pattern)
        for _ in range(8):
            text = "".join(r.choice("abcABCkKK ") for _ in range(r.randrange(14)))
            if needed and regex.search(pattern, text, regex.V0 | regex.UNICODE):
                assert any(t in folded(text) for t in needed), (pattern, text)
                tried += 1
    assert tried > 100


def books(spark, patterns):
    return spark.createDataFrame([(i, p, k, "", "", "", "", "") for i, (p, k) in enumerate(patterns)], schema.RUNBOOK_SCHEMA)


def hits(df):
    return sorted((r["line_no"], r["id"]) for r in df.collect())


def test_many_patterns_equal_few(spark, monkeypatch):
    r = random.Random(6)
    words = ["alpha", "Beta", "gamma", "ſtraße", "KELVIN", "Kelvin", "10.0.0.1", "x y", "delta9", ""]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(6))) for _ in range(400)] + [None, "", "漢字 alpha\nBeta"]
    rows = spark.createDataFrame(list(enumerate(texts)), "line_no long, msg string")
    table = books(spark, [("alpha", "regex"), (r"(?i)kelvin", "regex"), (r"(?i)STRA", "regex"), (r"\d{2}\.0", "regex"),
                          ("*gamma*delta?", "glob"), ("[", "regex"), ("", "regex"), (r"beta|Beta x", "regex"), (r"^$", "regex"),
                          (r"alpha.*alpha", "regex"), ("*", "glob"), ("never here", "regex"), ("字 alpha", "regex")])
    few = hits(runbooks.match_runbooks(rows, table, keep=("line_no",)))
    monkeypatch.setattr(runbooks, "PATTERNS_PER_PASS", 3)
    assert hits(runbooks.match_runbooks(rows, table, keep=("line_no",))) == few and len(few) > 300
    assert hits(runbooks.match_runbooks(rows.limit(0), table, keep=("line_no",))) == []


def test_patterns_without_any_text(spark, monkeypatch):
    monkeypatch.setattr(runbooks, "PATTERNS_PER_PASS", 1)
    rows = spark.createDataFrame([(1, "a1"), (2, "b")], "line_no long, msg string")
    assert hits(runbooks.match_runbooks(rows, books(spark, [(r"\d", "regex"), ("[ab]", "regex")]), keep=("line_no",))) == [
        (1, 0), (1, 1), (2, 1)]


def test_two_thousand_patterns_cost_little_more_than_ten(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("line_no"), F.concat(
        F.lit("request of user "), F.col("id") % 5000, F.lit(" failed after "), F.col("id") % 977, F.lit(" ms at node n"),
        F.col("id") % 31).alias("msg")).repartition(8).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))

    def seconds(n):
        table = books(spark, [(rf"user {i} failed.*n\d+$", "regex") for i in range(n)])
        found = runbooks.match_runbooks(rows, table, keep=("line_no",))
        best = []
        for _ in range(2):
            start = time.perf_counter()
            found.write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        return min(best)
    ten, many = seconds(10), seconds(2000)
    print(f"10 patterns {ten:.2f} s, 2,000 patterns {many:.2f} s")
    assert many <= 3 * ten + 2
