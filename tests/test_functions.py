import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logquarry import functions as C
from logquarry.functions.text import TEMPLATE_PATTERN


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "s string").select(fn(F.col("s"))).first()[0]


@pytest.mark.parametrize("text, want", [
    ("", ""), (None, ""), ("no es una fecha", ""), ("2023-10-10 10:00:00", "2023-10-10T10:00:00"),
    ("2023-10-10T10:00:00", "2023-10-10T10:00:00"), ("2023-10-10T10:00:00Z", "2023-10-10T10:00:00"),
    ("2023-10-10T12:00:00+02:00", "2023-10-10T10:00:00"), ("2023-10-10T10:00:00.123456", "2023-10-10T10:00:00.123456"),
    ("2023-10-10T10:00:00.5", "2023-10-10T10:00:00.500000"), ("2023-10-10T10:00:00.000", "2023-10-10T10:00:00"),
    ("2023-10-10", "2023-10-10T00:00:00"), ("2023-10-10 10:00", "2023-10-10T10:00:00"),
    ("21/Aug/2026:13:00:00 +0000", "2026-08-21T13:00:00"), ("21/Aug/2026:15:00:00 +0200", "2026-08-21T13:00:00"),
    ("1/sept/2026:15:00:00", "2026-09-01T15:00:00"), ("21/Aug/2026:13:00:00 +0000 tail", "2026-08-21T13:00:00"),
    ("31/Feb/2026:13:00:00 +0000", ""), ("21/Ago/2026:13:00:00 +0000", ""), ("1696948800", "2023-10-10T14:40:00"),
    ("1696948800123", "2023-10-10T14:40:00.123000"), ("9" * 40, ""), ("2023", "1970-01-01T00:33:43"),
    ("10:00:00", ""), ("2023-1-1 1:2:3", ""), ("=2023-10-10", ""), ("2023-13-10 10:00:00", ""),
])
def test_norm_ts(spark, text, want):
    assert one(spark, text, C.norm_ts) == want


def test_norm_ts_other_months(spark):
    assert one(spark, "21/Ago/2026:13:00:00 +0000", lambda c: C.norm_ts(c, {"ago": 8})) == "2026-08-21T13:00:00"


@pytest.mark.parametrize("text, want", [
    ("conecto desde 10.0.0.5 al puerto 8080", "conecto desde * al puerto *"), ("hash deadbeef00112233 ok", "hash * ok"),
    ("item 42 de 100 copias 9f8e7d654321", "item * de * copias *"), (None, ""), ("x1 1x a_1", "x1 1x a_1"),
    ("2023-10-10 13:55:36 info fallo desde 192.168.1.9 puerto 8080", "*-*-* *:*:* info fallo desde * puerto *"),
])
def test_template(spark, text, want):
    assert one(spark, text, C.make_template) == want


PARTS = st.lists(st.sampled_from(["1", "255", "1234", ".", ".", " ", "deadbeef", "g", "_", "-", "é", "٣", "12345678"]),
                 max_size=24).map("".join)


@settings(max_examples=1500, deadline=None, suppress_health_check=list(HealthCheck))
@given(PARTS)
def test_one_pattern_equals_three_replacements(text):
    steps = text
    for p in (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b[0-9a-fA-F]{8,}\b", r"\b\d+\b"):
        steps = re.sub(p, "*", steps)
    assert re.sub(TEMPLATE_PATTERN.replace("(?dU)", ""), "*", text) == steps


def test_small_ones(spark):
    assert [one(spark, x, C.norm_level) for x in ("warning", "Fatal", "odd")] == ["WRN", "CRIT", "odd"]
    assert [one(spark, x, C.csv_cell) for x in ("=1", "+1", "-", "@x", "\tx", "\rx", "\nx", "x=", "", None)] == [
        "'=1", "'+1", "'-", "'@x", "'\tx", "'\rx", "'\nx", "x=", "", ""]
    assert [one(spark, x, C.status_class) for x in ("200", "301", "404", "500", "", "-", "20x")] == [
        "2xx", "3xx", "4xx", "5xx", "", "", "2xx"]
    assert [one(spark, x, C.safe_base_name) for x in ("../../../etc/passwd", "archivo<script>.log", "..", "a/b c.txt")] == [
        "passwd", "archivo_script_.log", "subido", "b_c.txt"]
    assert [one(spark, x, C.norm_lang) for x in (" ES", "en", "fr", None)] == ["es", "en", "auto", "auto"]
    assert [one(spark, x, C.level_rank) for x in ("INF", "ERR", "RAW", "zz")] == [1, 3, 6, 7]
    assert one(spark, "a 999.1.1.1 b 2.2.2.2", C.first_ipv4) == "999.1.1.1"


def test_answer_key(spark):
    key = lambda m, l: one(spark, "línea", lambda c: C.answer_key(c, F.lit(m), F.lit(l)))
    assert key("m", "es") == hashlib.sha256("m\0es\0línea".encode()).hexdigest()
    assert len({key("m", "es"), key("n", "es"), key("m", "en")}) == 3 and key("", "zz") == key("local", "auto")


@pytest.mark.parametrize("glob, hits, misses", [
    ("*504*", ["x 504 y", "504"], ["50 4"]), ("a?c", ["abc"], ["ac", "abcd", "abc\n"]), ("[!a]x", ["bx"], ["ax"]),
    ("[a-c]x", ["bx"], ["dx"]), ("a.b", ["a.b"], ["axb"]), ("[", ["["], ["x"]), ("a\nb*", ["a\nbc"], ["ab"]),
])
def test_glob(spark, glob, hits, misses):
    pattern = C.glob_to_regex(glob)
    assert [one(spark, x, lambda c: c.rlike(pattern)) for x in hits + misses] == [True] * len(hits) + [False] * len(misses)


def test_highlight(spark):
    mark = lambda s, *t: one(spark, s, lambda c: C.highlight(c, list(t)))
    assert mark("<b> & amp AMP", "amp") == "&lt;b&gt; &amp; <mark>amp</mark> <mark>AMP</mark>"
    assert mark("a.b axb", "a.b") == "<mark>a.b</mark> axb"
    assert mark("<script>'\"", "", " ") == "&lt;script&gt;&#39;&quot;"


def test_sql_functions_equal_the_column_functions(spark):
    texts = ["", None, "2023-10-10 10:00:00,5", "2023-10-10T12:00+02:00", "2023-10-10", "21/Aug/2026:15:00:00 +0200",
             "1/sept/2026:15:00:00", "31/Feb/2026:13:00:00", "1696948800", "1696948800123", "9" * 40, "=2023-10-10",
             "warning", "odd", "conecto desde 10.0.0.5 al 8080 deadbeef00112233", "=1", "\tx", "é" * 601]
    assert C.register_sql_functions(spark)
    spark.createDataFrame([(t,) for t in texts], "s string").createOrReplaceTempView("texts")
    same = {"lq_norm_level": C.norm_level, "lq_first_ipv4": C.first_ipv4, "lq_make_template": C.make_template,
            "lq_truncate": C.truncate, "lq_csv_cell": C.csv_cell, "lq_event_time": C.event_time, "lq_norm_ts": C.norm_ts}
    got = spark.sql("SELECT s, " + ", ".join(f"{n}(s) AS {n}" for n in same) + " FROM texts")
    want = spark.table("texts").select("s", *[f(F.col("s")).alias(n) for n, f in same.items()])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_bucket_range():
    assert C.bucket_range("2023-10-10T10:05") == ("2023-10-10T10:05:00", "2023-10-10T10:06:00")
    assert C.bucket_range("2023-10-10T23") == ("2023-10-10T23:00:00", "2023-10-11T00:00:00")
    assert C.bucket_range("2023-10-10") is None and C.bucket_range("2023-99-10T10") is None
