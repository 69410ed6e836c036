import pytest
from pyspark.sql import functions as F

from logquarry.operators import answers, context, filters, paging, rollups, runbooks
from logquarry.operators.filters import FilterSpec, Presets, parse_terms
from logquarry import schema


@pytest.fixture
def three(rows):
    return rows(
        dict(ts="2023-10-10 10:00:00", level="INF", ip="1.1.1.1", path="/a", code="200", msg="alpha uno"),
        dict(ts="2023-10-10 11:00:00", level="ERR", ip="10.0.0.5", path="/b", code="404", msg="beta, dos"),
        dict(ts="2023-10-11 10:00:00", level="INF", ip="1.1.1.1", path="/c", code="301", msg="Alphá tres"),
        dict(level="WRN", msg="sin hora")).cache()


def test_terms():
    assert parse_terms("") is parse_terms(None) is parse_terms(", ,") is parse_terms("! ,!") is None
    assert parse_terms(" 200 , !err ,! x") == [(False, "200"), (True, "err"), (True, "x")]


@pytest.mark.parametrize("spec, want", [
    ({}, [0, 1, 2, 3]), ({"level": "!ERR"}, [0, 2, 3]), ({"level": "err"}, []), ({"code": "200,301"}, [0, 2]),
    ({"code": "200,!404"}, [0]), ({"ip": "!10.0.0.5"}, [0, 2, 3]), ({"ip": "1.1"}, [0, 2]), ({"path": "/A,/c"}, [0, 2]),
    ({"q": "ALPHA"}, [0]), ({"q": "alpha,!uno"}, []), ({"q": "!beta"}, [0, 2, 3]), ({"q": "%"}, []),
    ({"q": "alpha", "phrase": True}, [0, 2]), ({"q": "beta dos", "phrase": True}, [1]), ({"q": "alph", "phrase": True}, []),
    ({"q": "alpha,beta,!uno", "phrase": True}, [1, 2]), ({"q": "!uno,!dos", "phrase": True}, [2, 3]), ({"q": "--", "phrase": True}, []),
    ({"tpl": "sin hora"}, [3]), ({"tpl": "sin hora "}, []), ({"dt": "10-10 1"}, [0, 1]),
    ({"dt_from": "2023-10-10 10:30:00", "dt_to": "2023-10-10 11:30:00"}, [1]), ({"dt_from": "2023-10-11"}, [2]),
    ({"dt_to": "2023-10-10T10:59:59"}, [0, 3]), ({"dt_to": "2023-10-10T10:59:59", "require_time": True}, [0]),
    ({"dt_from": "2023-10-12"}, []), ({"dt_from": "zzz"}, []),
])
def test_filters(three, spec, want):
    found = filters.apply_filter(three, FilterSpec(**spec))
    assert [r["line_no"] for r in found.orderBy("line_no").collect()] == want


def test_bucket_drilldown_is_half_open(rows):
    table = rows(dict(ts="2023-10-10 10:00:59.500"), dict(ts="2023-10-10 10:01:00"))
    assert filters.apply_filter(table, FilterSpec().with_bucket("2023-10-10T10:00")).count() == 1


def test_filter_reaches_the_scan(three, tmp_path, spark):
    path = str(tmp_path / "rows")
    three.write.partitionBy("owner", "dataset").parquet(path)
    spec = FilterSpec(level="ERR", dt_from="10/Oct/2023:10:00:00 +0000")
    plan = filters.for_owner(filters.apply_filter(spark.read.parquet(path), spec), "o").select("ip")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(level,ERR)" in text and "GreaterThanOrEqual(ts_norm,2023-10-10T" in text
    assert "PartitionFilters: [isnotnull(owner" in text
    read = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "raw" not in read and "search" not in read


def test_presets(three, spark):
    p = Presets().add("a", FilterSpec(level="ERR")).add("a", FilterSpec(level="INF")).add("b", FilterSpec())
    assert {tuple(r) for r in filters.count_by_preset(three, p).collect()} == {("a", 2), ("b", 4)}
    assert Presets.from_table(p.to_table(spark)).items == p.items
    assert list(p.remove("a").items) == ["b"]


def test_pages(rows):
    table = rows(*[dict(msg=f"m{i}", file=f"f{i % 3}") for i in range(60)]).cache()
    whole = [(r["file"], r["line_no"]) for r in table.orderBy("file", "line_no").collect()]
    at = lambda df: [(r["file"], r["line_no"]) for r in df.collect()]
    assert at(paging.page(table, FilterSpec(), 2, 7)) == whole[7:14]
    for page, size in ((0, 5), (1, 0)):
        with pytest.raises(ValueError):
            paging.page(table, FilterSpec(), page, size)
    for start in (0, 18, 19, 55, 70):
        assert at(paging._deep_page(table, start, 10)) == whole[start:start + 10]
    assert at(paging.keyset_page(table, FilterSpec(), whole[20], 5)) == whole[21:26]
    assert "search" not in paging.page(table, FilterSpec()).columns


def test_tops_and_kpis(three):
    assert [tuple(r) for r in rollups.top_values(three, "ip").collect()] == [("1.1.1.1", 2), ("10.0.0.5", 1)]
    assert rollups.top_values(three, "nope").count() == rollups.top_values(three, "msg").count() == 0
    assert rollups.kpis(three).first().asDict() == {"ips": 2, "paths": 3, "codes": 3, "levels": 3}
    got = {(r["field"], r["value"]): (r["rank"], r["n"]) for r in rollups.top_many(three, {"level": 1, "ip": 5}).collect()}
    assert got == {("level", "INF"): (1, 2), ("ip", "1.1.1.1"): (1, 2), ("ip", "10.0.0.5"): (2, 1)}


def test_templates(rows):
    table = rows(*[dict(ts=f"2023-10-10 10:00:0{i}", level="ERR", raw=f"fail {i} from 10.0.0.{i}") for i in range(4)],
                 dict(level="ERR", raw="no time"), dict(level="INF", ts="2023-10-10 09:00:00", raw="single"), dict(raw=""))
    got = [tuple(r) for r in rollups.templates(table).collect()]
    assert got == [("fail * from *", 4, "2023-10-10T10:00:00", "2023-10-10T10:00:03", "fail 0 from 10.0.0.0"),
                   ("no time", 1, "", "", "no time"), ("single", 1, "2023-10-10T09:00:00", "2023-10-10T09:00:00", "single")]
    assert rollups.templates(table, min_count=2).count() == 1
    assert rollups.templates(table, level="ERR").count() == 2
    assert [r["template"] for r in rollups.templates(table, limit=1).collect()] == ["fail * from *"]
    assert {tuple(r) for r in rollups.templates(table, limit=None).collect()} == set(got)


def test_templates_aggregate_by_hash(three, tmp_path, spark):
    three.write.parquet(str(tmp_path / "r"))
    counts = rollups.template_counts(spark.read.parquet(str(tmp_path / "r")))
    first = [x for x in counts._jdf.queryExecution().executedPlan().toString().split("\n") if "partial_count" in x]
    assert first and "HashAggregate" in first[0]


def test_histogram(rows):
    table = rows(*[dict(ts=f"2023-10-10 10:05:0{i}", level="ERR") for i in range(5)], dict(ts="2023-10-10 10:06:00"),
                 dict(ts="2023-10-10 11:00:00"), dict(ts="2023-10-10 11:30:00"), dict(msg="no time"))
    at = lambda df: [tuple(r) for r in df.collect()]
    minutes = rollups.histogram(table)
    assert at(minutes) == [("2023-10-10T10:05", 5), ("2023-10-10T10:06", 1), ("2023-10-10T11:00", 1), ("2023-10-10T11:30", 1)]
    assert at(rollups.histogram(table, gran="hour")) == [("2023-10-10T10", 6), ("2023-10-10T11", 2)]
    assert at(rollups.histogram(table, FilterSpec(level="ERR"))) == [("2023-10-10T10:05", 5)]
    assert rollups.histogram_total(minutes).first()[0] == 8
    filled = at(rollups.fill_gaps(minutes))
    assert len(filled) == 86 and sum(n for _, n in filled) == 8 and filled[2] == ("2023-10-10T10:07", 0)


BOOKS = [(1, "timeout", "regex"), (2, r"5\d{2}", "regex"), (3, "ERR * red*", "glob"), (4, "*504*", "glob"),
         (5, "([", "regex"), (6, "", "regex"), (7, r"(?P<n>x)y", "regex")]


def books(spark, items=BOOKS):
    return spark.createDataFrame([(i, p, k, "", "", "", "", "t") for i, p, k in items], schema.RUNBOOK_SCHEMA)


def test_runbook_match(spark, rows):
    table = rows(dict(msg="GET /x 504 gateway timeout"), dict(msg="ERR 504 de red a las 10:00"), dict(msg="quiet"))
    hits = runbooks.match_runbooks(table, books(spark), keep=("line_no",))
    assert {tuple(r) for r in hits.collect()} == {(0, 1), (0, 2), (0, 4), (1, 2), (1, 3), (1, 4)}
    assert [r["msg"] for r in runbooks.unmatched(table, books(spark)).collect()] == ["quiet"]
    counts = {r["id"]: r["n"] for r in runbooks.coverage(table, books(spark)).collect()}
    assert counts == {1: 1, 2: 2, 3: 1, 4: 2, 5: 0, 6: 0, 7: 0}
    assert runbooks.pattern_error(table, "([") and runbooks.pattern_error(table, "") and not runbooks.pattern_error(table, "a+")


def test_runbook_match_in_several_passes(spark, rows, monkeypatch):
    table = rows(dict(msg="GET /x 504 gateway timeout"), dict(msg="quiet"))
    monkeypatch.setattr(runbooks, "PATTERNS_PER_PASS", 1)
    hits = runbooks.match_runbooks(table, books(spark), keep=("line_no",))
    assert {tuple(r) for r in hits.collect()} == {(0, 1), (0, 2), (0, 4)}
    assert [r["msg"] for r in runbooks.unmatched(table, books(spark)).collect()] == ["quiet"]


def test_runbook_table(spark):
    base = books(spark, BOOKS[:2])
    new = lambda *p: spark.createDataFrame([(x, "odd") for x in p], "pattern string, kind string")
    grown = runbooks.add_runbooks(base, new("b", "a"))
    assert [(r["id"], r["pattern"], r["kind"]) for r in runbooks.list_runbooks(grown).collect()][2:] == [
        (3, "a", "regex"), (4, "b", "regex")]
    with pytest.raises(ValueError):
        runbooks.add_runbooks(base, new("timeout"))
    with pytest.raises(ValueError):
        runbooks.add_runbooks(base, new("q", "q"))
    assert runbooks.add_runbooks(base, new("timeout", "q"), on_conflict="ignore").count() == 3
    edit = lambda i, p: spark.createDataFrame([(i, p, "glob", "why")], "id long, pattern string, kind string, causa string")
    changed = runbooks.get_runbook(runbooks.update_runbooks(base, edit(1, "late*")), 1).first()
    assert (changed["pattern"], changed["kind"], changed["causa"], changed["created_at"]) == ("late*", "glob", "why", "t")
    assert runbooks.update_runbooks(base, edit(99, "zz")).exceptAll(base).isEmpty()
    with pytest.raises(ValueError):
        runbooks.update_runbooks(base, edit(1, r"5\d{2}"))
    assert [r["id"] for r in runbooks.delete_runbook(base, 1).collect()] == [2]


def test_context(lines, spark):
    table = lines(*[f"linea{i}" for i in range(10)])
    target = lambda n: spark.createDataFrame([("f", n)], "file string, line_no long")
    at = lambda n, k: [(r["position"], r["value"], r["shown_line"]) for r in
                       context.context(table, target(n), k).orderBy("line_no").collect()]
    assert at(4, 2) == [("before", "linea2", 3), ("before", "linea3", 4), ("current", "linea4", 5),
                        ("after", "linea5", 6), ("after", "linea6", 7)]
    assert [p for p, _, _ in at(1, 5)].count("before") == 1
    assert at(0, 0) == [("current", "linea0", 1)]
    frame = context.context_frame(table, 2, block_bits=1).orderBy("line_no").collect()
    assert [(r["before"], r["after"]) for r in frame][3:5] == [("linea1\nlinea2", "linea4\nlinea5"), ("linea2\nlinea3", "linea5\nlinea6")]


# --- answers ---------------------------------------------------------------

def fail_on_x(prompt):
    return ("x" not in prompt, prompt.upper())


def test_answers(spark):
    lines_df = spark.createDataFrame([("a",), ("a",), ("x",), ("b",), ("",)], "line string")
    empty = spark.createDataFrame([], schema.ANSWER_SCHEMA)
    got, fresh = answers.enrich_answers(lines_df, empty, fail_on_x)
    assert {(r["line"], r["ok"], r["answer"], r["cached"]) for r in got.collect()} == {
        ("a", True, "A", False), ("b", True, "B", False), ("x", False, "X", False)}
    cache = answers.insert_or_ignore(empty, fresh)
    again, fresh = answers.enrich_answers(lines_df, cache, fail_on_x)
    assert {r["line"]: r["cached"] for r in again.collect()} == {"a": True, "b": True, "x": False}
    assert fresh.count() == 0
    other = cache.limit(1).withColumn("answer", F.lit("changed"))
    assert answers.insert_or_ignore(cache, other).exceptAll(cache).isEmpty()


def carry(prompt):
    return True, str(prompt.count("PLANTILLA (")) + ("+" + prompt.split("\n")[1] if prompt.startswith("Summary") else "")


def second_fails(prompt):
    return ("Summary" not in prompt, "bad" if "Summary" in prompt else "s")


@pytest.mark.parametrize("n, sizes", [(60, [50, 10]), (50, [50]), (230, [50, 50, 50, 50])])
def test_diagnosis(rows, n, sizes):
    word = lambda i: "".join(chr(103 + int(c)) for c in f"{i:03d}")
    table = rows(*[dict(level="ERR", raw=f"fail {word(i)} now") for i in range(n)])
    chosen = answers.select_templates(table).cache()
    batches = answers.diagnose_batches(chosen).orderBy("batch").collect()
    assert [r["size"] for r in batches] == sizes and {r["total"] for r in batches} == {sum(sizes)}
    assert [r["is_last"] for r in batches] == [False] * (len(sizes) - 1) + [True]
    end = answers.diagnose(answers.diagnose_batches(chosen), carry).first()
    assert (end["ok"], end["conclusion"], end["analyzed"]) == (True, "+".join(map(str, reversed(sizes))), sum(sizes))
    failed = answers.diagnose(answers.diagnose_batches(chosen), second_fails).first()
    assert failed["ok"] == (len(sizes) == 1)
    report = answers.diagnose_report(chosen, answers.diagnose(answers.diagnose_batches(chosen), carry)).first()
    assert len(report["top"]) == 10


def test_diagnosis_of_nothing_and_of_imports(rows):
    assert answers.select_templates(rows(dict(level="INF", raw="a"))).count() == 0
    imported = rows(dict(raw="a", format="results"), dict(raw="b", format="results"))
    assert answers.select_templates(imported).count() == 2


def test_diagnosis_key(rows):
    chosen = answers.select_templates(rows(dict(level="ERR", raw="a b"), dict(level="ERR", raw="c d"))).cache()
    key = lambda c, *a: answers.diagnose_keys(c, *a).first()["hash"]
    keys = [key(chosen, "ERR", "m", "es"), key(chosen, "WRN", "m", "es"), key(chosen, "ERR", "n", "es"),
            key(chosen, "ERR", "m", "en"), key(chosen.filter("rank = 1"), "ERR", "m", "es"),
            key(chosen.withColumn("dataset", F.lit("z")), "ERR", "m", "es")]
    assert len(set(keys)) == len(keys) and key(chosen, "ERR", "m", "es") == keys[0]
