import pytest
from pyspark.sql import functions as F

from logquarry.operators import detect, parsers
from logquarry.session import settle

CLF = '127.0.0.1 - - [10/Oct/2023:13:55:36 -0700] "GET /index.html HTTP/1.1" 200 1234'


def fields(df, *names):
    return [tuple(r) for r in df.orderBy("file", "line_no").select(*names).collect()]


def test_access_log(lines):
    got = fields(parsers.parse_clf(lines(CLF, "noise", CLF)), "line_no", "ip", "method", "path", "code",
                 "bytes", "msg", "raw", "ts", "ts_norm", "code_int", "bytes_num", "level")
    want = ("127.0.0.1", "GET", "/index.html", "200", "1234", "GET /index.html", CLF,
            "10/Oct/2023:13:55:36 -0700", "2023-10-10T20:55:36", 200, 1234, "")
    assert got == [(0, *want), (2, *want)]


@pytest.mark.parametrize("line, variant, code, size", [
    (CLF, "strict", "200", "1234"),
    ('1.1.1.1 - - [x] "GET /a HTTP/1.0" 304 -', "strict", "304", "-"),
    ('1.1.1.1 - [x] "GET /a HTTP/1.0" 200 5', "loose", "200", "5"),
    ('1.1.1.1 - - [x] "GET /a" 404 5', "loose", "404", "5"),
    ('1.1.1.1 - - [x] "GET /a"', "loose", "", ""),
    ('1.1.1.1 - - [x] "GET /a 1350.0"', "loose", "", ""),
    ('1.1.1.1 - - [x] "GET /a 500 12', "open_quote", "500", "12"),
])
def test_access_log_variants(lines, line, variant, code, size):
    df = lines(line).select("*", parsers.clf_variant(parsers.CLF.capture(F.col("value"))).alias("v"))
    assert [r["v"] for r in df.collect()] == [variant]
    assert fields(parsers.parse_clf(lines(line)), "code", "bytes") == [(code, size)]


def test_line_holding_the_separator(lines):
    odd = CLF.replace("index", "in\u0001d\u0001ex")
    assert fields(parsers.parse_clf(lines(odd, CLF)), "path", "code") == [
        ("/in\u0001d\u0001ex.html", "200"), ("/index.html", "200")]


W3C = ["#Software: IIS", "#Version: 1.0",
       "#Fields: date time c-ip cs-method cs-uri-stem sc-status sc-bytes",
       "2023-10-10 13:55:36 192.168.1.1 GET /api/data 200 567", "", "short line",
       "2023-10-10 13:55:37  192.168.1.2\tPOST /b 500 -  extra"]


def test_w3c(lines):
    got = fields(parsers.parse_w3c(lines(*W3C)), "line_no", "ts", "ip", "method", "path", "code", "bytes", "bytes_num")
    assert got == [(3, "2023-10-10 13:55:36", "192.168.1.1", "GET", "/api/data", "200", "567", 567),
                   (6, "2023-10-10 13:55:37", "192.168.1.2", "POST", "/b", "500", "-", None)]


def test_w3c_without_header_gives_nothing(lines):
    assert parsers.parse_w3c(lines(*W3C[3:])).count() == 0


def test_w3c_repeated_header(lines):
    text = ["#Fields: date c-ip", "2023-01-01 1.1.1.1", "#Fields: c-ip date", "2.2.2.2 2023-01-02"]
    assert fields(parsers.parse_w3c(lines(*text)), "ip") == [("1.1.1.1",), ("2023-01-02",)]
    assert fields(parsers.parse_w3c(lines(*text), repeated_headers=True), "ip") == [("1.1.1.1",), ("2.2.2.2",)]


@pytest.mark.parametrize("line, want", [
    ('{"level": "ERROR", "ip": "10.0.0.1", "msg": "fallo de conexion"}', ("ERR", "10.0.0.1", "fallo de conexion", "")),
    (' {"severity": "warn", "message": "m", "@timestamp": "2023-10-10T10:00:00Z"} ', ("WRN", "", "m", "2023-10-10T10:00:00")),
    ('{"msg": "", "message": "second", "time": 1696948800}', ("", "", "second", "2023-10-10T14:40:00")),
    ('{"a": 1}', ("", "", '{"a": 1}', "")),
    ('{"msg": {"k": 1}}', ("", "", '{"k":1}', "")),
    ('{"msg": "a", "msg": "b"}', ("", "", "b", "")),
])
def test_json(lines, line, want):
    assert fields(parsers.parse_jsonl(lines(line)), "level", "ip", "msg", "ts_norm") == [want]


@pytest.mark.parametrize("line", [
    "", "text", "[1]", '[{"msg": "x"}]', '{"a": 1', '{"a": 1} x', '{"a": 1}}', '{"a": 1}]', '{"a": 1},{"b": 2}',
    '{"a": 1},', "{'a': 1}", "null", "5"])
def test_json_refused(lines, line):
    tagged = parsers.tag_lines(lines(line).withColumn("format", F.lit("json")), ["json"])
    assert parsers.reject_rows(tagged).count() == 1
    assert parsers.parse_jsonl(lines(line)).count() == 0


def test_syslog(lines):
    got = parsers.parse_syslog(lines("<34>1 2023-10-10T13:55:36.123Z host01 app1[123]: mensaje de 10.0.0.9",
                                     "1 2023-10-10T13:55:36+02:00 h app msg", "no"))
    assert fields(got, "ts", "host", "app", "pid", "msg", "ip", "ts_norm") == [
        ("2023-10-10T13:55:36.123Z", "host01", "app1", "123", "mensaje de 10.0.0.9", "10.0.0.9", "2023-10-10T13:55:36.123000"),
        ("2023-10-10T13:55:36+02:00", "h", "app", "", "msg", "", "2023-10-10T11:55:36")]


def test_generic(lines):
    got = parsers.parse_generic(lines("2023-10-10 13:55:36 info servicio iniciado", "noise 1.2.3.4",
                                      "2023-10-10 13:55:36.25(CET)[1:2] FATAL x", ""))
    assert fields(got, "line_no", "level", "ts", "msg", "ip") == [
        (0, "INF", "2023-10-10 13:55:36", "servicio iniciado", ""), (1, "RAW", "", "noise 1.2.3.4", "1.2.3.4"),
        (2, "CRIT", "2023-10-10 13:55:36.25", "x", ""), (3, "RAW", "", "", "")]


def test_raw_lines_stay_whole(lines):
    got = fields(parsers.parse_raw(lines("linea sin formato", "é" * 700)), "level", "msg", "raw")
    assert got == [("RAW", "linea sin formato", "linea sin formato"), ("RAW", "é" * 700, "é" * 700)]


FILES = {
    "apache": [CLF] * 8 + ["x"] * 2, "apache_70": [CLF] * 7 + ["x"] * 3, "w3c": W3C,
    "json": ['{"a": 1}'] * 3, "generic": ["", "2023-10-10 13:55:36 info x"], "blank": ["", "  "],
    "syslog": ["<34>1 2023-10-10T13:55:36.123Z h app: m"], "raw": ["a", "b"],
    "late": ["x"] * 100 + [CLF] * 400, "padded": [""] * 5000 + [CLF] * 200,
}


def test_detection(lines):
    got = {r["file"]: r for r in detect.detect_format(lines(FILES)).collect()}
    assert {f: r["format"] for f, r in got.items()} == {
        "apache": "apache", "apache_70": "raw", "w3c": "w3c", "json": "json", "generic": "generic",
        "syslog": "syslog", "raw": "raw", "late": "raw", "padded": "apache"}
    assert got["w3c"]["w3c_fields"] == W3C[2].split()[1:] and got["w3c"]["meta"] == W3C[:3]
    assert got["raw"]["w3c_fields"] == [] and got["raw"]["meta"] == []


def test_auto_equals_each_parser(lines):
    table = lines(FILES)
    found = settle(detect.detect_format(table))
    auto = parsers.parse_auto(table, found)
    single = {"apache": parsers.parse_clf, "json": parsers.parse_jsonl, "generic": parsers.parse_generic,
              "syslog": parsers.parse_syslog, "w3c": parsers.parse_w3c, "raw": parsers.parse_raw}
    for name, parse in single.items():
        mine = auto.filter((F.col("file") == name)).drop("format")
        assert mine.exceptAll(parse(table.filter(F.col("file") == name)).drop("format")).isEmpty()
        assert mine.count() == parse(table.filter(F.col("file") == name)).count()


def test_quality_adds_up(lines):
    table = lines(FILES)
    tagged = parsers.tag_auto(table, settle(detect.detect_format(table)))
    for r in parsers.parse_quality(tagged).collect():
        assert r["parsed"] + r["rejected"] == r["total"] == len(FILES[r["file"]])


def test_registered_parser(lines):
    from logquarry.functions.patterns import capture, captured, whole_line
    parsers.register_parser(parsers.LineParser(
        "pairs", lambda v: capture(v, whole_line(r"(\w+)=(\w+)"), 2), lambda g, v: captured(g, 2),
        lambda g, v: {"app": F.get(g, 1), "msg": F.get(g, 2)}))
    try:
        assert fields(parsers._parse_as(lines("a=b", "zz"), "pairs"), "app", "msg") == [("a", "b")]
    finally:
        del parsers.PARSERS["pairs"]


def test_lookup_beyond_broadcast_gives_the_same(lines, spark):
    from logquarry.session import lookup_join
    table = lines(FILES)
    small = settle(detect.detect_format(table)).select("file", "format")
    wide = lookup_join(table, small, ["file"], max_bytes=2)
    spun = lookup_join(table, small, ["file"], max_bytes=2)
    near = lookup_join(table, small, ["file"])
    assert spun.select(near.columns).exceptAll(near).isEmpty() and spun.count() == near.count()
    assert sorted(map(tuple, wide.select(near.columns).collect())) == sorted(map(tuple, near.collect()))
