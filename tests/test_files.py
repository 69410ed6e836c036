import bz2
import gzip
import lzma
import zipfile

import pytest
from pyspark.sql import functions as F

from logquarry.operators.filters import FilterSpec
from logquarry.plans.load import load_files
from logquarry.sinks import audit, exports, tables
from logquarry.sources import archives, lines, listing, results

CLF = '127.0.0.1 - - [10/Oct/2023:13:55:36 -0700] "GET /{} HTTP/1.1" 200 1234'


def read(spark, path):
    return [r["value"] for r in lines.read_lines(spark, [str(path)]).orderBy("line_no").collect()]


@pytest.mark.parametrize("data, want", [
    (b"a\nb\n", ["a", "b"]), (b"a\n\nb", ["a", "", "b"]), (b"a\r\nb\rc\r\r\n", ["a", "b\rc"]),
    ("﻿año\n".encode(), ["año"]), (b"caf\xe9 \x93test\x94\n", ["café “test”"]),
    (b"hola\x81mundo\n", ["hola\x81mundo"]), ("a\x85b c\n".encode(), ["a\x85b c"]),
])
def test_lines_and_encodings(spark, tmp_path, data, want):
    (tmp_path / "a.log").write_bytes(data)
    assert read(spark, tmp_path / "a.log") == want


def test_encoding_is_judged_on_the_whole_file(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * 65535 + "é\n".encode() * 3 + b"end\n")
    profile = lines.file_profile(lines.profile_splits(lines.scan_text(spark, [str(tmp_path / "a.log")])))
    assert profile.first()["encoding"] == "utf-8"


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.log").write_text("".join(f"{f} line {i} {'x' * (i % 97)}\n" for i in range(20000)))
    paths = [str(tmp_path / f"{f}.log") for f in range(3)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("100000", old["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = lines.read_lines(spark, paths).select(
                F.split("value", " ")[2].cast("long").alias("i"), "line_no", "file").cache()
            assert got.filter("i <> line_no").isEmpty() and got.count() == 60000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_changed_splits_fail_loudly(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n" * 50000)
    raw = lines.scan_text(spark, [str(tmp_path / "a.log")])
    splits = lines.profile_splits(raw).withColumn("lines", F.col("lines") - 1)
    with pytest.raises(Exception, match="splits changed"):
        lines.number_lines(raw, splits, lines.file_profile(splits)).collect()


@pytest.fixture
def packed(tmp_path):
    text = b"uno\r\ndos\n\ntres"
    (tmp_path / "a.log").write_bytes(gzip.compress(text))        # misnamed
    (tmp_path / "b.xz").write_bytes(lzma.compress(text))
    (tmp_path / "c.bz2").write_bytes(bz2.compress(text))
    (tmp_path / "d.gz").write_bytes(gzip.compress(text))
    (tmp_path / "h.gz").write_bytes(text)                        # plain text named .gz
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        for name, data in (("d/", b""), ("__MACOSX/x.log", b"no"), ("notas.md", b"no"), ("in/app.LOG", text)):
            z.writestr(name, data)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("only.bin", text)
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("dir/", b"")
    return tmp_path


def test_kinds_by_leading_bytes(spark, packed):
    found = listing.classify_files(listing.list_files(spark, str(packed)))
    got = {r["path"][-5:]: (r["compressed"], r["via"]) for r in found.collect()}
    assert got == {"a.log": ("gzip", "archive"), "/b.xz": ("xz", "archive"), "c.bz2": ("bzip2", "text"),
                   "/d.gz": ("gzip", "text"), "e.zip": ("zip", "archive"), "f.zip": ("zip", "archive"),
                   "g.zip": ("zip", "archive"), "/h.gz": ("", "archive")}


def test_archives(spark, packed):
    files = listing.classify_files(listing.list_files(spark, str(packed))).filter("via = 'archive'")
    seen = archives.inspect_archives(files).cache()
    info = {r["file"][-5:]: (r["inner"], r["total"], r["error"]) for r in seen.collect()}
    assert info == {"a.log": ("", 4, ""), "/b.xz": ("", 4, ""), "e.zip": ("app.LOG", 4, ""), "f.zip": ("only.bin", 4, ""),
                    "g.zip": ("", 0, "empty_zip"), "/h.gz": ("", 4, "")}
    got = archives.read_archives(archives.readable(seen).join(files.select("file", "compressed"), "file"))
    for name in ("a.log", "b.xz", "e.zip", "f.zip", "h.gz"):
        own = got.filter(F.col("file").endswith("/" + name)).orderBy("line_no").collect()
        assert [(r["line_no"], r["value"]) for r in own] == list(enumerate(["uno", "dos", "", "tres"]))
    tight = {r["error"] for r in archives.inspect_archives(files, limit=5).collect()}
    assert tight == {"too_large_decompressed", "empty_zip"}


def test_load(spark, packed, tmp_path):
    more = tmp_path / "more"
    more.mkdir()
    (more / "web.log").write_text("".join(CLF.format(i) + "\n" for i in range(30)) + "noise\n")
    (more / "iis.log").write_text("#Version: 1\n#Fields: date time c-ip sc-status\n2023-10-10 13:55:36 1.2.3.4 500\n")
    (more / "empty.log").write_text("")
    (more / "blank.log").write_text("\n \n")
    (more / "cp.log").write_bytes(b"2023-10-10 10:00:00 error caf\xe9\n")
    (more / "bad.xz").write_bytes(b"\xfd7zXZ\x00broken")
    sub = more / "sub"
    sub.mkdir()
    (sub / "web.log").write_text('{"msg": "m", "level": "error"}\n')
    got = load_files(spark, [str(packed)], owner="u")
    files = {r["dataset"]: r.asDict() for r in got.files.collect()}
    assert {d: (f["format"], f["total"], f["parsed"], f["rejected"]) for d, f in files.items()} == {
        "a.log": ("raw", 4, 4, 0), "b.xz": ("raw", 4, 4, 0), "c.bz2": ("raw", 4, 4, 0), "d.gz": ("raw", 4, 4, 0),
        "e.zip": ("raw", 4, 4, 0), "f.zip": ("raw", 4, 4, 0), "h.gz": ("raw", 4, 4, 0), "web.log_1": ("apache", 31, 30, 1),
        "iis.log": ("w3c", 3, 1, 2), "cp.log": ("generic", 1, 1, 0), "web.log": ("json", 1, 1, 0)}
    assert {r["file"].rsplit("/", 1)[1]: r["reason"] for r in got.refused.collect()} == {
        "g.zip": "empty_zip", "empty.log": "empty", "blank.log": "empty", "bad.xz": "unreadable"}
    assert files["cp.log"]["encoding"] == "cp1252" and files["e.zip"]["inner"] == "app.LOG"
    assert files["iis.log"]["w3c_fields"] == ["date", "time", "c-ip", "sc-status"]
    assert files["iis.log"]["meta"] == ["#Version: 1", "#Fields: date time c-ip sc-status"]
    assert got.rows.filter("dataset = 'cp.log'").first()["msg"] == "café"
    assert got.rows.count() == sum(f["parsed"] for f in files.values())
    assert {(r["dataset"], r["value"]) for r in got.rejects.collect()} == {
        ("web.log_1", "noise"), ("iis.log", "#Version: 1"), ("iis.log", "#Fields: date time c-ip sc-status")}


def test_admission(spark):
    files = lambda *f: listing.admit_files(spark.createDataFrame(list(f), "path string, size long"))
    names = [f"/x/a{e}" for e in (".log", ".TXT", ".csv", ".json", ".gz", ".bz2", ".xz", ".zip")]
    assert all(r["admitted"] for r in files(*[(n, 5) for n in names]).collect())
    bad = {r["path"]: (r["reasons"], r["admitted"]) for r in files(
        ("a.log", 1), ("b.pdf", 1), ("c", 1), (".log", 1), ("d.log", 600 << 20)).collect()}
    assert bad == {"a.log": ([], False), "b.pdf": (["unsupported_extension"], False), "c": (["unsupported_extension"], False),
                   ".log": (["unsupported_extension"], False), "d.log": (["too_large"], False)}
    whole = files(*[(f"{i}.log", 400 << 20) for i in range(3)]).collect()
    assert {tuple(r["reasons"]) for r in whole} == {("batch_too_large",)}


def test_names(spark):
    paths = ["/1/a.log", "/2/a.log", "/3/a.log_1", "/4/b<.log"]
    got = listing.assign_names(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert [r["dataset"] for r in got.orderBy("path").collect()] == ["a.log", "a.log_1", "a.log_1_1", "b_.log"]


def test_names_that_look_numbered(spark):
    """As one file after the other takes the first free name."""
    import random
    r = random.Random(3)
    bases = ["a", "a", "a_1", "a_1"] + [r.choice(["a", "a_1", "a_1_1", "a_2", "b", "c_7"]) for _ in range(60)]
    taken, want = set(), []
    for base in bases:
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        want.append(name)
    got = listing.assign_names(spark.createDataFrame([(i, f"/{i}/{b}") for i, b in enumerate(bases)], "i int, path string"), order="i")
    assert [x["dataset"] for x in got.orderBy("i").collect()] == want and want[:4] == ["a", "a_1", "a_1_1", "a_1_2"]


def test_one_damaged_file_is_refused_alone(spark, tmp_path):
    import gzip
    from logquarry import load_files
    whole = gzip.compress(b"2024-01-05 10:00:00 ERROR broken pipe\n" * 2000)
    (tmp_path / "good.log.gz").write_bytes(whole)
    (tmp_path / "bad.log.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "plain.log").write_text("2024-01-05 10:00:00 ERROR other\n")
    got = load_files(spark, [str(tmp_path)])
    assert got.rows.count() == 2001
    assert [(r["file"].rsplit("/", 1)[-1], r["reason"]) for r in got.refused.collect()] == [("bad.log.gz", "unreadable")]


def test_several_damaged_files_of_any_name(spark, tmp_path, monkeypatch):
    import bz2
    import gzip

    from logquarry.plans import load
    text = b"2024-01-05 10:00:00 ERROR broken pipe\n" * 2000
    packed, crushed = gzip.compress(text), bz2.compress(text)
    bad = {"a b%20c.log.gz": packed[:len(packed) // 2], "crc.gz": packed[:-8] + b"12345678",
           "d+e.bz2": crushed[:len(crushed) // 2], "g.bz2": crushed[:60] + b"XXXX" + crushed[64:]}
    for name, data in {**bad, "good.gz": packed, "good.bz2": crushed}.items():
        (tmp_path / name).write_bytes(data)
    for limit in (8, 1):
        monkeypatch.setattr(load, "DAMAGED_ONE_BY_ONE", limit)
        got = load.load_files(spark, [str(tmp_path)])
        assert got.rows.count() == 4000
        assert {r["reason"] for r in got.refused.collect()} == {"unreadable"} and got.refused.count() == len(bad)


def test_other_failures_are_not_taken_for_damage(spark, tmp_path, monkeypatch):
    import gzip

    from logquarry.plans import load
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"x\n"))
    calls = []

    def fails(*_):
        calls.append(1)
        raise RuntimeError("Job aborted: ExecutorLostFailure (executor 3 exited)")
    monkeypatch.setattr(load, "_profiled", fails)
    with pytest.raises(RuntimeError, match="ExecutorLost"):
        load.load_files(spark, [str(tmp_path)])
    assert len(calls) == 1
    assert load.damaged_file(RuntimeError("[FAILED_READ_FILE.NO_HINT] Encountered error while reading file file:///a.gz. "
                                          " SQLSTATE: KD001 AccessControlException: Permission denied")) is None


def test_a_batch_with_a_refused_file_is_not_loaded(spark, tmp_path):
    from logquarry.plans.load import Admission, load_files
    (tmp_path / "a.log").write_text("2024-01-05 10:00:00 ERROR x\n")
    (tmp_path / "b.exe").write_text("2024-01-05 10:00:00 ERROR y\n")
    got = load_files(spark, [str(tmp_path)], admission=Admission())
    assert {r["file"].rsplit("/", 1)[-1]: r["reason"] for r in got.refused.collect()} == {
        "a.log": "batch_refused", "b.exe": "unsupported_extension"}
    assert got.rows.count() == got.rejects.count() == got.files.count() == 0
    whole = load_files(spark, [str(tmp_path)])
    assert whole.rows.count() == 2 and [(f.name, f.dataType) for f in whole.files.schema] == [
        (f.name, f.dataType) for f in got.files.schema] and whole.rows.columns == got.rows.columns
    only = load_files(spark, [str(tmp_path / "a.log")], admission=Admission(max_file=None, max_batch=10))
    assert only.refused.first()["reason"] == "batch_too_large"


def test_size_limit_only_where_given(spark, tmp_path):
    import lzma
    from logquarry import load_files
    (tmp_path / "a.log.xz").write_bytes(lzma.compress(b"2024-01-05 10:00:00 ERROR x\n" * 5000))
    (tmp_path / "b.log").write_text("2024-01-05 10:00:00 ERROR y\n")
    assert load_files(spark, [str(tmp_path)]).rows.count() == 5001
    cut = load_files(spark, [str(tmp_path)], max_decompressed=1000)
    assert cut.rows.count() == 1 and cut.refused.first()["reason"] == "too_large_decompressed"


def test_cloud_paths_as_the_file_library_names_them():
    assert listing.library_uri("s3a://logs/2024/a b.gz") == "s3://logs/2024/a b.gz"
    assert listing.library_uri("abfss://c@acc.dfs.core.windows.net/x") == "abfs://c@acc.dfs.core.windows.net/x"
    assert [listing.library_uri(u) for u in ("/a/b", "file:/a/b", "file:///a/b", "hdfs://n:1/a", "gs://b/a")] == [
        "file:///a/b", "file:/a/b", "file:///a/b", "hdfs://n:1/a", "gs://b/a"]


def test_audit_of_a_quiet_user(spark, tmp_path):
    trail = spark.createDataFrame([(f"t{i:04d}", i, "a", "busy" if i else "quiet", None, None) for i in range(900)], audit.AUDIT_SCHEMA)
    assert audit.audit_for(trail, "quiet").count() == 1 and audit.audit_for(trail).count() == 500


def test_exports(spark, rows, tmp_path):
    table = rows(dict(msg='a "q", b\nc', path="=1+1", raw="r"), dict(msg=" edge ", level="ERR"), dict(msg="ñ", ip="-"))
    exports.export_csv(table, str(tmp_path / "c"))
    text = sorted(x for p in (tmp_path / "c").glob("*.csv") for x in p.read_text().split("\n")[1:])
    assert " edge " in "".join(text) and "'=1+1" in "".join(text) and '"a ""q"", b' in "".join(text)
    back = {(r["msg"], r["path"], r["ip"]) for r in exports.read_csv_export(spark, str(tmp_path / "c")).collect()}
    assert back == {('a "q", b\nc', "'=1+1", ""), (" edge ", "", ""), ("ñ", "", "'-")}
    exports.export_jsonl(table, str(tmp_path / "j"), FilterSpec(level="ERR"))
    only = spark.read.json(str(tmp_path / "j")).collect()
    assert len(only) == 1 and only[0]["msg"] == " edge " and only[0]["host"] == "" and "raw" in only[0].asDict()


def test_datasets(spark, rows, tmp_path):
    path = str(tmp_path / "rows")
    table = rows(*[dict(msg=str(i)) for i in range(30)])
    odd = table.withColumn("dataset", F.lit("a b/c=d"))
    tables.append_rows(table.unionByName(odd), path)
    tables.replace_datasets(table, path)
    assert tables.read_rows(spark, path).count() == 60
    assert tables.remove_dataset(spark, path, "o", "a b/c=d")
    assert tables.read_rows(spark, path).count() == 30
    tables.append_rows(table.withColumn("owner", F.lit("p")), path)
    assert tables.remove_dataset(spark, path, "o")
    assert [r[0] for r in tables.read_rows(spark, path).select("owner").distinct().collect()] == ["p"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "books")
    for n in (1, 2):
        tables.write_version(spark.range(n), path)
    assert tables.read_version(spark, path).count() == 2


def test_audit(spark, tmp_path):
    path = str(tmp_path / "audit")
    entries = [("2024-01-01 00:00:00", 1, "upload", "ana", "1.1.1.1"), ("2024-01-01 00:00:00", 2, "export", "eva", ""),
               ("2024-01-02 00:00:00", 3, "remove", "ana", "")]
    audit.append_audit(spark.createDataFrame(entries, "ts string, seq long, action string, user string, ip string"), path)
    trail = audit.read_audit(spark, path)
    assert [r["action"] for r in audit.audit_for(trail).collect()] == ["remove", "export", "upload"]
    assert [r["action"] for r in audit.audit_for(trail, "ana").collect()] == ["remove", "upload"]
    assert [r["action"] for r in audit.audit_for(trail, "ana", 1).collect()] == ["remove"]


def test_results(spark, lines):
    table = lines('{"_time":"1724000000.5","line":"FAIL user=x src=1.2.3.4","src_ip":"1.2.3.4","host":"h1"}',
                  '{"count":"7","sourcetype":"ms:aad:signin"}', "{}", "[]", '{"_x": "1"}', '{"_time":"2023-10-10T10:00:00Z","a":"b"}')
    got = results.rows_from_results(table).orderBy("line_no").collect()
    assert [(r["ts"], r["msg"], r["ip"], r["host"], r["app"], r["level"]) for r in got] == [
        ("1724000000", "FAIL user=x src=1.2.3.4", "1.2.3.4", "h1", "", ""),
        ("", "count=7 sourcetype=ms:aad:signin", "", "", "ms:aad:signin", ""),
        ("2023-10-10T10:00:00", "a=b", "", "", "", "")]
    assert got[0]["ts_norm"] == "2024-08-18T16:53:20" and got[0]["template"] == "FAIL user=x src=*"
    assert results.rows_from_results(table, 1).count() == 1
