"""Stateful following against the batch load of the same files."""

import os

import pytest

from logquarry import load_files
from logquarry.operators.detect import detect_format
from logquarry.streaming import following, live, tail

HEAD, LATER = "#Fields: date time c-ip sc-status", "#Fields: date time c-ip cs-method"


@pytest.fixture
def run(spark, tmp_path):
    """run() takes in what the followed folder holds by now; each call is a restarted query."""
    folder, tables = tmp_path / "logs", live.LiveTables(spark, str(tmp_path / "live"))
    os.makedirs(folder)

    def once(datasets=None, **options):
        lines = tail.follow(spark, str(folder), "d", statePath=str(tmp_path / "state.json"), **options)
        live.run_available(following.follow_rows(lines, datasets), tables.write, str(tmp_path / "checkpoint"))
        return tables.rows()
    return folder, once


def base(df, *columns):
    return sorted((r["file"].rsplit("/", 1)[-1], r["line_no"], *(r[c] for c in columns)) for r in df.collect())


def test_stream_equals_the_batch_load(spark, run):
    """Three formats, a blank line, a half-written line; taken in over three runs."""
    folder, once = run
    w3c = [HEAD] + [f"2024-01-01 10:00:{i % 60:02d} 10.0.0.{i % 9} {200 + i % 3}" for i in range(300)]
    plain = [f"2024-01-01 10:00:{i % 60:02d} error failed {i}" if i != 7 else "" for i in range(250)]
    clf = [f'10.0.0.{i % 9} - - [01/Jan/2024:10:00:{i % 60:02d} +0000] "GET /p{i} HTTP/1.1" 200 5' for i in range(180)]
    files = {"w.log": w3c, "g.log": plain, "a.log": clf}
    for share in (0.5, 0.8, 1.0):
        for name, text in files.items():
            whole = "\n".join(text) + "\n"
            (folder / name).write_text(whole if share == 1.0 else whole[:int(len(whole) * share)])
        got = once(maxPartitionBytes="900")
    loaded = load_files(spark, [str(folder)]).rows
    columns = ("format", "ts", "level", "ip", "code", "path", "msg", "raw")
    assert base(got, *columns) == base(loaded, *columns) and got.count() == 300 + 250 + 180


def test_a_changed_header_holds_from_its_line_on(run):
    folder, once = run
    (folder / "w.log").write_text("\n".join([HEAD, "2024-01-01 10:00:00 1.1.1.1 200", ""]))
    once()
    with (folder / "w.log").open("a") as f:
        f.write("\n".join(["2024-01-01 10:00:01 1.1.1.1 404", LATER, "2024-01-01 10:00:02 2.2.2.2 POST", ""]))
    once()
    with (folder / "w.log").open("a") as f:
        f.write("2024-01-01 10:00:03 3.3.3.3 PUT\n")
    assert base(once(), "code", "method") == [("w.log", 1, "200", ""), ("w.log", 2, "404", ""), ("w.log", 4, "", "POST"),
                                              ("w.log", 5, "", "PUT")]


def test_a_cut_file_starts_anew(run):
    folder, once = run
    (folder / "g.log").write_text("".join(f"2024-01-01 10:00:00 info {i}\n" for i in range(5)))
    once()
    (folder / "g.log").write_text(HEAD + "\n2024-01-01 10:00:00 1.1.1.1 200\n")
    assert [(f.split("#")[1:], n, c) for f, n, c in base(once(), "code") if "#" in f] == [(["1"], 1, "200")]


def test_many_lines_of_one_file_keep_their_order(run):
    """More lines in a batch than an Arrow batch holds, read in many ranges."""
    folder, once = run
    (folder / "g.log").write_text("".join(f"2024-01-01 10:00:00 info number {i}\n" for i in range(25_000)))
    rows = once(maxPartitionBytes="30000")
    assert rows.count() == 25_000 and rows.filter("msg <> concat('number ', line_no)").count() == 0


def test_known_datasets_keep_their_format(spark, run):
    folder, once = run
    known = spark.createDataFrame([("d", "w3c", ["date", "time", "c-ip", "sc-status"])], "dataset string, format string, w3c_fields array<string>")
    (folder / "w.log").write_text("2024-01-01 10:00:00 1.1.1.1 200\n\n2024-01-01 10:00:01 1.1.1.1 500\n")
    assert base(once(known), "format", "code") == [("w.log", 0, "w3c", "200"), ("w.log", 2, "w3c", "500")]


@pytest.mark.parametrize("text", [
    ["plain words"] * 3, [HEAD, "x"], ['{"level": "error", "msg": "m"}'] * 8 + ["other"] * 2, ["2024-01-01 10:00:00 info a"] * 71 + ["x"] * 29,
    ["2024-01-01 10:00:00 info a"] * 70 + ["x"] * 30, [HEAD] + ['1.1.1.1 - - [01/Jan/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 5'] * 9])
def test_the_verdict_is_that_of_a_load(lines, text):
    from pyspark.sql import functions as F

    from logquarry.operators.detect import marks
    table = lines(*text)
    row = table.agg(F.count("*").alias("n"), *[F.count_if(c).alias(m) for m, c in marks(F.col("value")).items()]).first()
    counts = {m: row[m] for m in following.MARKS}
    assert following.verdict(row["n"], row["w3c"] > 0, counts) == detect_format(table).first()["format"]
