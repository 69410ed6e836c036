import os

from pyspark.sql import functions as F

from logquarry.streaming import live, tail
from logquarry.streaming.tail import TailReader


def poll(reader, start):
    end = reader.latestOffset()
    got = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            got += [(r["generation"], r["byte_pos"], r["value"]) for r in batch.to_pylist()]
    return got, end


def reader(path, **options):
    return TailReader({"path": str(path), **options})


def test_appends_and_partial_lines(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\r\ntwo")
    r = reader(log)
    start = r.initialOffset()
    got, at = poll(r, start)
    assert got == [(0, 0, "one")]
    log.open("ab").write(b" done\nthree\n")
    got, at = poll(r, at)
    assert got == [(0, 5, "two done"), (0, 14, "three")]
    assert poll(r, at)[0] == []


def test_cut_file_is_read_anew(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\n")
    r = reader(log)
    _, at = poll(r, r.initialOffset())
    log.write_bytes(b"new\n")
    got, at = poll(r, at)
    assert got == [(1, 0, "new")]
    log.open("ab").write(b"more\n")
    assert poll(r, at)[0] == [(1, 4, "more")]


def test_cut_while_stopped(tmp_path):
    log, state = tmp_path / "a.log", str(tmp_path / "s" / "state.json")
    log.write_bytes(b"one\ntwo\n")
    r = reader(log, statePath=state)
    _, at = poll(r, r.initialOffset())
    log.write_bytes(b"new\n")
    again = reader(log, statePath=state)
    got, at = poll(again, at)
    assert got == [(1, 0, "new")]
    forgetful = reader(log)
    assert poll(forgetful, {str(log): [0, 8]})[0] == [(1, 0, "new")]


def test_cut_between_plan_and_read(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\nthree\n")
    r = reader(log)
    start = r.initialOffset()
    end = r.latestOffset()
    log.write_bytes(b"new\n")
    parts = r.partitions(start, end)
    got = [x["value"] for p in parts for b in r.read(p) for x in b.to_pylist()]
    assert got == ["new"]                                   # what the file still holds, no error
    again = reader(log)                                     # and after a restart
    assert [x["value"] for p in again.partitions(start, end) for b in again.read(p) for x in b.to_pylist()] == ["new"]
    log.open("ab").write(b"more\n")
    assert poll(r, end)[0] == [(1, 0, "new"), (1, 4, "more")]


def test_one_limit_for_all_files(tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.log").write_bytes(b"0123456\n" * 10)
    r, at, seen = reader(tmp_path, maxBytesPerTrigger=100), None, []
    at = r.initialOffset()
    for _ in range(20):
        got, at = poll(r, at)
        seen.append(len(got))
        if not got:
            break
    assert max(seen) <= 13 and sum(seen) == 50


def test_start_at_end(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"old\n")
    r = reader(log, startingOffsets="latest")
    start = r.initialOffset()
    log.open("ab").write(b"new\n")
    assert poll(r, start)[0] == [(0, 4, "new")]


def test_ranges_cut_anywhere(tmp_path):
    lines = [f"line {i} " + "x" * (i % 13) for i in range(300)] + ["", "", "é" * 40]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    for size in (1, 7, 64, 1000, 1 << 20):
        r = reader(tmp_path, maxPartitionBytes=str(size))
        got, _ = poll(r, r.initialOffset())
        assert [v for _, _, v in sorted(got)] == lines


def test_rate_limit_loses_nothing(tmp_path):
    (tmp_path / "a.log").write_text("".join(f"{i}\n" for i in range(100)) + "y" * 500 + "\nend\n")
    r = reader(tmp_path / "a.log", maxBytesPerTrigger="50")
    at, got, rounds = r.initialOffset(), [], 0
    while True:
        new, nxt = poll(r, at)
        if nxt == at:
            break
        got, at, rounds = got + new, nxt, rounds + 1
    assert [v for _, _, v in got] == [str(i) for i in range(100)] + ["y" * 500, "end"] and rounds > 5


def test_query_resumes_and_repeated_batches_do_not_double(spark, tmp_path):
    folder = tmp_path / "logs"
    os.makedirs(folder)
    tables = live.LiveTables(spark, str(tmp_path / "live"))

    def run():
        rows = live.parse_stream(tail.follow(spark, str(folder), "d", statePath=str(tmp_path / "state.json")), "generic")
        live.run_available(rows, tables.write, str(tmp_path / "checkpoint"))
    (folder / "a.log").write_text("2023-10-10 13:55:36 error uno\n2023-10-10 13:55:37 info dos\nhalf")
    run()
    (folder / "a.log").open("a").write(" line\n2023-10-10 13:56:00 error tres\n")
    run()
    run()
    assert sorted(r["msg"] for r in tables.rows().collect()) == ["dos", "half line", "tres", "uno"]
    assert {tuple(r) for r in tables.top("level", 5).collect()} == {("ERR", 2), ("INF", 1), ("RAW", 1)}
    first = tables.rows().filter("msg IN ('uno', 'dos')")
    tables.write(spark.createDataFrame(first.collect(), first.schema), 0)      # batch 0 run again
    assert {tuple(r) for r in tables.top("level", 5).collect()} == {("ERR", 2), ("INF", 1), ("RAW", 1)}
    assert [tuple(r) for r in tables.histogram().collect()] == [("2023-10-10T13:55", 2), ("2023-10-10T13:56", 1)]


def test_stream_parses_like_batch(spark, lines, tmp_path):
    from logquarry.operators import parsers
    text = ["#Fields: date c-ip sc-status", "2023-10-10 1.1.1.1 200", "short", "2023-10-10 2.2.2.2 500"]
    fields = ["date", "c-ip", "sc-status"]
    lines(*text).write.parquet(str(tmp_path / "l"))
    source = spark.readStream.schema(lines(*text).schema).parquet(str(tmp_path / "l"))
    live.run_available(live.parse_stream(source, "w3c", fields),
                       lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    batch = parsers.parse_w3c(lines(*text), fields)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.exceptAll(batch.select(got.columns)).isEmpty()
    assert got.filter(F.col("code") == "500").count() == 1


def test_files_of_a_large_landing_grow_instead_of_their_number(spark, tmp_path):
    """The micro-batches of the top queries stay as many, however many events there are."""
    from logquarry.catalog import streams
    from logquarry.session import configure
    configure(spark)

    def files(of, name):
        folder = str(tmp_path / name)
        spark.range(0, 300_000, 1000).select(
            F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
            (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.5).alias("value")).limit(of).write.parquet(
                f"{folder}/events.parquet")
        landed = streams._landed(spark, folder, per_file=streams._events_per_file(spark, folder))
        return len([d for d in os.listdir(landed) if d.startswith("bucket=")]), spark.read.text(landed).count()
    buckets, lines = files(300, "many")
    assert buckets <= streams.MOST_FILES and lines == 300
    assert files(3, "few") == (1, 3)


def test_top_queries_make_few_batches(spark, tmp_path):
    from logquarry.catalog import streams
    spark.range(0, 2_000_000, 20_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.5).alias("value")).write.parquet(
            str(tmp_path / "events.parquet"))
    seen, write = [], live.LiveTables.write
    live.LiveTables.write = lambda self, rows, i: (seen.append(i), write(self, rows, i))[1]
    try:
        got = {(r["kind"], r["value"]): r["n"] for r in streams.stream_incremental_tops(spark, str(tmp_path)).collect()}
    finally:
        live.LiveTables.write = write
    assert got["level", "ERR"] == 100 and len(set(seen)) <= streams.MOST_FILES // 10


def test_a_large_landing_makes_few_batches(spark, tmp_path):
    """Files of 2,500 events each, as the result names them, but more of them in a batch."""
    from logquarry.catalog import streams
    from logquarry.session import configure
    from logquarry.streaming import landing
    configure(spark)
    spark.range(290).select(
        (F.col("id") * 2500 + 1).alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.5).alias("value")).write.parquet(
            str(tmp_path / "events.parquet"))
    seen, write = [], live.LiveTables.write
    live.LiveTables.write = lambda self, rows, i: (seen.append(i), write(self, rows, i))[1]
    try:
        got = sorted(tuple(r) for r in streams.stream_landing_parse(spark, str(tmp_path)).select("bucket", "line_no", "level").collect())
    finally:
        live.LiveTables.write = write
    assert got == [(i, 0, "ERR") for i in range(290)]
    assert len(set(seen)) <= landing.MOST_BATCHES


def test_files_of_a_batch(spark, tmp_path):
    from logquarry.streaming import landing
    for i in range(landing.MOST_BATCHES * 2 + 1):
        os.makedirs(tmp_path / "landed" / f"bucket={i}")
        (tmp_path / "landed" / f"bucket={i}" / "part.txt").write_text("one\n")
    os.makedirs(tmp_path / "none")
    assert [landing.files_per_batch(spark, str(tmp_path / "landed"), n) for n in (1, 3, 16)] == [3, 3, 16]
    assert landing.files_per_batch(spark, str(tmp_path / "none"), 16) == 16


def test_listing_takes_few_tasks_and_leaves_the_session_as_it_was(spark, tmp_path):
    from logquarry.streaming import landing
    for i in range(100):
        os.makedirs(tmp_path / f"bucket={i}")
        (tmp_path / f"bucket={i}" / "part.txt").write_text("one\n")
    tasks, tracker = [], spark.sparkContext.statusTracker()
    before = spark.conf.get(landing.LISTING_TASKS)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        with landing.few_listing_tasks(spark):
            landing.watch_folder(spark, str(tmp_path))
        for job in tracker.getJobIdsForGroup("listing"):
            tasks += [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(job).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(landing.LISTING_TASKS) == before
    spark.conf.set(landing.LISTING_TASKS, 7)
    try:
        with landing.few_listing_tasks(spark):
            pass
        assert spark.conf.get(landing.LISTING_TASKS) == "7"
    finally:
        spark.conf.unset(landing.LISTING_TASKS)
