"""Load: files -> rows, rejected lines and a manifest."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry import schema
from logquarry.operators import parsers
from logquarry.operators.detect import judge
from logquarry.session import lookup_join, scratch_folder, settle
from logquarry.sources import archives, listing, lines


@dataclass
class Loaded:
    rows: DataFrame
    rejects: DataFrame      # lines a parser refused
    files: DataFrame        # manifest, loaded files only
    refused: DataFrame      # (file, reason): empty, unreadable, too large


@dataclass(frozen=True)
class Admission:
    """What a batch of files must meet to be loaded at all; None: no bound of that size."""
    max_file: int | None = V.MAX_FILE_BYTES
    max_batch: int | None = V.MAX_BATCH_BYTES


def load_files(spark: SparkSession, paths: list[str], owner: str = "local",
               max_decompressed: int | None = None, admission: Admission | None = None) -> Loaded:
    """Read, decode, detect and parse any mix of files.

    `admission`: names and sizes are judged before anything is read; one refused file
    refuses the batch, which then gives no rows, and `refused` says why for each file.
    `max_decompressed`: compressed files with more text are refused; None takes all.
    The text is read twice: once to count lines and judge the encoding, once to
    parse. Parsed lines are written to the shared folder, accepted and refused ones
    apart; rows, rejects and the manifest's counts all read that.
    """
    listed = listing.list_files(spark, *paths)
    if admission is not None:
        judged = settle(listing.admit_files(listed, admission.max_file, admission.max_batch))
        if not judged.filter("NOT admitted").isEmpty():
            return _refused_batch(spark, judged)
    names = listing.assign_names(listed)
    files = settle(listing.classify_files(names.drop("dataset")).join(
        names.select("file", "dataset"), "file"))

    profile, raw, splits = _profile(spark, files, max_decompressed)
    heads = archives.read_heads(profile.filter("error = '' AND total > 0"))
    known = settle(profile.join(judge(heads), "file", "left").withColumn(
        "error", F.when(F.col("error") != "", F.col("error"))
        .when(F.col("format").isNull(), "empty").otherwise("")))
    good = known.filter("error = ''")

    # Each line meets one lookup, which gives it its number, encoding and format.
    carry = ("dataset", "format", "w3c_fields", "error")
    parts = []
    if raw is not None:
        parts.append(lines.number_lines(raw, splits, known, carry).filter("error = ''").drop("error"))
    packed = good.filter("via = 'archive'")
    if not packed.isEmpty():
        parts.append(lookup_join(archives.read_archives(packed), settle(packed.select(
            "file", "dataset", "format", "w3c_fields")), ["file"]))
    if not parts:
        raise ValueError("no readable file")
    text = reduce(DataFrame.unionByName, parts).withColumn("owner", F.lit(owner))
    tagged = parsers.tag_lines(text, parsers.present_formats(good))
    rows = parsers.enrich(
        tagged.withColumn("rejected_value", F.when(~F.col("accepted"), F.col("value"))),
        ("accepted", "rejected_value"))
    store = scratch_folder(spark, "parsed")
    rows.withColumn("kept", F.col("accepted").cast("int")).drop("accepted").write.partitionBy(
        "kept").parquet(store)
    stored = spark.read.parquet(store)

    counts = stored.groupBy("file").agg(F.count_if(F.col("kept") == 1).alias("parsed"),
                                        F.count_if(F.col("kept") == 0).alias("rejected"))
    manifest = (good.join(counts, "file", "left").withColumn("owner", F.lit(owner))
                .withColumn("loaded_at", F.current_timestamp()).select(*schema.MANIFEST_COLUMNS))
    rejects = stored.filter("kept = 0").select(
        *schema.KEYS, "format", F.col("rejected_value").alias("value"), F.lit("no_match").alias("reason"))
    return Loaded(stored.filter("kept = 1").select(*schema.ROW_COLUMNS), rejects, manifest,
                  known.filter("error != ''").select("file", F.col("error").alias("reason")))


def _refused_batch(spark: SparkSession, judged: DataFrame) -> Loaded:
    """No rows; each file's own reasons, or that others of its batch were refused."""
    reason = F.when(F.size("reasons") > 0, F.array_join("reasons", ",")).otherwise("batch_refused")
    nothing = spark.createDataFrame([], schema.LINE_SCHEMA).withColumn("format", F.lit("raw"))
    tagged = parsers.tag_lines(nothing, ["raw"])
    rejects = nothing.select(*schema.KEYS, "format", "value", F.lit("no_match").alias("reason"))
    return Loaded(parsers.enrich(tagged.filter("accepted")).select(*schema.ROW_COLUMNS), rejects,
                  spark.createDataFrame([], schema.MANIFEST_SCHEMA), judged.select("file", reason.alias("reason")))


# What decoders say of damaged input; a lost executor or a missing permission says none of it.
DAMAGED = re.compile(r"EOFException|ZipException|gzip stream CRC failure|crc error|[Uu]nexpected end of|not in gzip format"
                     r"|incorrect (?:header|data) check|bad block header|BZip2 formatted|[Ii]nvalid (?:block|stored|distance|code|bit)"
                     r"|ArrayIndexOutOfBoundsException")
NAMED = re.compile(r"FAILED_READ_FILE[.\w]*\] Encountered error while reading file (.+?)\.\s+SQLSTATE")
DAMAGED_ONE_BY_ONE = 8


def damaged_file(error: Exception) -> str | None:
    """The file whose damage ended a scan, or None if anything else did."""
    said = str(error)
    named = NAMED.search(said)
    return named.group(1) if named and DAMAGED.search(said) else None


def _plain_path(uri: str) -> str:
    return re.sub("^file:/+", "/", unquote(uri))


def _profile(spark: SparkSession, files: DataFrame, max_decompressed: int | None):
    """(files with inner, total, encoding and error; raw text lines; their splits).

    One damaged compressed file ends the text reader's whole scan. That file is then read
    by itself, which refuses it alone, and the scan is done again without it. Where more
    than a few are damaged, all compressed files are read one by one.
    """
    bad: set[str] = set()
    packed = (F.col("via") == "text") & (F.col("compressed") != "")
    while True:
        try:
            return _profiled(spark, files, max_decompressed)
        except Exception as error:
            file = damaged_file(error)
            if file is None or len(bad) > DAMAGED_ONE_BY_ONE:
                raise
            known = _plain_path(file) in bad        # its name did not find it: all go one by one
            bad = bad | {_plain_path(file)} if not known else bad | {str(i) for i in range(DAMAGED_ONE_BY_ONE + 1)}
            path = F.regexp_replace("path", "^file:/+", "/")
            alone = packed if len(bad) > DAMAGED_ONE_BY_ONE else packed & path.isin(sorted(bad))
            files = settle(files.withColumn("via", F.when(alone, "archive").otherwise(F.col("via"))))


def _profiled(spark: SparkSession, files: DataFrame, max_decompressed: int | None):
    direct = files.filter("via = 'text'")
    # Paths, not data: the reader's own file index holds the same list.
    plain = [r["path"] for r in direct.select("path").toLocalIterator()]
    columns = ("inner", "total", "encoding", "error")
    found, raw, splits = [], None, None
    if plain:
        raw = lines.scan_text(spark, plain)
        splits = settle(lines.profile_splits(raw))
        seen = direct.join(lines.file_profile(splits), "file", "left")
        oversize = (F.lit(False) if max_decompressed is None else
                    (F.col("compressed") != "") & (F.col("text_bytes") > max_decompressed))
        found.append(seen.withColumns({
            "inner": F.lit(""), "total": F.coalesce("total", F.lit(0)),
            "error": F.when(oversize, "too_large_decompressed").otherwise("")}))
    packed = files.filter("via = 'archive'")
    if not packed.isEmpty():
        found.append(packed.join(archives.inspect_archives(packed, max_decompressed), "file"))
    kept = [f.select(*files.columns, *columns) for f in found]
    return settle(reduce(DataFrame.unionByName, kept)), raw, splits
