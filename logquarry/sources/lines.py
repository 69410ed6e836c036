"""Files to numbered, decoded lines.

Line numbers need the number of lines in all earlier splits of the file. One
cheap scan counts lines per split (and judges the encoding on the way); a second
one adds the split's offset to the position inside it. The text itself is never
shuffled or sorted, so a file may be as large as it likes.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.session import lookup_join, settle


@lru_cache(maxsize=1)
def cp1252_letters() -> tuple[str, str]:
    """Latin-1 control characters 0x80-0x9F and what code page 1252 has there."""
    pairs = []
    for byte in range(0x80, 0xA0):
        try:
            pairs.append((chr(byte), bytes([byte]).decode("cp1252")))
        except UnicodeDecodeError:
            pass
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def decode_lines(value: Column, encoding: Column) -> Column:
    """Raw bytes of a text column read as the given encoding."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return (F.when(encoding == "utf-8", value)
            .when(encoding == "cp1252", F.translate(latin, *cp1252_letters()))
            .when(encoding == "latin-1", latin).otherwise(F.make_valid_utf8(value)))


def encoding_flags(value: Column) -> tuple[Column, Column]:
    """(is UTF-8, fits code page 1252) of a line's raw bytes."""
    valid = F.is_valid_utf8(value)
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return valid, valid | ~latin.rlike(f"[{V.CP1252_UNDEFINED}]")


def encoding_name(all_utf8: Column, all_cp1252: Column) -> Column:
    return F.when(all_utf8, "utf-8").when(all_cp1252, "cp1252").otherwise("latin-1")


def scan_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, _block, _id, value): raw lines; `_id` grows with the position in a split.

    The reader's default also ends lines at a lone CR, hence the explicit separator.
    """
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_id"),
                    F.rtrim(F.col("value"), F.lit("\r")).alias("value")))


def profile_splits(raw: DataFrame) -> DataFrame:
    """One row per split of a file: lines, bytes, first id, encoding verdicts, offset."""
    utf8, cp1252 = encoding_flags(F.col("value"))
    splits = raw.groupBy("file", "_block").agg(
        F.count("*").alias("lines"), F.min("_id").alias("_first"),
        F.sum(F.octet_length("value") + 1).alias("text_bytes"),
        F.bool_and(utf8).alias("utf8"), F.bool_and(utf8 | cp1252).alias("cp1252"))
    # A window over the splits of a file: a few numbers per 128 MB of text.
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    return splits.withColumn("_offset", F.coalesce(F.sum("lines").over(before), F.lit(0)))


def file_profile(splits: DataFrame) -> DataFrame:
    return splits.groupBy("file").agg(
        F.sum("lines").alias("total"), F.sum("text_bytes").alias("text_bytes"),
        encoding_name(F.bool_and("utf8"), F.bool_and("cp1252")).alias("encoding"))


def number_lines(raw: DataFrame, splits: DataFrame, files: DataFrame,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(file, line_no, value, carry..) with decoded text; `carry` names columns of `files`.

    Both scans must cut the files alike. If they ever did not (say the session's
    split size changed in between), some position falls outside its split's
    range and the job fails instead of numbering lines wrongly.
    """
    lookup = splits.join(files.select("file", "encoding", *carry), "file").select(
        "file", "_block", "_first", "_offset", "lines", "encoding", *carry)
    found = lookup_join(raw, settle(lookup), ["file", "_block"], how="left")
    at = F.col("_id") - F.col("_first")
    line_no = F.when((at >= 0) & (at < F.col("lines")), F.col("_offset") + at).otherwise(
        F.raise_error(F.lit("file splits changed between two scans of one load")).cast("long"))
    return found.select("file", line_no.alias("line_no"),
                        decode_lines(F.col("value"), F.col("encoding")).alias("value"), *carry)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Numbered, decoded lines of files the text reader can open by name."""
    raw = scan_text(spark, paths)
    splits = settle(profile_splits(raw))
    return number_lines(raw, splits, file_profile(splits))
