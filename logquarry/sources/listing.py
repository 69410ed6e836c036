"""File listings as DataFrames: kinds by leading bytes, admission, dataset names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logquarry import fixed_values as V
from logquarry.functions.text import safe_base_name
from logquarry.session import settle


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, path, size) without reading any content.

    A scan has no split for an empty file, so such files are added by name.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    found = scan.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"))
    # Both are URIs, but a local one has three slashes here and one in a scan.
    names = [re.sub("^file:/+", "file:/", n) for n in scan.inputFiles()]
    if len(names) == found.count():
        return found
    listed = spark.createDataFrame([(n, unquote(n), 0) for n in names], "file string, path string, size long")
    return found.unionByName(listed.join(found.select("file"), "file", "left_anti"))


# Scheme in Spark's paths -> scheme of the file library that reads heads and archives.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def library_uri(uri: str) -> str:
    """A path as the file library names it; a path without a scheme is a local file."""
    scheme, mark, rest = uri.partition("://")
    if mark:
        return f"{SCHEMES.get(scheme, scheme)}://{rest}"
    return uri if uri.startswith("file:") else f"file://{uri}"


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(library_uri(uri))


def open_input(file: str):
    filesystem, path = resolve(file)
    return filesystem.open_input_file(path)


def _leading_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heads = []
        for file in batch["file"]:
            with open_input(file) as f:
                heads.append(f.read(8))
        yield batch.assign(head=heads)


def classify_files(files: DataFrame) -> DataFrame:
    """Add `compressed` ('' gzip bzip2 xz zip) and `via` (text or archive).

    The kind comes from the leading bytes, whatever the name says. Spark's text
    reader picks its codec by extension only, so it gets plain files and those
    gzip/bzip2 files whose name agrees; all else is decompressed by `archives`.
    """
    head = F.col("head")
    kind = (F.when(head.startswith(F.lit(V.MAGIC_GZIP)), "gzip").when(head.startswith(F.lit(V.MAGIC_BZIP2)), "bzip2")
            .when(head.startswith(F.lit(V.MAGIC_XZ)), "xz").when(head.startswith(F.lit(V.MAGIC_ZIP)), "zip")
            .otherwise(""))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    codec_names = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd")
    direct = (((F.col("compressed") == "") & ~ext.isin(*codec_names))
              | ((F.col("compressed") == "gzip") & (ext == ".gz"))
              | ((F.col("compressed") == "bzip2") & (ext == ".bz2")))
    return (files.mapInPandas(_leading_bytes, "file string, path string, size long, head binary")
            .withColumn("compressed", kind).drop("head")
            .withColumn("via", F.when(direct, "text").otherwise("archive")))


def admit_files(files: DataFrame, max_file: int | None = V.MAX_FILE_BYTES,
                max_batch: int | None = V.MAX_BATCH_BYTES) -> DataFrame:
    """Files with `reasons`: any entry refuses the file, and one refused file the batch.

    `admitted` is the verdict for the batch as a whole. None: no bound of that size.
    """
    max_file, max_batch = (2 ** 63 - 1 if n is None else n for n in (max_file, max_batch))
    ext = F.lower(F.regexp_extract("path", r"[^/.][^/]*(\.[^./]*)$", 1))
    reasons = F.array_compact(F.array(
        F.when(F.col("size") > max_file, "too_large"),
        F.when(~ext.isin(*V.SUPPORTED_EXTENSIONS), "unsupported_extension")))
    judged = files.withColumn("reasons", reasons)
    batch = judged.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_bytes"),
                       F.count_if(F.size("reasons") > 0).alias("_bad"))
    ok = (F.col("_bytes") <= max_batch) & (F.col("_bad") == 0)
    # One row on the right, by construction of a global aggregate.
    return (judged.withColumn("_k", F.lit(1)).join(F.broadcast(batch.withColumn("_k", F.lit(1))), "_k")
            .withColumn("reasons", F.when(F.col("_bytes") > max_batch, F.array_append("reasons", F.lit("batch_too_large")))
                        .otherwise(F.col("reasons")))
            .withColumn("admitted", ok).drop("_k", "_bytes", "_bad"))


def assign_names(files: DataFrame, order: str = "path", source: str = "path") -> DataFrame:
    """Add `dataset`: the safe base name; where it is taken, the first free one of _1, _2, ..

    Names can only meet if they are equal without their numbers at the end. Files of such
    a family with one base name are numbered by their place, counted in a sorted table, so
    a name that every host uses fills many tasks. Families in which a base name looks like
    a numbered one are rare; each of those is walked in order.
    """
    named = settle(files.withColumn("_base", safe_base_name(F.col(source)))
                   .withColumn("_family", F.regexp_replace("_base", r"(_\d+)+$", "")))
    mixed = settle(named.groupBy("_family").agg(F.min("_base").alias("_a"), F.max("_base").alias("_z"))
                   .filter("_a < _z").select("_family"))
    plain = _placed(named.join(mixed, "_family", "left_anti"), "_base", order)
    number = F.when(F.col("_place") > 0, F.concat(F.lit("_"), F.col("_place").cast("string"))).otherwise("")
    plain = plain.withColumn("dataset", F.concat("_base", number)).select(*files.columns, "dataset")
    walked = named.join(mixed, "_family", "left_semi").select(*files.columns, "_family", "_base")
    schema = StructType([*files.schema.fields, StructField("dataset", StringType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, following, names = set(), {}, []
        pdf = pdf.sort_values(order)
        for base in pdf["_base"]:
            name, n = base, following.get(base, 1)
            while name in taken:
                name, n = f"{base}_{n}", n + 1
            following[base] = n
            taken.add(name)
            names.append(name)
        return pdf.drop(columns=["_family", "_base"]).assign(dataset=names)
    return plain.unionByName(walked.groupBy("_family").applyInPandas(walk, schema))


def _placed(files: DataFrame, key: str, order: str) -> DataFrame:
    """Each row's place, from 0, among the rows of its key."""
    ordered = settle(files.repartitionByRange(key, order).sortWithinPartitions(key, order)
                     .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = ordered.groupBy(key, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(key, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (ordered.withColumn("_part", F.shiftright("_at", 33)).join(before, [key, "_part"])
            .withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_part", "_at", "_first", "_before"))
