"""CSV and JSON-lines exports of filtered rows, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.functions.text import blank, csv_cell
from logquarry.operators.filters import FilterSpec, apply_filter

# Minimal quoting, doubled quotes, spaces kept, empty cells left empty.
CSV_WRITE = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_READ = {"header": "true", "escape": '"', "multiLine": "true",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
EXPORT_SCHEMA = ", ".join(f"{c} string" for c in V.EXPORT_FIELDS)



def csv_rows(rows: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    return apply_filter(rows, spec).select(*[csv_cell(F.col(c)).alias(c) for c in V.EXPORT_FIELDS])


def json_rows(rows: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    return apply_filter(rows, spec).select(
        *[blank(F.col(c)).alias(c) for c in (*V.EXPORT_FIELDS, "raw")])


def export_csv(rows: DataFrame, path: str, spec: FilterSpec = FilterSpec(),
               rows_per_file: int = 0) -> None:
    (csv_rows(rows, spec).write.mode("overwrite").options(**CSV_WRITE)
     .option("maxRecordsPerFile", rows_per_file).csv(path))


def export_jsonl(rows: DataFrame, path: str, spec: FilterSpec = FilterSpec(),
                 rows_per_file: int = 0) -> None:
    (json_rows(rows, spec).write.mode("overwrite").option("ignoreNullFields", "false")
     .option("maxRecordsPerFile", rows_per_file).json(path))


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV_READ).schema(EXPORT_SCHEMA).csv(path).fillna("")
