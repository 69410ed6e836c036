"""From raw documents to a mixture: five stages, each one of the training-data operators.

Every stage works on what the stage before kept, written as Parquet and read again. All
but the last return the columns of `documents`; the last one the rates of the mixture.
Where a stage decides by document, rows with equal ids share their fate: they go when all
of them are rejected. Rows with a null id are judged by the classifier like any other and
are never near duplicates.

A stage's result has to be written before the next stage is called: the tables that earlier
stages wrote on their way are removed then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import cotraining, decontaminate, jaccard_join, line_dedup, mixing
from logquarry.llm.common import discard, prepared, recorded, stored, table, without

NEAR_WORDS, NEAR_PERCENT = 5, 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: dict[tuple[str, int], list[DataFrame]] = {}      # (application, stage's place) -> its tables


def cleared(place: int, stage: Stage) -> Stage:
    """The stage, after the removal of what the stages before it wrote on their way."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        for earlier in range(place):
            discard(*_made.pop((application, earlier), []))
        with recorded() as made:
            out = stage(prepared(spark), docs, sf_dir)
        _made.setdefault((application, place), []).extend(made)
        return out
    return run


def gone(verdicts: DataFrame) -> DataFrame:
    """verdicts: doc_id, keep. The ids none of whose rows is kept."""
    return verdicts.groupBy("doc_id").agg(F.max("keep").alias("keep")).where(~F.col("keep")).select("doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    found = cotraining.classify(docs, table(spark, sf_dir, "labels"))
    return without(docs, gone(found.select("doc_id", F.col("kept").alias("keep"))))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more share."""
    return line_dedup.without_frequent_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id."""
    found = jaccard_join.jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT)
    keep = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return without(docs, gone(found.select("doc_id", keep.alias("keep"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, gone(found.select("doc_id", (~F.col("contaminated")).alias("keep"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rate and copies of every document that is left."""
    return mixing.mix(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup_stage), ("near duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixture)]
STAGES = [(name, cleared(place, stage)) for place, (name, stage) in enumerate(STAGES)]

# A classifier and a fit of rates are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    return docs
