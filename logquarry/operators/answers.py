"""Answers from a caller's function: keyed cache, misses only, batches of templates."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.functions.text import answer_key, template_item
from logquarry.operators.rollups import template_counts, template_order, with_example
from logquarry.session import lookup_join, settle

Ask = Callable[[str], tuple[bool, str]]


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) by hash: hits carry the cached answer, misses are distinct.

    A hash wanted by very many rows stays spread over tasks; for the misses only
    distinct hashes are looked up.
    """
    known = cache.select("hash", "answer")
    hits = lookup_join(requests, settle(known), ["hash"])
    wanted = requests.groupBy("hash").agg(F.min("line").alias("line"))
    return hits, wanted.join(known.select("hash"), "hash", "left_anti")


def insert_or_ignore(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache plus the new answers whose hash it lacks; the first of a hash stays."""
    one = new.groupBy("hash").agg(F.min(F.struct("created_at", "line", "answer")).alias("_v"))
    fresh = one.join(cache.select("hash"), "hash", "left_anti")
    return cache.unionByName(fresh.select("hash", "_v.line", "_v.answer", "_v.created_at"))


def ask_each(misses: DataFrame, ask: Ask) -> DataFrame:
    """(hash, line, ok, answer) from `ask`, batch-wise, in parallel over misses."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [ask(line) for line in batch["line"]]
            yield pd.DataFrame({"hash": batch["hash"], "line": batch["line"],
                                "ok": [g[0] for g in got], "answer": [g[1] for g in got]})
    return (misses.select("hash", "line")
            .mapInPandas(run, "hash string, line string, ok boolean, answer string"))


LOG_BUCKETS = 256


def ask_once(misses: DataFrame, ask: Ask, log: str, per_second: float | None = None,
             buckets: int = LOG_BUCKETS) -> DataFrame:
    """(hash, line, ok, answer) like `ask_each`, with every good answer put under the shared
    folder `log` as it arrives, in the folder of its hash's bucket. A task that is lost and
    run again, or a later job, reads what is logged and asks only the rest. An answer is put
    in place whole, by a move. All tasks together ask at most `per_second` times a second:
    there are at most `buckets` of them, each with its share. Failures are not logged.
    """
    pause = buckets / per_second if per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(log)
        free_at = 0.0
        for batch in batches:
            got = []
            for key, line, bucket in zip(batch["hash"], batch["line"], batch["bucket"], strict=True):
                folder = f"{root}/{bucket:05d}"
                place = f"{folder}/{hashlib.sha256(key.encode()).hexdigest()}"
                if files.get_file_info(place).type == fs.FileType.File:
                    with files.open_input_stream(place) as f:
                        got.append((True, f.read().decode()))
                    continue
                time.sleep(max(free_at - time.monotonic(), 0.0))
                free_at = time.monotonic() + pause
                ok, answer = ask(line)
                if ok:
                    files.create_dir(folder, recursive=True)
                    part = f"{place}.{uuid.uuid4().hex}"
                    with files.open_output_stream(part) as f:
                        f.write(answer.encode())
                    files.move(part, place)
                got.append((ok, answer))
            yield pd.DataFrame({"hash": batch["hash"], "line": batch["line"],
                                "ok": [g[0] for g in got], "answer": [g[1] for g in got]})
    bucket = F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int")
    return (misses.select("hash", "line", bucket.alias("bucket")).repartition(buckets, "bucket")
            .mapInPandas(run, "hash string, line string, ok boolean, answer string"))


def enrich_answers(lines: DataFrame, cache: DataFrame, ask: Ask, model: str = "local",
                   lang: str = "auto", log: str | None = None,
                   per_second: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, fresh): one answer per distinct line, and the rows to add to the cache.

    Failures are answered but never enter `fresh`. With a `log` folder no answer is paid
    twice, whatever task is lost (see `ask_once`).
    """
    if per_second and log is None:
        raise ValueError("a rate needs a log folder: tasks run again would exceed it")
    keyed = lines.select("line", answer_key(F.col("line"), F.lit(model), F.lit(lang)).alias("hash"))
    requests = keyed.filter("line != ''").distinct()
    hits, misses = cache_split(requests, cache)
    asked = ask_each(misses, ask) if log is None else ask_once(misses, ask, log, per_second)
    asked = settle(asked)                       # both results read it: asked once
    answers = hits.select("hash", "line", F.lit(True).alias("ok"), "answer",
                          F.lit(True).alias("cached")).unionByName(
        asked.withColumn("cached", F.lit(False)))
    return answers, fresh_answers(answers)


def fresh_answers(answers: DataFrame) -> DataFrame:
    return answers.filter("ok AND NOT cached").select(
        "hash", "line", "answer",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# --- diagnosis over many datasets at once ----------------------------------

def select_templates(rows: DataFrame, level: str = "ERR", fallback_format: str = "results",
                     limit: int = V.TEMPLATE_LIMIT) -> DataFrame:
    """(dataset, rank, template, n, example): the leading templates of each dataset.

    Imported results carry no level; such a dataset without a row of the level is
    described by all its templates.
    """
    # Counts keep level and format apart, so one aggregate serves both cases; it is
    # small and read three times, hence settled.
    source = rows.withColumn("_fits", F.col("level") == level)
    counts = settle(template_counts(source, ("dataset", "format", "_fits")))
    at = F.min(F.struct("file", "line_no")).alias("_at")

    def merged(part: DataFrame) -> DataFrame:
        return part.groupBy("dataset", "template").agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), at,
        ).select("dataset", "template", "n", "first", "last", "_at.file", "_at.line_no")
    narrow = counts.filter("_fits")
    loose = counts.filter(F.col("format") == fallback_format).join(
        narrow.select("dataset").distinct(), "dataset", "left_anti")
    groups = merged(narrow).unionByName(merged(loose))
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(*template_order()))
    groups = groups.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return with_example(groups, rows).select(
        "dataset", "rank", "template", "n", "example")


HEADER = ("%d distinct log templates of level %s follow (%d in all)."
          " Each has its number of occurrences and one example line:")
CLOSING = ("Give ONE short final conclusion: what is happening, the templates that matter most"
           " (highest counts) with their exact text and example, the likely cause, next steps.")
INTERIM = ("Summarise this batch only: the most frequent patterns, their counts and what they"
           " point to. The summary is context for the final conclusion.")


def diagnose_batches(chosen: DataFrame, level: str = "ERR") -> DataFrame:
    """(dataset, batch, size, total, is_last, items): prompts' bodies, 50 templates each."""
    item = template_item(F.col("n"), F.col("template"), F.col("example"))
    numbered = chosen.select("dataset", "rank", item.alias("item"),
                             F.floor((F.col("rank") - 1) / V.DIAGNOSE_PER_CALL).cast("int").alias("batch"))
    # At most 50 items per group, at most 4 groups per dataset.
    packed = numbered.groupBy("dataset", "batch").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item"))).getField("item").alias("_items"))
    whole = Window.partitionBy("dataset")
    return packed.select(
        "dataset", "batch", F.size("_items").alias("size"),
        F.sum(F.size("_items")).over(whole).cast("long").alias("total"),
        (F.col("batch") == F.max("batch").over(whole)).alias("is_last"),
        F.array_join("_items", "\n\n").alias("items"))


def diagnose_keys(chosen: DataFrame, level: str = "ERR", model: str = "local",
                  lang: str = "auto") -> DataFrame:
    """(dataset, hash, analyzed): cache key over dataset, level and the exact items."""
    item = template_item(F.col("n"), F.col("template"), F.col("example"))
    listed = chosen.groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank"), item.alias("item"))))
        .getField("item").alias("_items"), F.count("*").alias("analyzed"))
    text = F.concat_ws("\u0001", F.col("dataset"), F.lit(level), F.array_join("_items", "\u0001"))
    return listed.select("dataset", answer_key(text, F.lit(model), F.lit(lang)).alias("hash"),
                         "analyzed")


def diagnose(batches: DataFrame, ask: Ask, level: str = "ERR") -> DataFrame:
    """(dataset, ok, conclusion, analyzed): fold over a dataset's batches (four at most).

    Each call carries the summary so far; the first failure ends the fold.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        summary = ""
        for row in pdf.sort_values("batch").itertuples(index=False):
            parts = [f"Summary of the batches so far:\n{summary}"] if summary else []
            parts += [HEADER % (row.size, level, row.total) + "\n\n" + row.items,
                      CLOSING if row.is_last else INTERIM]
            ok, summary = ask("\n\n".join(parts))
            if not ok:
                return pd.DataFrame([(row.dataset, False, summary, 0)],
                                    columns=["dataset", "ok", "conclusion", "analyzed"])
        return pd.DataFrame([(pdf["dataset"].iloc[0], True, summary, int(pdf["total"].iloc[0]))],
                            columns=["dataset", "ok", "conclusion", "analyzed"])
    return batches.groupBy("dataset").applyInPandas(
        fold, "dataset string, ok boolean, conclusion string, analyzed long")


def diagnose_report(chosen: DataFrame, conclusions: DataFrame) -> DataFrame:
    """(dataset, conclusion, analyzed, top): the answer with its ten leading templates."""
    top = chosen.filter(F.col("rank") <= V.DIAGNOSE_TOP).groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct("rank", "template", "n", "example"))).alias("top"))
    return conclusions.filter("ok").join(top, "dataset").select(
        "dataset", "conclusion", "analyzed", "top")
