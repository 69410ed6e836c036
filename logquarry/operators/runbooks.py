"""Known errors: patterns kept in a small table, matched against messages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from logquarry.functions.literals import folded, required
from logquarry.functions.patterns import glob_to_regex, java_regex
from logquarry.session import lookup_join, settle

# Patterns per expression: each is a literal, compiled once per task, and an
# expression of this many keeps generated code at a sane size. More patterns go
# through an automaton first.
PATTERNS_PER_PASS = 200
EDITABLE = ("pattern", "kind", "explicacion", "causa", "solucion", "ref")


def to_java(pattern: str, kind: str) -> str:
    return glob_to_regex(pattern) if kind == "glob" else java_regex(pattern)


def _compiler(df: DataFrame):
    return df.sparkSession._jvm.java.util.regex.Pattern


def pattern_error(df: DataFrame, pattern: str, kind: str = "regex", compiler=None) -> str | None:
    """Why a pattern cannot be used, or None. Both dialects must accept a regex."""
    if not pattern:
        return "empty pattern"
    try:
        if kind != "glob":
            re.compile(pattern)
        (compiler or _compiler(df)).compile(to_java(pattern, kind))
    except re.error as e:
        return str(e)
    except Exception as e:      # the JVM's PatternSyntaxException arrives wrapped
        return str(e).splitlines()[0]
    return None


def usable_patterns(runbooks: DataFrame) -> list[tuple[int, str]]:
    """(id, regex) in id order. Runbooks are written by hand, so the table is small."""
    found, compiler = runbooks.select("id", "pattern", "kind").orderBy("id").toLocalIterator(), _compiler(runbooks)
    return [(r["id"], to_java(r["pattern"], r["kind"])) for r in found
            if pattern_error(runbooks, r["pattern"] or "", r["kind"] or "regex", compiler) is None]


def hit_ids(message: Column, patterns: list[tuple[int, str]]) -> Column:
    """Array of the ids whose pattern occurs in the message, in id order."""
    if not patterns:
        return F.array().cast("array<bigint>")
    return F.array_compact(F.array(*[
        F.when(message.rlike(regex), F.lit(rid).cast("long")) for rid, regex in patterns]))


def match_runbooks(rows: DataFrame, runbooks: DataFrame, message: str = "msg",
                   keep: tuple[str, ...] = ("file", "line_no")) -> DataFrame:
    """(keep.., id): every row with every runbook that matches it."""
    patterns = usable_patterns(runbooks)
    source = rows.select(*keep, F.col(message).alias("_message")).filter("_message IS NOT NULL")
    if len(patterns) > PATTERNS_PER_PASS:
        return match_many(source, patterns, keep)
    return source.select(*keep, F.explode(hit_ids(F.col("_message"), patterns)).alias("id"))


def match_many(source: DataFrame, patterns: list[tuple[int, str]], keep: tuple[str, ...]) -> DataFrame:
    """The same for many patterns. Most patterns hold a text that no match can do without;
    one automaton looks for all those texts in one pass over a message, and a pattern is
    tried only where one of its texts stands. Patterns without such a text are tried on every
    message, as few patterns are."""
    texts: dict[str, list[int]] = {}
    always = []
    for rid, regex in patterns:
        needed = required(regex.removeprefix(java_regex("")))
        if needed is None:
            always.append((rid, regex))
        for text in needed or ():
            texts.setdefault(text, []).append(rid)
    sure = [hit_ids(F.col("_message"), always[i:i + PATTERNS_PER_PASS])
            for i in range(0, len(always), PATTERNS_PER_PASS)] or [hit_ids(F.col("_message"), [])]
    source = source.withColumn("_sure", F.concat(*sure))
    found = source.mapInArrow(_candidates(texts), StructType(
        [*source.schema.fields, StructField("_maybe", ArrayType(LongType()))]))
    tried = found.select(*keep, "_message", F.inline(F.concat(
        F.transform("_sure", lambda i: F.struct(i.alias("id"), F.lit(True).alias("_holds"))),
        F.transform("_maybe", lambda i: F.struct(i.alias("id"), F.lit(False).alias("_holds"))))))
    books = settle(source.sparkSession.createDataFrame(patterns, "id long, _regex string"))
    return (lookup_join(tried, books, ["id"]).filter(F.col("_holds") | F.rlike("_message", F.col("_regex")))
            .select(*keep, "id"))


def _candidates(texts: dict[str, list[int]]):
    """Adds `_maybe`, the ids one of whose texts stands in the message; drops rows without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for text, ids in texts.items():
            automaton.add_word(text, ids)
        automaton.make_automaton()
        for batch in batches:
            at = batch.schema.get_field_index("_message")
            maybe = []
            for message in batch.column(at).to_pylist():
                found: set[int] = set()
                for _, ids in automaton.iter(folded(message)) if texts else ():
                    found.update(ids)
                maybe.append(sorted(found))
            ids = pa.array(maybe, pa.list_(pa.int64()))
            some = pc.or_(pc.greater(pc.list_value_length(ids), 0),
                          pc.greater(pc.list_value_length(batch.column(batch.schema.get_field_index("_sure"))), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "_maybe"]).filter(some)
    return run


def coverage(rows: DataFrame, runbooks: DataFrame) -> DataFrame:
    """(id, pattern, n): rows each runbook explains, zero included."""
    hits = match_runbooks(rows, runbooks).groupBy("id").agg(F.count("*").alias("n"))
    return (runbooks.select("id", "pattern").join(hits, "id", "left")
            .select("id", "pattern", F.coalesce("n", F.lit(0)).alias("n")))


def unmatched(rows: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Rows that no runbook explains: one predicate, no join."""
    patterns = usable_patterns(runbooks)
    message = F.coalesce(F.col("msg"), F.lit(""))
    for i in range(0, len(patterns), PATTERNS_PER_PASS):
        rows = rows.filter(F.size(hit_ids(message, patterns[i:i + PATTERNS_PER_PASS])) == 0)
    return rows


# --- the table -------------------------------------------------------------

def _clean(new: DataFrame) -> DataFrame:
    text = [c for c in EDITABLE if c not in ("pattern", "kind")]
    have = set(new.columns)
    return new.select(
        *(["id"] if "id" in have else []), "pattern",
        F.when(F.col("kind").isin("regex", "glob"), F.col("kind")).otherwise("regex").alias("kind")
        if "kind" in have else F.lit("regex").alias("kind"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in text],
        (F.col("created_at") if "created_at" in have
         else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).alias("created_at"))


def add_runbooks(base: DataFrame, new: DataFrame, on_conflict: str = "error") -> DataFrame:
    """Base plus new runbooks with fresh ids. A pattern may exist only once."""
    from pyspark.sql import Window
    fresh = _clean(new)
    once = F.row_number().over(Window.partitionBy("pattern").orderBy("kind"))
    fresh = fresh.withColumn("_n", once)
    if on_conflict == "error":
        taken = fresh.join(base.select("pattern"), "pattern", "left_semi")
        if not taken.isEmpty() or not fresh.filter("_n > 1").isEmpty():
            raise ValueError("pattern already exists")
    fresh = fresh.filter("_n = 1").drop("_n").join(base.select("pattern"), "pattern", "left_anti")
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    ranked = fresh.withColumn("_rank", F.row_number().over(Window.orderBy("pattern")))
    ranked = ranked.withColumn("_k", F.lit(1)).join(
        F.broadcast(top.withColumn("_k", F.lit(1))), "_k")
    return base.unionByName(ranked.withColumn("id", (F.col("_top") + F.col("_rank")).cast("long"))
                            .select(*base.columns))


def update_runbooks(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace the editable columns of the given ids; unknown ids change nothing."""
    edits = _clean(changes).drop("created_at").select(
        "id", *[F.col(c).alias(f"_{c}") for c in EDITABLE])
    merged = base.join(edits, "id", "left").select(
        "id", *[F.coalesce(f"_{c}", c).alias(c) for c in EDITABLE], "created_at")
    if not merged.groupBy("pattern").count().filter("count > 1").isEmpty():
        raise ValueError("pattern already exists")
    return merged


def get_runbook(base: DataFrame, rid: int) -> DataFrame:
    return base.filter(F.col("id") == rid)


def list_runbooks(base: DataFrame) -> DataFrame:
    return base.orderBy("id")


def delete_runbook(base: DataFrame, rid: int) -> DataFrame:
    return base.filter(F.col("id") != rid)
