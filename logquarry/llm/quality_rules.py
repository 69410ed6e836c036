"""Quality rules as a short-circuit cascade, in column expressions only (operator 6).

A rule rejects a text. On a sample each rule is timed and its verdicts are noted; rules
are then put in the order of rejections per cost among the texts the earlier ones let
through. The cascade is one CASE expression, so a rejected text ends its evaluation.
The order changes what is computed, never the verdict.

Words are runs of anything but ASCII white space. A null text has no words and counts
like an empty one: no word, no line with a word, rejected for too few words. Ties in the
order go to the rule named first. Equality of word windows is that of 64-bit hashes
within one text. Rows are judged one by one, so repeated rows repeat their verdict; extra
columns play no part.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import query, table

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """`rejects` is a boolean SQL expression over the columns of `measured`."""
    name: str
    rejects: str


# Thresholds in the range published for web corpora.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", r"2 * (length(text) - length(regexp_replace(text, '[A-Z]', ''))) > word_chars"),
    Rule("exclaiming", "5 * (length(text) - length(replace(text, '!', ''))) > n_words"),
    Rule("ellipses", r"10 * size(filter(lines, x -> rlike(x, '(\\.\\.\\.|…)\\s*$'))) > 3 * n_lines"),
    Rule("bullets", r"10 * size(filter(lines, x -> rlike(x, '^\\s*[-•*]'))) > 9 * n_lines"),
)


def repeated_words(words: str, n_words: str) -> list[tuple[str, Column]]:
    """Steps to the number of words in windows found twice or more in the same text.
    The sorting steps are done only for texts where a window's hash comes twice."""
    def window_hash(word: Column, i: Column) -> Column:
        return F.xxhash64(word, *[F.get(F.col(words), i + k) for k in range(1, WINDOW)])
    starts = F.slice(F.col(words), F.lit(1), F.greatest(F.col(n_words) - (WINDOW - 1), F.lit(0)).cast("int"))
    hashes = F.transform(starts, window_hash)
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    ordered = F.when(F.col("_twice"), F.sort_array(F.transform(
        F.col("_hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    again = F.when(F.col("_twice"), F.sort_array(F.transform(F.filter(
        F.col("_ordered"),
        lambda x, k: (x["h"] == F.get(F.col("_ordered"), k - 1)["h"])
        | (x["h"] == F.get(F.col("_ordered"), k + 1)["h"])), lambda x: x["i"])))
    covered = F.aggregate(
        F.col("_again"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])
    return [("_hashes", hashes), ("_twice", twice), ("_ordered", ordered), ("_again", again),
            ("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text, lines (those with a word) and the counts rules are made of."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    has_word = lambda x: x.rlike(WORD)      # noqa: E731
    out = out.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words"),
                     F.filter(F.split("text", "\n"), has_word).alias("lines"))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")})
    for name, column in repeated_words("_words", "n_words"):
        out = out.withColumn(name, column)
    return out.drop("_words", "_hashes", "_twice", "_ordered", "_again")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
                  seed: int = 7) -> list[Estimate]:
    """Rules by rejections per second on a sample of about sample_rows texts, each judged
    among the texts that the rules before it let through."""
    n = docs.count()
    sample = measured(docs.select("doc_id", "text").sample(min(1.0, sample_rows / max(n, 1)), seed))
    sample = sample.repartition(1).cache()
    names = [f"r{i}" for i in range(len(rules))]
    verdicts = sample.select(*[F.coalesce(F.expr(r.rejects), F.lit(False)).alias(c)
                               for c, r in zip(names, rules, strict=True)])
    patterns = [(tuple(r[c] for c in names), r["count"]) for r in verdicts.groupBy(*names).count().collect()]

    def seconds(expression: str) -> float:
        job, best = sample.agg(F.count_if(F.expr(expression))), None
        for _ in range(2):
            start = time.perf_counter()
            job.collect()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        return best
    idle = seconds("n_words < 0")
    cost = [max(seconds(r.rejects) - idle, 1e-4) for r in rules]
    sample.unpersist()
    order, left = [], list(range(len(rules)))
    while left:
        total = max(sum(k for _, k in patterns), 1)
        share = {i: sum(k for p, k in patterns if p[i]) / total for i in left}
        best = max(left, key=lambda i: (share[i] / cost[i], -cost[i], -i))
        order.append(Estimate(rules[best], cost[best], share[best]))
        patterns = [(p, k) for p, k in patterns if not p[best]]
        left.remove(best)
    return order


def passes(order: list[Estimate]) -> Column:
    """The cascade: false at the first rule that rejects."""
    out = None
    for step in order:
        rejects = F.expr(step.rule.rejects)
        out = F.when(rejects, False) if out is None else out.when(rejects, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, base_failed and kept for every row of docs."""
    order = cascade_order(docs, rules)
    return (measured(docs).withColumn("base_failed", base_failed())
            .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(passes(order)))
            .drop("text", "lines"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM
  (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM s) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM
  (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, text, ls, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (
  10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
  OR 2 * n_dup_lines > n_lines
  OR 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > word_chars
  OR 5 * (length(text) - length(replace(text, '!', ''))) > n_words
  OR 10 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 3 * n_lines
  OR 10 * len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-•*]'))) > 9 * n_lines) AS kept
FROM b"""


@query("op6_quality_rules", SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the cascade's verdict."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
