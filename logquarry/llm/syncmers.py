r"""Document fingerprints from closed syncmers, in column expressions only (operator 11).

A text is read as pieces: runs of up to 16 code points without ASCII white space, or single
code points from U+2E80 on, where scripts have no blanks. Five pieces are a k-mer, two
neighbouring pieces inside it a substring of it, ordered by their hash. A k-mer is a closed
syncmer if its least substring is the first or the last one. That depends on the k-mer
alone, not on what stands around it, so a stretch that two texts share has the same anchors
in both, wherever it stands and whatever precedes it. A text of fewer than five pieces has
each of them as an anchor.

The fingerprint holds the 256 least of the anchors' hashes, 8 hexadecimal digits each,
ascending: all of them up to about 500 words, a bottom sketch beyond. The likeness of two
fingerprints is the share of hashes that both hold among the 256 least of both together,
which estimates the Jaccard similarity of the anchor sets, and is exact for short texts.
`matches` uses the anchors' positions instead: stretches two texts share, by diagonal.

A null text is an empty one. A text without a piece has the empty fingerprint; two such are
alike (1.0), one and any other are not (0.0). Equal texts have equal fingerprints. The edited
text takes the head of the document that follows by doc_id (nulls first; of equal ids by the
text's hash, then the text). Every row of the table gets its row, copies too; extra columns
play no part. Texts are hashed whole, in one task each, in memory that follows their length.
Rows are compared with their followers in runs of a few hundred neighbours, dealt out by
boundaries that depend on doc_id and text, so one id that many rows hold is split as well;
only rows equal in both stay together.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.common import query, table

K, S = 5, 2                     # pieces of a k-mer and of its inner substrings
ANCHORS = 256                   # hashes in a fingerprint
DIGITS = 8
PIECE = r"[^\x20\x09-\x0D\x{2E80}-\x{10FFFF}]{1,16}|[\x{2E80}-\x{10FFFF}]"
RUN_ROWS = 500                  # neighbours dealt out together, about
MOST_RUNS = 20_000              # boundaries held as literals, a few hundred kilobytes
PER_RUN = 8                     # keys drawn to place each boundary


def digest(x: Column, digits: int) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, digits)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: array of (pos, code) of the anchors of a text column, in order of position."""
    pieces, order = F.col("_pieces"), F.col("_order")
    df = df.withColumn("_pieces", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0)))
    n = F.size(pieces)
    df = df.withColumn("_order", F.transform(
        F.slice(pieces, F.lit(1), F.greatest(n - (S - 1), F.lit(0))),
        lambda x, i: digest(F.concat_ws(" ", x, *[F.get(pieces, i + j) for j in range(1, S)]), 16)))
    last = K - S

    def closed(first: Column, i: Column) -> Column:
        inner = [F.get(order, i + j) for j in range(1, last)]
        return F.least(first, F.get(order, i + last)) <= F.least(*inner)
    starts = F.transform(F.slice(order, F.lit(1), F.greatest(n - (K - 1), F.lit(0))),
                         lambda first, i: F.when(closed(first, i), i))
    df = df.withColumn("_starts", F.array_compact(starts))
    found = F.transform("_starts", lambda i: F.struct(
        i.alias("pos"), digest(F.concat_ws(" ", F.slice(pieces, i + 1, F.lit(K))), DIGITS).alias("code")))
    single = F.transform(pieces, lambda x, i: F.struct(i.alias("pos"), digest(x, DIGITS).alias("code")))
    return df.withColumn(out, F.when(n < K, single).otherwise(found)).drop("_pieces", "_order", "_starts")


def fingerprint(anchors: Column) -> Column:
    codes = F.transform(anchors, lambda a: a["code"])
    return F.array_join(F.slice(F.sort_array(F.array_distinct(codes)), 1, ANCHORS), "")


def codes(printed: Column) -> Column:
    """The hashes a fingerprint holds."""
    return F.regexp_extract_all(printed, F.lit("[0-9a-f]{%d}" % DIGITS), F.lit(0))


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds the likeness, from 0 to 1, of two fingerprint columns."""
    df = df.withColumns({"_a": codes(F.col(a)), "_b": codes(F.col(b))})
    df = df.withColumn("_least", F.slice(F.sort_array(F.array_union("_a", "_b")), 1, ANCHORS))
    shared = F.size(F.array_intersect(F.array_intersect("_least", "_a"), F.col("_b")))
    return (df.withColumn(out, F.when(F.size("_least") == 0, 1.0).otherwise(shared / F.size("_least")))
            .drop("_a", "_b", "_least"))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, pos, code: every anchor of every text."""
    found = with_anchors(docs.select("doc_id", "text"), "text", "_anchors")
    return found.select("doc_id", F.inline("_anchors"))


def matches(left: DataFrame, right: DataFrame, least: int = 3) -> DataFrame:
    """Positional matching of two tables of anchors: (left_id, right_id, shift, n, pos_from,
    pos_to) where at least `least` anchors that each text holds once stand the same
    distance apart. Anchors that a text repeats don't tell a position and are left out."""
    def once(side: DataFrame, name: str) -> DataFrame:
        one = side.groupBy("doc_id", "code").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
        return one.where("n = 1").select(F.col("doc_id").alias(f"{name}_id"), "code", F.col("pos").alias(f"{name}_pos"))
    pairs = once(left, "left").join(once(right, "right"), "code")
    return (pairs.groupBy("left_id", "right_id", (F.col("right_pos") - F.col("left_pos")).alias("shift"))
            .agg(F.count("*").alias("n"), F.min("left_pos").alias("pos_from"), F.max("left_pos").alias("pos_to"))
            .where(F.col("n") >= least))


# --- the document that follows ----------------------------------------------

def boundaries(keyed: DataFrame) -> list:
    """Keys (doc_id, tie) at which runs of about RUN_ROWS neighbours begin, ascending; the
    first is the least key of all. Drawn by hash and bounded: they place work, never rows."""
    n = keyed.count()
    if not n:
        return []
    runs = min(max(n // RUN_ROWS, 1), MOST_RUNS)
    every = max(n // (runs * PER_RUN), 1)
    drawn = keyed.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(every)) == 0).agg(
        F.sort_array(F.collect_set("key")).alias("keys"))
    least = keyed.agg(F.min("key").alias("k")).first()["k"]
    keys = [tuple(k) for k in drawn.first()["keys"]]
    step = max(len(keys) // runs, 1)
    return [tuple(least), *[k for k in keys[step::step] if k != tuple(least)]]


def run_of(key: Column, bounds: list, kind: str) -> tuple[Column, Column]:
    """Number of boundaries not above the key, and the last of them: a binary search in a
    literal array."""
    held = F.from_json(F.lit(json.dumps([{"doc_id": d, "tie": t} for d, t in bounds])), f"array<{kind}>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda low, step: F.when((low + step <= len(bounds)) & (F.get(held, low + step - 1) <= key), low + step)
        .otherwise(low))
    return at, F.get(held, at - 1)


def with_follower(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), next_text, and columns _run, _guest, .. that keep the order:
    rows with _guest = 1 repeat the first row of the run that follows and go in the end."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("tie")))
    bounds = boundaries(keyed.select("key"))
    kind = keyed.schema["key"].dataType.simpleString()
    run, bound = run_of(F.col("key"), bounds, kind) if bounds else (F.lit(1), F.col("key"))
    before = F.when(F.col("_run") > 1, F.col("_run") - 1).otherwise(max(len(bounds), 1))
    home = F.struct(F.col("_run").alias("_run"), F.lit(0).alias("_guest"))
    guest = F.struct(before.alias("_run"), F.lit(1).alias("_guest"))
    placed = keyed.withColumns({"_run": run, "_first": bound.eqNullSafe(F.col("key"))})
    placed = placed.select("doc_id", "text", F.col("key.tie").alias("_tie"),
                           F.inline(F.when(F.col("_first"), F.array(home, guest)).otherwise(F.array(home))))
    return placed.withColumn("next_text", F.lead("text").over(in_order()))


def in_order() -> Window:
    return Window.partitionBy("_run").orderBy("_guest", F.asc_nulls_first("doc_id"), "_tie", "text")


def edited(df: DataFrame) -> DataFrame:
    """Adds n_chars and edited_text: the last quarter replaced by the follower's head."""
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    return (df.withColumn("n_chars", F.char_length("text").cast("long"))
            .withColumn("edited_text", F.concat(
                F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")),
                F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    df = edited(with_follower(docs)).drop("next_text")
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256))
    df = with_anchors(df, "text", "_anchors").withColumn("fingerprint", fingerprint(F.col("_anchors"))).drop("_anchors")
    df = with_anchors(df, "edited_text", "_anchors").withColumn(
        "edited_fingerprint", fingerprint(F.col("_anchors"))).drop("_anchors", "edited_text")
    df = df.withColumn("next_fingerprint", F.lead("fingerprint").over(in_order())).where("_guest = 0")
    df = likeness(df, "fingerprint", "edited_fingerprint", "near_edited")
    df = likeness(df, "fingerprint", "next_fingerprint", "near_next")
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id),
    first_value(text) OVER (ORDER BY doc_id)) AS following,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
x AS (SELECT doc_id, next_id, n, text, left(text, n - n // 4) || left(following, n // 4) AS edited FROM e),
t AS (SELECT doc_id, 0 AS kind, text FROM x UNION ALL SELECT doc_id, 1, edited FROM x),
p AS (SELECT doc_id, kind, regexp_extract_all(text, '{PIECE}') AS p FROM t),
h AS (SELECT *, list_transform(range(1, len(p)), lambda i: left(md5(p[i] || ' ' || p[i + 1]), 16)) AS h FROM p),
c AS (SELECT doc_id, kind, CASE WHEN len(p) < {K} THEN list_transform(p, lambda x: left(md5(x), {DIGITS}))
  ELSE list_transform(list_filter(range(1, len(p) - {K - 2}),
    lambda i: least(h[i], h[i + 3]) <= least(h[i + 1], h[i + 2])),
    lambda i: left(md5(array_to_string(p[i:i + {K - 1}], ' ')), {DIGITS})) END AS c FROM h),
f AS (SELECT doc_id, kind, list_sort(list_distinct(c))[1:{ANCHORS}] AS f FROM c),
j AS (SELECT x.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.f AS a, b.f AS b, o.f AS o,
  list_sort(list_distinct(list_concat(a.f, b.f)))[1:{ANCHORS}] AS ab,
  list_sort(list_distinct(list_concat(a.f, o.f)))[1:{ANCHORS}] AS ao
  FROM x JOIN f a ON a.doc_id = x.doc_id AND a.kind = 0 JOIN f b ON b.doc_id = x.doc_id AND b.kind = 1
  JOIN f o ON o.doc_id = next_id AND o.kind = 0)
SELECT doc_id, n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(ab) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(ab, a), b)) / len(ab) END AS near_edited,
  CASE WHEN len(ao) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(ao, a), o)) / len(ao) END AS near_next
FROM j"""


@query("op11_syncmer_fingerprints", SQL)
def op11_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprints(table(spark, sf_dir, "documents"))
