r"""Spelling variants grouped through Bloom-guided neighbourhoods (operator 13).

Words are counted over all documents; those long and frequent enough are the vocabulary.
All its words are laid into blocked Bloom filters, one per word length: a word sets bits of
one 512-bit block. The filters are sent to every task, which generates a word's edits (each
letter left out, each replaced by a greater letter that words of its length have, so that every
pair is generated once) and probes the filter of the edit's length. Only positives are shuffled, to
an exact join with the vocabulary that drops the false ones.

The filters take about 16 bits a word up to `MOST_BLOCKS` blocks (64 MB for all lengths
together) and no more: a vocabulary that outgrows them gets more false positives, so more
rows to the exact join, and the same result. Two words differ by one letter through one
left-out letter or one replaced letter only once, so no pair comes twice. A word has at most
some thousand edits, so no key of the join is hot, whatever its frequency.

A word's form is its near word of greatest n (ties: the first in code-point order) if that n
is at least `RATIO` times its own. Forms grow by that factor at each step, so the way to the
root is short (under 28 steps for any count that fits 64 bits); it is followed by doubling.

A null text has no words, an empty one neither. A null doc_id is written as nothing before
the colon of the hashed key. Words are counted per row: repeated rows count each time. Long
texts are split by column expressions, in memory that follows their length. Runs and words
hold letters of Latin-1 only, so a word is an array of single bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import query, stored, table
from logquarry.llm.words import constants, mixed

LETTERS = r"[A-Za-z\x{C0}-\x{FF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = np.array([*LOWER.encode(), *range(0xC0, 0x100)], dtype=np.uint8)
DELETE_EVERY = 199
LEAST_LENGTH, LEAST_N, RATIO = 6, 5, 5
BLOCK_BITS, LANES = 512, 8              # a block: eight lanes of 64 bits
BITS_A_WORD, BITS_SET = 16, 6
MOST_BLOCKS = 1 << 20                   # 64 MB
EDITS_AT_ONCE = 1 << 20
WORDS_A_TASK = 10_000                   # a word has some hundred edits, so few bytes are much work
BASE = int(constants(1, 21)[0])
LETTER = constants(256, 22)


# --- words -------------------------------------------------------------------

def lowered(run: Column) -> Column:
    """A-Z lower-cased, other letters kept."""
    plain = F.octet_length(run) == F.char_length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """word, n of the words of at least least_length code points and least_n occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all("text", F.lit(LETTERS + "{%d,}" % least_length), F.lit(0))).alias("_run"))
    runs = runs.select("_id", lowered(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (h % F.char_length("_run")).cast("int")
    without = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    words = runs.select(F.when(h % DELETE_EVERY == 0, without).otherwise(F.col("_run")).alias("word"))
    return (words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_n))


# --- filters -----------------------------------------------------------------

def bytes_of(words: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in words.to_pylist()]


def word_hash(letters: np.ndarray) -> np.ndarray:
    """Sum of letter values times powers of the base, for words of one length (rows)."""
    powers = np.full(letters.shape[1], np.uint64(BASE))
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    return (LETTER[letters] * powers).sum(axis=1, dtype=np.uint64)


def block_of(code: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and a number that holds its bits' places there."""
    spread = mixed(code)
    block = ((spread >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return block.astype(np.int64), mixed(spread + np.uint64(1))


def bit_of(places: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane of the i-th bit, and the lane with that bit alone."""
    bit = (places >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)
    return (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


def bits_of(code: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its mask: LANES words of 64 bits."""
    block, places = block_of(code, blocks)
    mask, rows = np.zeros((len(code), LANES), dtype=np.uint64), np.arange(len(code))
    for i in range(BITS_SET):
        lane, bit = bit_of(places, i)
        mask[rows, lane] |= bit
    return block, mask


def by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indices, letters): the words of each length as rows of letters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, np.frombuffer(b"".join(words[i] for i in at), dtype=np.uint8).reshape(len(at), size)


class Filters:
    """Blocked Bloom filters by word length, and the letters that words of a length have."""

    def __init__(self, blocks: dict[int, np.ndarray], letters: dict[int, np.ndarray] | None = None):
        self.blocks, self.letters = blocks, letters or {}

    def holds(self, size: int, code: np.ndarray) -> np.ndarray:
        """Whether the filter of a length may hold each hash. A bit is looked up only for
        hashes that had all bits before it."""
        out, held = np.zeros(len(code), dtype=bool), self.blocks.get(size)
        if held is None:
            return out
        block, places = block_of(code, len(held))
        at = np.arange(len(code))
        for i in range(BITS_SET):
            lane, bit = bit_of(places, i)
            there = np.flatnonzero(held[block, lane] & bit)
            at, block, places = at[there], block[there], places[there]
        out[at] = True
        return out


def block_counts(sizes: dict[int, int], most: int = MOST_BLOCKS) -> dict[int, int]:
    """Blocks per word length: BITS_A_WORD for each of its words; all shrink alike at the bound."""
    wanted = {size: -(-n * BITS_A_WORD // BLOCK_BITS) for size, n in sizes.items()}
    share = min(1.0, most / max(sum(wanted.values()), 1))
    return {size: max(1, int(n * share)) for size, n in wanted.items()}


def build_filters(vocabulary: DataFrame, most_blocks: int = MOST_BLOCKS) -> Filters:
    """Tasks set their words' bits, Spark joins the blocks; blocks, not words, reach the driver."""
    sizes = {r["size"]: r["count"] for r in vocabulary.groupBy(F.char_length("word").alias("size")).count().collect()}
    counts = block_counts(sizes, most_blocks)
    lanes = [f"l{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, letters in by_length(bytes_of(batch.column(0))):
                block, mask = bits_of(word_hash(letters), counts[size])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(block), size, dtype=np.int32)), pa.array(block),
                     *[pa.array(mask[:, i].view(np.int64)) for i in range(LANES)]], names=["size", "block", *lanes])
    rows = vocabulary.select("word").mapInArrow(run, "size int, block long, " + ", ".join(f"{c} long" for c in lanes))
    found = rows.groupBy("size", "block").agg(*[F.bit_or(c).alias(c) for c in lanes]).toArrow()
    blocks = {size: np.zeros((n, LANES), dtype=np.uint64) for size, n in counts.items()}
    size, block = found["size"].to_numpy(), found["block"].to_numpy()
    data = np.stack([found[c].to_numpy().astype(np.int64).view(np.uint64) for c in lanes], axis=1)
    for each in blocks:
        blocks[each][block[size == each]] = data[size == each]
    return Filters(blocks, letters_of(vocabulary))


def letters_of(vocabulary: DataFrame) -> dict[int, np.ndarray]:
    """The letters, in order, that words of each length have: no other letter makes a word of
    that length. At most the alphabet for each length reaches the driver."""
    found = vocabulary.select(F.char_length("word").alias("size"), F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
    out: dict[int, list[int]] = {}
    for r in found.where("letter <> ''").distinct().collect():
        out.setdefault(r["size"], []).append(r["letter"].encode("latin-1")[0])
    return {size: np.array(sorted(held), dtype=np.uint8) for size, held in out.items()}


# --- neighbours --------------------------------------------------------------

def edits(letters: np.ndarray, alphabet: np.ndarray = ALPHABET) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, word, place, letter, hash) of the edits of words of one length: each letter
    left out (letter 0), each replaced by each greater one of the alphabet. A letter left out of a run of
    equal ones is tried once."""
    n, size = letters.shape
    powers = np.full(size, np.uint64(BASE))
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    value = LETTER[letters]
    total = (value * powers).sum(axis=1, dtype=np.uint64)
    tail = np.zeros((n, size + 1), dtype=np.uint64)             # sum from a place on, one power less
    lower = np.concatenate([[np.uint64(0)], powers[:-1]]).astype(np.uint64)
    tail[:, :size] = np.cumsum((value * lower)[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    head = np.zeros((n, size + 1), dtype=np.uint64)
    head[:, 1:] = np.cumsum(value * powers, axis=1, dtype=np.uint64)
    if size > 1:
        gone = head[:, :-1] + tail[:, 1:]
        first = np.ones((n, size), dtype=bool)
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        word, place = np.nonzero(first)
        yield size - 1, word, place, np.zeros(len(word), dtype=np.uint8), gone[word, place]
    for letter in alphabet:
        word, place = np.nonzero(letters < letter)
        code = total[word] + (LETTER[letter] - value[word, place]) * powers[place]
        yield size, word, place, np.full(len(word), letter, dtype=np.uint8), code


def candidates(vocabulary: DataFrame, filters: Filters) -> DataFrame:
    """word, n, near: edits that the filters hold, false positives included."""
    spark = vocabulary.sparkSession
    shared = spark.sparkContext.broadcast((filters.blocks, filters.letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(*shared.value)
        for batch in batches:
            words, n = bytes_of(batch.column(0)), batch.column(1).to_numpy()
            for size, at, letters in by_length(words):
                step = max(1, EDITS_AT_ONCE // size)
                for low in range(0, len(at), step):
                    part = letters[low:low + step]
                    for to, word, place, letter, code in edits(part, filters.letters.get(size, ALPHABET)):
                        hit = np.flatnonzero(filters.holds(to, code))
                        if not len(hit):
                            continue
                        which = at[low + word[hit]]
                        near = [words[w][:p] + (bytes([c]) if c else b"") + words[w][p + 1:]
                                for w, p, c in zip(which.tolist(), place[hit].tolist(), letter[hit].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([words[w].decode("latin-1") for w in which.tolist()]), pa.array(n[which]),
                             pa.array([x.decode("latin-1") for x in near])], names=["word", "n", "near"])
    spread = vocabulary.select("word", "n").repartition(1 + vocabulary.count() // WORDS_A_TASK, "word")
    return spread.mapInArrow(run, "word string, n long, near string")


def near_pairs(vocabulary: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """word, n, near, near_n: every two words one edit apart, in both directions."""
    found = candidates(vocabulary, build_filters(vocabulary, most_blocks))
    exact = found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    both = F.array(F.struct("word", "n", "near", "near_n"),
                   F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                            F.col("n").alias("near_n")))
    return exact.select(F.inline(both))


# --- forms and roots -----------------------------------------------------------

def with_forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    known = vocabulary.select("word", "n").join(best, "word", "left")
    holds = -F.col("best.rank") >= ratio * F.col("n")
    return known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                        F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.rank")).alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """Adds `root`. Only words with a form take part in the doubling."""
    up = stored(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-up")
    moved = True
    while moved:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        up = stored(up.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-up")
        moved = not up.where("moved").isEmpty()
        up = up.drop("moved")
    return words.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, ratio: int = RATIO,
                   most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of docs."""
    vocabulary = stored(word_counts(docs, least_length, least_n), "spelling-words")
    words = stored(with_forms(vocabulary, near_pairs(vocabulary, most_blocks), ratio), "spelling-forms")
    return with_roots(words).select("word", "form", "root", "n", "n_near", "form_n")


# The SQL computes CRC-32 from its rule, byte by byte; near words through the words with one
# letter left out.
SQL = r"""
WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
  count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY 1, 2),
bytes AS (SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128
  THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)) AS b
  FROM runs),
crc AS (SELECT run, k, 4294967295 - list_reduce(list_prepend(4294967295, b),
  lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])) AS h FROM bytes, tab),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
  k FROM crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM
  (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM cut c JOIN v ON v.word = c.rest),
best AS (SELECT p.word, count(*) AS n_near, arg_min(near, {'a': -v.n, 'b': near}) AS near, max(v.n) AS near_n
  FROM pairs p JOIN v ON v.word = near GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
  CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
last AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last ON last.word = f.word"""


@query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the form and the root of their spelling."""
    return group_variants(table(spark, sf_dir, "documents"))
