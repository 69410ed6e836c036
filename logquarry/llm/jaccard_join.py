"""Jaccard join of word shingles by set relations (operator 9).

Two documents are linked when their sets of shingles have a Jaccard similarity of at
least `percent` hundredths; a document's component is the smallest id it can be reached
from. Equal sets are one node, so copies never meet as pairs.

Index. Hashes deal the shingles to cells, more cells than two linked sets can differ by in
shingles; what a set has in one cell is a segment. Of the segments with two shingles or more,
in the order of the cells, a set lists the first d + 1, where d is what any link of it can
differ by: linked sets share one of them, and the first one shared has no more than d before
it in either. A set with too few such segments lists those of one shingle too, then segments
by other hashes, and at last one token of its level, so it needs no luck. The number of cells
comes from a ladder of levels by the size of the larger set; a set lists itself on all levels
of the sets it can link to, mostly one or two. A segment is equal only where sets agree in
all of it, so sets that merely share some frequent shingles do not meet, however many there
are. Segments that only one set lists are dropped, and of lists with the same sets the first
one stays. An entry knows its set's size and its place. Blocks of a list are skipped by size
(beyond a factor t) and by place: the larger of two sets must be early, see `led_lists`.

Answers. In each list one set leads, then the next 1, 7, 56 ..., and all others at once when
the pairs they can still meet are no more than some per entry; a leader's overlaps are
computed only with sets that are not yet in its component. From the overlaps with the
first leader L those of other pairs are bounded without reading them:
o(L,x) + o(L,y) - |L| <= o(x,y) <= min(o(L,x) + |y| - o(L,y), o(L,y) + |x| - o(L,x)),
which links or rejects most sets that are much like L; only what lies between is computed.
Before, 256 bits of either set, each the parity of the shingles that fall on it, tell most
pairs that differ in too much apart.
An overlap is first taken over the eighth of the sets with the least hashes; what is left
of the smaller set bounds the rest, and only pairs that can still be linked are compared
whole. A list ends when all its sets are in one component or have led. No link between
different components is left out, and groups of copies cost one overlap per member.

Shingles are told by 64-bit hashes, sets by 128 bits. Nulls: a null text, or one without
words, has an empty set and no link; a row with a null id is linked with nothing and has a
null component. Rows with equal ids are one document, with all its sets linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.common import (BROADCAST_ROWS, bitmaps, discard, few, lookup, map_texts, maybe_in, query, stored,
                                  table, text_key)
from logquarry.llm.components import components
from logquarry.llm.words import constants, grams, inside, mixed, words

SHINGLE = 4
PERCENT = 85
SEEDS = 2                       # ways to deal shingles to cells
BROADCAST_TOKENS = 1_000_000    # shared segments sent to every task, 8 bytes each
BITS = ["b0", "b1", "b2", "b3"]
PAIRS_AT_ONCE = 1000            # pairs of entries per entry that one round may look at
ALL_LEADERS = 1 << 62           # beyond the rank of any
HEAD = 1 << 61                  # hashes below are compared first: an eighth of a set


def levels(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last level of sets of n shingles (none: the last is -1), and of every level
    the most that linked sets can differ by and the number of its cells."""
    largest = 100 * n // percent
    own, most = (2 * x * (100 - percent) // (100 + percent) for x in (n, largest))
    caps = [1]
    while caps[-1] < most.max(initial=0):
        caps.append(max(caps[-1] + 1, caps[-1] * 8 // 5))
    caps = np.array(caps, dtype=np.int64)
    return (np.searchsorted(caps, np.maximum(own, 1)), np.where(most > 0, np.searchsorted(caps, most), -1),
            caps, caps + 2 + caps // 8)


class Sets:
    """Sorted shingle sets of the texts of one piece."""

    def __init__(self, w, size: int):
        self.first, self.rows = w.first, w.rows
        n_words = np.diff(w.bounds)
        whole = inside(w.row, size)
        code, row = [grams(w.code, size)[whole]], [w.row[:len(whole)][whole]]
        for k in range(1, size):
            short = np.flatnonzero(n_words == k)
            code.append(grams(w.code, k, seed=k)[w.bounds[:-1][short]] if len(short) else np.zeros(0, np.uint64))
            row.append(short)
        code, row = np.concatenate(code), np.concatenate(row)
        order = np.argsort(code)
        order = order[np.argsort(row[order].astype(np.uint16 if w.rows < 1 << 16 else np.int64), kind="stable")]
        code, row = code[order], row[order]
        fresh = np.ones(len(code), dtype=bool)
        fresh[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        self.code, self.row = code[fresh], row[fresh]
        self.bounds = np.searchsorted(self.row, np.arange(w.rows + 1))
        self.n = np.diff(self.bounds)

    def ids(self) -> np.ndarray:
        """Two 64-bit sums that tell sets apart, per text."""
        out = np.zeros((self.rows, 2), dtype=np.uint64)
        for k, c in enumerate(constants(2, 500)):
            sums = np.append(np.uint64(0), np.cumsum(mixed(self.code * c + c)))
            out[:, k] = mixed(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.n.astype(np.uint64))
        return out

    def segments(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, token, place) of the listed segments. The first byte of a token tells its
        level, the way of dealing, and whether segments hold one shingle."""
        low, high, caps, cells = levels(self.n, percent)
        reach = (self.n + 100 * self.n // percent) * (100 - percent) // (100 + percent)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]

        def listing(row, token, place, step):
            found.append((row, token >> np.uint64(8) | step.astype(np.uint64)[row] << np.uint64(56), place))
        for up in range(int((high - low).max(initial=-1)) + 1):
            wanting = low + up <= high
            level = np.minimum(low + up, len(caps) - 1)
            differ = np.minimum(caps[level], reach)
            for seed in range(SEEDS):
                row, token, load = self._cells(wanting, cells[level], seed)
                filled = np.zeros(self.rows, dtype=np.int64)
                for single in (0, 1):
                    pick = np.flatnonzero(((load == 1) == single) & wanting[row])
                    r = row[pick]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    filled += np.bincount(r, minlength=self.rows)
                    early = place <= differ[r]
                    listing(r[early], token[pick[early]], place[early], (2 * SEEDS + 1) * level + 2 * seed + single)
                    wanting = wanting & (filled <= differ)
            last = np.flatnonzero(wanting)
            listing(last, np.zeros(len(last), np.uint64), np.zeros(len(last), np.int64),
                    (2 * SEEDS + 1) * level + 2 * SEEDS)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def bits(self) -> np.ndarray:
        """Four numbers per text, whose 256 bits tell whether an odd number of its shingles falls on them."""
        place = self.row * 256 + (self.code & np.uint64(255)).astype(np.int64)
        odd = (np.bincount(place, minlength=256 * self.rows) & 1).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view("<i8").reshape(self.rows, 4)

    def _cells(self, wanted: np.ndarray, cells: np.ndarray, seed: int):
        """(text, token, number of shingles) of the filled cells of the wanted texts, in order."""
        pick = np.flatnonzero(wanted[self.row])
        code, row = self.code[pick], self.row[pick]
        if not len(row):
            return row, code, np.zeros(0, np.int64)
        deal = code
        if seed:
            deal = mixed(code + constants(SEEDS, 700)[seed])
            order = np.lexsort((deal, row))
            code, row, deal = code[order], row[order], deal[order]
        cell = (deal >> np.uint64(32)) * cells[row].astype(np.uint64) >> np.uint64(32)
        edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])))
        a, b = constants(2, 800)
        token = mixed(np.add.reduceat(mixed(code * a + a), edge) + mixed(cell[edge] * b + b))
        return row[edge], token, np.diff(np.append(edge, len(row)))


def blob(ids: np.ndarray) -> pa.Array:
    """16-byte values from rows of two 64-bit numbers."""
    data = np.ascontiguousarray(ids.astype(">u8")).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(data)]).cast(pa.binary())


def readable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL")


def shapes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n, sid for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in words(batch.column(1), lower=True):
            s = Sets(w, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(w.first, w.rows), batch.column(2).slice(w.first, w.rows),
                 pa.array(s.n.astype(np.int64)), blob(s.ids())], names=["doc_id", "text_key", "n", "sid"])
    return map_texts(docs.select("doc_id", "text", text_key().alias("text_key")), ["doc_id", "text", "text_key"],
                     run, f"doc_id {kind}, text_key long, n long, sid binary")


def listed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, half) of all listed segments, the set by half of its id."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in words(batch.column(1), lower=True):
            s = Sets(w, size)
            row, token, _ = s.segments(percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(s.ids()[row, 0].view(np.int64))], names=["token", "half"])
    return map_texts(readable(docs), ["doc_id", "text"], run, "token long, half long")


def index(docs: DataFrame, size: int, percent: int, broadcast_tokens: int) -> DataFrame:
    """Entries (token, sid, n, i, bits) under segments that two different sets list."""
    spark = docs.sparkSession
    shared = stored(listed(docs, size, percent).groupBy("token").agg(
        F.min("half").alias("a"), F.max("half").alias("b")).where("a < b").select("token"), "shared-segments")
    known = None
    if few(shared, broadcast_tokens):
        known = spark.sparkContext.broadcast(np.sort(shared.toArrow().column("token").to_numpy().view(np.uint64)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in words(batch.column(1), lower=True):
            s = Sets(w, size)
            row, token, place = s.segments(percent)
            if known is not None:
                values = known.value
                hit = (values[np.minimum(np.searchsorted(values, token), len(values) - 1)] == token
                       if len(values) else np.zeros(len(token), bool))
                row, token, place = row[hit], token[hit], place[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), blob(s.ids()[row]), pa.array(s.n[row].astype(np.int64)),
                 pa.array(place.astype(np.int64)), *map(pa.array, np.ascontiguousarray(s.bits()[row].T))],
                names=["token", "sid", "n", "i", *BITS])
    rows = map_texts(readable(docs), ["doc_id", "text"], run, "token long, sid binary, n long, i long, "
                     + ", ".join(f"{b} long" for b in BITS))
    if known is None:
        maps = stored(bitmaps(shared, F.col("token")), "segment-filter")
        rows = maybe_in(rows, F.col("token"), maps).join(shared, "token", "left_semi")
    return stored(rows.distinct(), "entries")


def different_lists(entries: DataFrame) -> DataFrame:
    """Entries without the lists that hold the same sets as another one. The first stays, by
    the first byte of its token and by place: where any two of its sets first meet."""
    lists = entries.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y"), F.min(F.struct("sid", "i")).alias("first"))
    kept = stored(lists.groupBy("m", "x", "y").agg(
        F.min(F.struct(F.shiftright("token", 56), "first.i", "token")).alias("l")).select("l.token"), "different-lists")
    out = stored(entries.join(lookup(kept), "token", "left_semi"), "entries")
    discard(kept, entries)
    return out


def contents(docs: DataFrame, shape: DataFrame, sids: DataFrame, size: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """(sid, n, head, rest: sorted 64-bit values, those below HEAD apart) of the wanted sets,
    each once, from one of its texts that has an id. Written once; all overlaps read this."""
    one = (shape.where("doc_id IS NOT NULL").join(sids, "sid", "left_semi").groupBy("sid")
           .agg(F.min(F.struct("doc_id", "text_key")).alias("d")).select("d.doc_id", "d.text_key"))
    one = stored(one, "set-texts").withColumnsRenamed({"doc_id": "_lq_id", "text_key": "_lq_text"})
    slim = readable(docs).select("doc_id", "text", text_key().alias("_lq_key"))
    if few(one, most):
        one = F.broadcast(one)
    else:                       # only texts that a filter of the wanted ones lets through are shuffled
        maps = stored(bitmaps(one, F.struct("_lq_id", "_lq_text")), "set-filter")
        slim = maybe_in(slim, F.struct("doc_id", "_lq_key"), maps)
    slim = slim.join(one, (slim["doc_id"] == one["_lq_id"]) & (slim["_lq_key"] == one["_lq_text"]), "left_semi")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in words(batch.column(1), lower=True):
            s = Sets(w, size)
            each = [s.code[a:b] for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
            cuts = [int(np.searchsorted(x, np.uint64(HEAD))) for x in each]
            yield pa.RecordBatch.from_arrays(
                [blob(s.ids()), pa.array(s.n.astype(np.int64)),
                 pa.array([x[:k].tobytes() for x, k in zip(each, cuts, strict=True)], pa.binary()),
                 pa.array([x[k:].tobytes() for x, k in zip(each, cuts, strict=True)], pa.binary())],
                names=["sid", "n", "head", "rest"])
    # A row that is repeated with its id gives its set twice: its pairs then come twice, to no effect.
    return stored(map_texts(slim, ["doc_id", "text"], run, "sid binary, n long, head binary, rest binary"), "sets")


def common(pairs: DataFrame, sets: DataFrame, whole: bool) -> DataFrame:
    """(a, b, na, nb, ra, rb, o): for settled pairs (leader a, member b) the overlap of their
    heads, or of the whole sets, and how many shingles each has besides. Few pairs go to the
    sets, so that only the wanted sets move to each other."""
    held = F.concat("head", "rest") if whole else F.col("head")
    members = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), held.alias("tb"))
    leaders = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), held.alias("ta"))
    leaders = leaders.join(lookup(pairs.select("a").distinct()), "a", "left_semi")
    both = members.join(lookup(pairs), "b").join(leaders, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = []
            for x, y in zip(batch.column(6), batch.column(7), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                p, q = (p, q) if len(p) < len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), max(len(q) - 1, 0))
                o.append(int((q[at] == p).sum()) if len(p) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(o, pa.int64())],
                                             names=["a", "b", "na", "nb", "ra", "rb", "o"])
    outside = [(F.col(n) - F.length(t) / 8).cast("long").alias(r) for n, t, r in (("na", "ta", "ra"), ("nb", "tb", "rb"))]
    return both.select("a", "b", "na", "nb", *outside, "ta", "tb").mapInArrow(
        run, "a binary, b binary, na long, nb long, ra long, rb long, o long")


def hopeful(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """The settled pairs that can be linked by their heads."""
    return stored(common(pairs, sets, whole=False).where(
        F.col("o") + F.least("ra", "rb") >= needed(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct(), "hopeful", rows=rows)


def merged(labels: DataFrame | None, links: list[DataFrame]) -> DataFrame:
    """(node, label) after more links: only components that a new link touches are worked on."""
    fresh = links[0]
    for x in links[1:]:
        fresh = fresh.unionByName(x)
    if labels is not None:
        ends = lookup(labels).withColumnsRenamed({"node": "_lq_node", "label": "_lq_label"})
        for side in ("a", "b"):
            fresh = (fresh.join(ends, F.col(side) == F.col("_lq_node"), "left")
                     .withColumn(side, F.coalesce("_lq_label", side)).select("a", "b"))
    fresh = stored(fresh.where("a <> b").distinct(), "fresh-links")
    step = components(fresh, fresh.count())
    discard(fresh)
    if labels is None:
        return step
    known = lookup(step).withColumnsRenamed({"node": "_lq_node", "label": "_lq_label"})
    moved = (labels.join(known, labels["label"] == known["_lq_node"], "left")
             .select("node", F.coalesce("_lq_label", "label").alias("label")))
    out = stored(moved.unionByName(step.join(labels, "node", "left_anti")), "set-labels")
    discard(labels, step)
    return out


def led_lists(entries: DataFrame, percent: int) -> DataFrame:
    """Entries that some block of their list can meet, with `leader`, `l_n`, `l_i`: the first
    of them in their list. Blocks are bands of sizes, each with its early entries (with no more
    segments before than what a link to an equal or smaller set can differ by) and late ones; a
    set meets its own band and the next ones, and of two sets the larger must be early. One
    shuffle by the list."""
    width = math.log(100 / percent) * 1.0001
    blocked = entries.withColumns({
        "_lq_band": F.floor(F.log("n") / width),
        "_lq_early": (100 + percent) * F.col("i") <= 2 * (100 - percent) * F.col("n")})
    part = Window.partitionBy("token")
    bands = part.orderBy("_lq_band")
    early = F.count_if("_lq_early")
    met = blocked.withColumns({
        "_lq_small": F.count(F.lit(1)).over(bands.rangeBetween(-1, 0)),
        "_lq_large": early.over(bands.rangeBetween(1, 1)),
        "_lq_larger": early.over(bands.rangeBetween(0, 1))})
    met = met.where(F.when(F.col("_lq_early"), F.col("_lq_small") + F.col("_lq_large") > 1)
                    .otherwise(F.col("_lq_larger") > 0))
    first = F.min(F.struct("sid", "n", "i")).over(part)
    return met.withColumn("_lq_first", first).select(
        *entries.columns, F.col("_lq_first.sid").alias("leader"), F.col("_lq_first.n").alias("l_n"),
        F.col("_lq_first.i").alias("l_i"))


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Least overlap of a link: o >= t * (na + nb - o)."""
    return F.ceil(percent * (na + nb) / float(100 + percent) - 1e-9)


def linked(o: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * o >= percent * (na + nb - o)


def relabel(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with the component of their set in `c`."""
    if labels is None:
        return entries.withColumn("c", F.col("sid"))
    l = lookup(labels.withColumnRenamed("node", "_lq_node"))       # noqa: E741
    return (entries.drop("c").join(l, entries["sid"] == l["_lq_node"], "left")
            .withColumn("c", F.coalesce("label", "sid")).drop("_lq_node", "label"))


def open_lists(entries: DataFrame, low: int) -> DataFrame:
    """Entries of lists that hold two components and a set that has not led yet."""
    alive = entries.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.max("r").alias("last"))
    alive = alive.where((F.col("c1") < F.col("c2")) & (F.col("last") > low)).select("token")
    return entries.join(alive, "token", "left_semi")


def compatible(percent: int) -> Column:
    """Whether a leader's and a member's entry are in blocks that can meet."""
    c = F.col
    sizes = 100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")
    return sizes & (F.greatest("i", "l_i") <= c("n") + c("l_n") - 2 * needed(c("n"), c("l_n"), percent))


def candidates(entries: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """Pairs of the leaders of rank low .. high - 1 with later sets of their lists, but for
    blocks skipped by size and place, pairs whose bits differ in more places than their sets
    may in shingles, and pairs decided by the first leader's overlaps."""
    names = ["sid", "n", "i", "r", "c", "o", "n1", *BITS]
    lead = entries.where((F.col("r") >= low) & (F.col("r") < high)).select(
        "token", *[F.col(x).alias(f"l_{x}") for x in names])
    joined = entries.join(lead, "token").where("r > l_r AND c <> l_c")
    c = F.col
    least = needed(c("n"), c("l_n"), percent)
    most = F.least(c("o") + c("l_n") - c("l_o"), c("l_o") + c("n") - c("o"))
    sure = c("o") + c("l_o") - c("n1") >= least
    apart = sum(F.bit_count(c(b).bitwiseXOR(c(f"l_{b}"))) for b in BITS) > c("n") + c("l_n") - 2 * least
    return (joined.where(compatible(percent) & ~apart & (c("o").isNull() | c("l_o").isNull() | (most >= least)))
            .select(c("l_sid").alias("a"), c("sid").alias("b"), F.coalesce(sure, F.lit(False)).alias("sure"))
            .groupBy("a", "b").agg(F.max("sure").alias("sure")))


def join_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
              broadcast_tokens: int = BROADCAST_TOKENS, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(shape of every row, component label of every linked set). What a step wrote is
    removed once the next one no longer reads it."""
    shape = stored(shapes(docs, size), "set-shapes")
    listed_sets = different_lists(index(docs, size, percent, broadcast_tokens))
    entries = stored(led_lists(listed_sets, percent), "lists")
    discard(listed_sets)
    sets = contents(docs, shape, entries.select("sid").distinct(), size, most)

    # the sets of one id belong together
    ids = shape.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b"))
    of_ids = (shape.select("doc_id", F.col("sid").alias("b")).where("doc_id IS NOT NULL")
              .join(ids.where("a < b").select("doc_id", "a"), "doc_id").select("a", "b"))

    def overlaps(pairs: DataFrame) -> DataFrame:
        """Whole overlaps of those settled pairs that can be linked, settled."""
        n = pairs.count()
        close = hopeful(pairs, sets, percent, n)
        found = stored(common(close, sets, whole=True).select("a", "b", "na", "nb", "o").distinct(), "overlaps", rows=n)
        discard(close, pairs)
        return found

    def links(found: DataFrame) -> DataFrame:
        return found.where(linked(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "b")

    # every set with the least of its leaders, then with its other leaders
    led = entries.where((F.col("leader") != F.col("sid")) & compatible(percent))
    least = led.groupBy(F.col("sid").alias("b")).agg(F.min("leader").alias("a")).select("a", "b")
    nearest = stored(least, "nearest")
    first = overlaps(stored(nearest, "pairs"))
    now = merged(None, [of_ids, links(first)])
    rest = relabel(led, now).join(
        lookup(nearest).select(F.col("a").alias("leader"), F.col("b").alias("sid")), ["leader", "sid"], "left_anti")
    owner = lookup(now).select(F.col("node").alias("leader"), F.col("label").alias("lc"))
    rest = (rest.join(owner, "leader", "left").where(F.coalesce("lc", "leader") != F.col("c"))
            .select(F.col("leader").alias("a"), F.col("sid").alias("b")).distinct())
    second = overlaps(stored(rest, "pairs"))
    now = merged(now, [links(second)])
    seen = stored(first.unionByName(second).select(
        F.col("a").alias("leader"), F.col("b").alias("sid"), "o", F.col("na").alias("n1")), "leaders-overlaps",
        rows=first.count() + second.count())
    opened = open_lists(relabel(entries, now).withColumn("r", F.lit(2)), 1).drop("r", "l_n", "l_i")
    opened = opened.join(lookup(seen), ["leader", "sid"], "left")
    itself = F.col("leader") == F.col("sid")
    opened = opened.withColumns({"o": F.when(itself, F.col("n")).otherwise(F.col("o")),
                                 "n1": F.when(itself, F.col("n")).otherwise(F.col("n1"))})
    lists = stored(opened.drop("leader"), "led-lists")
    discard(entries, nearest, first, second, seen)
    current = ranked(lists)
    discard(lists)
    low, high, n = 1, 2, None
    every = current.count()
    while True:
        before, current = current, stored(open_lists(relabel(current, now), low), "open-lists", rows=n)
        discard(before)
        n = current.count()
        if not n:
            discard(current, sets)
            return shape, now
        if pairs_left(current, low) <= PAIRS_AT_ONCE * every:
            high = ALL_LEADERS
        pairs = stored(candidates(current, low, high, percent), "candidates")
        found = overlaps(stored(pairs.where("NOT sure").select("a", "b"), "pairs", rows=pairs.count()))
        now = merged(now, [pairs.where("sure").select("a", "b"), links(found)])
        discard(pairs, found)
        low, high = high, 8 * high


def pairs_left(entries: DataFrame, low: int) -> int:
    """Pairs of different components, list by list, that leaders of rank `low` on can still meet."""
    sizes = entries.where(F.col("r") >= low).groupBy("token", "c").agg(F.count(F.lit(1)).cast("double").alias("m"))
    lists = sizes.groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
    return lists.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2), F.lit(0))).first()[0]


def ranked(entries: DataFrame) -> DataFrame:
    """Entries with their place `r` in their list; the leader has 0. Places come from the
    order of all entries at once, so a long list is spread over many tasks."""
    ordered = stored(entries.repartitionByRange("token", "sid").sortWithinPartitions("token", "sid")
                     .withColumn("_lq_at", F.monotonically_increasing_id()), "ordered-lists")
    part = F.shiftright("_lq_at", 33)
    inside_part = ordered.groupBy("token", part.alias("_lq_part")).agg(
        F.min("_lq_at").alias("_lq_first"), F.count(F.lit(1)).alias("_lq_n"))
    earlier = Window.partitionBy("token").orderBy("_lq_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = inside_part.select("token", "_lq_part", "_lq_first",
                                 F.coalesce(F.sum("_lq_n").over(earlier), F.lit(0)).alias("_lq_before"))
    out = stored(ordered.withColumn("_lq_part", part).join(offsets, ["token", "_lq_part"])
                 .withColumn("r", F.col("_lq_before") + F.col("_lq_at") - F.col("_lq_first"))
                 .drop("_lq_part", "_lq_at", "_lq_first", "_lq_before"), "ranked-lists")
    discard(ordered)
    return out


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
                       broadcast_tokens: int = BROADCAST_TOKENS, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs. Up to `broadcast_tokens` shared
    segments and `most` wanted texts are sent to every task; beyond, they are joined."""
    shape, labels = join_sets(docs, size, percent, broadcast_tokens, most)
    l = labels.withColumnRenamed("node", "_lq_node")       # noqa: E741
    placed = stored(shape.join(l, shape["sid"] == l["_lq_node"], "left").select(
        "doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("label", "sid")).alias("c")), "placed")
    least = placed.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') AS g FROM
  (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""


@query("op9_jaccard_join", SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by the similarity of their shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))
