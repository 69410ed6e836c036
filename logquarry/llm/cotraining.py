"""Quality classifier by co-training (operator 4).

Two views of a document: its text (hashed words, and shares of word shapes and of
repetition) and its page metadata (source, language, length). Each view has a classifier
of its own: log odds of the features whose classes differ by `least_z` standard errors,
calibrated on labelled documents that were not learned from. In every round each view
labels, for the other one, the unlabelled documents it is sure of; both are then fitted
again. The score adds both calibrated log odds to the prior's.

Features of all documents are written once. The choice of features, the pseudo-labels, the
regression and the calibration count all of them. Up to `local_rows` (pseudo-)labelled rows
are fitted on the driver; beyond, Spark sums the gradients per bucket, one pass over the
chosen features for each step of all views.

There are two targets, each with classifiers of its own: `sound` (quality 1) and
`harmless` (toxic 0); the score is the chance of both. With several label rows of an id
the worst counts; a null quality or toxic is no label for that target. Nulls: a null text
has no text features, a null source, language or length is a value of its own. A target
without labels of both classes rejects nothing: its chance is 1. Rows with a null id are unlabelled.
Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logquarry.llm.common import few, map_texts, query, same, stored, table
from logquarry.llm.words import words

WORD_BUCKETS = 1 << 18
SHAPES = 3 ** 8
SHARES = (0.02, 0.1, 0.3, 0.6)
LEAST_WORDS = 10            # shares of fewer words say nothing
TEXT_BUCKETS = WORD_BUCKETS + (SHAPES + 2) * len(SHARES)
META_BUCKETS = 1 << 16
TARGETS = ("sound", "harmless")
BROADCAST_LABELS = 1_000_000    # labelled ids sent to every task (about 40 bytes each); beyond, a shuffled join
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
           b".,;:'\"-()?", b"!", b"#*$%&|<>")


def _class_of_byte() -> np.ndarray:
    out = np.full(256, 6, dtype=np.int64)
    out[128:] = 7
    for i, members in enumerate(CLASSES):
        out[np.frombuffer(members, dtype=np.uint8)] = i
    return out


BYTE_CLASS = _class_of_byte()


def text_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, meta_tokens, text_tokens: sorted buckets of words, shapes' shares and repetition."""
    def run(batch: pa.RecordBatch):
        values, counts = [], []
        for w in words(batch.column(1)):
            n = np.diff(w.bounds)
            shape = np.zeros(len(w.code), dtype=np.int64)
            kinds = BYTE_CLASS[w.data]
            for k in range(8):
                total = np.zeros(len(kinds) + 1, dtype=np.int32)
                np.cumsum(kinds == k, out=total[1:])
                most = 1 if k in (0, 1, 2, 7) else 2
                shape = shape * 3 + np.minimum(total[w.end] - total[w.start], most)
            parts = [w.row.astype(np.int64) << 20 | (w.code % np.uint64(WORD_BUCKETS)).astype(np.int64)]
            again = np.zeros(len(w.code), dtype=bool)
            again[1:] = (w.code[1:] == w.code[:-1]) & (w.row[1:] == w.row[:-1])
            for row, kind in ((w.row, shape), (w.row[again], np.full(again.sum(), SHAPES))):
                key, number = np.unique(row * (SHAPES + 2) + kind, return_counts=True)
                owner, kind = key // (SHAPES + 2), key % (SHAPES + 2)
                share = number / n[owner]
                for b, least in enumerate(SHARES):
                    over = (share > least) & (n[owner] >= LEAST_WORDS)
                    parts.append(owner[over] << 20 | WORD_BUCKETS + kind[over] * len(SHARES) + b)
            found = np.unique(np.concatenate(parts))
            values.append((found & ((1 << 20) - 1)).astype(np.int32))
            counts.append(np.bincount(found >> 20, minlength=w.rows))
        offsets = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1)
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))],
            names=["doc_id", "meta_tokens", "text_tokens"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, ["doc_id", "text", "meta_tokens"], run,
                     f"doc_id {kind}, meta_tokens array<int>, text_tokens array<int>")


def meta_tokens() -> Column:
    """Hashed source, language, length and their pairs."""
    source = F.concat(F.lit("s="), F.coalesce(F.col("source"), F.lit("\0")))
    lang = F.concat(F.lit("l="), F.coalesce(F.col("lang"), F.lit("\0")))
    size = F.concat(F.lit("n="), F.coalesce(F.floor(F.log2(F.col("n_chars") + 1.0)).cast("string"), F.lit("\0")))
    parts = [source, lang, size, F.concat(source, lang), F.concat(lang, size)]
    return F.array_sort(F.array_distinct(F.array(*[
        F.pmod(F.xxhash64(p), F.lit(META_BUCKETS)).cast("int") for p in parts])))


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, sound, harmless: 0.0, 1.0 or null), one row per labelled id."""
    return (labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1).cast("double")).alias("sound"),
        F.min((F.col("toxic") == 0).cast("double")).alias("harmless")))


@dataclass
class View:
    """One view's classifier of one target: weights per bucket, and a line from raw score
    to log odds."""
    target: str
    column: str
    weights: np.ndarray
    slope: float = 0.0
    offset: float = 0.0
    start: float = 0.0          # the regression's intercept

    @property
    def raw(self) -> str:
        return f"raw_{self.target}_{self.column}"

    def log_odds(self) -> Column:
        return F.col(self.raw) * self.slope + self.offset


BUCKETS = {"text_tokens": TEXT_BUCKETS, "meta_tokens": META_BUCKETS}
Y = {(t, c): f"y_{t}_{c}" for t in TARGETS for c in BUCKETS}     # what a view learns from


def held_back() -> Column:
    """Labelled documents that calibrate and are not learned from."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0


def chosen(rows: DataFrame, column: str, totals: dict[str, tuple[float, int]], least_z: float,
           most_features: int, least_docs: int = 5) -> np.ndarray:
    """Buckets whose share differs most between the classes of any target."""
    ys = [Y[t, column] for t in TARGETS]
    parts = [x for y in ys for x in (F.coalesce(F.sum(y), F.lit(0.0)).alias(f"g_{y}"), F.count(y).alias(f"n_{y}"))]
    some = F.greatest(*[F.col(f"n_{y}") for y in ys]) >= least_docs
    counts = (rows.where(F.coalesce(*ys).isNotNull()).select(F.explode(column).alias("t"), *ys)
              .groupBy("t").agg(*parts).where(some).toArrow())
    picked = [np.zeros(0, dtype=np.int64)]
    for y in ys:
        good, every = totals[y]
        if not (counts.num_rows and 0 < good < every):
            continue
        t, g, n = (counts.column(c).to_numpy() for c in ("t", f"g_{y}", f"n_{y}"))
        b = n - g
        odds = np.log((g + .5) / (good + 1)) - np.log((b + .5) / (every - good + 1))
        z = np.where(n >= least_docs, np.abs(odds) / np.sqrt(1 / (g + .5) + 1 / (b + .5)), 0)
        best = np.lexsort((t, -z))[:most_features]
        picked.append(t[best][z[best] >= least_z].astype(np.int64))
    return np.unique(np.concatenate(picked))


DECAY = 2e-4


class Descent:
    """Weights of a logistic regression over set features, by L-BFGS: `at` is where loss and
    gradient are wanted next, `done` when the gradient has all but vanished. The last weight
    is the intercept, which does not decay."""

    def __init__(self, start: np.ndarray, tolerance: float = 2e-3, memory: int = 10):
        self.at, self.best, self.tolerance, self.memory = start.copy(), start, tolerance, memory
        self.loss, self.gradient, self.step, self.done = math.inf, np.zeros(len(start)), 1.0, False
        self.history: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction = np.zeros(len(start))

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        """The mean loss and its gradient at `at`, both without the decay."""
        loss += DECAY / 2 * float(self.at[:-1] @ self.at[:-1])
        gradient = gradient + DECAY * np.append(self.at[:-1], 0.0)
        if loss > self.loss + 1e-4 * self.step * float(self.gradient @ self.direction):
            self.step /= 2                                        # too far
            self.done = self.step < 1e-4
        else:
            moved, turned = self.at - self.best, gradient - self.gradient
            if math.isfinite(self.loss) and moved @ turned > 1e-12:
                self.history = [*self.history, (moved, turned)][-self.memory:]
            self.best, self.loss, self.gradient = self.at, loss, gradient
            self.done = float(np.linalg.norm(gradient)) <= self.tolerance
            self.direction = self._direction()
            self.step = 1.0 if self.history else min(1.0, 1.0 / max(float(np.abs(gradient).sum()), 1e-9))
        self.at = self.best + self.step * self.direction

    def _direction(self) -> np.ndarray:
        out, shares = -self.gradient, []
        for moved, turned in reversed(self.history):
            shares.append(float(moved @ out) / float(moved @ turned))
            out = out - shares[-1] * turned
        if self.history:
            moved, turned = self.history[-1]
            out = out * (float(moved @ turned) / float(turned @ turned))
        for (moved, turned), share in zip(self.history, reversed(shares), strict=True):
            out = out + (share - float(turned @ out) / float(moved @ turned)) * moved
        return out


def slope_sums(batch: pa.RecordBatch, weights: dict[tuple[str, str], np.ndarray]) -> dict[tuple[str, str], np.ndarray]:
    """Per view: the loss summed over the labelled rows, then its gradient."""
    out = {}
    for (target, column), w in weights.items():
        tokens, y = batch.column(column), batch.column(Y[target, column])
        if y.null_count == len(y):
            continue
        known = y.is_valid().to_numpy(zero_copy_only=False)
        truth = y.fill_null(0.0).to_numpy(zero_copy_only=False)
        index = tokens.flatten().to_numpy()
        row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy())
        raw = np.bincount(row, w[index], minlength=len(tokens)) + w[-1]
        miss = np.where(known, 1 / (1 + np.exp(-np.clip(raw, -500, 500))) - truth, 0.0)
        loss = (np.logaddexp(0.0, raw) - truth * raw)[known].sum()
        out[target, column] = np.concatenate([[loss], np.bincount(index, miss[row], minlength=len(w) - 1), [miss.sum()]])
    return out


def summed_slopes(rows: DataFrame, weights: dict[tuple[str, str], np.ndarray]) -> dict[tuple[str, str], np.ndarray]:
    """slope_sums of all rows (settled), summed per view and place by Spark."""
    views = list(weights)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for v, part in slope_sums(batch, shared.value).items():
                sums[v] = sums[v] + part if v in sums else part
        for v, part in sums.items():
            spot = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(spot), views.index(v), np.int32)), pa.array(spot.astype(np.int32)), pa.array(part[spot])],
                names=["view", "spot", "x"])
    got = rows.mapInArrow(run, "view int, spot int, x double").groupBy("view", "spot").agg(F.sum("x").alias("x")).toArrow()
    view, spot, x = (got.column(c).to_numpy() for c in ("view", "spot", "x"))
    out = {}
    for i, v in enumerate(views):
        out[v] = np.zeros(len(weights[v]) + 1)
        out[v][spot[view == i]] = x[view == i]
    shared.destroy()
    return out


def chosen_tokens(rows: DataFrame, picked: dict[str, np.ndarray]) -> DataFrame:
    """The labels Y and the places of the chosen features of every row with a label."""
    ys = list(Y.values())
    place = {c: np.full(BUCKETS[c], -1, dtype=np.int32) for c in BUCKETS}
    for c, buckets in picked.items():
        place[c][buckets] = np.arange(len(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, c in enumerate(BUCKETS):
                tokens = batch.column(i)
                spot = place[c][tokens.flatten().to_numpy()]
                owner = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy())[spot >= 0]
                offsets = np.searchsorted(owner, np.arange(len(tokens) + 1)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(spot[spot >= 0])))
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[2:]], names=[*BUCKETS, *ys])
    schema = ", ".join([*[f"{c} array<int>" for c in BUCKETS], *[f"{y} double" for y in ys]])
    return rows.where(F.coalesce(*ys).isNotNull()).select(*BUCKETS, *ys).mapInArrow(run, schema)


def fit(rows: DataFrame, least_z: float, most_features: int, local_rows: int, before: list[View] | None = None,
        most_steps: int = 60) -> list[View]:
    """Both views of both targets. rows: doc_id, the tokens, the labels Y. Starts from the
    weights of the views `before`."""
    ys = list(Y.values())
    got = rows.agg(*[x for y in ys for x in (F.coalesce(F.sum(y), F.lit(0.0)), F.count(y))],
                   F.count(F.coalesce(*ys))).first()
    totals = {y: (got[2 * i], got[2 * i + 1]) for i, y in enumerate(ys)}
    picked = {c: chosen(rows, c, totals, least_z, most_features) for c in BUCKETS}
    views = [View(t, c, np.zeros(BUCKETS[c], dtype=np.float32)) for t, c in Y]
    old = {(v.target, v.column): v for v in before or []}
    todo = {}
    for key, y in Y.items():
        good, every = totals[y]
        buckets = picked[key[1]]
        if len(buckets) and 0 < good < every:
            start = old[key].weights[buckets].astype(np.float64) if key in old else np.zeros(len(buckets))
            share = math.log(good / (every - good)) if key not in old else old[key].start
            todo[key] = Descent(np.append(start, share))
    if todo:
        tokens = chosen_tokens(rows, picked)
        local = tokens.toArrow().combine_chunks().to_batches() if got[len(got) - 1] <= local_rows else None
        tokens = stored(tokens, "chosen-features") if local is None else tokens
        for _ in range(most_steps):
            weights = {k: d.at for k, d in todo.items() if not d.done}
            if not weights:
                break
            sums = slope_sums(local[0], weights) if local is not None else summed_slopes(tokens, weights)
            for k in weights:
                n = totals[Y[k]][1]
                todo[k].tell(sums[k][0] / n, sums[k][1:] / n)
    for view in views:
        d = todo.get((view.target, view.column))
        if d is not None:
            view.weights[picked[view.column]], view.start = d.best[:-1], float(d.best[-1])
    return views


def scored(features: DataFrame, views: list[View], carry: list[str]) -> DataFrame:
    """The carried columns and the raw score of every view."""
    shared = features.sparkSession.sparkContext.broadcast([(v.column, v.weights) for v in views])
    rows = features.select(*carry, *[F.col(c).alias(f"_lq_{c}") for c in BUCKETS])
    schema = StructType([*rows.select(*carry).schema.fields, *[StructField(v.raw, DoubleType()) for v in views]])
    names, kept = schema.names, len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = []
            for column, weights in shared.value:
                tokens = batch.column(batch.schema.get_field_index(f"_lq_{column}"))
                sums = np.append(0, np.cumsum(weights[tokens.flatten().to_numpy()], dtype=np.float64))
                ends = np.append(0, np.cumsum(tokens.value_lengths().to_numpy())).astype(np.int64)
                extra.append(pa.array(sums[ends[1:]] - sums[ends[:-1]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *extra], names=names)
    return rows.mapInArrow(run, schema)


def calibrated(features: DataFrame, views: list[View]) -> list[View]:
    """Fit every view's line on held-back labels, from counts per tenth of raw score."""
    def tenth(v: View) -> Column:
        return F.round(F.greatest(F.least(F.col(v.raw), F.lit(200.0)), F.lit(-200.0)) * 10)
    rows = features.where(held_back() & F.coalesce(*TARGETS).isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("view"), tenth(v).alias("x"), F.col(v.target).alias("y"))
                               for i, v in enumerate(views)]))
    got = (scored(rows, views, list(TARGETS)).select(each.alias("e")).where("e.y IS NOT NULL").groupBy("e.view", "e.x")
           .agg(F.sum("e.y").alias("g"), F.count(F.lit(1)).alias("n")).collect())
    for i, view in enumerate(views):
        mine = sorted((r["x"] / 10, r["g"], r["n"]) for r in got if r["view"] == i)
        view.slope, view.offset = line(*[np.array([m[k] for m in mine], dtype=float) for k in range(3)])
    return views


def line(x: np.ndarray, g: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of log odds over raw scores x: g of n labels are 1."""
    good, bad = g.sum(), n.sum() - g.sum()
    prior = math.log((good + 1) / (bad + 1))
    if not (good and bad):
        return 0.0, max(prior, 0.0)
    hit, miss = (good + 1) / (good + 2), 1 / (bad + 2)     # softened labels
    target = (g * hit + (n - g) * miss) / n
    a, b = 0.0, prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        curve = n * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(np.array([[(curve * x * x).sum() + 1e-3, (curve * x).sum()],
                                         [(curve * x).sum(), curve.sum() + 1e-6]]),
                               np.array([(n * (target - p) * x).sum() - 1e-3 * a, (n * (target - p)).sum()]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 0.0), b


def cotrained(features: DataFrame, rounds: int, confidence: float, least_z: float, most_features: int,
              local_rows: int) -> list[View]:
    """The views after all rounds. A view learns from labels and, where there is none, from
    what the other view of its target is sure of."""
    edge = math.log(confidence / (1 - confidence))
    other = {"text_tokens": "meta_tokens", "meta_tokens": "text_tokens"}
    tokens = ["doc_id", *TARGETS, *BUCKETS]
    labels = {t: F.when(~held_back(), F.col(t)) for t in TARGETS}
    known = features.where(F.coalesce(*TARGETS).isNotNull())
    rows = known.select(*tokens, *[labels[t].alias(y) for (t, _), y in Y.items()])
    views = calibrated(features, fit(rows, least_z, most_features, local_rows))
    for _ in range(rounds):
        odds = {(v.target, v.column): v.log_odds() for v in views}
        sure = {k: F.when(o >= edge, 1.0).when(o <= -edge, 0.0) for k, o in odds.items()}
        rows = scored(features, views, tokens).select(*tokens, *[
            F.when(F.col(t).isNotNull(), labels[t]).otherwise(sure[t, other[c]]).alias(y) for (t, c), y in Y.items()])
        views = calibrated(features, fit(rows, least_z, most_features, local_rows, views))
    return views


def classify(docs: DataFrame, labels: DataFrame, rounds: int = 2, confidence: float = 0.98,
             least_z: float = 2.5, most_features: int = 1024, local_rows: int = 8_000,
             threshold: float = 0.5, clean_loss: float = 0.01) -> DataFrame:
    """doc_id, p_sound, p_harmless, score, kept for every row of docs. A document is kept
    from the score `threshold` on, or from a lower one if the threshold would lose more than
    the share `clean_loss` of the documents labelled sound and harmless."""
    known = stored(labels_of(labels).withColumnRenamed("doc_id", "_lq_id"), "labels")
    known = F.broadcast(known) if few(known, BROADCAST_LABELS) else known
    slim = text_tokens(docs.select("doc_id", "text", meta_tokens().alias("meta_tokens")))
    labelled = slim.join(known, same(slim["doc_id"], known["_lq_id"]), "left")
    features = stored(labelled.drop("_lq_id"), "view-features")
    views = cotrained(features, rounds, confidence, least_z, most_features, local_rows)
    got = features.agg(*[x for t in TARGETS for x in (F.coalesce(F.sum(t), F.lit(0.0)), F.count(t))]).first()
    out = scored(features, views, ["doc_id", *TARGETS])
    for i, target in enumerate(TARGETS):
        text, meta = [v.log_odds() for v in views if v.target == target]
        good, every = got[2 * i], got[2 * i + 1]
        if 0 < good < every:
            together = text + meta - F.lit(math.log((good + 1) / (every - good + 1)))
            out = out.withColumn(f"p_{target}", 1 / (1 + F.exp(-together)))
        else:
            out = out.withColumn(f"p_{target}", F.lit(1.0))
    score = F.col("p_sound") * F.col("p_harmless")
    clean = (F.col("sound") == 1) & (F.col("harmless") == 1)
    out = stored(out.select("doc_id", "p_sound", "p_harmless", score.alias("score"), clean.alias("clean")), "scores")
    lowest = out.where("clean").agg(F.percentile_approx("score", clean_loss, 10_000)).first()[0]
    cut = threshold if lowest is None else min(threshold, lowest)
    return out.drop("clean").withColumn("kept", F.col("score") >= cut)


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels table."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
