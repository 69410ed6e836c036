"""Language identification with hyperdimensional profiles (operator 5).

Every letter has a random +1/-1 vector fixed by its code point. A trigram's vector binds
its letters, each rotated by its place: rot2(a) * rot1(b) * c. A text is the sum of the
vectors of all its trigrams, a language prototype the sum over its labelled texts, each
weighted to equal mass. A text gets the language of the largest cosine.

Texts are lower-cased; every run of other characters is one blank, and blanks stand at
both ends. A null text or one without a letter gives `und` with score 0, as does every
text when nothing was learned. Equal cosines give the alphabetically first language.
Prototypes are sums of whole numbers, so they don't depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import map_texts, query, table
from logquarry.llm.words import mixed, pieces

DIMENSIONS = 1024
MASS = 1 << 16              # of one labelled text in its prototype
PIECE_BYTES = 256 << 10
BLOCK = 4096                # trigrams bound at once
UNKNOWN = "und"
_tables: dict[str, np.ndarray] = {}


def is_letter() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _tables["place"] = np.zeros(0x110000, dtype=np.int64)
    return _tables["letter"]


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """Random +1/-1 rows, a function of the code point alone."""
    words = -(-dimensions // 64)
    seeds = mixed(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                  + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    bits = np.unpackbits(seeds.view(np.uint8).reshape(len(points), -1), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


class Trigrams:
    """Trigram counts of the texts of one piece: counts[text, g], vectors(from, to)."""

    def __init__(self, texts: list[str], dimensions: int):
        letter, place = is_letter(), None
        place = _tables["place"]
        lowered = [f" {t.lower()} " for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
        points = np.where(letter[points], points, 0)
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (row[1:] != row[:-1])
        points, row = points[keep], row[keep]
        self.has_letter = np.bincount(row[points != 0], minlength=len(texts)) > 0
        seen = np.zeros(0x110000, dtype=bool)
        seen[points] = True
        self.alphabet = np.flatnonzero(seen)
        size = len(self.alphabet)
        place[self.alphabet] = np.arange(size)
        p = place[points]
        whole = row[2:] == row[:-2]
        code = ((p[:-2] * size + p[1:-1]) * size + p[2:])[whole]
        row = row[:-2][whole]
        if size ** 3 <= 1 << 22:
            used = np.flatnonzero(np.bincount(code, minlength=size ** 3))
            position = np.zeros(size ** 3, dtype=np.int64)
            position[used] = np.arange(len(used))
            which = position[code]
        else:
            used, which = np.unique(code, return_inverse=True)
        self.codes, self.which, self.row, self.texts = used, which, row, len(texts)
        self.totals = np.bincount(row, minlength=len(texts))
        vectors = letter_vectors(self.alphabet, dimensions)
        self.bound = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), vectors

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(counts[text, g], vectors[g, dimension]) of at most BLOCK trigrams at a time."""
        size = len(self.alphabet)
        for at in range(0, len(self.codes), BLOCK):
            codes = self.codes[at:at + BLOCK]
            mine = (self.which >= at) & (self.which < at + BLOCK)
            counts = np.bincount(self.row[mine] * len(codes) + self.which[mine] - at,
                                 minlength=self.texts * len(codes)).reshape(self.texts, -1)
            a, b, c = self.bound
            vectors = a[codes // (size * size)] * b[codes // size % size] * c[codes % size]
            yield counts, vectors.astype(np.float32)


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype per language of (text, lang); unlabelled rows are left out."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, _, offsets in pieces(batch.column(0), PIECE_BYTES):
                n = len(offsets) - 1
                found = Trigrams(batch.column(0).slice(first, n).to_pylist(), dimensions)
                names = sorted(set(langs[first:first + n]))
                member = np.array([[x == name for x in langs[first:first + n]] for name in names])
                member = (member & found.has_letter).astype(np.float64)
                mine = np.zeros((len(names), dimensions))
                for counts, vectors in found.blocks():
                    share = counts * MASS // np.maximum(found.totals, 1)[:, None]
                    mine += (member @ share) @ vectors.astype(np.float64)
                for name, vector in zip(names, mine, strict=True):
                    total[name] = total.get(name, 0) + vector
        names = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()),
             pa.array([total[x].astype(np.int64) for x in names], pa.list_(pa.int64()))],
            names=["lang", "vector"])
    rows = (labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
            .mapInArrow(sums, "lang string, vector array<long>")
            .select("lang", F.posexplode("vector").alias("i", "v"))
            .groupBy("lang", "i").agg(F.sum("v").alias("v"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vector"))
            .collect())
    found = {r["lang"]: np.array([x["v"] for x in r["vector"]], dtype=np.float64) for r in rows}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from its text alone."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]).T if names else None
    labels = np.array([*names, UNKNOWN], dtype=object)

    def predict(batch: pa.RecordBatch):
        best, score = [], []
        for first, _, offsets in pieces(batch.column(1), PIECE_BYTES):
            n = len(offsets) - 1
            found = Trigrams([t or "" for t in batch.column(1).slice(first, n).to_pylist()],
                             len(matrix) if names else 1)
            if not names:
                best.append(np.zeros(n, dtype=np.int64))
                score.append(np.zeros(n))
                continue
            bundle = np.zeros((n, len(matrix)))
            for counts, vectors in found.blocks():
                bundle += counts.astype(np.float32) @ vectors
            cosine = (bundle @ matrix) / np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)[:, None]
            best.append(np.where(found.has_letter, cosine.argmax(axis=1), len(names)))
            score.append(np.where(found.has_letter, np.clip(cosine.max(axis=1), 0, 1), 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(labels[np.concatenate(best)] if best else [], pa.string()),
             pa.array(np.concatenate(score) if score else [], pa.float64())],
            names=["doc_id", "lang_pred", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, ["doc_id", "text"], predict, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """A quarter of the ids is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(~held_out()))
    return identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
