"""Words of Arrow text columns as numpy arrays: offsets, rows and 64-bit hashes.

A batch is cut into pieces of a quarter of a megabyte (one text at least), so memory does
not follow the batch: the arrays over a piece take up to sixty times its size, in every
worker. All word classes here are sets of ASCII bytes that separate,
so texts are handled as UTF-8 bytes; every byte of a longer character is a word byte.
Hashes depend on the word's bytes alone: they are equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 256 << 10
SPACE = bytes([0x20, *range(0x09, 0x0E)])
# ASCII letters and digits stay, and every byte of a non-ASCII character.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values over all bits (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants fixed by the seed."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                 + np.uint64(seed)) | np.uint64(1)


BYTE_VALUES = constants(256, 11)
BASE = int(constants(1, 12)[0])
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(n, np.uint64(base), dtype=np.uint64)
        known[:1] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


@dataclass
class Words:
    """Words of the texts of one piece, in order.

    `rows`: texts in the piece; `first`: index of its first text in the batch;
    `row`, `start`, `end`, `code`: per word its text, byte offsets in `data`, hash;
    `bounds`: word index at which each text begins, and the end.
    """
    rows: int
    first: int
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    bounds: np.ndarray
    text_start: np.ndarray


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def pieces(texts: pa.Array, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets from 0) of runs of whole texts."""
    if not len(texts):
        return
    data, offsets = text_buffer(texts)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + piece_bytes, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: bytes):
    """Start, end and text of every word."""
    inside = np.ones(256, dtype=bool)
    inside[np.frombuffer(separators, dtype=np.uint8)] = False
    on = np.zeros(len(data) + 1, dtype=bool)
    on[:-1] = inside[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = on[:-1]
    cut = offsets[1:-1]
    split = cut[on[cut] & before[cut]]          # a word of one text touching a word of the next
    change = on != before
    edges = np.flatnonzero(change)
    start, end = edges[0::2], edges[1::2]
    if len(split):
        split = np.unique(split)
        start, end = np.sort(np.concatenate([start, split])), np.sort(np.concatenate([end, split]))
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = PIECE_BYTES) -> np.ndarray:
    """64-bit hash of data[start:end] for ascending spans that don't overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        to = max(int(np.searchsorted(end, start[at] + block, side="right")), at + 1)
        low, high = int(start[at]), int(end[to - 1])
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data[low:high]] * powers(BASE, high - low), out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        value = (sums[e] - sums[s]) * powers(BASE_INVERSE, high - low + 1)[s]
        out[at:to] = mixed(value + (e - s).astype(np.uint64))
        at = to
    return out


def words(texts: pa.Array, separators: bytes = SPACE, lower: bool = False,
          piece_bytes: int = PIECE_BYTES) -> Iterator[Words]:
    """The words of a text column, piece by piece."""
    for first, data, offsets in pieces(texts, piece_bytes):
        if lower:
            data = LOWER[data]
        start, end, row = word_spans(data, offsets, separators)
        yield Words(len(offsets) - 1, first, data, row, start, end, hashes(data, start, end),
                    np.searchsorted(row, np.arange(len(offsets))), offsets)


def grams(code: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of code[i:i + n] for every i; len(code) - n + 1 of them."""
    if len(code) < n:
        return np.zeros(0, dtype=np.uint64)
    factors = constants(n, 1000 + seed)
    out = np.zeros(len(code) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += code[k:len(code) - n + 1 + k] * factors[k]
    return mixed(out)


def inside(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from i on belong to one text, for every i."""
    return row[n - 1:] == row[:len(row) - n + 1] if len(row) >= n else np.zeros(0, dtype=bool)
