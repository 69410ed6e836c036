"""xz, zip and misnamed gzip/bzip2 files: streamed, one file per task.

Such files cannot be split, so a task per file is all there is; each is read in
pieces, never as a whole. A size limit, where given, is judged when a file is
inspected; files that passed are read without one.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry import fixed_values as V
from logquarry.sources.listing import open_input

PIECE = 1 << 20
HEAD_PIECE = 1 << 16
UNDEFINED = V.CP1252_UNDEFINED.encode("latin-1")


class TooLarge(ValueError):
    pass


def _member(archive: zipfile.ZipFile) -> str:
    """The first member with a log extension, else the first file; folders and the
    metadata twins some systems add do not count."""
    def rank(place_and_info) -> tuple[bool, int]:
        place, info = place_and_info
        return not info.filename.lower().endswith(V.ZIP_MEMBER_EXTENSIONS), place
    files = [(i, m) for i, m in enumerate(archive.infolist())
             if not (m.is_dir() or m.filename.startswith("__MACOSX"))]
    if not files:
        raise ValueError("empty_zip")
    return min(files, key=rank)[1].filename


def _open(raw, kind: str):
    """(stream, inner name)"""
    if kind == "zip":
        archive = zipfile.ZipFile(raw)
        name = _member(archive)
        return archive.open(name), os.path.basename(name)
    opener = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}.get(kind)
    return (opener(raw, "rb") if opener else raw), ""


def _split(piece: bytes, encoding: str, first: bool) -> list[str]:
    """Lines of a piece, without CR at their ends and without the byte-order mark."""
    text = piece.decode(encoding, "replace")
    if first and encoding == "utf-8":
        text = text.removeprefix("\ufeff")
    found = [t.rstrip("\r") for t in text.split("\n")]
    if text.endswith("\n"):
        found.pop()
    return found


def _pieces(stream, limit: int | None = None, size: int = PIECE) -> Iterator[bytes]:
    """Runs of whole lines, each ending in a newline but perhaps the last."""
    rest, seen = [], 0
    while chunk := stream.read(size):
        seen += len(chunk)
        if limit is not None and seen > limit:
            raise TooLarge("too_large_decompressed")
        cut = chunk.rfind(b"\n") + 1
        if cut:
            yield b"".join([*rest, chunk[:cut]])
            rest = []
        if cut < len(chunk):
            rest.append(chunk[cut:])
    if rest:
        yield b"".join(rest)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _inspect(limit: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, kind in zip(batch["file"], batch["compressed"]):
                inner, total, size, utf8, cp1252, error = "", 0, 0, True, True, ""
                try:
                    with open_input(file) as raw:
                        stream, inner = _open(raw, kind)
                        for piece in _pieces(stream, limit):
                            size += len(piece)
                            total += piece.count(b"\n") + (not piece.endswith(b"\n"))
                            utf8 = utf8 and _is_utf8(piece)
                            cp1252 = cp1252 and len(piece.translate(None, UNDEFINED)) == len(piece)
                except Exception as e:      # one bad file must not end the load
                    error = str(e) if isinstance(e, TooLarge) or str(e) == "empty_zip" else "unreadable"
                encoding = "utf-8" if utf8 else "cp1252" if cp1252 else "latin-1"
                out.append((file, inner, total, size, encoding, error))
            yield pd.DataFrame(out, columns=["file", "inner", "total", "text_bytes", "encoding", "error"])
    return run


def _spread(files: DataFrame) -> DataFrame:
    """One file per task as far as hashing allows; the count is of files, not lines."""
    return files.repartition(max(1, min(files.count(), 100_000)), "file")


def inspect_archives(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(file, inner, total, text_bytes, encoding, error) by reading each file through."""
    return _spread(files.select("file", "compressed")).mapInPandas(
        _inspect(limit), "file string, inner string, total long, text_bytes long,"
                         " encoding string, error string")


LINE_BATCH = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            line_no = 0
            with open_input(row["file"]) as raw:
                stream, _ = _open(raw, row["compressed"])
                for piece in _pieces(stream):
                    found = _split(piece, row["encoding"], line_no == 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["file"]] * len(found), pa.string()),
                         pa.array(range(line_no, line_no + len(found)), pa.int64()),
                         pa.array(found, pa.string())], schema=LINE_BATCH)
                    line_no += len(found)


def read_archives(files: DataFrame) -> DataFrame:
    """(file, line_no, value) of inspected files: needs file, compressed, encoding."""
    return _spread(files.select("file", "compressed", "encoding")).mapInArrow(
        _lines, "file string, line_no long, value string")


def _heads(sample: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, kind, encoding in zip(batch["file"], batch["compressed"], batch["encoding"]):
                found, line_no = [], 0
                with open_input(file) as raw:
                    stream, _ = _open(raw, kind)
                    for piece in _pieces(stream, size=HEAD_PIECE):
                        for line in _split(piece, encoding, line_no == 0):
                            if line.strip() and len(found) < sample:
                                found.append((file, line_no, line))
                            line_no += 1
                        if len(found) >= sample:
                            break
                yield pd.DataFrame(found, columns=["file", "line_no", "value"])
    return run


def read_heads(files: DataFrame, sample: int = V.DETECT_SAMPLE) -> DataFrame:
    """(file, line_no, value): the first non-blank lines of each file.

    `files`: file, compressed, encoding. Reads a few kilobytes per file, so formats
    are known before the text is read whole.
    """
    return _spread(files.select("file", "compressed", "encoding")).mapInPandas(
        _heads(sample), "file string, line_no long, value string")


def readable(inspected: DataFrame) -> DataFrame:
    return inspected.filter(F.col("error") == "")
