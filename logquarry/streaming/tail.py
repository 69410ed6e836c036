"""Stream source for files that grow: whole new lines by byte offset.

Spark's file source reads a file once and never sees what is appended later.
This source keeps a byte position per file in the query's checkpoint. It stops
at the last newline, so a half-written line waits for its end. A file shorter
than its position was cut or replaced: it is read from the start again under the
next generation number, so (file, generation, byte_pos) stays unique.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logquarry.sources.listing import resolve

SCHEMA = "file string, generation int, byte_pos bigint, value string"
BATCH = pa.schema([("file", pa.string()), ("generation", pa.int32()),
                   ("byte_pos", pa.int64()), ("value", pa.string())])
PIECE = 1 << 20
LINES_PER_BATCH = 20_000


class Range(InputPartition):
    """Lines of one file whose first byte lies in [lo, hi); `first` marks a line start."""

    def __init__(self, file: str, generation: int, lo: int, hi: int, end: int, first: bool):
        self.file, self.generation = file, generation
        self.lo, self.hi, self.end, self.first = lo, hi, end, first


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.from_end = options.get("startingOffsets", "earliest") == "latest"
        self.encoding = options.get("encoding", "utf-8")
        self.piece = int(options.get("maxPartitionBytes", 64 << 20))
        self.per_trigger = int(options.get("maxBytesPerTrigger", 0))
        self.state_path = options.get("statePath")
        self.seen: dict[str, list[int]] | None = None

    # positions: file -> [generation, byte position]

    def _sizes(self) -> dict[str, int]:
        sizes = {}
        for uri in self.paths:
            filesystem, path = resolve(uri)
            info = filesystem.get_file_info(path)
            found = ([info] if info.type == pafs.FileType.File else
                     filesystem.get_file_info(pafs.FileSelector(path)) if info.type == pafs.FileType.Directory
                     else [])
            for f in found:
                if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")):
                    base = uri.rstrip("/")
                    sizes[base if f is info else f"{base}/{f.base_name}"] = f.size
        return sizes

    def _load_state(self) -> dict[str, list[int]]:
        if not self.state_path:
            return {}
        filesystem, path = resolve(self.state_path)
        if filesystem.get_file_info(path).type != pafs.FileType.File:
            return {}
        with filesystem.open_input_stream(path) as f:
            return json.loads(f.read())

    def _save_state(self) -> None:
        if self.state_path:
            filesystem, path = resolve(self.state_path)
            filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with filesystem.open_output_stream(path + ".new") as f:
                f.write(json.dumps(self.seen).encode())
            filesystem.move(path + ".new", path)

    def _last_newline(self, file: str, lo: int, hi: int) -> int:
        """Position behind the last newline in [lo, hi), or lo."""
        filesystem, path = resolve(file)
        with filesystem.open_input_file(path) as f:
            while hi > lo:
                start = max(lo, hi - PIECE)
                f.seek(start)
                at = f.read(hi - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                hi = start
        return lo

    def _next_newline(self, file: str, lo: int, hi: int) -> int:
        filesystem, path = resolve(file)
        with filesystem.open_input_file(path) as f:
            f.seek(lo)
            while lo < hi:
                data = f.read(min(PIECE, hi - lo))
                at = data.find(b"\n")
                if at >= 0 or not data:
                    return lo + at + 1 if data else hi
                lo += len(data)
        return hi

    def _advance(self, file: str, lo: int, size: int, left: int) -> int:
        """Where a batch may read to: whole lines, and `left` bytes where there is a limit
        (a longer line passes alone)."""
        whole = self._last_newline(file, lo, size)
        if self.per_trigger and whole - lo > left:
            capped = self._last_newline(file, lo, lo + left)
            return capped if capped > lo else self._next_newline(file, lo + left, whole)
        return whole

    def _fair(self, sizes: dict[str, int], seen: dict[str, list[int]]) -> list[tuple[str, int]]:
        """Files with the least read first, so a limit for all of them starves none."""
        return sorted(sizes.items(), key=lambda f: (seen.get(f[0], [0, 0])[1], f[0]))

    def initialOffset(self) -> dict:
        start = {}
        if self.from_end:
            start = {f: [0, self._last_newline(f, 0, n)] for f, n in self._sizes().items()}
        if self.seen is None:
            self.seen = {**self._load_state(), **start}
        return start

    def latestOffset(self) -> dict:
        if self.seen is None:
            self.seen = self._load_state()
        now, left = dict(self.seen), self.per_trigger
        for file, size in self._fair(self._sizes(), now):
            generation, pos = now.get(file, [0, 0])
            if size < pos:
                generation, pos = generation + 1, 0
            if size == pos:                 # nothing new: the file is not opened
                now[file] = [generation, pos]
                continue
            if self.per_trigger and left <= 0:
                now[file] = [generation, pos]
                continue
            to = self._advance(file, pos, size, left)
            left -= to - pos
            now[file] = [generation, to]
        if now != self.seen:
            self.seen = now
            self._save_state()
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.seen is None:
            self.seen = dict(end)
        out = []
        for file, (generation, to) in end.items():
            was, pos = start.get(file, [0, 0])
            lo = pos if was == generation and pos <= to else 0
            if was == generation and pos > to:      # cut while nobody kept count
                generation += 1
            for at in range(lo, to, self.piece):
                out.append(Range(file, generation, at, min(at + self.piece, to), to, at == lo))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        filesystem, path = resolve(part.file)
        with filesystem.open_input_file(path) as f:
            # A file cut since the batch was planned gives what it still holds; the next
            # trigger sees it shorter than its position and reads it as a new generation.
            size = f.size()
            if part.lo >= size:
                return
            part.end = min(part.end, size)
            part.hi = min(part.hi, size)
            pos = part.lo
            if not part.first:
                pos = part.lo - 1
                f.seek(pos)
                pos = self._skip_line(f, pos, part.end)
            f.seek(pos)
            held, rows = b"", []
            while pos < part.hi:
                data = f.read(min(PIECE, part.end - pos - len(held)))
                if not data and not held:
                    break
                lines = (held + data).split(b"\n")
                held = lines.pop()
                for line in lines:
                    if pos >= part.hi:
                        break
                    rows.append((pos, line))
                    pos += len(line) + 1
                    if len(rows) >= LINES_PER_BATCH:
                        yield self._batch(part, rows)
                        rows = []
                if not data:
                    break
            if rows:
                yield self._batch(part, rows)

    @staticmethod
    def _skip_line(f, pos: int, end: int) -> int:
        while pos < end:
            data = f.read(min(PIECE, end - pos))
            at = data.find(b"\n")
            if at >= 0:
                return pos + at + 1
            pos += len(data)
        return end

    def _batch(self, part: Range, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([part.file] * len(rows), pa.string()),
            pa.array([part.generation] * len(rows), pa.int32()),
            pa.array([p for p, _ in rows], pa.int64()),
            pa.array([b.decode(self.encoding, "replace").rstrip("\r") for _, b in rows], pa.string()),
        ], schema=BATCH)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def follow(spark: SparkSession, path: str, dataset: str, owner: str = "local",
           **options: str) -> DataFrame:
    """Stream of lines of growing files, ready for any parser.

    `line_no` is the byte position, `file` carries the generation once it is
    above zero. Give `statePath` to tell a cut file even across restarts.
    """
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("logtail").options(**options).load(path)
    file = F.when(F.col("generation") > 0, F.concat("file", F.lit("#"), "generation")).otherwise(F.col("file"))
    return lines.select(F.lit(owner).alias("owner"), F.lit(dataset).alias("dataset"), file.alias("file"),
                        F.col("byte_pos").alias("line_no"), "value", "generation")
