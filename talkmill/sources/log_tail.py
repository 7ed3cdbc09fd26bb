"""Many growing log files as one stream: each complete line once, whatever is appended, added or written anew.

The offset is a map from file to where its last complete line ends, and a checksum of its first bytes. The driver lists the files and reads
of each changed one a few bytes at its start and what lies after its last line end; tasks read the lines, a stretch of bytes each,
and find the line starts in it by themselves. Numbers of lines come from counts by stretch (``line_numbers``).
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes at a file's start that tell whether it is still the same file.
HEAD = 256
#: Bytes read at once in search of a line end.
BLOCK = 1 << 16

SCHEMA = "source_file string, stretch long, place long, position long, line string"
_ARROW = pa.schema([("source_file", pa.string()), ("stretch", pa.int64()), ("place", pa.int64()), ("position", pa.int64()), ("line", pa.string())])


class Stretch(InputPartition):
    """The lines of a file that start from ``start`` to before ``end``; the window of the batch goes from ``low``, a line's start, to ``high``."""

    def __init__(self, path: str, start: int, end: int, low: int, high: int):
        self.path, self.start, self.end, self.low, self.high = path, start, end, low, high


class TailReader(DataSourceStreamReader):
    """Complete lines of the files below a folder whose names fit a pattern, or of a single file.

    A batch takes about ``most_bytes``, shared among the files that have grown; a line longer than a file's share is taken whole, once its end is there.
    The first batch after a restart takes all there is, as where the last one ended is known only then. A file that is shorter
    than what was read of it, or starts otherwise, has been written anew and is read from its start.
    """

    def __init__(self, path: str, pattern: str, most_bytes: int, stretch: int):
        self.path, self.pattern, self.most_bytes, self.stretch = path, pattern, most_bytes, stretch
        self.at: dict | None = None
        #: Where the search for the end of an unfinished long line stopped.
        self.searched: dict[str, int] = {}

    def _files(self) -> tuple[fs.FileSystem, list]:
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
            return store, sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)), key=lambda f: f.path)
        return store, [info] if info.type == fs.FileType.File else []

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    @staticmethod
    def _read(f, start: int, length: int) -> bytes:
        f.seek(start)
        return f.read(length)

    def _end(self, path: str, f, size: int, start: int, share: int | None) -> int:
        """Where the last complete line ends that starts from ``start`` on, within ``share`` bytes or, for a longer line, at its end."""
        limit = size if share is None else min(size, start + share)
        at = limit
        while at > start:
            low = max(start, at - BLOCK)
            cut = self._read(f, low, at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
        at = max(limit, self.searched.get(path, 0))
        while at < size:
            block = self._read(f, at, min(BLOCK, size - at))
            if (cut := block.find(b"\n")) >= 0:
                self.searched.pop(path, None)
                return at + cut + 1
            at += len(block)
        self.searched[path] = at
        return start

    def latestOffset(self) -> dict:
        store, files = self._files()
        known = self.at or {}
        grown = [f for f in files if f.path not in known or f.size != known[f.path]["bytes"]]
        share = None if self.at is None else max(1, self.most_bytes // max(1, len(grown)))
        out = {f.path: known[f.path] for f in files if f.path in known}
        for info in grown:
            with store.open_input_file(info.path) as f:
                old = known.get(info.path)
                same = old is None or self._same(f, info.size, old)
                start = old["bytes"] if old and same else 0
                if not same or info.size < self.searched.get(info.path, 0):
                    self.searched.pop(info.path, None)
                end = self._end(info.path, f, info.size, start, share)
                head = self._read(f, 0, min(HEAD, end))
            out[info.path] = {"bytes": end, "head": len(head), "crc": zlib.crc32(head)}
        return out

    def _same(self, f, size: int, old: dict) -> bool:
        return size >= old["bytes"] and zlib.crc32(self._read(f, 0, old["head"])) == old["crc"]

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.at = end
        store, _ = self._files()
        found = []
        for path, to in end.items():
            old = start.get(path)
            if old == to:
                continue
            low = 0
            if old:
                with store.open_input_file(path) as f:
                    low = old["bytes"] if to["bytes"] >= old["bytes"] and zlib.crc32(self._read(f, 0, old["head"])) == old["crc"] else 0
            found += [Stretch(path, at, min(at + self.stretch, to["bytes"]), low, to["bytes"]) for at in range(low, to["bytes"], self.stretch)]
        return found

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        p = partition
        store, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        with store.open_input_file(p.path) as f:
            data, at = self._read(f, p.start, p.end - p.start), p.start
            if p.start > p.low and self._read(f, p.start - 1, 1) != b"\n":
                cut = data.find(b"\n") + 1
                if not cut:
                    return  # the middle of a long line
                data, at = data[cut:], p.start + cut
            more = []
            end = p.end
            # The last line may end beyond the stretch, before the window's end.
            while data and end < p.high and not (more[-1] if more else data).endswith(b"\n"):
                block = self._read(f, end, min(BLOCK, p.high - end))
                cut = block.find(b"\n") + 1
                more.append(block[:cut] if cut else block)
                end += len(more[-1])
            data += b"".join(more)
        lines = data.split(b"\n")[:-1]
        if lines:
            ends, told = [], at
            for x in lines:
                told += len(x) + 1
                ends.append(told)
            n = len(lines)
            columns = [[p.path] * n, [p.start] * n, range(1, n + 1), ends, [x.decode("utf-8", "replace") for x in lines]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").option("path", ...)``: (source_file, stretch, place, position, line).

    ``position`` is where the line ends in its file, ``stretch`` where the task began to read and ``place`` the line's number there. The path, a file or a folder,
    must be readable by the driver and the executors. Options: pattern (``*.jsonl``), maxBytesPerBatch (64 MB), stretchBytes (4 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        get = self.options.get
        return TailReader(self.options["path"], get("pattern", "*.jsonl"), int(get("maxBytesPerBatch", 64 << 20)), int(get("stretchBytes", 4 << 20)))


def line_numbers(batch: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """``batch`` with line_no, numbered from 1 within each file: what ``cursors`` (source_file, position, lines) counted, then stretch by stretch.

    A batch that doesn't go on after its file's cursor has a file that was written anew, and starts from 1. Counts, not lines, are summed in order.
    """
    counts = batch.groupBy("source_file", "stretch").agg(F.count("*").alias("n"), F.min("position").alias("_first"))
    before = Window.partitionBy("source_file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_file", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.min("stretch").over(Window.partitionBy("source_file")).alias("_low"))
    if cursors is not None:
        known = cursors.select("source_file", F.col("position").alias("_position"), F.col("lines").alias("_lines"))
        starts = starts.join(known, "source_file", "left").withColumn("_before", F.col("_before") + F.when(F.col("_low") >= F.col("_position"), F.col("_lines")).otherwise(0))
        starts = starts.withColumn("_before", F.coalesce("_before", F.lit(0)))
    return batch.join(starts.select("source_file", "stretch", "_before"), ["source_file", "stretch"]).withColumn("line_no", F.col("_before") + F.col("place")).drop("_before")
