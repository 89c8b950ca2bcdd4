"""Line logs by byte offset, as a batch and a streaming Spark data source.

Spark's file stream tracks files, not bytes: lines appended to a file it has seen
are lost to it, and its text reader returns a last line that is still being
written. This source keeps ``{file: byte}`` as its offset, ends at the last line
feed, and starts over when a file has become shorter than its offset. New bytes
are cut into ranges, so that executors share even a single large file, and a range is read
a block at a time.
"""

from __future__ import annotations

import fnmatch
import json
import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, InputPartition,
)

from evalweave import constants as C
from evalweave.functions.metrics import log_counter

SCHEMA = "path string, pos bigint, line string"
RANGE_BYTES = 32 << 20
BLOCK_BYTES = 1 << 18
TAIL_BYTES = 1 << 16
RANK_LOG = C.LATEST_RANK_LOG


@dataclass
class ByteRange(InputPartition):
    path: str
    first: int  # where the unread part of the file begins
    start: int
    end: int


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def log_files(path: str, every: bool = False) -> dict[str, int]:
    """The log to read, with its size.

    A folder means its ``rank_0.log``; several matches of a pattern mean the
    newest one (by time, then path), with a warning. ``every`` takes all matches.
    """
    fs, inner = _fs(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        pattern = f"{inner.rstrip('/')}/{'*' if every else RANK_LOG}"
    else:
        pattern = inner
    folder = pattern.rpartition("/")[0] or "."
    if any(c in pattern for c in "*?["):
        listed = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        found = [i for i in listed if i.type == pafs.FileType.File and fnmatch.fnmatchcase(i.path, pattern)]
    else:
        found = [i for i in [fs.get_file_info(pattern)] if i.type == pafs.FileType.File]
    if not every and len(found) > 1:
        found = [max(found, key=lambda i: (i.mtime_ns, i.path))]
        warnings.warn(f"several logs match, only the newest is read: {found[0].path}", stacklevel=2)
    return {scheme + i.path: i.size for i in found}


def _complete_end(path: str, size: int) -> int:
    """Position after the last line feed, searched from the end."""
    fs, inner = _fs(path)
    with fs.open_input_file(inner) as f:
        end = size
        while end > 0:
            start = max(0, end - TAIL_BYTES)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def _ranges(start: dict[str, int], end: dict[str, int], width: int) -> list[ByteRange]:
    parts = []
    for path, stop in sorted(end.items()):
        first = start.get(path, 0)
        if stop < first:  # truncated since
            first = 0
        parts += [ByteRange(path, first, a, min(a + width, stop)) for a in range(first, stop, width)]
    return parts


def _lines(path: str, pos: int, data: bytes) -> pa.RecordBatch:
    """Whole lines, of which the first begins at ``pos``."""
    lines, places = data.split(b"\n")[:-1], []
    for line in lines:
        places.append(pos)
        pos += len(line) + 1
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(lines)), pa.array(places, pa.int64()),
         pa.array([x.decode("utf-8", "ignore") for x in lines])], names=["path", "pos", "line"])


def _read(part: ByteRange) -> Iterator[pa.RecordBatch]:
    """Lines that begin inside the range; a line across its end is finished. No more than a
    block and the line that it breaks off in is held at a time."""
    fs, inner = _fs(part.path)
    with fs.open_input_file(inner) as f:
        # up to the first line feed belongs to the range before
        begun = part.start <= part.first
        pos = part.start if begun else part.start - 1
        f.seek(pos)
        left, held = part.end - pos, []
        while left > 0 or held:
            block = f.read(min(left, BLOCK_BYTES) if left > 0 else TAIL_BYTES)
            if not block:  # the line is still being written
                return
            if left <= 0:  # behind the range only the end of the open line counts
                block = block[:block.find(b"\n") + 1] or block
            left -= len(block)
            if not begun:
                cut = block.find(b"\n") + 1
                pos += cut or len(block)
                if not cut:
                    continue
                begun, block = True, block[cut:]
            cut = block.rfind(b"\n") + 1
            if cut:
                data = b"".join([*held, block[:cut]])
                yield _lines(part.path, pos, data)
                pos += len(data)
                held, block = [], block[cut:]
            if block:
                held.append(block)


class ByteLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.every = options.get("every", "false").lower() == "true"
        self.width = int(options.get("rangebytes", RANGE_BYTES))
        self.starting = options.get("startingoffsets", "earliest")
        self.known: dict[str, tuple[int, int]] = {}  # size of each file, and where its lines end

    def sizes(self) -> dict[str, int]:
        """Where the complete lines of each file end. A snapshot may lie behind that, in a
        line that was still being written: as long as the file is no shorter than the
        snapshot nothing was truncated, and there is nothing to read yet. Only files
        whose size has changed are opened."""
        given = {} if self.starting == "latest" else self.first_offsets()
        ends, listed = {}, log_files(self.path, self.every)
        for path, size in listed.items():
            if self.known.get(path, (-1, 0))[0] != size:
                self.known[path] = size, _complete_end(path, size)
            end, start = self.known[path][1], given.get(path, 0)
            ends[path] = max(end, start) if size >= start else end
        self.known = {path: self.known[path] for path in listed}
        return ends

    def first_offsets(self) -> dict[str, int]:
        if self.starting == "earliest":
            return {}
        if self.starting == "latest":
            return self.sizes()
        return {p: int(n) for p, n in json.loads(self.starting).items()}

    def partitions(self) -> list[ByteRange]:
        """From one listing; tasks find where lines end."""
        return _ranges(self.first_offsets(), log_files(self.path, self.every), self.width)

    def read(self, partition):
        # without any range, Spark asks once, for nothing
        return iter(()) if partition is None else _read(partition)


class ByteLogStream(ByteLogReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return self.first_offsets()

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return _ranges(start, end, self.width)

    def commit(self, end: dict) -> None:
        pass


class ByteLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bytelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ByteLogReader:
        return ByteLogReader(self.options)

    def streamReader(self, schema) -> ByteLogStream:
        return ByteLogStream(self.options)


# travels with the query, so that executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """Complete lines (path, pos, line) at or after ``startingOffsets``."""
    spark.dataSource.register(ByteLog)
    return spark.read.format("bytelog").options(path=path, **options).load()


def stream_log(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ByteLog)
    return spark.readStream.format("bytelog").options(path=path, **options).load()


def snapshot_offsets(path: str, every: bool = False) -> str:
    """Current sizes as ``startingOffsets``: what is logged so far does not count."""
    return json.dumps(log_files(path, every))


def acceptance_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """(accepted, proposed) of each log line, null where a field is absent."""
    return lines.withColumn("accepted", log_counter(line, C.ACCEPTED_FIELD)).withColumn(
        "proposed", log_counter(line, C.PROPOSED_FIELD)).drop(line)


def read_acceptance_log(spark: SparkSession, path: str, **options) -> DataFrame:
    counts = acceptance_counts(read_log(spark, path, **options))
    return counts.where(F.coalesce(F.col("accepted") <= F.col("proposed"), F.lit(False)))
