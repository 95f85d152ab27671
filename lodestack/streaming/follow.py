"""

Each batch takes whole lines that were appended since the one before, at most ``maxBytes`` of a file's and ``maxBytes`` of all
files' where there is more (one line at least), cut into ranges of ``splitBytes`` that executors read side by side. A
line's number is its place in the file in bytes, which orders the lines of a file as their numbers would.

Defined cases: a last line without its end waits until it has one; an empty line is a line; a carriage return at a
line's end goes; bytes that aren't UTF-8 are replaced; a file that became shorter, or begins otherwise than before, is
read anew, its lines numbered behind all earlier ones; a file that is gone adds nothing; no files give empty batches.

The driver keeps a small record for each file. After a restart the checkpoint's offsets count; the bound of the first batch
goes by what was planned last (kept below ``state``), so it holds twice the bound at most.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.durable import Store

SCHEMA = "file string, line_no long, value string"
#: Bytes that tell a file from another one of the same name; bytes read at once; where a generation's numbers begin.
HEAD, BLOCK, GENERATION = 256, 1 << 22, 1 << 48


@dataclass
class Range(InputPartition):
    """Lines that begin at a byte from ``first`` on and before ``last``; ``start`` and ``end`` bound the lines of the batch."""

    path: str
    generation: int
    start: int
    end: int
    first: int
    last: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _last_line_end(file: Any, start: int, end: int) -> int:
    """The place after the last line end in [start, end); start if there is none."""
    while end > start:
        size = min(1 << 16, end - start)
        file.seek(end - size)
        at = file.read(size).rfind(b"\n")
        if at >= 0:
            return end - size + at + 1
        end -= size
    return start


def _first_line_end(file: Any, at: int, end: int) -> int:
    """The place after the first line end in [at, end); end if there is none."""
    file.seek(at)
    while at < end:
        part = file.read(min(1 << 16, end - at))
        if not part:
            return end
        hit = part.find(b"\n")
        if hit >= 0:
            return at + hit + 1
        at += len(part)
    return end


def read_range(store: fs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range, some megabytes at a time."""
    name = posixpath.basename(part.path)
    with store.open_input_file(part.path) as file:
        # a line that crosses into the range belongs to the one before
        at = part.first if part.first == part.start else _first_line_end(file, part.first - 1, part.end)
        file.seek(at)
        held = b""
        while at < part.last:
            more = file.read(min(BLOCK, part.end - at - len(held)))
            held += more
            cut = held.rfind(b"\n") + 1
            if not cut and more:
                continue
            lines, numbers = [], []
            for line in held[:cut].split(b"\n")[:-1]:
                if at >= part.last:
                    break
                numbers.append(part.generation * GENERATION + at)
                lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                at += len(line) + 1
            held = held[cut:]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(numbers, pa.int64()), pa.array(lines)], ["file", "line_no", "value"])
            if not more:
                break


class FollowedReader(DataSourceStreamReader):
    """Offsets are {path: [generation, bytes, head's size, head's checksum]}."""

    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*.log")
        self.most, self.split = int(options.get("maxBytes", 1 << 30)), int(options.get("splitBytes", 1 << 26))
        self.kept = Store(options["state"]) if "state" in options else None
        self.planned: dict[str, list[int]] = (self.kept and self.kept.get_json("planned.json")) or {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _head(self, file: Any, size: int) -> int:
        file.seek(0)
        return zlib.crc32(file.read(size))

    def latestOffset(self) -> dict:  # noqa: N802
        store, top = _store(self.path)
        now, left = dict(self.planned), self.most
        found = [] if store.get_file_info(top).type == fs.FileType.NotFound else store.get_file_info(fs.FileSelector(top))
        for info in sorted((i for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob)), key=lambda i: i.path):
            generation, at, size, head = now.get(info.path, [0, 0, 0, 0])
            if info.size == 0 and at == 0:
                continue
            with store.open_input_file(info.path) as file:
                if info.size < at or self._head(file, size) != head:
                    generation, at = generation + 1, 0
                if left > 0 and info.size > at:
                    end = _last_line_end(file, at, min(info.size, at + left))
                    if end == at < info.size - left:  # a line that is longer than the bound
                        end = _first_line_end(file, at, info.size)
                        end = end if _last_line_end(file, at, end) == end else at
                    left -= end - at
                    at = end
                size = min(HEAD, at)
                now[info.path] = [generation, at, size, self._head(file, size)]
        self.planned = now
        if self.kept:
            self.kept.put_json("planned.json", now)
        return now

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # a reader that was started again plans on from here
        out = []
        for path, (generation, to, *_) in sorted(end.items()):
            before = start.get(path, [generation, 0])
            at = before[1] if before[0] == generation else 0
            out += [Range(path, generation, at, to, a, min(to, a + self.split)) for a in range(at, to, self.split)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_range(_store(self.path)[0], partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Followed(DataSource):
    """Options path, glob, maxBytes, splitBytes, state."""

    @classmethod
    def name(cls) -> str:
        return "lodestack_follow"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FollowedReader(dict(self.options))


def lines(spark: SparkSession, path: str, glob: str = "*.log", max_bytes: int = 1 << 30, split_bytes: int = 1 << 26, state: str | None = None) -> DataFrame:
    """[R1, S1] The lines of a folder's logs as they are appended: file (its name), line_no, value."""
    spark.dataSource.register(Followed)
    options = {"path": path, "glob": glob, "maxBytes": str(max_bytes), "splitBytes": str(split_bytes)} | ({"state": state} if state else {})
    return spark.readStream.format(Followed.name()).options(**options).load()
