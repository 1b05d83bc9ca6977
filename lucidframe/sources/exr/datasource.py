"""The format as a Python data source: ``spark.read.format("exr").load(path)``, ``files.write.format("exr").save(path)``.

The driver lists files and their sizes only.  A partition is a stretch of a file: its task reads the headers and the
chunk table, and seeks to the chunks that begin in its stretch, so a task never loads a whole file; deep parts have no
pixels and are left out; ``channels`` prunes channels, and the options ``part_id``, ``level_x``, ``level_y`` and
``y`` (bounds like 5:7) prune chunks; whole chunks come back, so an exact bound on lines is a filter besides.  Spark
keeps what a filter once pushed into a Python reader for later scans of the same DataFrame, so pruning goes by options
and not by pushed filters.  Files are written by their tasks and get their names when all tasks are done.  For folders
that are mounted on every executor; ``frames.read`` and ``frames.save_files`` serve any other store.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lucidframe.sources.exr import format as f

SCHEMA = "path string, part_id int, level_x int, level_y int, y int, x int, channel string, value double"
#: Bytes of a file that a partition has.
GROUP_BYTES = 8 << 20
HEAD = 1 << 20


@dataclass
class Stretch(InputPartition):
    path: str
    size: int
    number: int
    count: int


class ExrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exr"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExrReader:
        return ExrReader(self.options)

    def writer(self, schema, overwrite: bool) -> ExrWriter:
        return ExrWriter(schema, self.options, overwrite)


class ExrReader(DataSourceReader):
    def __init__(self, options):
        path = options["path"].removeprefix("file://")
        self.files = sorted(glob.glob(os.path.join(path, "**", "*.exr"), recursive=True) if os.path.isdir(path) else glob.glob(path))
        self.channels = {c.strip() for c in options["channels"].split(",")} if options.get("channels") else None
        #: option("y", "5:7") or option("part_id", "1"): inclusive bounds
        self.limits: dict[str, tuple[int, int]] = {}
        for column in ("part_id", "level_x", "level_y", "y"):
            if options.get(column):
                lo, _, hi = options[column].partition(":")
                self.limits[column] = (int(lo), int(hi or lo))

    def _fits(self, column: str, lo: int, hi: int) -> bool:
        a, b = self.limits.get(column, (-(1 << 62), 1 << 62))
        return lo <= b and hi >= a

    def partitions(self) -> list[Stretch]:
        out = []
        for path in self.files:
            size = os.path.getsize(path)
            count = max(1, -(-size // GROUP_BYTES))
            out += [Stretch(path, size, k, count) for k in range(count)]
        return out

    def _chunks(self, stretch: Stretch, parts: list, tables: list[list[int]]) -> Iterator[tuple[int, int, int]]:
        """(part, offset, bytes) of the chunks that begin in this stretch and that no option prunes."""
        ends = sorted({o for t in tables for o in t} | {stretch.size})
        after = dict(zip(ends, ends[1:]))
        for k, (p, table) in enumerate(zip(parts, tables)):
            if p.deep or not self._fits("part_id", k, k):
                continue
            tiles = p.tile_list() if p.tile else None
            for i, o in enumerate(table):
                if o * stretch.count // stretch.size != stretch.number:
                    continue
                chunk = f.Chunk(k, i, *(tiles[i] if tiles else (0, 0, 0, 0)), 0 if tiles else i * f.LINES[p.compression], b"")
                _, y, _, lines = f.chunk_shape(p, chunk)
                reach = max(c.y_sampling for c in p.channels) - 1  # a sample may stand for lines below its block
                if self._fits("level_x", chunk.level_x, chunk.level_x) and self._fits("level_y", chunk.level_y, chunk.level_y) and (p.line_order or self._fits("y", y, y + lines - 1 + reach)):
                    yield k, o, after[o] - o

    def read(self, partition: Stretch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        with open(partition.path, "rb") as file:
            n = HEAD
            while True:  # headers and tables may be longer than the first read
                file.seek(0)
                head = file.read(n)
                try:
                    version, parts, at = f.parse_headers(head)
                    if len(head) < partition.size and at + 8 * sum(p.n_chunks() for p in parts) > len(head):
                        raise f.ImageError(f.BAD_DATA, "more to read")
                    break
                except f.ImageError:
                    if len(head) >= partition.size or not head:
                        raise
                    n *= 4
            if all(p.deep for p in parts):
                return

            def fetch(offset: int, size: int) -> bytes:
                file.seek(offset)
                return file.read(size)

            tables, _ = f.chunk_tables(head, parts, at, bool(version["multipart"]), partition.size, fetch)
            for k, offset, size in self._chunks(partition, parts, tables):
                p = parts[k]
                chunk = f.parse_chunk(fetch(offset, size), p, k, bool(version["multipart"]))
                x, _, w, _ = f.chunk_shape(p, chunk)
                for name, (y, plane) in f.decode_chunk(p, chunk).items():
                    if self.channels is None or name in self.channels:
                        kind, lines = next(c.pixel_type for c in p.channels if c.name == name), len(plane)
                        m = w * lines
                        i32 = lambda v, m=m: pa.array(np.full(m, v, np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([partition.path] * m), i32(k), i32(chunk.level_x), i32(chunk.level_y), pa.array(np.repeat(np.arange(y, y + lines, dtype=np.int32), w)), pa.array(np.tile(np.arange(x, x + w, dtype=np.int32), lines)), pa.array([name] * m), pa.array(f.as_numbers(plane, kind).ravel())],
                            ["path", "part_id", "level_x", "level_y", "y", "x", "channel", "value"],
                        )


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: their names, and where they wait."""

    files: list[tuple[str, str]]


class ExrWriter(DataSourceArrowWriter):
    """Encoded files (path, content) below a folder.  They wait in a folder of their own until all tasks are done."""

    def __init__(self, schema, options, overwrite: bool):
        if {"path", "content"} - set(schema.names):
            raise f.ImageError(f.BAD_ARGUMENT, "files have the columns path and content; frames.encode makes them")
        self.folder, self.overwrite = options["path"].removeprefix("file://").rstrip("/"), overwrite
        self.waiting = f"{self.folder}/_waiting-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        from lucidframe.sources.exr.frames import relative_name

        done = []
        os.makedirs(self.waiting, exist_ok=True)
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                part = f"{self.waiting}/{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(content)
                name = relative_name(path)
                done.append((name if name.endswith(".exr") else f"{name}.exr", part))
        return Written(done)

    def commit(self, messages: list) -> None:
        files = [x for m in messages if m for x in m.files]
        if len({name for name, _ in files}) < len(files):
            self.abort(messages)
            raise f.ImageError(f.CANNOT_WRITE, "two files of one name")
        if self.overwrite:
            for old in glob.glob(os.path.join(self.folder, "**", "*.exr"), recursive=True):
                os.remove(old)
        for name, part in files:
            to = os.path.join(self.folder, name)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            os.replace(part, to)
        shutil.rmtree(self.waiting, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.waiting, ignore_errors=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExrSource)
