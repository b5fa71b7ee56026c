"""Log files that grow: only what was appended since the last run is read, in blocks, with numbers of lines in the file.

The source ``appended_lines`` plans blocks of the bytes after a file's bookmark, so what lies before it is never read.
A line belongs to the block that it begins in. Each block gives its lines with their places in it and one summary row; line numbers come from
the summaries, as a sum over the blocks before.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from telemill.plans.storage import store

#: Bytes of a block; bytes at a file's head that tell whether it is still the same file.
BLOCK, HEAD = 16 << 20, 1024
#: file, bytes and lines read so far, and the file's first bytes (at most HEAD of those read), in hex.
BOOKMARK = "file string, bytes long, lines long, head string"
_SCHEMA = "file string, block long, line long, value string, end long, head string, from_start boolean"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "/", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def lines_of(read, start: int, end: int, first: int, size: int) -> tuple[list[bytes], int]:
    """Lines that begin in [start, end) and end before ``size``, and the place after the last.

    read(a, b) gives bytes; ``first`` is where reading starts in the file, so a block that begins there begins with a line.
    """
    data = read(start - (start > first), end)
    if start > first:  # unless the byte before ends a line, a line of the block before goes on
        cut = data.find(b"\n") + 1
        if not cut:
            return [], first
        start, data = start - 1 + cut, data[cut:]
    if start >= end:
        return [], start
    at = end
    while not data.endswith(b"\n") and at < size:
        more = read(at, min(at + (1 << 20), size))
        cut = more.find(b"\n") + 1
        data, at = data + (more[:cut] if cut else more), at + len(more)
        if cut:
            break
    data = data[: data.rfind(b"\n") + 1]
    return data.split(b"\n")[:-1], start + len(data)


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Block(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: int, size: int):
        self.file, self.start, self.end, self.first, self.size = file, start, end, first, size


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob, self.block = options["path"], options.get("glob", "*"), int(options.get("block", BLOCK))
        self.bookmarks = {b["file"]: b for b in json.loads(options.get("bookmarks", "[]"))}

    def partitions(self) -> list[_Block]:
        system, root = _open(self.path)
        out = []
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            if info.type != fs.FileType.File or not fnmatch(info.base_name, self.glob) or info.base_name.startswith((".", "_")):
                continue
            first, known = 0, self.bookmarks.get(info.path)
            if known and info.size >= known["bytes"]:
                with system.open_input_file(info.path) as f:
                    head = f.read(min(known["bytes"], HEAD))
                first = known["bytes"] if head.hex() == known["head"] else 0
            out += [_Block(info.path, a, min(a + self.block, info.size), first, info.size) for a in range(first, info.size, self.block)]
        return out or [_Block("", 0, 0, 0, 0)]

    def read(self, part: _Block) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.file) as f:

            def read(a: int, b: int) -> bytes:
                f.seek(a)
                return f.read(b - a)

            found, end = lines_of(read, part.start, part.end, part.first, part.size)
            head = read(0, min(end, HEAD)).hex() if part.start == part.first or part.start <= HEAD else None
        n = len(found)
        keep = [k for k, line in enumerate(found) if line.strip()]
        for a in range(0, len(keep), 10_000):
            some = keep[a : a + 10_000]
            yield _batch(part, [k + 1 for k in some], [found[k].decode(errors="replace").rstrip("\r") for k in some], None, None)
        yield _batch(part, [n], [None], end, head)


def _batch(part: _Block, line: list[int], value: list, end: int | None, head: str | None) -> pa.RecordBatch:
    n = len(line)
    columns = [pa.array([part.file] * n), pa.array([part.start] * n, pa.int64()), pa.array(line, pa.int64()), pa.array(value, pa.string()), pa.array([end] * n, pa.int64()), pa.array([head] * n, pa.string()), pa.array([part.first == 0] * n)]
    return pa.RecordBatch.from_arrays(columns, ["file", "block", "line", "value", "end", "head", "from_start"])


def read_appended(spark: SparkSession, path: str, bookmarks: DataFrame | None = None, glob: str = "*", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lines, bookmarks): lines of the files below a folder after their bookmarks, and the bookmarks for the next run.

    lines has file, line_number (from 1, in the whole file; blank lines count but are left out) and value; bytes that are no UTF-8 become replacement
    characters. A file whose head has changed, or that is shorter than its bookmark, was rotated and is read from its
    start. A last line without its end waits for the next run. Files that are gone keep their bookmarks. What is new is written once to the shared folder, so
    lines and bookmarks belong together whatever is appended meanwhile. The list of files and their bookmarks is on the driver, as for every file source.
    """
    spark.dataSource.register(AppendedLines)
    old = bookmarks if bookmarks is not None else spark.createDataFrame([], BOOKMARK)
    known = json.dumps([r.asDict() for r in old.collect()])
    raw = store(spark.read.format("appended_lines").options(path=path, glob=glob, block=str(block), bookmarks=known).load(), "appended")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = raw.filter("value IS NULL").join(old.select("file", F.col("lines").alias("_old")), "file", "left")
    start = F.when(F.col("from_start"), F.lit(0)).otherwise(F.coalesce("_old", F.lit(0)))
    blocks = blocks.select("file", "block", F.col("line").alias("n"), "end", "head", (start + F.coalesce(F.sum("line").over(before), F.lit(0))).alias("before"))
    lines = raw.filter("value IS NOT NULL").join(blocks.select("file", "block", "before"), ["file", "block"])
    lines = lines.select("file", (F.col("before") + F.col("line")).alias("line_number"), "value")
    now = blocks.groupBy("file").agg(F.max("end").alias("bytes"), F.max(F.col("before") + F.col("n")).alias("lines"), F.max_by("head", F.length("head")).alias("head"))
    return lines, store(now.unionByName(old.join(now, "file", "left_anti")), "bookmarks")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so workers need not have this module
