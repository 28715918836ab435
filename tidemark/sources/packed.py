"""Packed record files as a Spark data source: fixed-length records, read by ranges of bytes and written by committed tasks.

    spark.read.format("packed").option("layout", "time <i8, last <f8").load(path)

A file of any size is read by many tasks, each with its own range of whole records; only the columns of the schema that is asked for
are made. A series' files are numbered as they were written, and its records (``seq``) through all of them.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

RANGE = 1_000_000  #: records of a task
BATCH = 100_000  #: records that are Arrow columns at a time
_NUMBER = re.compile(r"\.\d{6}-\d{6}(?=\.[^.]*$)")  # of a file among those of its series: the write's and the task's
_KINDS = {"i8": LongType(), "u8": LongType(), "f8": DoubleType(), "i4": IntegerType()}


def layout(kind: np.dtype) -> str:
    return ", ".join(f"{n} {kind[n].str}" for n in kind.names)


def _dtype(text: str) -> np.dtype:
    return np.dtype([tuple(part.split()) for part in text.split(",")])


def store(path: str):
    """The file system and the path in it; of any kind that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder or glob (in the last part only), in the order in which they were written."""
    from pyarrow import fs

    where, base = store(path)
    folder, pattern = (base, "*") if "*" not in posixpath.basename(base) else posixpath.split(base)
    info = where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if where.get_file_info(base).type != fs.FileType.File else [where.get_file_info(base)]
    return sorted((f.path, f.size) for f in info if f.type == fs.FileType.File and f.base_name[0] not in "._" and (fnmatch.fnmatch(f.base_name, pattern) or len(info) == 1))


@dataclass
class _Range(InputPartition):
    path: str
    symbol: str
    first: int  #: record of the file
    seq: int  #: its number within the series
    count: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.kind, self.path = _dtype(options["layout"]), options["path"]
        self.symbol = re.compile(options.get("symbol", r"([A-Za-z0-9$]+?)_?[^/_]*$"))
        self.first, self.range = int(options.get("first", -1)), int(options.get("records", RANGE))
        self.names = schema.names
        self.only = set(options["symbols"].split("\n")) if "symbols" in options else None

    def partitions(self) -> list[_Range]:
        out, seen = [], {}
        for path, size in listed(self.path):
            name = posixpath.basename(path)
            series = _NUMBER.sub("", name)
            symbol = self.symbol.search(name)
            symbol = symbol[1] if symbol else ""
            if self.only is not None and symbol not in self.only:
                continue
            begun, n = seen.get(series, 0), size // self.kind.itemsize
            seen[series] = begun + n
            n = n if self.first < 0 else min(n, max(0, self.first - begun))
            out += [_Range(path, symbol, at, begun + at, min(self.range, n - at)) for at in range(0, n, self.range)]
        return out

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there is no file
            return
        size = self.kind.itemsize
        with store(self.path)[0].open_input_file(part.path) as file:
            for at in range(0, part.count, BATCH):
                n = min(BATCH, part.count - at)
                a = np.frombuffer(file.read_at(n * size, (part.first + at) * size), dtype=self.kind)
                made = {"symbol": lambda: pa.array([part.symbol]).take(pa.array(np.zeros(n, np.int32))), "seq": lambda: pa.array(np.arange(part.seq + at, part.seq + at + n))}
                columns = [made[c]() if c in made else pa.array(np.ascontiguousarray(a[c]).astype(np.int64 if a[c].dtype.kind == "u" else a[c].dtype.newbyteorder("="))) for c in self.names]
                yield pa.RecordBatch.from_arrays(columns, self.names)


@dataclass
class _Written(WriterCommitMessage):
    part: int
    files: list[tuple[str, str]]  #: name, where it is


class _Writer(DataSourceArrowWriter):
    """Tasks write files of their own into a folder that readers don't look into; only those of tasks that count are moved."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.kind, self.path, self.overwrite = _dtype(options["layout"]), options["path"], overwrite
        self.name = schema.names[0]
        self.own = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        where, base = store(self.path)
        where.create_dir(f"{base}/{self.own}", recursive=True)
        files, now, out = [], None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            a = np.zeros(batch.num_rows, dtype=self.kind)
            for n in self.kind.names:
                a[n] = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if names[i] is None or "/" in names[i]:
                    raise ValueError(f"{self.name}: {names[i]!r} is no file name")
                if names[i] != now:
                    if out:
                        out.close()
                    now = names[i]
                    files.append((now, f"{base}/{self.own}/{uuid.uuid4().hex}"))
                    out = where.open_output_stream(files[-1][1])
                out.write(a[i:j].tobytes())
        if out:
            out.close()
        return _Written(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[_Written | None]) -> None:
        where, base = store(self.path)
        there = [p for p, _ in listed(self.path)]
        if self.overwrite:
            for p in there:
                where.delete_file(p)
        last = max((int(m[0][1:7]) for p in there if (m := _NUMBER.search(p))), default=-1)
        for m in messages:
            for name, own in m.files if m else ():
                where.move(own, f"{base}/{name}.{0 if self.overwrite else last + 1:06d}-{m.part:06d}.bin")
        self._clear(where, base)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*store(self.path))

    def _clear(self, where, base: str) -> None:
        from pyarrow import fs

        if where.get_file_info(f"{base}/{self.own}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/{self.own}")


class Packed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> StructType:
        kind = _dtype(self.options["layout"])
        return StructType([StructField("symbol", StringType()), StructField("seq", LongType()), *(StructField(n, _KINDS[kind[n].str[1:]]) for n in kind.names)])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, self.options, overwrite)
