"""Binary graph files and NumPy arrays, read in ranges of one file by several tasks and written by tasks.

Two data sources of Spark's Python API: `csr` and `npy`. Files are opened by URI through pyarrow, so they
can be in any store that it knows (file, hdfs, s3, gs); a task reads its range and what it must of the
file's tables, never the whole file.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Values of a record batch at most, and row starts that are looked at together.
BLOCK = 1 << 16
#: Tasks of a scan at most if no number is given: where there are more ranges, a task reads several that follow
#: each other.
TASKS = 4096


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a local path, and the path in it."""
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def files(path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder with the suffix, by name."""
    fs, at = opened(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [at]
    found = fs.get_file_info(pafs.FileSelector(at))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix))


def numbers(file, at: int, n: int, kind: str) -> np.ndarray:
    """n numbers from byte `at` on."""
    file.seek(at)
    data = file.read(n * np.dtype(kind).itemsize)
    if len(data) < n * np.dtype(kind).itemsize:
        raise EOFError("the file ends before its header says")
    return np.frombuffer(data, kind)


@dataclass
class Part(InputPartition):
    file: str
    first: int
    last: int
    base: int = 0


@dataclass
class Several(InputPartition):
    """Ranges that one task reads one after the other."""

    parts: list[Part]


class RangeReader(DataSourceReader):
    """Ranges of files, in a bounded number of tasks: a task of few rows costs its start and little else."""

    def __init__(self, options: dict) -> None:
        self.path, self.tasks = options["path"], int(options.get("tasks", TASKS))

    def ranges(self) -> list[Part]:
        raise NotImplementedError

    def read_range(self, part: Part) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def partitions(self) -> list[Several]:
        found = self.ranges() or [Part("", 0, 0)]
        ends = np.linspace(0, len(found), min(self.tasks, len(found)) + 1).astype(int)
        return [Several(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def read(self, several: Several) -> Iterator[pa.RecordBatch]:
        for part in several.parts:
            yield from self.read_range(part)


def split(file: str, n: int, size: int, base: int = 0) -> list[Part]:
    return [Part(file, a, min(n, a + size), base) for a in range(0, n, size)]


class CsrReader(RangeReader):
    """Ranges of edges. A range looks its first row up in the row starts by halving, and goes on through
    the row starts in blocks."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.weighted = options.get("weighted", "false") == "true"
        self.size, self.rows = int(options.get("edges", 1 << 22)), int(options.get("rows_per_file", 0))

    def ranges(self) -> list[Part]:
        fs, _ = opened(self.path)
        out = []
        for k, name in enumerate(files(self.path, ".bcsr")):
            with fs.open_input_file(name) as f:
                block = re.search(r"part-(\d+)\.bcsr$", name)
                out += split(name, int(numbers(f, 0, 2, "<u4")[1]), self.size, int(block[1] if block else k) * self.rows)
        return out

    def read_range(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(part.file) as f:
            n, m = map(int, numbers(f, 0, 2, "<u4"))
            start = lambda row: int(numbers(f, 8 + 4 * row, 1, "<u4")[0]) if row < n else m
            low, high = 0, n  # the last row that starts at or before the first edge
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if start(mid) <= part.first else (low, mid)
            row, edge = low, part.first
            w = fs.open_input_file(part.file + "w") if self.weighted else None
            try:
                while edge < part.last:
                    starts = numbers(f, 8 + 4 * row, min(BLOCK, n - row), "<u4").astype(np.int64)
                    ends = np.r_[starts[1:], start(row + len(starts))]
                    until = min(part.last, int(ends[-1]))
                    for a in range(edge, until, BLOCK):
                        b = min(until, a + BLOCK)
                        counts = np.clip(np.minimum(ends, b) - np.maximum(starts, a), 0, None)
                        src = np.repeat(np.arange(row, row + len(starts)), counts) + part.base
                        dst = numbers(f, 8 + 4 * n + 4 * a, b - a, "<u4").astype(np.int64)
                        weight = np.ones(b - a, np.int64) if w is None else numbers(w, 4 + 4 * a, b - a, "<u4").astype(np.int64)
                        yield pa.record_batch([src, dst, weight], names=["src", "dst", "w"])
                    edge, row = max(edge, until), row + len(starts)
            finally:
                if w is not None:
                    w.close()


class NpyReader(RangeReader):
    """Ranges of rows of arrays of one or two dimensions; ids count on from file to file."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.size = int(options.get("rows", 1 << 16))

    def _header(self, file) -> tuple[tuple[int, ...], np.dtype, int]:
        head = io.BytesIO(file.read(1 << 16))
        version = np.lib.format.read_magic(head)
        shape, turned, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if (turned and len(shape) > 1) or len(shape) not in (1, 2) or kind.hasobject:
            raise ValueError("only arrays of numbers in row order of one or two dimensions can be read in ranges")
        return shape, kind, head.tell()

    def ranges(self) -> list[Part]:
        fs, _ = opened(self.path)
        out, base = [], 0
        for name in files(self.path, ".npy"):
            with fs.open_input_file(name) as f:
                n = self._header(f)[0][0]
            out += split(name, n, self.size, base)
            base += n
        return out

    def read_range(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(part.file) as f:
            shape, kind, begin = self._header(f)
            width = shape[1] if len(shape) == 2 else 1
            step = max(1, BLOCK // max(1, width))
            for a in range(part.first, part.last, step):
                n = min(step, part.last - a)
                values = numbers(f, begin + a * width * kind.itemsize, n * width, kind.str).astype(np.float64)
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()) if width else pa.array(np.zeros(n + 1), pa.int32()), pa.array(values))
                yield pa.record_batch([pa.array(np.arange(a, a + n) + part.base, pa.int64()), x], names=["id", "x"])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class BlockWriter(DataSourceArrowWriter):
    """One file for each block of rows (block, ...) that a task gets, blocks one after the other. Files
    have temporary names until all tasks are done, so a task that ran twice leaves nothing."""

    suffix = ""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options["block"])

    def encode(self, block: int, rows: pa.Table) -> dict[str, bytes]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        names: list[tuple[str, str]] = []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if held:
                rows = pa.Table.from_batches(held)
                block = rows["block"][0].as_py()
                for end, data in self.encode(block, rows).items():
                    name = f"{at}/.{uuid.uuid4().hex}"
                    with fs.open_output_stream(name) as out:
                        out.write(data)
                    names.append((name, f"{at}/part-{block:08d}{end}"))
                held.clear()

        for batch in iterator:
            ids = batch.column(batch.schema.get_field_index("block")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(held[0].schema.get_field_index("block"))[0].as_py() != ids[a]:
                    flush()
                held.append(batch.slice(a, b - a))
        flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in filter(None, messages):
            for name, final in m.names:
                fs.move(name, final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in filter(None, messages):
            for name, _ in m.names:
                fs.delete_file(name)


class CsrWriter(BlockWriter):
    def encode(self, block: int, rows: pa.Table) -> dict[str, bytes]:
        src = rows["src"].to_numpy() - block * self.size
        starts = np.searchsorted(src, np.arange(self.size)).astype("<u4")
        head = np.array([self.size, len(src)], "<u4").tobytes()
        ends, w = (rows[c].to_numpy().astype("<u4").tobytes() for c in ("dst", "w"))
        return {".bcsr": head + starts.tobytes() + ends, ".bcsrw": np.array([len(src)], "<u4").tobytes() + w}


class NpyWriter(BlockWriter):
    def encode(self, block: int, rows: pa.Table) -> dict[str, bytes]:
        out = io.BytesIO()
        np.save(out, np.array(rows["x"].to_pylist(), np.float64))
        return {".npy": out.getvalue()}


class Csr(DataSource):
    """(src, dst, w) of files of compressed rows: unsigned 32-bit n, m, n row starts and m ends, with
    `weighted` a file of the same name and a w of m and m weights (else 1). Options: path, a file or a
    folder of .bcsr files; edges, those of a range; tasks, at most (they share the ranges); rows_per_file, by which the sources of a file are moved,
    times the number in its name (part-<number>.bcsr) or else its place among the files."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "src long, dst long, w long"

    def reader(self, schema: StructType) -> CsrReader:
        return CsrReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CsrWriter:
        return CsrWriter(self.options)


class Npy(DataSource):
    """(id, x) of the rows of NumPy arrays; numbers are given as doubles, those of one dimension in
    arrays of one. Options: path, a file or a folder of .npy files; rows, those of a range; tasks, at most."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id long, x array<double>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options)


def _source(spark: SparkSession) -> SparkSession:
    for kind in (Csr, Npy):
        spark.dataSource.register(kind)
    return spark


def _tasks(spark: SparkSession) -> int:
    return max(512, 8 * spark.sparkContext.defaultParallelism)


def read_csr(spark: SparkSession, path: str, weighted: bool = False, edges: int = 1 << 22, rows_per_file: int = 0) -> DataFrame:
    """(src, dst, w) of a file or a folder of compressed rows, `edges` edges a range; a task
    reads one, or several where there are more ranges than 512 and than eight for each core."""
    return _source(spark).read.format("csr").options(path=path, weighted=str(weighted).lower(), edges=edges, rows_per_file=rows_per_file, tasks=_tasks(spark)).load()


def write_csr(edges: DataFrame, path: str, rows: int) -> None:
    """Edges (src, dst, w) as files of compressed rows with their weights, `rows` sources a file (numbered
    from 0 in it), for read_csr(rows_per_file=rows). A task holds one file at a time; a block's
    number stands in its file's name, and blocks without edges have no file."""
    _source(edges.sparkSession)
    block = F.floor(F.col("src") / rows).cast("long").alias("block")
    e = edges.select(block, "src", "dst", F.col("w").cast("long").alias("w"))
    e.repartition("block").sortWithinPartitions("block", "src", "dst").write.format("csr").options(path=path, block=rows).mode("append").save()


def read_npy(spark: SparkSession, path: str, rows: int = 1 << 16) -> DataFrame:
    """(id, x) of an array file or a folder of them, `rows` rows a range, as read_csr() deals them."""
    return _source(spark).read.format("npy").options(path=path, rows=rows, tasks=_tasks(spark)).load()


def write_npy(vectors: DataFrame, path: str, rows: int) -> None:
    """Vectors (id, x) of ids from 0 without gaps as array files of `rows` rows, for read_npy()."""
    _source(vectors.sparkSession)
    v = vectors.select(F.floor(F.col("id") / rows).cast("long").alias("block"), "id", F.col("x").cast("array<double>").alias("x"))
    v.repartition("block").sortWithinPartitions("block", "id").write.format("npy").options(path=path, block=rows).mode("append").save()
