"""``spark.read/write/readStream.format("records")`` for the binary record format.

Reading: ``path`` is a file or folder on a file system that all executors mount; ``columns`` (comma separated) reads
only those; ``records_per_partition`` sets the split, which in paged files follows the pages. Records are numbered through
the files in the order of their names, in ``_rec``; filters on ``_rec`` narrow the partitions. With ``pages`` (true) the number
of each record's page, through the files likewise, is in ``_page`` (null where a file has none). ``register`` comes first. For
other file systems ``read_anywhere`` reads whole files through Spark, and ``ranged`` reads byte ranges by a function.

Writing: files per partition in ``layout`` (row, compact, columnar or paged; a columnar file has ``records_per_file`` at most, a
page ``page_records``, the last one fewer, and one sooner that would take more than 64 MB), renamed into place when the job commits. An overwrite then removes the record files that were there before, and nothing
else: until then a reader may see both, and no crash loses the old ones. With ``batch`` (a number), files of an earlier run
of the same batch are replaced, so that a repeated batch leaves its records once.

Streaming reads all files of a folder, present and future, each as far as it is whole; paged and row files may still be
growing. The offset is the number of records taken of each file. In a stream ``_rec`` counts within a file.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from lamina.sources import encode
from lamina.sources.wire import FormatError, RangedFile, RecordFile, wider_schema

SUFFIX = ".rec"
_PER_PARTITION = 1 << 18
_PER_FILE = 1 << 20
_BATCH = 1 << 15
_PAGE_BYTES = 1 << 26


def _local(path: str) -> str:
    path = path.removeprefix("file://")
    if "://" in path:
        raise ValueError(f"the records format needs a mounted file system, not {path}; use read_anywhere or ranged")
    return path


def files(path: str) -> list[str]:
    """The record files of a folder, in the order of their names; or the file itself."""
    path = _local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(SUFFIX) and not f.startswith(("_", ".")))
    return [path] if os.path.exists(path) else []


def _asked(options: dict[str, str], name: str) -> bool:
    return options.get(name, "false").strip().lower() == "true"


def mapped(path: str, streaming: bool = False) -> RecordFile:
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            raise FormatError("ERR_OUT_OF_BOUNDS", "empty file")
        return RecordFile.open(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)), streaming)


def _batches(f: RecordFile, start: int, stop: int, schema: pa.Schema, base: int = 0, page: int | None = None) -> Iterator[pa.RecordBatch]:
    """``base``: records of the files before; ``page``: pages of those, if ``_page`` is asked for."""
    firsts = np.array([p.first for p in f.pages] if page is not None else [], np.int64)
    for k in range(start, stop, _BATCH):
        b = f.read(k, min(stop, k + _BATCH), schema)
        if base and "_rec" in schema.names:
            at = schema.get_field_index("_rec")
            b = b.set_column(at, schema.field(at), pa.array(range(base + k, base + k + len(b)), pa.int64()))
        if len(firsts) and "_page" in schema.names:
            at = schema.get_field_index("_page")
            b = b.set_column(at, schema.field(at), pa.array(page - 1 + np.searchsorted(firsts, np.arange(k, k + len(b)), "right"), pa.int64()))
        yield b


def _cuts(f: RecordFile, low: int, high: int, step: int) -> list[tuple[int, int]]:
    """Ranges of about ``step`` records that cover ``low`` to ``high``; in a paged file they end where a page does."""
    if f.layout != "paged":
        return [(k, min(high, k + step)) for k in range(low, high, step)]
    out, start = [], low
    for p in f.pages:
        end = min(high, p.first + p.n)
        if end > start and (end - start >= step or end == high):
            out.append((start, end))
            start = end
    return out


@dataclass
class Range(ds.InputPartition):
    path: str
    start: int
    stop: int
    base: int
    page: int | None = None


class RecordReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters: list) -> Iterator:
        """Takes note of bounds on ``_rec``; Spark still applies every filter."""
        for f in filters:
            if getattr(f, "attribute", None) == ("_rec",):
                v, kind = getattr(f, "value", None), type(f).__name__
                if kind == "EqualTo":
                    self.only = {v} if self.only is None else self.only & {v}
                elif kind == "In":
                    self.only = set(v) if self.only is None else self.only & set(v)
                elif kind in ("GreaterThan", "GreaterThanOrEqual"):
                    self.low = max(self.low, v + (kind == "GreaterThan"))
                elif kind in ("LessThan", "LessThanOrEqual"):
                    top = v - (kind == "LessThan")
                    self.high = top if self.high is None else min(self.high, top)
            yield f

    def partitions(self) -> list[Range]:
        step, base, out = int(self.options.get("records_per_partition", _PER_PARTITION)), 0, []
        page = 0 if _asked(self.options, "pages") else None
        for path in files(self.options["path"]):
            f = mapped(path)
            n = f.n
            if self.only is not None:
                out += [Range(path, i - base, i - base + 1, base, page) for i in sorted(self.only) if base <= i < base + n and i >= self.low and (self.high is None or i <= self.high)]
            else:
                low, high = max(0, self.low - base), n if self.high is None else min(n, self.high + 1 - base)
                out += [Range(path, a, z, base, page) for a, z in _cuts(f, low, high, step)]
            base += n
            page = None if page is None else page + len(f.pages)
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from _batches(mapped(part.path), part.start, part.stop, to_arrow_schema(self.schema), part.base, part.page)


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class RecordWriter(ds.DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.options, self.overwrite = schema, options, overwrite
        self.job = uuid.uuid4().hex
        os.makedirs(_local(options["path"]), exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        folder, layout, names = _local(self.options["path"]), self.options.get("layout", "row"), []
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        tag = f"batch{int(self.options['batch']):010d}-" if "batch" in self.options else ""

        def temporary() -> str:
            names.append(f"{tag}part-{part:05d}-{len(names):03d}-{self.job}-{attempt}{SUFFIX}")
            return os.path.join(folder, f"_{names[-1]}")

        first = next(batches, None)
        schema = first.schema if first is not None else to_arrow_schema(self.schema)
        every = (b for bs in (([first] if first is not None else []), batches) for b in bs)
        if layout == "row":
            w = encode.RowWriter(schema)
            with open(temporary(), "wb") as f:
                f.write(w.head())
                for b in every:
                    f.write(w.sector(b))
                f.write(w.tail())
        elif layout == "paged":
            w, size = encode.PageWriter(schema), int(self.options.get("page_records", 4096))
            with open(temporary(), "wb") as f:
                f.write(w.head())
                for b in _pages(every, size):
                    f.write(w.page(b))
                f.write(w.tail())
        elif layout == "columnar":
            most = int(self.options.get("records_per_file", _PER_FILE))
            for held in _full(every, most):
                with open(temporary(), "wb") as f:
                    f.write(encode.encode_columns(held, schema))
        elif layout == "compact":
            pooled = {c.strip() for c in self.options.get("pooled", "").split(",") if c.strip()}
            for held in _full(every, _PER_FILE):  # the pool of a file comes before its records
                values = {v for b in held for c in sorted(pooled & set(schema.names)) for v in b.column(c).unique().to_pylist() if v is not None}
                w = encode.CompactWriter(schema, sorted(values), pooled)
                with open(temporary(), "wb") as f:
                    f.write(w.head())
                    for b in held:
                        f.write(w.sector(b))
                    f.write(w.tail())
        else:
            raise ValueError("layout: row, compact, columnar or paged")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        folder = _local(self.options["path"])
        kept = {n for m in messages if m for n in m.names}
        before = [os.path.basename(f) for f in files(self.options["path"])]
        for name in sorted(kept):
            os.replace(os.path.join(folder, f"_{name}"), os.path.join(folder, name))
        tag = f"batch{int(self.options['batch']):010d}-" if "batch" in self.options else None
        for old in before:
            if self.overwrite or (tag and old.startswith(tag)):
                os.remove(os.path.join(folder, old))
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Removes what attempts of this job have left that didn't count."""
        folder = _local(self.options["path"])
        for name in os.listdir(folder):
            if name.startswith("_") and f"-{self.job}-" in name:
                os.remove(os.path.join(folder, name))


def _full(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, ``most`` rows at a time; one empty list if there are none."""
    held, n, any_yet = [], 0, False
    for b in batches:
        while len(b):
            take = b.slice(0, most - n)
            held.append(take)
            n, b = n + len(take), b.slice(len(take))
            if n == most:
                yield held
                held, n, any_yet = [], 0, True
    if held or not any_yet:
        yield held


def _pages(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut anew, ``most`` rows each but the last; fewer where those, from several batches, would take more than
    ``_PAGE_BYTES``."""
    held, n, size = [], 0, 0
    for b in batches:
        while len(b):
            take = b.slice(0, most - n)
            if n == most or held and size + take.nbytes > _PAGE_BYTES:
                yield pa.concat_batches(held)
                held, n, size, take = [], 0, 0, b.slice(0, most)
            held.append(take)
            n, size, b = n + len(take), size + take.nbytes, b.slice(len(take))
    if held:
        yield pa.concat_batches(held)


@dataclass
class Arrived(ds.InputPartition):
    path: str
    start: int
    stop: int


class RecordStream(ds.DataSourceStreamReader):
    """Offsets are numbers of whole records by file name; a page counts when it is whole. Files that haven't changed since
    the last look aren't opened again."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.known: dict[str, tuple[int, int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path in files(self.path):
            now = os.stat(path)
            size, changed, n = self.known.get(path, (-1, -1, 0))
            if (size, changed) != (now.st_size, now.st_mtime_ns):
                n = mapped(path, streaming=True).n if now.st_size >= 32 else 0
                self.known[path] = (now.st_size, now.st_mtime_ns, n)
            out[os.path.basename(path)] = n
        return out

    def partitions(self, start: dict, end: dict) -> list[Arrived]:
        out = []
        for path in files(self.path):
            name = os.path.basename(path)
            low, high = start.get(name, 0), end.get(name, 0)
            if high > low:
                out += [Arrived(path, a, z) for a, z in _cuts(mapped(path, streaming=True), low, high, _PER_PARTITION)]
        return out

    def read(self, part: Arrived) -> Iterator[pa.RecordBatch]:
        yield from _batches(mapped(part.path, streaming=True), part.start, part.stop, to_arrow_schema(self.schema))

    def commit(self, end: dict) -> None:
        pass


class RecordSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> StructType:
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        schema = wider_schema([mapped(name, streaming=True).arrow_schema() for name in found])
        if wanted := [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]:
            schema = pa.schema([schema.field(c) for c in ["_rec", *wanted] if c in schema.names])
        if _asked(self.options, "pages"):
            if "_page" in schema.names:
                raise ValueError("the files have a key _page; read without the option pages")
            schema = schema.insert(1, pa.field("_page", pa.int64()))
        return from_arrow_schema(schema)

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(schema, dict(self.options), overwrite)

    def streamReader(self, schema: StructType) -> RecordStream:
        return RecordStream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and turns on the filter pushdown that its reader needs there."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: its layout, records, pages, keys, type marks, and whether it is sealed. Only heads and tails are
    touched."""
    rows = []
    for name in files(path):
        f = mapped(name, streaming=True)
        rows.append((name, f.layout, f.n, len(f.pages), f.keys, "".join(map(chr, f.sigils)), f.sealed))
    return spark.createDataFrame(rows, "file string, layout string, records long, pages int, keys array<string>, marks string, sealed boolean")


def pread(path: str, start: int, stop: int) -> bytes:
    """Bytes of a file on a mounted file system: the plainest fetcher."""
    with open(_local(path), "rb") as f:
        return os.pread(f.fileno(), stop - start, start)


def ranged(spark: SparkSession, sizes: dict[str, int], fetch: Callable[[str, int, int], bytes] = pread, columns: list[str] | None = None, *, records_per_partition: int = _PER_PARTITION) -> DataFrame:
    """Files that ``fetch(path, start, stop)`` gives byte ranges of, from any store. ``sizes``: their sizes in bytes. Only
    head and tail are read to plan; a task then fetches the bytes of its records and columns. ``_rec`` counts through the
    files in their order. In row layout lists and nested records are told from the first ``_BATCH`` records."""
    opened = {path: RangedFile.open(lambda a, z, path=path: fetch(path, a, z), size) for path, size in sizes.items()}
    schema = wider_schema([f.arrow_schema(_BATCH) for f in opened.values()]) if opened else pa.schema([("_rec", pa.int64())])
    if columns:
        schema = pa.schema([schema.field(c) for c in ["_rec", *columns] if c in schema.names])
    plan, base = [], 0
    for path, f in opened.items():
        plan += [(path, sizes[path], a, z, base) for a, z in _cuts(f.file, 0, f.file.n, records_per_partition)]
        base += f.file.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start, stop, base in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                f = RangedFile.open(lambda a, z, path=path: fetch(path, a, z), size)
                for k in range(start, stop, _BATCH):
                    f.need(k, min(stop, k + _BATCH), schema.names)
                    yield from _batches(f.file, k, min(stop, k + _BATCH), schema, base)

    planned = spark.createDataFrame(plan, "path string, size long, start long, stop long, base long")
    return planned.repartition(max(1, len(plan)), "path", "start").mapInArrow(run, from_arrow_schema(schema))


def counted(spark: SparkSession, path: str) -> DataFrame:
    """``n``, the number of records, from heads and tails alone, many files at a time."""
    names = files(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([mapped(name).n for name in b.column(0).to_pylist()], pa.int64())], names=["n"])

    listed = spark.createDataFrame([(name,) for name in names], "file string").repartition(max(1, len(names) // 64))
    return listed.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def read_anywhere(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Files on any file system that Spark reads, whole (each under 2 GB), one a task. ``_rec`` counts within a file,
    which ``_file`` names. The schema is that of all files."""
    whole = spark.read.format("binaryFile").load(path)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [RecordFile.open(memoryview(c.as_buffer())).arrow_schema().serialize().to_pybytes() for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["path", "kinds"])

    found = whole.select("path", "content").mapInArrow(kinds, "path string, kinds binary").groupBy("kinds").agg(F.min("path").alias("path")).orderBy("path").collect()
    schema = wider_schema([pa.ipc.read_schema(pa.py_buffer(bytes(r["kinds"]))) for r in found])
    if columns:
        schema = pa.schema([schema.field(c) for c in ["_rec", *columns] if c in schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                f = RecordFile.open(memoryview(content.as_buffer()))
                for rows in _batches(f, 0, f.n, schema):
                    yield rows.append_column("_file", pa.array([name.as_py()] * len(rows), pa.string()))

    return whole.select("path", "content").mapInArrow(run, from_arrow_schema(schema.append(pa.field("_file", pa.string()))))
