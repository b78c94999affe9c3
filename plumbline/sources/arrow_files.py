"""Tables of Arrow IPC files as a format of Spark's own: batch and stream, read and written.

``spark.read.format("arrow_files").load(folder)`` and ``df.write.format("arrow_files").mode("append").save(folder)``,
after ``register(spark)``. Arrow files are what feature stores and training code exchange, and
Spark has no reader for them.

A folder holds data files and ``_commits``, one small JSON file for each finished write, numbered
from 1. Only files that a commit names are ever read.

- **Writing**: each task writes files under names of its own and reports them with their rows and
  with the least and greatest value of each column. The job's commit then makes them visible at
  once. A task that fails removes its file; what a lost executor leaves behind is in no commit, so
  a task that runs again leaves no second copy. An aborted job removes what its tasks reported.
  Streams are written with ``writer`` (a name of the stream): the commit of a batch that was
  committed before is dropped, so a repeated batch counts once. One writer at a time commits; two that meet are
  noticed, and the later one takes the next number.
- **Reading**: a partition is a run of record batches of one file, of about ``partition_bytes``. The
  option ``columns`` (names with commas) reads these only.
- **Filters** reach the reader through ``scan``, as the format ``arrow_files_pushed``: ``=``, ``<``, ``<=``, ``>``, ``>=``,
  ``IN``, ``IS [NOT] NULL`` and the negation of these leave out files by the committed values and rows by Arrow's
  kernels; all others Spark applies. Spark 4.1 keeps the filters of a loaded relation's last plan, and a
  second query over the same DataFrame would get its rows. So ``scan`` takes the conditions itself and loads anew
  for each call, and the plain format, whose DataFrames may be used again, pushes nothing.
- **Streaming**: the offset is the commit's number; a batch takes in all commits since the last one.

``overwrite`` writes a commit that replaces all before it; streams go on with the files of the new commit.
Paths are opened through Arrow's file systems. Types are those Arrow and Spark share.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, WriterCommitMessage)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME, PUSHED = "arrow_files", "arrow_files_pushed"
PARTITION_BYTES = 64 << 20
#: Most rows of a written record batch; a task reads one at least.
BATCH_ROWS = 64 << 10
FILE_BYTES = 256 << 20

_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


# ---- commits ---------------------------------------------------------------

def commits(folder: str) -> list[int]:
    """Numbers of the finished writes, in order."""
    system, root = opened(folder)
    found = system.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def commit_of(folder: str, number: int) -> dict:
    system, root = opened(folder)
    with system.open_input_stream(f"{root}/_commits/{number:010d}.json", compression=None) as f:
        return json.loads(f.read())


def live(folder: str) -> list[dict]:
    """The commits that a reader sees: those from the last one on that replaced all before."""
    out: list[dict] = []
    for number in reversed(commits(folder)):
        out.append(commit_of(folder, number))
        if out[-1]["replaces"]:
            break
    return out[::-1]


def add_commit(folder: str, schema: pa.Schema, files: list[dict], replaces: bool = False, writer: str | None = None, batch: int | None = None) -> int:
    """Make files visible at once; the number of the commit, 0 if the writer's batch is there already."""
    system, root = opened(folder)
    system.create_dir(f"{root}/_commits", recursive=True)
    mark = uuid4().hex
    while True:
        known = commits(folder)
        if writer is not None and any(c["writer"] == writer and c["batch"] == batch for c in map(lambda n: commit_of(folder, n), known)):
            return 0
        number = (known[-1] if known else 0) + 1
        body = {"mark": mark, "replaces": replaces, "writer": writer, "batch": batch, "schema": schema.serialize().to_pybytes().hex(), "files": files}
        draft = f"{root}/_commits/.{mark}"
        with system.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps(body).encode())
        if system.get_file_info(f"{root}/_commits/{number:010d}.json").type != fs.FileType.NotFound:
            continue
        system.move(draft, f"{root}/_commits/{number:010d}.json")
        if commit_of(folder, number)["mark"] == mark:
            return number


def schema_of(commit: dict) -> pa.Schema:
    return pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(commit["schema"])))


def told(value):
    """A least or greatest value as JSON, or None where there is no order to use."""
    if isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else {"float": value.hex()}
    if isinstance(value, Decimal):
        return {"decimal": str(value)}
    if isinstance(value, datetime):
        return {"time": value.isoformat()}
    if isinstance(value, date):
        return {"date": value.isoformat()}
    return None


def untold(value):
    if not isinstance(value, dict):
        return value
    kind, text = next(iter(value.items()))
    return {"float": float.fromhex, "decimal": Decimal, "time": datetime.fromisoformat, "date": date.fromisoformat}[kind](text)


# ---- filters ---------------------------------------------------------------

def usable(f: Filter, schema: pa.Schema) -> bool:
    """Filters on whole columns whose meaning Arrow and Spark share; NaN has an order in Spark alone, so floats are left to Spark."""
    if isinstance(f, Not):
        return not isinstance(f.child, Not) and usable(f.child, schema)
    if not isinstance(f, (*_COMPARE, In, IsNull, IsNotNull)) or len(f.attribute) != 1 or f.attribute[0] not in schema.names:
        return False
    kind = schema.field(f.attribute[0]).type
    if isinstance(f, (IsNull, IsNotNull)):
        return True
    return not (pa.types.is_floating(kind) or pa.types.is_nested(kind))


def rows_that(f: Filter, batch: pa.RecordBatch) -> pa.Array:
    """True where the filter holds; false and null where it doesn't."""
    if isinstance(f, Not):
        return pc.invert(rows_that(f.child, batch))
    column = batch.column(f.attribute[0])
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        values = [v for v in f.value if v is not None]
        found = pc.is_in(column, pa.array(values, column.type))
        # a null, in the column or in the list, leaves it open
        unknown = pc.or_(pc.is_null(column), pc.and_(pc.invert(found), pa.scalar(len(values) < len(f.value))))
        return pc.if_else(unknown, pa.scalar(None, pa.bool_()), found)
    return _COMPARE[type(f)](column, pa.scalar(f.value, column.type))


def may_hold(f: Filter, file: dict) -> bool:
    """Whether a file can have rows for which the filter holds."""
    if isinstance(f, Not) or f.attribute[0] not in file["columns"]:
        return True
    c = file["columns"][f.attribute[0]]
    low, high = untold(c["min"]), untold(c["max"])
    if isinstance(f, IsNull):
        return c["nulls"] > 0
    if c["nulls"] == file["rows"]:
        return False
    if isinstance(f, IsNotNull) or low is None or high is None:
        return True
    try:
        if isinstance(f, In):
            return any(v is not None and low <= v <= high for v in f.value)
        if isinstance(f, EqualTo):
            return low <= f.value <= high
        return high > f.value if isinstance(f, GreaterThan) else high >= f.value if isinstance(f, GreaterThanOrEqual) else \
            low < f.value if isinstance(f, LessThan) else low <= f.value
    except TypeError:   # values of other types than the file's
        return True


# ---- reading ---------------------------------------------------------------

@dataclass
class Batches(InputPartition):
    """Record batches ``first`` to ``last`` of a file."""
    file: str
    first: int
    last: int

    def __init__(self, file: str, first: int, last: int) -> None:
        self.file, self.first, self.last = file, first, last


def split(folder: str, files: Iterable[dict], partition_bytes: int) -> list[InputPartition]:
    out: list[InputPartition] = []
    for f in files:
        step = max(1, f["batches"] * partition_bytes // max(f["bytes"], 1))
        out += [Batches(f"{folder}/{f['name']}", at, min(at + step, f["batches"]) - 1) for at in range(0, f["batches"], step)]
    return out


def batches_of(part: Batches, schema: pa.Schema, filters: Sequence[Filter] = ()) -> Iterator[pa.RecordBatch]:
    system, path = opened(part.file)
    with system.open_input_file(path) as source:
        wanted = {*schema.names, *(g.attribute[0] for f in filters for g in [f.child if isinstance(f, Not) else f])}
        names = pa.ipc.open_file(source).schema.names
        read = [i for i, n in enumerate(names) if n in wanted]
        with pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=read)) as stored:
            for i in range(part.first, part.last + 1):
                batch = stored.get_batch(i)
                for f in filters:
                    batch = batch.filter(rows_that(f, batch), null_selection_behavior="drop")
                if batch.num_rows:
                    # files of an older schema lack the newer columns
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(n).cast(t) if n in batch.schema.names else pa.nulls(batch.num_rows, t) for n, t in zip(schema.names, schema.types)],
                        schema=schema)


class ArrowReader(DataSourceReader):
    def __init__(self, folder: str, schema: pa.Schema, partition_bytes: int) -> None:
        self.folder, self.schema, self.partition_bytes, self.filters = folder, schema, partition_bytes, []

    def partitions(self) -> Sequence[InputPartition]:
        files = [f for c in live(self.folder) for f in c["files"]]
        kept = [f for f in files if all(may_hold(x, f) for x in self.filters)]
        # a table without a file still needs a partition
        return split(self.folder, kept, self.partition_bytes) or [Batches("", 0, -1)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from batches_of(partition, self.schema, self.filters)


class PushedReader(ArrowReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if usable(f, self.schema):
                self.filters.append(f)
            else:
                yield f


class ArrowStreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: pa.Schema, partition_bytes: int) -> None:
        self.folder, self.schema, self.partition_bytes = folder, schema, partition_bytes

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": (commits(self.folder) or [0])[-1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        numbers = [n for n in commits(self.folder) if start["commit"] < n <= end["commit"]]
        return split(self.folder, [f for n in numbers for f in commit_of(self.folder, n)["files"]], self.partition_bytes)

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition, self.schema)


# ---- writing ---------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    files: list


class _Ranges:
    """Least and greatest value and nulls of each column of a file."""

    def __init__(self, schema: pa.Schema) -> None:
        self.columns = {f.name: {"min": None, "max": None, "nulls": 0} for f in schema}
        self.ordered = {f.name for f in schema if pa.types.is_integer(f.type) or pa.types.is_string(f.type) or pa.types.is_date(f.type)
                        or pa.types.is_timestamp(f.type) or pa.types.is_decimal(f.type)}

    def add(self, batch: pa.RecordBatch) -> None:
        for name, seen in self.columns.items():
            column = batch.column(name)
            seen["nulls"] += column.null_count
            if name in self.ordered and column.null_count < len(column):
                low, high = (pc.min(column).as_py(), pc.max(column).as_py())
                seen["min"] = low if seen["min"] is None else min(low, seen["min"])
                seen["max"] = high if seen["max"] is None else max(high, seen["max"])

    def as_json(self) -> dict:
        return {n: {"min": told(c["min"]), "max": told(c["max"]), "nulls": c["nulls"]} for n, c in self.columns.items()}


def store(folder: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch], file_bytes: int = FILE_BYTES) -> list[dict]:
    """Write batches as files with names of their own; what is known of each. If it fails, no file stays."""
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    done: list[dict] = []
    out = sink = None

    def close() -> None:
        nonlocal out
        out.close()
        sink.close()
        info["bytes"], info["columns"] = system.get_file_info(f"{root}/{info['name']}").size, ranges.as_json()
        out = None

    try:
        for arrived in batches:
            for at in range(0, arrived.num_rows, BATCH_ROWS):
                batch = pa.RecordBatch.from_arrays([arrived.column(n).cast(t) for n, t in zip(schema.names, schema.types)], schema=schema).slice(at, BATCH_ROWS)
                if out is None:
                    context = TaskContext.get()
                    info = {"name": f"part-{context.partitionId() if context else 0:05d}-{uuid4().hex}.arrow", "rows": 0, "batches": 0, "bytes": 0}
                    done.append(info)
                    ranges, sink = _Ranges(schema), system.open_output_stream(f"{root}/{info['name']}", compression=None)
                    out = pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(batch)
                ranges.add(batch)
                info["rows"] += batch.num_rows
                info["batches"] += 1
                if sink.tell() >= file_bytes:
                    close()
        if out is not None:
            close()
    except BaseException:
        if sink is not None and not sink.closed:
            sink.close()
        remove(folder, done)
        raise
    return done


def remove(folder: str, files: list[dict]) -> None:
    system, root = opened(folder)
    for f in files:
        if system.get_file_info(f"{root}/{f['name']}").type != fs.FileType.NotFound:
            system.delete_file(f"{root}/{f['name']}")


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: pa.Schema, overwrite: bool, file_bytes: int) -> None:
        self.folder, self.schema, self.overwrite, self.file_bytes = folder, schema, overwrite, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return Written(store(self.folder, self.schema, iterator, self.file_bytes))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        add_commit(self.folder, self.schema, [f for m in messages if m for f in m.files], self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        remove(self.folder, [f for m in messages if m for f in m.files])


class ArrowStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str, schema: pa.Schema, writer: str, file_bytes: int) -> None:
        self.folder, self.schema, self.writer, self.file_bytes = folder, schema, writer, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return Written(store(self.folder, self.schema, iterator, self.file_bytes))

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files = [f for m in messages if m for f in m.files]
        if not add_commit(self.folder, self.schema, files, False, self.writer, batchId):
            remove(self.folder, files)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        remove(self.folder, [f for m in messages if m for f in m.files])


class ArrowFiles(DataSource):
    """The format; its option ``path`` is the folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _option(self, name: str, default=None):
        # option names keep or lose their case on the way
        return next((v for k, v in self.options.items() if k.lower() == name), default)

    def _folder(self) -> str:
        return self._option("path").rstrip("/")

    def _number(self, name: str, default: int) -> int:
        return int(self._option(name, default))

    def schema(self) -> StructType:
        known = commits(self._folder())
        if not known:
            raise ValueError(f"no table of Arrow files in {self._folder()}")
        whole = from_arrow_schema(schema_of(commit_of(self._folder(), known[-1])), prefer_timestamp_ntz=True)
        names = [c.strip() for c in self._option("columns", "").split(",") if c.strip()]
        return StructType([whole[n] for n in names]) if names else whole

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self._folder(), to_arrow_schema(schema), self._number("partition_bytes", PARTITION_BYTES))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ArrowStreamReader(self._folder(), to_arrow_schema(schema), self._number("partition_bytes", PARTITION_BYTES))

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self._folder(), to_arrow_schema(schema), overwrite, self._number("file_bytes", FILE_BYTES))

    def streamWriter(self, schema: StructType, overwrite: bool) -> ArrowStreamWriter:
        writer = self._option("writer")
        if not writer:
            raise ValueError("a stream names itself in the option 'writer', so that a repeated batch is known")
        return ArrowStreamWriter(self._folder(), to_arrow_schema(schema), writer, self._number("file_bytes", FILE_BYTES))


class PushedArrowFiles(ArrowFiles):
    """The same with filters pushed to its reader; for relations that one query reads, see ``scan``."""

    @classmethod
    def name(cls) -> str:
        return PUSHED

    def reader(self, schema: StructType) -> DataSourceReader:
        return PushedReader(self._folder(), to_arrow_schema(schema), self._number("partition_bytes", PARTITION_BYTES))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let Spark hand filters to those that take them."""
    spark.dataSource.register(ArrowFiles)
    spark.dataSource.register(PushedArrowFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, folder: str, condition: Column | str, columns: Sequence[str] = (), **options) -> DataFrame:
    """The rows for which the condition holds; what can be pushed is. The columns must include those of the condition."""
    reader = spark.read.format(PUSHED).options(**options)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(folder).where(condition)
