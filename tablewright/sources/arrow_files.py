"""Data source ``arrow_files``: Arrow IPC files of both framings, split by record batches.

Without an index a file is cut into ranges of bytes, and a task reads the batches that
begin in its range; it finds them by walking over the messages without their bodies.
With the table that :func:`index_arrow_files` writes, the places are known beforehand,
and filters on the data skip batches by their least and greatest values. Either way the
driver lists the files and opens one, for the schema. Batches go to Spark one at a time, so
a file need not fit in memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from tablewright.functions.batches import pieces
from tablewright.sources.arrow_messages import BATCH, Message, batches_of, messages

SPLIT_BYTES = 64 << 20
# Parts that all files together are cut into, about; ranges grow beyond ``split_bytes`` where there would be more.
MOST_PARTS = 2000
POSITION = ["_file", "_batch", "_row"]
DAMAGE = "_damage"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
# Files looked at for a schema where damaged ones are reported.
SCHEMA_FILES = 20

INDEX_SCHEMA = (
    "path string, size long, mtime long, kind int, batch long, offset long, bytes long, rows long, "
    "bounds map<string,string>"
)
# Characters of a text that the index holds of a least or greatest value.
BOUND_CHARACTERS = 64


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Listed:
    """A file as the driver sees it without opening it."""

    path: str
    inner: str
    size: int
    mtime: int  # milliseconds


def _listed(path: str, info: fs.FileInfo) -> Listed:
    return Listed(path, info.path, info.size or 0, (info.mtime_ns or 0) // 1_000_000)


def inner_of(path: str) -> str:
    """The path as its file system has it, read off the text alone."""
    if path.startswith("file:"):
        return re.sub("^file:/*", "/", path)
    if "://" not in path:
        return path
    parts = urlsplit(path)
    return parts.path if parts.scheme in ("hdfs", "viewfs") else parts.netloc + parts.path


def _expand(paths: list[str]) -> list[Listed]:
    """Files as themselves, folders as their ``.arrow`` files at any depth."""
    if not paths:
        return []
    system = locate(paths[0])[0]
    infos = system.get_file_info([inner_of(p) for p in paths])
    found = []
    for path, info in zip(paths, infos, strict=True):
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            found.append(_listed(path, info))
            continue
        root, inner = path.rstrip("/"), inner_of(path).rstrip("/")
        below = system.get_file_info(fs.FileSelector(inner, recursive=True))
        arrow = [i for i in below if i.type == fs.FileType.File and i.path.endswith(".arrow")]
        found += sorted((_listed(root + i.path[len(inner) :], i) for i in arrow), key=lambda f: f.path)
    return found


@contextmanager
def _open(path: str) -> Iterator[pa.NativeFile]:
    system, inner = locate(path)
    with system.open_input_file(inner) as source:
        yield source


def _schema_of(path: str) -> pa.Schema:
    with _open(path) as source:
        first = next(messages(source))
        return pa.ipc.open_stream(pa.BufferReader(_bytes(source, first))).schema


def _bytes(source: pa.NativeFile, message: Message) -> bytes:
    source.seek(message.offset)
    return source.read(message.size)


def _plain(schema: pa.Schema) -> pa.Schema:
    """Dictionary-encoded columns as the columns they stand for."""
    return pa.schema([f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in schema])


@dataclass
class Part(InputPartition):
    """Batches of one file: those that begin in ``ranges``, (low, high, number of the first batch or None).

    ``before`` has the places of the schema and the dictionaries where they are known.
    """

    file: Listed
    ranges: list[tuple[int, int, int | None]]
    before: list[tuple[int, int]] | None = None
    folder: str = ""


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_files").load(path)``, or ``option("paths", <JSON list>)`` for several.

    Further options: ``position`` = true adds ``_file``, ``_batch`` and ``_row`` in the batch.
    ``folder`` = a name adds a column with the first folder below ``root`` that a file lies in;
    filters on it skip files. ``index`` is the folder of an index. ``damaged`` = report adds ``_damage``:
    a file or batch that cannot be read gives one row with the reason there and nulls in the data,
    instead of an error.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    @cached_property
    def _files(self) -> list[Listed]:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        files = _expand(paths)
        if not files:
            raise FileNotFoundError(", ".join(paths))
        return files

    def _reports(self) -> bool:
        return self.options.get("damaged") == "report"

    def schema(self) -> StructType:
        for number, file in enumerate(self._files, 1):
            try:
                found = from_arrow_schema(_plain(_schema_of(file.path)))
                break
            except (pa.ArrowException, ValueError, OSError, StopIteration) as error:
                if not self._reports() or number in (len(self._files), SCHEMA_FILES):
                    raise ValueError(f"{file.path}: {error or 'no schema'}") from error
        if "folder" in self.options:
            found = found.add(self.options["folder"], "string")
        if self.options.get("position") == "true":
            found = found.add("_file", "string").add("_batch", "long").add("_row", "long")
        return found.add(DAMAGE, "string") if self._reports() else found

    def reader(self, schema: StructType) -> DataSourceReader:
        # Spark refuses readers that take filters where it does not offer them.
        kind = FilteredArrowFilesReader if self.options.get("pushdown") == "true" else ArrowFilesReader
        return kind(self._files, schema, dict(self.options))


class ArrowFilesReader(DataSourceReader):
    def __init__(self, files: list[Listed], schema: StructType, options: dict[str, str]):
        self.files = files
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.folder = options.get("folder")
        self.root = inner_of(options.get("root", "")).rstrip("/")
        self.index = options.get("index")
        self.names = schema.fieldNames()
        self.reports = DAMAGE in self.names
        added = {*POSITION, DAMAGE, self.folder}
        self.columns = [c for c in self.names if c not in added]
        self.types = schema
        self.filters: list[Filter] = []

    # -- planning, on the driver: no file is opened ------------------------

    def _folder_of(self, file: Listed) -> str:
        below = file.inner[len(self.root) + 1 :] if file.inner.startswith(f"{self.root}/") else file.inner
        return below.split("/", 1)[0] if "/" in below else ""

    def partitions(self) -> list[Part]:
        files = [f for f in self.files if not self.folder or self._may_hold(self.folder, [self._folder_of(f)] * 2)]
        self.split_bytes = max(self.split_bytes, -(-sum(f.size for f in files) // MOST_PARTS))
        known = self._known(files) if self.index else {}
        parts = []
        for file in files:
            folder = self._folder_of(file) if self.folder else ""
            if file.inner in known:
                parts += [Part(file, ranges, known[file.inner].before, folder) for ranges in known[file.inner].parts]
            else:
                lows = range(0, max(file.size, 1), self.split_bytes)
                parts += [Part(file, [(low, low + self.split_bytes, None)], None, folder) for low in lows]
        # Spark wants a partition, if only an empty one
        return parts or [Part(self.files[0], [])]

    def _known(self, files: list[Listed]) -> dict[str, _Plan]:
        """What is to be read of the indexed files, from a scan of the index that skips by the filters."""
        system, inner = locate(self.index)
        if system.get_file_info(inner).type == fs.FileType.NotFound:
            return {}
        wanted = {(f.inner, f.size, f.mtime) for f in files}
        columns = ["path", "size", "mtime", "kind", "batch", "offset", "bytes"]
        columns += ["bounds"] if self.filters else []
        plans: dict[str, _Plan] = {}
        places: dict[str, str] = {}
        table = ds.dataset(inner, filesystem=system, format="parquet")
        for chunk in table.to_batches(columns=columns):
            for row in zip(*(chunk.column(c).to_pylist() for c in columns), strict=True):
                place = places.get(row[0]) or places.setdefault(row[0], inner_of(row[0]))
                if (place, *row[1:3]) not in wanted:
                    continue
                kind, batch, offset, size = row[3:7]
                bounds = dict(row[7] or ()) if self.filters else {}
                held = {c: json.loads(text) for c, text in bounds.items()}
                keeps = all(self._may_hold(c, values) for c, values in held.items())
                plans.setdefault(place, _Plan(self.split_bytes)).add(kind, batch, offset, size, keeps)
        return plans

    def _may_hold(self, column: str, bounds: list) -> bool:
        """Whether values between the bounds can pass the filters on a column; no bounds: there are nulls only."""
        return all(_can_pass(f, bounds) for f in self.filters if f.attribute == (column,))

    # -- reading, in a task ------------------------------------------------

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not self.reports:
            with _open(partition.file.path) as source:
                for number, batch in self._batches(source, partition):
                    yield from self._shown(partition, number, batch)
            return
        known = partition.before is not None
        try:
            with _open(partition.file.path) as source:
                for low, high, number in self._places(source, partition):
                    before = [b for b in partition.before if b[0] < low]
                    try:
                        for batch in batches_of(source, before, low, high):
                            batch.validate(full=True)
                            yield from self._shown(partition, number, batch)
                    except (pa.ArrowException, KeyError, ValueError, OSError) as error:
                        yield self._damage(partition, number, error)
        except (pa.ArrowException, ValueError, OSError, StopIteration) as error:
            # later tasks meet the damage on their way; the one it lies in tells
            at = getattr(error, "at", 0)
            if known or any(low <= at < high for low, high, _ in partition.ranges):
                yield self._damage(partition, None, error)

    def _places(self, source: pa.NativeFile, part: Part) -> Iterator[tuple[int, int, int]]:
        """(low, high, number) of every batch of the part; sets what has to be read before each."""
        if part.before is not None:
            lows = {m.offset: m for m in messages(source, part.file.size) if m.kind == BATCH}
            for low, high, number in part.ranges:
                for k, message in enumerate(m for o, m in lows.items() if low <= o < high):
                    yield message.offset, message.offset + message.size, number + k
            return
        part.before = []
        number = 0
        low, high, _ = part.ranges[0] if part.ranges else (0, 0, None)
        for message in messages(source, part.file.size):
            if message.offset >= high:
                return
            if message.kind != BATCH:
                part.before.append((message.offset, message.size))
                continue
            if message.offset >= low:
                yield message.offset, message.offset + message.size, number
            number += 1

    def _batches(self, source: pa.NativeFile, part: Part) -> Iterator[tuple[int, pa.RecordBatch]]:
        if part.before is None:
            for low, high, number in self._places(source, part):
                for batch in batches_of(source, part.before, low, high):
                    yield number, batch
            return
        for low, high, first in part.ranges:
            yield from enumerate(batches_of(source, [b for b in part.before if b[0] < low], low, high), first)

    def _shown(self, part: Part, number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in pieces of bounded bytes, as what they are written to Spark in is a copy."""
        low = 0
        for piece in pieces([batch]) if batch.num_rows else [batch]:
            n = piece.num_rows
            own = {c: piece.column(c) for c in self.columns}
            own = {c: x.dictionary_decode() if pa.types.is_dictionary(x.type) else x for c, x in own.items()}
            own |= self._place(part, [number] * n, list(range(low, low + n)))
            yield pa.RecordBatch.from_arrays([own[c] for c in self.names], names=self.names)
            low += n

    def _place(self, part: Part, batch: list, row: list, damage: str | None = None) -> dict[str, pa.Array]:
        n = len(row)
        made = {
            "_file": pa.array([part.file.path] * n, pa.string()),
            "_batch": pa.array(batch, pa.int64()),
            "_row": pa.array(row, pa.int64()),
            DAMAGE: pa.array([damage] * n, pa.string()),
        }
        if self.folder:
            made[self.folder] = pa.array([part.folder] * n, pa.string())
        return {c: x for c, x in made.items() if c in self.names}

    def _damage(self, part: Part, number: int | None, error: Exception) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        reason = f"{type(error).__name__}: {str(error) or 'no data'}".splitlines()[0]
        schema = to_arrow_schema(self.types)
        made = self._place(part, [number], [None], reason)
        arrays = [made.get(f.name, pa.nulls(1, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


class FilteredArrowFilesReader(ArrowFilesReader):
    """Skips files and batches by filters; Spark applies them again to the rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.filters = [f for f in filters if isinstance(f, _COMPARISONS)]
        return filters


_COMPARISONS = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def _can_pass(condition: Filter, bounds: list) -> bool:
    """Whether a value between the bounds can meet the condition; unlike kinds of values can."""
    if not bounds:
        return False
    least, greatest = bounds

    def held(value: object) -> bool:
        return least <= value <= greatest

    try:
        match condition:
            case EqualTo(value=value):
                return held(value)
            case In(value=values):
                return any(held(v) for v in values if v is not None)
            case GreaterThan(value=value):
                return greatest > value
            case GreaterThanOrEqual(value=value):
                return greatest >= value
            case LessThan(value=value):
                return least < value
            case _:
                return least <= condition.value
    except TypeError:
        return True


@dataclass
class _Plan:
    """The parts of one indexed file, gathered batch by batch in the file's order."""

    split_bytes: int
    before: list[tuple[int, int]] = field(default_factory=list)
    parts: list[list[tuple[int, int, int]]] = field(default_factory=list)
    _bytes: int = 0
    _last: int = -1

    def add(self, kind: int, batch: int, offset: int, size: int, keeps: bool) -> None:
        if offset <= self._last:  # the file was indexed twice
            return
        self._last = offset
        if kind != BATCH:
            self.before.append((offset, size))
            return
        if not keeps:
            return
        if not self.parts or self._bytes + size > self.split_bytes:
            self.parts.append([])
            self._bytes = 0
        ranges = self.parts[-1]
        # a dictionary between two batches ends a range, as it is read before the next
        if ranges and ranges[-1][1] == offset:
            ranges[-1] = (ranges[-1][0], offset + size, ranges[-1][2])
        else:
            ranges.append((offset, offset + size, batch))
        self._bytes += size


# -- the index ---------------------------------------------------------------


def _bound(value: object, cut: str = "") -> object:
    return value[:BOUND_CHARACTERS] + cut if isinstance(value, str) and len(value) > BOUND_CHARACTERS else value


def _bounds_of(batch: pa.RecordBatch, columns: list[str]) -> dict[str, str]:
    """Least and greatest value of each column as JSON; columns whose values have no plain order are left out."""
    found = {}
    for name in columns:
        if name not in batch.schema.names:
            continue
        column = batch.column(name)
        if pa.types.is_dictionary(column.type):
            column = column.dictionary_decode()
        kind = column.type
        if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_boolean(kind)):
            continue
        if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
            continue
        both = pc.min_max(column).as_py()
        least, greatest = both["min"], both["max"]
        cut = "\U0010ffff"
        if isinstance(greatest, str) and cut in greatest:
            continue
        found[name] = json.dumps([] if least is None else [_bound(least), _bound(greatest, cut)])
    return found


def _index_rows(path: str, size: int, mtime: int, columns: list[str]) -> list[tuple]:
    """A row per message of a file; none where it cannot be followed, so that reading it tells why."""
    rows, before, number = [], [], 0
    try:
        with _open(path) as source:
            for m in messages(source, size):
                bounds = None
                if m.kind == BATCH:
                    if columns:
                        bounds = list(_bounds_of(next(batches_of(source, before, m.offset, m.offset + m.size)), columns).items())
                else:
                    before.append((m.offset, m.size))
                rows.append((path, size, mtime, m.kind, number, m.offset, m.size, m.rows, bounds))
                number += m.kind == BATCH
    except (pa.ArrowException, ValueError, OSError, StopIteration):
        return []
    return rows


def index_arrow_files(
    spark: SparkSession, root: str, index: str, columns: list[str] | None = None, files_per_task: int = 64
) -> DataFrame:
    """Index the ``.arrow`` files below ``root`` in the table at ``index`` and return its rows of these files.

    Files are walked in tasks. Those whose path, size and time are in the table already
    are not opened again. ``columns`` are those whose least and greatest value
    per batch is kept, for which the batches have to be read once.
    """
    columns = list(columns or [])
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.arrow")
        .load(root)
        .select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
    )
    mark = ["path", "size", "mtime"]
    try:
        there = spark.read.schema(INDEX_SCHEMA).parquet(index).select(*mark).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        there = spark.createDataFrame([], "path string, size long, mtime long")
    new = listed.join(there, mark, "left_anti")
    n_new = new.count()
    if n_new:

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fields = pa.schema(
                [("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("kind", pa.int32())]
                + [(c, pa.int64()) for c in ("batch", "offset", "bytes", "rows")]
                + [("bounds", pa.map_(pa.string(), pa.string()))]
            )
            for batch in batches:
                for file in batch.to_pylist():
                    rows = _index_rows(file["path"], file["size"], file["mtime"], columns)
                    if rows:
                        made = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
                        yield pa.RecordBatch.from_arrays(made, schema=fields)

        spread = new.repartition(-(-n_new // files_per_task), "path")
        spread.mapInArrow(walk, INDEX_SCHEMA).write.mode("append").parquet(index)
    elif there.isEmpty():
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).parquet(index).join(listed, mark, "left_semi")
