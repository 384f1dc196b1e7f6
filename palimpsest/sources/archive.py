"""Exports as a data source of Spark's: ``spark.read.format("page_archive")``, ``df.write.format("page_archive")``, and as a sink of streams.

An archive is a folder of gzipped JSON lines. A task writes a file of its own; only when all tasks are done, a manifest names the
files that count, with the least and the largest of each file's key (option ``key``). Readers follow manifests, so a write that
fails, or an attempt that was repeated, leaves nothing that is seen; on abort its files are deleted. A file is a partition of the
read; a filter on the key leaves out files that cannot have it before any is opened. A stream's batch has a manifest of its own
number, so a batch that is written again replaces itself.

Columns are strings, whole numbers, doubles, booleans, and arrays and structs of these."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

NAME = "page_archive"
_PLAIN = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageArchive)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _put(path: str, name: str, data: bytes) -> None:
    store, at = _store(path)
    store.create_dir(f"{at}/{name}".rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{at}/{name}", compression=None) as f:
        f.write(data)


def _get(path: str, name: str) -> bytes:
    store, at = _store(path)
    with store.open_input_stream(f"{at}/{name}", compression=None) as f:
        return f.read()


def _names(path: str, folder: str) -> list[str]:
    from pyarrow import fs

    store, at = _store(path)
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(f"{at}/{folder}", allow_not_found=True)) if x.is_file)


def _delete(path: str, name: str) -> None:
    store, at = _store(path)
    if _there(path, name):
        store.delete_file(f"{at}/{name}")


def _there(path: str, name: str) -> bool:
    from pyarrow import fs

    store, at = _store(path)
    return store.get_file_info(f"{at}/{name}").type == fs.FileType.File


def _checked(kind: T.DataType) -> None:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            _checked(f.dataType)
    elif isinstance(kind, T.ArrayType):
        _checked(kind.elementType)
    elif not isinstance(kind, _PLAIN):
        raise ValueError(f"an archive has no columns of {kind.simpleString()}")


def _value(x, kind: T.DataType):
    """A JSON value as a value of Spark's."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_value(x.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_value(y, kind.elementType) for y in x]
    return float(x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(_get(self.options["path"], "schema.json")))

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, self.options.get("key"), overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], schema, self.options.get("key"))


@dataclass
class File(InputPartition):
    name: str


@dataclass
class Done(WriterCommitMessage):
    name: str | None
    rows: int
    low: object
    high: object


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.kinds, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1:
                self.filters.append(f)
            yield f  # files are left out by it; rows are still filtered by Spark

    def partitions(self) -> list[File]:
        out = []
        for name in _names(self.path, "manifests"):
            manifest = json.loads(_get(self.path, f"manifests/{name}"))
            out += [File(f["name"]) for f in manifest["files"] if self._may_have(manifest["key"], f["low"], f["high"])]
        return out

    def _may_have(self, key: str | None, low, high) -> bool:
        for f in self.filters:
            if f.attribute[0] != key or low is None:
                continue
            v = f.value
            if isinstance(f, In):
                if not any(x is not None and low <= x <= high for x in v):
                    return False
            elif (isinstance(f, EqualTo) and not low <= v <= high) or (isinstance(f, GreaterThan) and high <= v) or (isinstance(f, GreaterThanOrEqual) and high < v) or (isinstance(f, LessThan) and low >= v) or (isinstance(f, LessThanOrEqual) and low > v):
                return False
        return True

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file has what is asked for
            return
        store, at = _store(self.path)
        with store.open_input_stream(f"{at}/files/{partition.name}", compression=None) as raw, gzip.open(raw, "rt", encoding="utf-8", errors="surrogatepass") as lines:
            for line in lines:
                yield _value(json.loads(line), self.kinds)


class _Writing:
    """What batch and stream writers share: a task's file, and what is left of tasks that failed."""

    def __init__(self, path: str, schema: T.StructType, key: str | None):
        _checked(schema)
        if key is not None and (key not in schema.names or not isinstance(schema[key].dataType, (T.LongType, T.IntegerType, T.StringType))):
            raise ValueError(f"no column {key} of whole numbers or strings")
        self.path, self.kinds, self.key = path, schema, key

    def write(self, rows: Iterator) -> Done:
        from pyspark import TaskContext

        name, n, low, high = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.jsonl.gz", 0, None, None
        store, at = _store(self.path)
        store.create_dir(f"{at}/files", recursive=True)
        with store.open_output_stream(f"{at}/files/{name}", compression=None) as raw, gzip.open(raw, "wt", encoding="utf-8", errors="surrogatepass", newline="\n") as out:
            for row in rows:
                own = row.asDict(recursive=True)
                out.write(json.dumps(own, ensure_ascii=False) + "\n")
                k = own[self.key] if self.key else None
                if k is not None:
                    low, high = (k, k) if low is None else (min(low, k), max(high, k))
                n += 1
        if not n:
            _delete(self.path, f"files/{name}")
        return Done(name if n else None, n, low, high)

    def _manifest(self, name: str, messages: list[Done | None]) -> None:
        files = [{"name": m.name, "rows": m.rows, "low": m.low, "high": m.high} for m in messages if m is not None and m.name]
        if not _there(self.path, "schema.json"):
            _put(self.path, "schema.json", self.kinds.json().encode())
        _put(self.path, f"manifests/{name}.json", json.dumps({"key": self.key, "files": files}).encode())

    def _drop(self, messages: list[Done | None]) -> None:
        for m in messages:
            if m is not None and m.name:
                _delete(self.path, f"files/{m.name}")


class Writer(_Writing, DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, key: str | None, overwrite: bool):
        super().__init__(path, schema, key)
        self.overwrite = overwrite

    def commit(self, messages: list[Done | None]) -> None:
        before = _names(self.path, "manifests") if self.overwrite else []
        self._manifest(f"write-{uuid.uuid4().hex}", messages)
        for name in before:
            old = json.loads(_get(self.path, f"manifests/{name}"))
            _delete(self.path, f"manifests/{name}")
            for f in old["files"]:
                _delete(self.path, f"files/{f['name']}")

    def abort(self, messages: list[Done | None]) -> None:
        self._drop(messages)


class StreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages: list[Done | None], batchId: int) -> None:
        self._manifest(f"batch-{batchId:09d}", messages)

    def abort(self, messages: list[Done | None], batchId: int) -> None:
        self._drop(messages)
