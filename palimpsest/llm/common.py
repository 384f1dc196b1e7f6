"""What the corpus operators share: lineage cuts, scratch folders, skew-proof joins, Arrow row plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrow import BATCH_BYTES, in_arrow
from ..operators.joins import HOT_SHARE, fresh, lookup
from ..operators.state import cut, scratch, shared_dir

__all__ = ["BATCH_BYTES", "HOT_SHARE", "WORD", "crc_bucket", "cut", "file_system", "fresh", "in_arrow", "lookup", "map_rows", "scratch", "shared_dir", "tasks"]

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return. ``bytes.split()``,
#: ``bytes.strip()`` use exactly these; ``bytes.lower()`` folds exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"


def file_system(path: str):
    """(pyarrow file system, path in it), for code that runs on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def crc_bucket(column: str, buckets: int) -> Column:
    """crc32 of the value as text, modulo ``buckets``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Enough partitions that each holds about ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[list[list]], Iterator[list[list]]]]) -> DataFrame:
    """``in_arrow`` over lists: ``make()`` runs once a task and returns a function from one batch's columns (Python
    lists, in order) to any number of batches of output columns (lists or arrays). The function may have ``finish()``, for what is left."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        pack = lambda cols: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)
        for batch in batches:
            if batch.num_rows:
                for out in f([c.to_pylist() for c in batch.columns]):
                    yield pack(out)
        if hasattr(f, "finish"):
            for out in f.finish():
                yield pack(out)

    return in_arrow(df.select(*columns), run, schema)
