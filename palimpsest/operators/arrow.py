"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, about: what a worker has as Python objects at a time. A longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_BYTES`` and a row, whatever the length of texts; a smaller bound that
    the session has stays. Workers are used again by other tasks, so each gives free memory back at its end."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    had = conf.get(name).lower().rstrip("b")
    if not (had.isdigit() and 0 < int(had) <= BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(bounded, schema)


def _give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
