"""Arrow batches in pieces of bounded text, so that a worker holds little of a batch as Python objects at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text taken together; a longer text is a piece of its own, and whole.
PIECE_BYTES = 1_000_000


#: Rows of an Arrow batch, where the session keeps Spark's default of 10,000: rows hold whole texts.
ROWS, _ROWS_CONF, _DEFAULT_ROWS = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Send texts to workers in smaller Arrow batches than Spark's default, unless the session has a size of its own."""
    if spark.conf.get(_ROWS_CONF, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS_CONF, str(ROWS))


def give_back() -> None:
    """Return what a task has freed to the system: a worker that waits for its next task would hold it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in pieces of at most `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            reached = ends[begin] - sizes[begin] + most
            stop = max(begin + 1, int(np.searchsorted(ends, reached, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
    give_back()
