"""Arrow and numpy helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that one numpy step looks at; bounds a task's memory
STEP_BYTES = 1 << 21


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that other columns, whatever their names, stay out of the way; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_pieces(text: Column, between: str) -> Column:
    """How many pieces a text has between separators, without the empty one at either end."""
    none = lambda piece: F.when(piece == "", 1).otherwise(0)
    return let(
        F.split(text, between),
        lambda a: F.size(a) - none(F.get(a, F.lit(0))) - F.when(F.size(a) > 1, none(F.get(a, F.size(a) - 1))).otherwise(0),
    ).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of about `limit` bytes in `column`, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column without nulls as one array of bytes and the n + 1 offsets of its values."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.empty(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers are reused, and an idle one keeps what it once needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mixed(values: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value (a bijection)."""
    z = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def ranges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal neighbours."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    bounds = np.concatenate([[0], cut, [len(values)]]) if len(values) else np.zeros(1, np.int64)
    return bounds[:-1], bounds[1:]
