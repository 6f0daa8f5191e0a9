"""Shared helpers of the corpus operators: reading, staging, word slicing.

A word is a run of bytes other than space and 0x09-0x0D. ``bytes.split()``
splits on exactly these, so texts travel to Python as UTF-8 binary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldshift.session import stage

__all__ = ["read", "stage", "as_bytes", "pieces", "binary", "mapped", "partitions"]

#: Bytes of text that one slice hands to a batch function.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each.

    One text is never cut: a longer one makes a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary array over one buffer: value i takes the next ``lengths[i]`` bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a slice holds over 2 GB")
    buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(lengths), buffers)


def mapped(
    df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = SLICE_BYTES
) -> DataFrame:
    """``fn`` over slices of bounded text size, in every partition."""

    def run(batches):
        for part in pieces(batches, column, limit):
            yield fn(part)

    return df.mapInArrow(run, schema)
