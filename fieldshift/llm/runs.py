"""Rows of one key brought together: hot keys split into pairs of blocks, runs streamed whole.

All pairs within a key are compared where the rows meet, never emitted. A key
with more than ``size`` rows is cut into blocks by a hash of the row, and every
pair of blocks becomes a group of its own, so a task holds at most two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def grouped(rows: DataFrame, keys: Sequence[str], row_id: str, size: int = BLOCK, attach: DataFrame | None = None) -> DataFrame:
    """Rows sorted by group within partitions; ``__g`` is the group, ``__b`` tells its two blocks apart.

    Groups of one row are left out: they hold no pair. Of a hot key, block i
    meets block j >= i once; pairs inside block i are only wanted where i = j
    (``__same``). ``attach`` adds columns by row once single rows are gone.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / size).cast("int")
    own = F.pmod(F.xxhash64(row_id, F.lit(17)), F.col("__k")).cast("int")
    spread = (
        # a row per key: never small enough to send around, whatever the planner guesses
        rows.join(counts.hint("merge"), list(keys))
        .withColumn("__k", blocks)
        .withColumn("__own", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
        .withColumn("__i", F.least("__own", "__other"))
        .withColumn("__j", F.greatest("__own", "__other"))
        .withColumn("__g", F.xxhash64(*keys, "__i", "__j"))
        .withColumn("__b", (F.col("__own") == F.col("__j")).cast("int"))
        .withColumn("__same", F.col("__i") == F.col("__j"))
        .drop("__n", "__k", "__own", "__other", "__i", "__j")
    )
    if attach is not None:
        spread = spread.join(attach, row_id)
    return spread.repartition("__g").sortWithinPartitions("__g", row_id)


def whole(batches, column: str = "__g") -> Iterator[pa.RecordBatch]:
    """Batches of a sorted partition, recut so that no run of ``column`` is divided."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        start = int(np.flatnonzero(key == key[-1])[0])
        if start:
            held.append(batch.slice(0, start))
            yield joined()
            held = [batch.slice(start)]
        elif held and held[-1].column(batch.schema.get_field_index(column))[-1].as_py() != key[0]:
            yield joined()
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield joined()


def starts_of(key: np.ndarray) -> np.ndarray:
    """First places of the runs of a sorted key, and its length."""
    return np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, int)


def lagged(key: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of all pairs within runs of a sorted key, in portions of at most about ``limit``."""
    length = np.diff(starts_of(key))
    left = np.repeat(starts_of(key)[1:], length) - np.arange(len(key)) - 1
    order = np.flatnonzero(left > 0)
    lag = 1
    while len(order):
        for i in range(0, len(order), limit):
            part = order[i : i + limit]
            yield part, part + lag
        lag += 1
        order = order[left[order] >= lag]


class Forest:
    """Components of the rows of a batch, by place; the smallest place is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the rows a[i] and b[i]; links inside a known component cost no loop."""
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(self.root, high, low)
            while (up := self.root[self.root])[self.root != up].size:
                self.root = up

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, id of its root) of every row that is linked to another."""
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return ids[at], ids[self.root[at]]
