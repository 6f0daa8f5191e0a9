"""Token vectors by skip-gram with hierarchical softmax, where every two places of a roster are a pair.

The loss of a pair depends on its two tokens alone, so a task counts the pairs
of its rosters and steps on counts: a batch costs its pairs once, in counting,
and its distinct (token, tree node) cells per step.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.functions.vectors import mean_vector

#: Pairs laid out at once, cells of a count held as a plain array, and cells that move together.
PAIRS, CELLS, TOGETHER = 1 << 19, 1 << 22, 1 << 17
#: AdaGrad steps on a batch's counts, and their size.
STEPS, RATE = 8, 0.1


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner nodes on the way to every token (-1 behind its end), and whether the way turns right there."""
    size = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above, right = np.zeros(2 * size, np.int64), np.zeros(2 * size, bool)
    for node in range(size, 2 * size - 1):
        (a, left), (b, other) = heapq.heappop(heap), heapq.heappop(heap)
        above[left] = above[other] = node
        right[other] = True
        heapq.heappush(heap, (a + b, node))
    nodes, turns, at = [], [], np.arange(size)
    while size > 1 and (at < 2 * size - 2).any():
        inside = at < 2 * size - 2
        nodes.append(np.where(inside, above[at] - size, -1))
        turns.append(right[at] & inside)
        at = np.where(inside, above[at], at)
    if not nodes:
        return np.zeros((size, 0), np.int64), np.zeros((size, 0), bool)
    return np.stack(nodes, axis=1), np.stack(turns, axis=1)


def _added(key: np.ndarray, size: int, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys below ``size`` in order, and the sums of their weights."""
    if size <= CELLS:
        sums = [np.bincount(key, w, size) for w in weights]
        kept = np.flatnonzero(sums[0])
        return kept, *[s[kept] for s in sums]
    kept, place = np.unique(key, return_inverse=True)
    return kept, *[np.bincount(place, w, len(kept)) for w in weights]


def counted_pairs(ids: np.ndarray, lengths: np.ndarray, size: int):
    """(token, other token, n) of all ordered pairs of different places of a roster; counts that fit ``CELLS`` come at once."""
    roster = np.repeat(np.arange(len(lengths)), lengths)
    entry, many = np.unique(roster * size + ids, return_counts=True)
    roster, token = entry // size, entry % size
    width = np.bincount(roster, minlength=len(lengths))
    first, each = (np.cumsum(width) - width)[roster], width[roster]
    before = np.cumsum(each) - each
    total = np.zeros(size * size) if size * size <= CELLS else None
    start = 0
    while start < len(entry):
        end = max(start + 1, int(np.searchsorted(before, before[start] + PAIRS, "right")) - 1)
        end = len(entry) if before[-1] + each[-1] <= before[start] + PAIRS else end
        left = np.repeat(np.arange(start, end), each[start:end])
        right = np.arange(len(left)) + (first[start:end] - before[start:end]).repeat(each[start:end]) + before[start]
        n = many[left] * many[right] - np.where(left == right, many[left], 0)
        key = token[left] * size + token[right]
        if total is None:
            kept, n = _added(key[n > 0], size * size, n[n > 0])
            yield kept // size, kept % size, n
        else:
            total += np.bincount(key, n, size * size)
        start = end
    if total is not None:
        kept = np.flatnonzero(total)
        yield kept // size, kept % size, total[kept]


class Tables:
    """Vectors of tokens and of tree nodes, with what AdaGrad remembers and how many pairs moved each row."""

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray):
        self.values = [vectors.copy(), nodes.copy()]
        self.squares = [np.zeros_like(v) for v in self.values]
        self.moved = [np.zeros(len(v)) for v in self.values]

    def learn(self, token: np.ndarray, other: np.ndarray, n: np.ndarray, paths: np.ndarray, turns: np.ndarray) -> None:
        """Steps on counted pairs: at the nodes on the way to ``other``, ``token`` foretells the turn."""
        width = len(self.values[1])
        row, level = np.nonzero(paths[other] >= 0)
        key = token[row] * width + paths[other[row], level]
        key, visits, lefts = _added(key, len(self.values[0]) * width, n[row], n[row] * ~turns[other[row], level])
        for start in range(0, len(key), TOGETHER):
            part = slice(start, start + TOGETHER)
            rows = key[part] // width, key[part] % width
            self._steps(rows, visits[part].astype(np.float32), lefts[part].astype(np.float32))

    def _steps(self, rows: tuple[np.ndarray, np.ndarray], visits: np.ndarray, lefts: np.ndarray) -> None:
        groups = []
        for table, row in enumerate(rows):
            order = np.argsort(row, kind="stable")
            touched, start = np.unique(row[order], return_index=True)
            weight = np.add.reduceat(visits[order], start)
            self.moved[table][touched] += weight
            groups.append((order, touched, start, weight[:, None]))
        for _ in range(STEPS):
            held = [v[row] for v, row in zip(self.values, rows)]
            miss = lefts - visits / (1 + np.exp(-np.einsum("ij,ij->i", *held)))
            for table, (order, touched, start, weight) in enumerate(groups):
                slope = np.add.reduceat(held[1 - table][order] * miss[order, None], start, axis=0) / weight
                self.squares[table][touched] += slope * slope
                self.values[table][touched] += RATE * slope / np.sqrt(self.squares[table][touched] + 1e-8)


def _ids(column: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens' numbers, how many each row has, and how many tokens it has in all."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(column.flatten(), value_set=names, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return at[at >= 0], np.bincount(row[at >= 0], minlength=len(sizes)), sizes


def fit_tokens(
    sentences: DataFrame, size: int, seed: int, min_count: int, iterations: int, partitions: int
) -> tuple[pa.Array, np.ndarray]:
    """Tokens of ``sentences`` (tokens) in order of frequency, and their vectors.

    In an iteration every task learns from the current vectors on its rosters;
    a row's new value is the mean over the tasks that moved it, by pairs.
    """
    counts = sentences.select(F.explode("tokens").alias("token")).where("token IS NOT NULL").groupBy("token").count()
    known = sorted(((r[0], r[1]) for r in counts.where(F.col("count") >= min_count).collect()), key=lambda x: (-x[1], x[0]))
    names = pa.array([t for t, _ in known], pa.string())
    paths, turns = huffman(np.array([n for _, n in known], np.int64))
    rng = np.random.default_rng(seed)
    now = [((rng.random((len(known), size)) - 0.5) / size).astype(np.float32), np.zeros((max(0, len(known) - 1), size), np.float32)]
    spread = sentences.select("tokens").coalesce(partitions)  # rosters lie by hash: nothing is gained by moving them
    for _ in range(iterations if len(known) > 1 else 0):

        def task(batches):
            tables = Tables(*now)
            for batch in batches:
                ids, lengths, _ = _ids(batch.column(0), names)
                for pairs in counted_pairs(ids, lengths, len(names)):
                    tables.learn(*pairs, paths, turns)
            for table, (values, moved) in enumerate(zip(tables.values, tables.moved)):
                at = np.flatnonzero(moved)
                ends = pa.array(np.arange(0, len(at) * size + 1, size), pa.int32())
                vec = pa.ListArray.from_arrays(ends, pa.array(values[at].ravel().astype(np.float64)))
                yield pa.record_batch(
                    [pa.array(np.full(len(at), table, np.int32)), pa.array(at), pa.array(moved[at]), vec], names=["kind", "id", "weight", "vec"]
                )

        moved = spread.mapInArrow(task, "kind int, id long, weight double, vec array<double>")
        for r in moved.groupBy("kind", "id").agg(mean_vector(F.col("vec"), F.col("weight")).alias("vec")).collect():
            now[r["kind"]][r["id"]] = r["vec"]
    return names, now[0]


def mean_of_tokens(sentences: DataFrame, names: pa.Array, vectors: np.ndarray, keep_tokens: bool = False) -> DataFrame:
    """(roster_id, embedding, tokens if kept): sum of the known tokens' vectors by the number of tokens."""
    kept = ["roster_id", *(["tokens"] if keep_tokens else [])]

    def task(batches):
        for batch in batches:
            at, known, sizes = _ids(batch.column("tokens"), names)
            out = np.zeros((len(sizes), vectors.shape[1]))
            some = np.flatnonzero(known)
            if len(some):
                out[some] = np.add.reduceat(vectors[at].astype(np.float64), (np.cumsum(known) - known)[some], axis=0)
                out[some] /= sizes[some, None]
            ends = pa.array(np.arange(0, out.size + 1, vectors.shape[1]), pa.int32())
            embedding = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in kept), embedding], names=[*kept, "embedding"])

    fields = ", ".join(f"{c} {sentences.schema[c].dataType.simpleString()}" for c in kept)
    return sentences.select("roster_id", "tokens").mapInArrow(task, f"{fields}, embedding array<double>")
