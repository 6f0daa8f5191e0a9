"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

Unit vectors are turned by ``S3 H S2 H S1 H`` (random signs, Walsh-Hadamard
transforms); the hash is the signed axis nearest to the turned vector. A table
concatenates k such hashes. Each vector is stored under its own bucket and
probes the k buckets in which one hash takes its second-nearest axis. Pairs that
meet are verified by cosine in double precision.

k grows with the number of vectors so that buckets stay small, and the number
of tables is the least whose recall on simulated pairs at exactly the threshold
reaches ``recall``; both depend on the vectors' number and dimension only.

Equal vectors are one class. A pair of classes met in several buckets counts
in the first of them, which both sides can tell from their codes; so tasks emit
counts and a spanning forest per group, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.components import components
from fieldshift.llm.runs import Forest, grouped, lagged, whole
from fieldshift.llm.tables import stage

THRESHOLD = 0.9
RECALL = 0.99
BUCKET = 64
MAX_TABLES = 64
SIMULATED = 2000


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (length a power of two), scaled to keep norms."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


class Tables:
    """``n`` tables of k cross-polytope hashes for vectors of one dimension."""

    def __init__(self, dim: int, k: int, n: int, seed: int = 11):
        self.k, self.n = k, n
        self.width = 1 << max(1, (dim - 1).bit_length())
        signs = np.random.default_rng([seed, dim]).integers(0, 2, (MAX_TABLES * 8, 3, self.width)) * 2.0 - 1
        self.signs = signs[: n * k].reshape(n, k, 3, self.width)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + k): own bucket, then the probed ones."""
        padded = np.zeros((len(x), self.width))
        padded[:, : x.shape[1]] = x
        rows = np.arange(len(x))
        out = np.zeros((len(x), self.n, 1 + self.k), np.int64)
        for t in range(self.n):
            axes = np.zeros((2, self.k, len(x)), np.int64)
            for j in range(self.k):
                turned = padded
                for s in self.signs[t, j]:
                    turned = transform(turned * s)
                size = np.abs(turned)
                for nearest in range(2):
                    at = size.argmax(axis=1)
                    axes[nearest, j] = 2 * at + (turned[rows, at] > 0)
                    size[rows, at] = -1
            for p in range(1 + self.k):
                for j in range(self.k):
                    out[:, t, p] = out[:, t, p] * 2 * self.width + axes[int(p == j + 1), j]
        return out


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, tables * (1 + k)^2): where codes of a and b meet, at least one being an own bucket."""
    equal = a[:, :, :, None] == b[:, :, None, :]
    equal[:, :, 1:, 1:] = False
    return equal.reshape(len(a), -1)


def settings(n: int, dim: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hashes per table and tables."""
    width = 1 << max(1, (dim - 1).bit_length())
    k = max(1, math.ceil(math.log(max(n, 2) / BUCKET, 2 * width))) if n > BUCKET else 1
    k = min(k, 8)
    if dim < 2:
        return k, 1
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, SIMULATED, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = threshold * a + math.sqrt(1 - threshold**2) * b
    tables = Tables(dim, k, MAX_TABLES)
    met = meets(tables.codes(a), tables.codes(b)).reshape(SIMULATED, MAX_TABLES, -1).any(axis=2)
    share = np.maximum.accumulate(met, axis=1).mean(axis=0)
    return k, int(np.argmax(share >= recall)) + 1 if share[-1] >= recall else MAX_TABLES


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each dimension among the rows."""
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[offsets[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def _placed(k: int, n: int):
    def fn(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in _matrix(batch.column(1)):
                for i in range(0, len(rows), 2048):
                    part = rows[i : i + 2048]
                    codes = Tables(x.shape[1], k, n).codes(x[i : i + 2048])
                    shape = codes.shape
                    table = np.broadcast_to(np.arange(n)[None, :, None], shape).ravel()
                    probing = np.broadcast_to((np.arange(1 + k) > 0)[None, None, :], shape).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids[part], n * (1 + k))),
                            pa.array(np.full(codes.size, x.shape[1], np.int32)),
                            pa.array(table.astype(np.int32)),
                            pa.array(codes.ravel()),
                            pa.array(probing),
                        ],
                        ["class", "dim", "table", "bucket", "probing"],
                    )

    return fn


def _verified(k: int, n: int, threshold: float):
    """class, root and links of the classes that link within each batch of whole groups."""

    def fn(batches):
        tables: dict[int, Tables] = {}
        for batch in whole(batches):
            names = batch.schema.names
            get = lambda c: batch.column(names.index(c)).to_numpy(zero_copy_only=False)
            group, ids, block, same, probing = get("__g"), get("class"), get("__b"), get("__same"), get("probing")
            table, bucket, copies = get("table"), get("bucket"), get("copies")
            x, dims, codes = {}, np.zeros(len(ids), np.int64), np.zeros((len(ids), n, 1 + k), np.int64)
            coded = np.zeros(len(ids), bool)  # codes are found once for each row that links at all
            for rows, unit in _matrix(batch.column(names.index("embedding"))):
                dims[rows] = unit.shape[1]
                x[unit.shape[1]] = np.zeros((len(ids), unit.shape[1]))
                x[unit.shape[1]][rows] = unit
            forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
            for a, b in lagged(group, 1 << 15):
                fits = ~(probing[a] & probing[b]) & (same[a] | (block[a] != block[b]))
                a, b = a[fits], b[fits]
                for d, unit in x.items():
                    own = dims[a] == d
                    p, q = a[own], b[own]
                    near = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                    p, q = p[near], q[near]
                    if not len(p):
                        continue
                    forest.link(p, q)
                    new = np.unique(np.r_[p, q])
                    new = new[~coded[new]]
                    if len(new):
                        tables.setdefault(d, Tables(d, k, n))
                        codes[new], coded[new] = tables[d].codes(unit[new]), True
                    first = meets(codes[p], codes[q]).argmax(axis=1)
                    at, slot = first // (1 + k) ** 2, first % (1 + k) ** 2 // (1 + k)
                    here = (at == table[p]) & (codes[p, at, slot] == bucket[p])
                    np.add.at(links, p[here], copies[q[here]])
                    np.add.at(links, q[here], copies[p[here]])
            rows = np.flatnonzero((links > 0) | (forest.root != np.arange(len(ids))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(ids[forest.root[rows]]), pa.array(links[rows])], ["u", "v", "links"]
            )

    return fn


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Null, zero and non-finite vectors link with nothing; only vectors of one length are
    compared. Repeated rows are vectors of their own that link with each other.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("ok", usable(F.col("embedding")))
    classes = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("class", F.xxhash64("embedding")), "classes")
    seen = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    k, n = settings(seen["n"], seen["dim"] or 1, threshold, recall)
    placed = classes.select("class", "embedding").mapInArrow(
        _placed(k, n), "class long, dim int, table int, bucket long, probing boolean"
    )
    met = grouped(placed, ["dim", "table", "bucket"], "class", attach=classes.select("class", "embedding", "copies"))
    found = stage(met.mapInArrow(_verified(k, n, threshold), "u long, v long, links long"), "links")
    counts = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "class")
    roots = components(found).withColumnRenamed("u", "class")
    named = (
        classes.select("class", "first", "copies", "embedding")
        .join(counts, "class", "left")
        .join(roots, "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("embedding", "copies", "links", "component_id", F.lit(True).alias("ok"))
    out = rows.join(named, ["ok", "embedding"], "left")
    return out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
