"""Pairs of texts with a shingle similarity (Jaccard, distinct shingles) of ``LEAST`` or more.

Candidates meet under ``BANDS`` keys, each made of ``ROWS`` minimal shingle
hashes: a pair of similarity s meets with probability 1 - (1 - s^ROWS)^BANDS,
0.9978 at 0.8, 0.99998 at 0.85. Keys join texts to candidate groups by forest edges,
so no pairs are written; inside a group every pair not linked already is
compared by its whole shingle sets, so each link is exact. Groups over
``BLOCK`` texts are cut into pairs of blocks.

SimHash fingerprints within op7's radius miss most of these pairs (see the README): the pairs
that they find are compared here too, and the keys add the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.components import components
from fieldshift.llm.runs import Forest, grouped, starts_of, whole
from fieldshift.llm.tables import as_bytes, mapped, pieces, stage

LEAST = 0.8
ROWS, BANDS = 7, 26
SEED = 42
BLOCK = 1024
#: Shingles hashed at once, so that they stay in the cache.
PORTION = 1 << 15
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS, ROWS), np.uint64, endpoint=False)
FLIPS, FACTORS = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingles(text: bytes, n: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the n-word shingles of the lower-cased words, with repeats; a text of up to n words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    body = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(body, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.r_[0, ends[:-n]].tolist()
    return np.array([xxhash.xxh64_intdigest(body[a:b], seed) for a, b in zip(begin, (ends[n - 1 :] - 1).tolist())], np.uint64)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Distinct shingle hashes in order; a text without words has the one member zero."""
    values = np.unique(shingles(text, n))
    return values if len(values) else np.zeros(1, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """``BANDS`` keys of each (non-empty) set."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    size = np.cumsum([len(s) for s in sets]) // PORTION
    bounds = starts_of(size)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        flat = np.concatenate(sets[low:high])
        start = np.cumsum([0] + [len(s) for s in sets[low : high - 1]])
        for band in range(BANDS):
            key = np.full(high - low, band, np.uint64)
            for flip, factor in zip(FLIPS[band], FACTORS[band]):
                least = np.minimum.reduceat((flat ^ flip) * factor, start)
                key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[low:high, band] = key
    return out


def node():
    """Number of a text; equal texts are one node."""
    return F.xxhash64(as_bytes())


def _linked(sets: list[np.ndarray], block: np.ndarray, same: bool, forest: Forest, first: int, least: float) -> None:
    """Link all pairs of a run with similarity ``least`` or more, but pairs that are connected already."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    mark = np.zeros(int(flat.max()) + 1, bool)
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        fits = forest.root[first + j] != forest.root[first + i]
        fits &= np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
        if not same:
            fits &= block[j] != block[i]
        j = j[fits]
        if not len(j):
            continue
        own = flat[start[i] : start[i + 1]]
        mark[own] = True
        members = np.concatenate([flat[start[k] : start[k + 1]] for k in j.tolist()])
        shared = np.add.reduceat(mark[members].astype(np.int64), np.r_[0, np.cumsum(size[j])[:-1]])
        mark[own] = False
        j = j[shared >= least * (size[i] + size[j] - shared) - 1e-9]
        forest.link(np.full(len(j), first + i), first + j)


def _verified(batches, least: float):
    """Edges of a spanning forest of the links in each batch of whole groups."""
    for batch in whole(batches):
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        group, ids, block, same = get("__g"), get("node"), get("__b"), get("__same")
        members = batch.column(batch.schema.get_field_index("members"))
        forest = Forest(len(ids))
        bounds = starts_of(group).tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in members.slice(a, b - a)]
            _linked(sets, block[a:b], bool(same[a]), forest, a, least)
        u, v = forest.edges(ids)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def similar(docs: DataFrame, n: int, least: float = LEAST, also: DataFrame | None = None) -> DataFrame:
    """doc_id, node, component of every row: texts linked by a similarity of ``least`` or more share a component.

    ``also`` holds further pairs of nodes (u, v) to compare, as found by fingerprints.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keyed(part: pa.RecordBatch) -> pa.RecordBatch:
        keys = band_keys([shingle_set(t, n) for t in part.column(2).to_pylist()]).view(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), keys], ["doc_id", "node", "keys"])

    rows = docs.select("doc_id", node().alias("node"), as_bytes().alias("t"))
    rows = stage(mapped(rows, "t", keyed, f"doc_id {kind}, node long, keys array<long>"), "band_keys")
    placed = rows.select("node", F.explode("keys").alias("key")).distinct()
    ends = placed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v != w").drop("w")
    met = placed.join(ends.hint("merge"), "key").select(F.col("node").alias("u"), "v")
    if also is not None:
        met = met.unionByName(also.select("u", "v"))
    candidates = stage(components(met).select(F.col("u").alias("node"), "root"), "candidates")

    def listed(batches):
        for part in pieces(batches, "t"):
            sets = [shingle_set(t, n).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "members"])

    texts = docs.select(node().alias("node"), as_bytes().alias("t")).join(candidates.select("node"), "node")
    sets = texts.groupBy("node").agg(F.first("t").alias("t")).mapInArrow(listed, "node long, members binary")
    edges = grouped(candidates, ["root"], "node", BLOCK, sets).mapInArrow(lambda b: _verified(b, least), "u long, v long")
    roots = components(edges).select(F.col("u").alias("node"), "root")
    return rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("component"))
