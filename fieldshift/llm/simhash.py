"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together. Two fingerprints
within ``RADIUS`` bits differ, in at least one part i, in at most t_i bits,
whenever the thresholds add up to ``RADIUS - parts + 1``. Parts may have
unequal thresholds, and -1 leaves a part out. For each number of parts a
dynamic program picks the thresholds of least estimated cost: rows to probe
plus candidate pairs, the latter from the part distances seen in a bounded
sample of pairs; the cheapest number of parts wins. Whatever is picked, every
link is found: the estimate only moves the cost.

Distinct fingerprints are indexed under their part values and probe all
values within the part's threshold; what meets is verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.components import components
from fieldshift.llm.runs import Forest, grouped, lagged, whole
from fieldshift.llm.shingle_sets import LEAST, SEED, node, shingles, similar
from fieldshift.llm.tables import as_bytes, mapped, stage

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Fingerprints in the driver's sample, 8 bytes each.
SAMPLE = 4096
PARTS = (2, 3, 4)
#: Cost of a shuffled row in compared pairs.
ROW_COST = 50.0


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: lower-cased words, n-word shingles with repeats; without words zero."""
    values = shingles(text, n, seed)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(values), 4096):
        octets = values[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(values)).tolist())


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, n) for t in part.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("t"))
    return mapped(keyed, "t", fn, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Equal parts grown greedily: each next bit is the one most correlated with the part so far."""
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).sum(axis=0))
    corr = np.abs(centred.T @ centred) / np.maximum(np.outer(scale, scale), 1e-9)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [free.pop(0)]
        while len(own) < size:
            best = max(free, key=lambda b: (corr[own, b].sum(), -b))
            free.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``total`` of least cost; costs[i, t + 1] is part i's cost at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                option = (cost + row[t + 1], [*chosen, t])
                if used + t not in following or option < following[used + t]:
                    following[used + t] = option
        best = following
    return best[total]


def _variants(width: int, t: int) -> list[int]:
    """Masks of at most t set bits among ``width``."""
    return [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)]


def plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, from sampled fingerprints of n in all."""
    bits = _bits(sample) if len(sample) else np.zeros((1, BITS), np.uint8)
    half = max(1, len(bits) // 2)
    differ = bits[:half] != bits[-half:]
    best = None
    for m in PARTS:
        parts = correlated_parts(bits.astype(float), m)
        costs = np.zeros((m, radius + 2))
        for i, part in enumerate(parts):
            distance = differ[:, part].sum(axis=1)
            for t in range(radius + 1):
                probes = len(_variants(len(part), t)) + (t > 0)
                # unseen collisions count as if the part's bits were even and independent
                chance = max((distance <= t).mean(), probes * 2.0 ** -len(part))
                costs[i, t + 1] = n * ROW_COST * probes + chance * n * n / 2
        cost, chosen = allocate(costs, radius - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(part, t) for part, t in zip(parts, chosen) if t >= 0])
    return best[1]


def _take(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits as a number."""
    out = np.zeros(len(values), np.uint64)
    for i, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def probes(batch: pa.RecordBatch, parts: list[tuple[list[int], int]]) -> pa.RecordBatch:
    """part, value, fp, probing: each fingerprint under its own and the probed values."""
    fp = batch.column(0).to_numpy()
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for i, (bits, t) in enumerate(parts):
        own = _take(fp.view(np.uint64), bits)
        for mask in _variants(len(bits), t):
            for c, v in zip(columns, (np.full(len(fp), i, np.int32), (own ^ np.uint64(mask)).view(np.int64), fp, np.full(len(fp), mask != 0))):
                c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["part", "value", "fp", "probing"])


def _verified(batches, radius: int):
    """Edges of a spanning forest of the links met in each batch of whole groups."""
    for batch in whole(batches):
        names = batch.schema.names
        get = lambda c: batch.column(names.index(c)).to_numpy(zero_copy_only=False)
        group, fp, block, same, probing = get("__g"), get("fp"), get("__b"), get("__same"), get("probing")
        forest = Forest(len(fp))
        for a, b in lagged(group):
            # own against own or probing; own x own inside a part's value is the threshold 0
            fits = ~(probing[a] & probing[b]) & (same[a] | (block[a] != block[b]))
            a, b = a[fits], b[fits]
            near = np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)) <= radius
            forest.link(a[near], b[near])
        u, v = forest.edges(fp)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect the same fingerprints as all links do; input: distinct fp."""
    n = distinct.count()
    rows = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    parts = plan(np.array([r["fp"] for r in rows], np.int64).view(np.uint64), n, radius)

    def spread(batches):
        for batch in batches:
            yield probes(batch, parts)

    placed = distinct.select("fp").mapInArrow(spread, "part int, value long, fp long, probing boolean")
    met = grouped(placed, ["part", "value"], "fp")
    return met.mapInArrow(lambda batches: _verified(batches, radius), "u long, v long")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row: documents linked by fingerprints within ``radius`` bits.

    A text without words (null and empty included) has the fingerprint zero, linked like any other.
    component_id is the smallest doc_id reachable; a null doc_id takes part and is never the smallest.
    """
    prints = stage(fingerprints(docs, n), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, radius)).select(F.col("u").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, n: int = 5, least: float = LEAST) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id (null last), of repeated ids the least text hash.

    Texts meet by their fingerprints, within ``RADIUS`` bits; an exact check keeps the links with a similarity of ``least``
    or more in their n-word shingles, and shingle keys add the links of that similarity whose fingerprints lie further apart.
    Texts without words are one group.
    A row is told by doc_id and text: rows with a null or repeated doc_id go only as copies of another row.
    """
    met = near_duplicates(docs.select(node().alias("doc_id"), "text"), n)
    met = met.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).where("u != v").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first")
    placed = similar(docs, n, least, met).groupBy("component").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.node").alias("__kept"))
    rows = docs.withColumn("__node", node())
    kept = rows.join(placed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__kept")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__node"]).drop("__node")
