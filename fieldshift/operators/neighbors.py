"""Exact k nearest neighbours by pruned cells, and approximate ones by random-projection order.

Distinct vectors are packed into blocks of bounded bytes, one row per block,
and searched block against block with one matrix product. What decides which
blocks meet carries ids only.

Exact search: cells around sampled pivots, cut into blocks. A query first
searches its own block, which bounds its k-th distance; then the nearest cells,
which tighten the bound; then only the cells that can still hold something
nearer. Blocks are dealt to groups, and a task searches the blocks of one group
in those of another: a block moves once per group that it meets, not once per
block. Where only some rows are queries, they are dealt to every part of the
rows in blocks and keep their nearest while the part is read: the vectors move once.

Approximate search: each table orders the vectors by a code of random
projections, and a block meets its neighbours in that order, so the work is
linear in the rows and no bucket can grow hot. A table moves the vectors once.
Tables are added until the recall on sampled queries, or on all of those that
are named, searched exactly against all rows, is reached.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.functions.draws import draw, first_k
from fieldshift.functions.vectors import as_double, norm, unit_length
from fieldshift.operators.codebook import BLOCK_CELLS, Centroids, assign_codebook
from fieldshift.session import stage

#: Bytes of vectors in a block, of all pivots, and of the sampled queries of a recall estimate.
BLOCK_BYTES, PIVOT_BYTES, SAMPLE_BYTES = 512 << 10, 32 << 20, 8 << 20
#: Cells a query searches before its bound is tightened.
NEAR_CELLS = 4
#: Bytes of a group of blocks that a task holds, and tasks a core that a search is cut into.
GROUP_BYTES, TASKS = 64 << 20, 4
#: Blocks of queries whose nearest a task holds at a time.
HELD_BLOCKS = 64
SLACK = 1e-9
HITS = "g long, id long, d double"


def l2_normalize(vectors: DataFrame, vec: str = "embedding", out: str = "embedding") -> DataFrame:
    """Unit length; vectors shorter than 1e-8 stay as they are."""
    return vectors.withColumn(out, unit_length(as_double(F.col(vec))))


def _search_space(vectors: DataFrame, key: str, metric: str, queries: Column | None = None) -> DataFrame:
    """(id, v, q): the space in which Euclidean order equals the metric's order.

    For cosine, unit vectors get one more coordinate that is 1 only for zero
    vectors, which puts them at cosine distance 1 from everything else.
    """
    raw = as_double(F.col("embedding"))
    q = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    if metric == "euclidean":
        return vectors.select(F.col(key).alias("id"), raw.alias("v"), q.alias("q"))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    flag = F.when(norm(raw) < 1e-8, F.lit(1.0)).otherwise(F.lit(0.0))
    return vectors.select(F.col(key).alias("id"), F.concat(unit_length(raw), F.array(flag)).alias("v"), q.alias("q"))


@dataclass(frozen=True)
class Groups:
    """The distinct vectors of a table in the search space of a metric."""

    space: DataFrame  # id, v, q, _h: every row, q telling whether it is a query
    groups: DataFrame  # g, v, q, _h: distinct vectors, named by their lowest id
    count: int
    width: int
    queries: int

    @property
    def block_rows(self) -> int:
        return max(1, BLOCK_BYTES // (8 * max(1, self.width)))


def _groups(vectors: DataFrame, key: str, metric: str, queries: Column | None = None) -> Groups:
    space = _search_space(vectors, key, metric, queries).withColumn("_h", F.xxhash64("v"))
    groups = space.groupBy("_h", "v").agg(F.min("id").alias("g"), F.bool_or("q").alias("q"))
    groups = stage(groups.select("g", "v", "q", "_h"), "knn-groups")
    shape = groups.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w"), F.count_if("q").alias("q")).first()
    if not shape["n"]:
        raise ValueError("no vectors to search")
    return Groups(space, groups, shape["n"], shape["w"], shape["q"])


def _packed(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, ids, points): the rows (g, v) of every block in one row, by ascending id."""
    listed = F.sort_array(F.collect_list(F.struct("g", "v")))
    packed = rows.groupBy(*keys).agg(listed.alias("_l"))
    return packed.select(*keys, F.transform("_l", lambda x: x["g"]).alias("ids"), F.flatten(F.transform("_l", lambda x: x["v"])).alias("points"))


def _best(queries: np.ndarray, names: np.ndarray, bounds: np.ndarray, base: np.ndarray, ids: np.ndarray, keep: int):
    """(g, id, d) of the ``keep`` nearest of every query, none beyond its bound."""
    half = np.einsum("ij,ij->i", base, base) / 2.0
    keep = min(keep, len(ids))
    out = []
    step = max(1, BLOCK_CELLS // max(1, len(ids)))
    for top in range(0, len(queries), step):
        part, bound = queries[top : top + step], bounds[top : top + step]
        own = np.einsum("ij,ij->i", part, part)
        # d^2 = own - 2 gain: the nearest gain most
        gain = part @ base.T
        gain -= half
        least, met = (own - bound * bound) / 2.0, None

        def from_least():
            limit = own - 2.0 * least
            return gain >= (least - 0.5e-9 * (1.0 + np.abs(limit) + own))[:, None]

        if np.isfinite(least).all():
            met = from_least()
        if met is None or np.count_nonzero(met) > 4 * keep * len(part):
            at = gain.shape[1] - keep
            least = np.maximum(least, np.partition(gain, at, axis=1)[:, at])
            met = from_least()
        row, col = np.nonzero(met)
        d = np.sqrt(((part[row] - base[col]) ** 2).sum(axis=1))
        order = np.lexsort((ids[col], d, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order = order[(place < keep) & (d[order] <= bound[row[order]])]
        out.append((names[top + row[order]], ids[col[order]], d[order]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _list(column: pa.Array, row: int, kind) -> np.ndarray:
    values = column[row].values
    return np.zeros(0, kind) if values is None else values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _search(keep: int, width: int):
    """Arrow pass over pairs of blocks: (ids, points) of the queries, (ids, points) of each block that they search.

    ``want`` names the queries of the block that search and their bounds; without
    it all do, unbounded.
    """

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            others = [n[len("points") :] for n in col if n.startswith("points_")]
            for i in range(batch.num_rows):
                names = _list(col["ids"], i, np.int64)
                queries = _list(col["points"], i, np.float64).reshape(len(names), width)
                bounds = np.full(len(names), np.inf)
                if "want" in col:
                    wanted = col["want"][i].values
                    at = np.searchsorted(names, wanted.field("g").to_numpy(zero_copy_only=False))
                    bounds = wanted.field("bound").to_numpy(zero_copy_only=False)
                    names, queries = names[at], queries[at]
                ids = np.concatenate([_list(col[f"ids{o}"], i, np.int64) for o in others])
                base = np.concatenate([_list(col[f"points{o}"], i, np.float64) for o in others]).reshape(len(ids), width)
                g, hit, d = _best(queries, names, bounds, base, ids, keep)
                yield pa.record_batch([pa.array(g), pa.array(hit), pa.array(d)], names=["g", "id", "d"])

    return run


def _named(packed: DataFrame, end: str, **keys: str) -> DataFrame:
    return packed.select(*[F.col(c).alias(n) for n, c in keys.items()], F.col("ids").alias(f"ids{end}"), F.col("points").alias(f"points{end}"))


def _top(found: DataFrame, keep: int) -> DataFrame:
    return first_k(found, ["g"], [F.col("d"), F.col("id")], keep)


def _bounds(found: DataFrame, k: int) -> DataFrame:
    """(g, bound): distance of the k-th other vector found so far, infinite with fewer."""
    return _top(found, k + 1).groupBy("g").agg(F.when(F.count(F.lit(1)) > k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))


def _ranked(space: Groups, found: DataFrame, k: int, metric: str) -> DataFrame:
    """Per row of the input its k best, self left out, from the k+1 best distinct vectors of its own.

    A group of copies keeps its k+1 lowest ids: no query can need more of them,
    so nothing is lost, and a hot group of copies stays small.
    """
    named = space.space.join(space.groups.select("_h", "v", "g"), ["_h", "v"]).select("id", "g", "q")
    copies = first_k(named, ["g"], [F.col("id")], k + 1).groupBy("g").agg(F.collect_list("id").alias("_c"))
    nearest = _top(found, k + 1).join(copies.withColumnRenamed("g", "id"), "id").select("g", "d", F.explode("_c").alias("id"))
    lists = _top(nearest, k + 1).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))
    near = F.slice(F.filter("near", lambda s: s["id"] != F.col("id")), 1, k)
    out = named.where("q").join(lists, "g").select("id", F.posexplode(near).alias("pos", "s"))
    distance = F.col("s.d") if metric == "euclidean" else F.col("s.d") * F.col("s.d") / 2.0
    return out.select("id", (F.col("pos") + 1).alias("neighbor_rank"), F.col("s.id").alias("neighbor_id"), distance.alias("distance"))


# --- queries against all rows ---


def _blocked(rows: int):
    """Arrow pass: (ids, points) of blocks of at most ``rows`` vectors (g, v), as they come."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ends = pa.array([0, part.num_rows], pa.int32())
                points = part.column("v").flatten()
                yield pa.record_batch(
                    [pa.ListArray.from_arrays(ends, part.column("g")), pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), points)],
                    names=["ids", "points"],
                )

    return run


def _nearest_held(keep: int, width: int):
    """Arrow pass over (block, ids, points) of queries, each with (ids, points) of a block to search: their nearest in the task."""

    def run(batches):
        held: dict[int, tuple] = {}

        def flush():
            for _, *best in held.values():
                yield pa.record_batch([pa.array(x) for x in best], names=["g", "id", "d"])
            held.clear()

        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                block = col["block"][i].as_py()
                names = _list(col["ids"], i, np.int64)
                queries = _list(col["points"], i, np.float64).reshape(len(names), width)
                ids = _list(col["ids_base"], i, np.int64)
                base = _list(col["points_base"], i, np.float64).reshape(len(ids), width)
                bounds, *before = held.get(block, (np.full(len(names), np.inf), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
                g, hit, d = (np.concatenate(x) for x in zip(before, _best(queries, names, bounds, base, ids, keep)))
                order = np.lexsort((hit, d, g))
                g, hit, d = g[order], hit[order], d[order]
                place = np.arange(len(g)) - np.searchsorted(g, g)
                bounds = np.full(len(names), np.inf)
                last = place == keep - 1
                bounds[np.searchsorted(names, g[last])] = d[last]
                near = place < keep
                if block not in held and len(held) >= HELD_BLOCKS:
                    yield from flush()
                held[block] = (bounds, g[near], hit[near], d[near])
        yield from flush()

    return run


def _scan(rows: DataFrame, queries: DataFrame, n_queries: int, width: int, keep: int) -> DataFrame:
    """(g, id, d): the ``keep`` nearest of all ``rows`` (g, v) to each of ``queries`` (g, v).

    Rows go in blocks to as many parts as a shuffle has partitions, and each part gets every block of queries.
    """
    parts, size = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, BLOCK_BYTES // (8 * max(1, width)))
    base = rows.select("g", "v").mapInArrow(_blocked(size), "ids array<long>, points array<double>")
    base = base.select(F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"), F.col("ids").alias("ids_base"), F.col("points").alias("points_base"))
    blocks = max(1, math.ceil(n_queries / size))
    asked = stage(_packed(queries.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int")), "block"), "knn-queries")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = asked.hint("merge").join(base, "part").select("block", "ids", "points", "ids_base", "points_base")
    return _top(met.mapInArrow(_nearest_held(keep, width), HITS), keep)


def _exact_scan(vectors: DataFrame, queries: Column, k: int, metric: str, key: str) -> DataFrame:
    """(id, neighbor_rank, neighbor_id, distance) of the rows that ``queries`` tells, against all rows."""
    space = _search_space(vectors, key, metric, queries)
    shape = space.agg(F.count_if("q").alias("q"), F.max(F.size("v")).alias("w")).first()
    if shape["w"] is None:
        raise ValueError("no vectors to search")
    # no query needs more than the k+1 lowest ids of a group of copies
    rows = first_k(space.withColumn("_h", F.xxhash64("v")), ["_h", "v"], [F.col("id")], k + 1)
    found = _scan(rows.select(F.col("id").alias("g"), "v"), space.where("q").select(F.col("id").alias("g"), "v"), shape["q"], shape["w"], k + 1)
    near = first_k(found.where(F.col("g") != F.col("id")), ["g"], [F.col("d"), F.col("id")], k, "neighbor_rank")
    distance = F.col("d") if metric == "euclidean" else F.col("d") * F.col("d") / 2.0
    return near.select(F.col("g").alias("id"), "neighbor_rank", F.col("id").alias("neighbor_id"), distance.alias("distance"))


# --- exact ---


def _visits(centres: np.ndarray, reaches: np.ndarray):
    """Arrow pass: (g, cell, block, other, gap, nth) per cell that may hold something within a query's bound."""

    def run(batches):
        for batch in batches:
            height = max(1, BLOCK_CELLS // max(1, len(centres)))
            for top in range(0, batch.num_rows, height):
                part = batch.slice(top, height)
                rows = part.num_rows
                points = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                gap = _gaps(points, centres, reaches)
                own = part.column("cell").to_numpy(zero_copy_only=False)
                gap[np.arange(rows), own] = -1.0  # the own cell before all others
                want = (gap <= bound[:, None] + 1e-6 + SLACK * gap) & (reaches[None, :] >= 0)
                nth = np.empty(gap.shape, np.int32)
                order = np.where(want, gap, np.inf).argsort(axis=1, kind="stable")
                np.put_along_axis(nth, order, np.arange(gap.shape[1], dtype=np.int32)[None, :], axis=1)
                row, other = np.nonzero(want)
                back = pa.array(row)
                yield pa.record_batch(
                    [
                        part.column("g").take(back),
                        part.column("cell").take(back),
                        part.column("block").take(back),
                        pa.array(other.astype(np.int32)),
                        pa.array(gap[row, other]),
                        pa.array(nth[row, other]),
                    ],
                    names=["g", "cell", "block", "other", "gap", "nth"],
                )

    return run


def _pairs(visits: DataFrame, blocks: DataFrame, skip_own: bool = True) -> DataFrame:
    """(cell, block, other, other_block, want): pairs of blocks to search and the queries that do, without vectors."""
    wanted = F.sort_array(F.collect_list(F.struct("g", "bound")))
    grouped = visits.groupBy("cell", "block", "other").agg(wanted.alias("want"))
    searched = blocks.select(F.col("cell").alias("other"), F.col("block").alias("other_block"))
    paired = grouped.join(searched, "other")
    return paired.where((F.col("cell") != F.col("other")) | (F.col("block") != F.col("other_block"))) if skip_own else paired


@dataclass(frozen=True)
class Cells:
    """Vectors in cells around pivots taken from them, cut into blocks."""

    member: DataFrame  # g, v, cell, block
    packed: DataFrame  # cell, block, ids, points
    blocks: DataFrame  # cell, block
    pivots: Centroids
    reaches: np.ndarray  # distance of a cell's farthest member, -1 for none
    width: int


def _in_blocks(placed: DataFrame, shape: DataFrame, rows: int) -> DataFrame:
    """(g, v, cell, block, ...): as many blocks a cell as keep one near ``rows`` rows."""
    count = F.ceil(F.col("_n") / rows).cast("int")
    return placed.join(shape.select("cell", "_n"), "cell").withColumn("block", F.pmod(F.xxhash64("g"), count).cast("int")).drop("_n")


def cells_of(vectors: DataFrame, count: int, width: int, pivots: int | None, seed: int, name: str) -> Cells:
    """Cells of distinct ``vectors`` (g, v), around as many pivots as the root of their count, or as ``PIVOT_BYTES`` hold."""
    rows, most = max(1, BLOCK_BYTES // (8 * max(1, width))), max(1, PIVOT_BYTES // (8 * max(1, width)))
    m = min(pivots or max(1, math.isqrt(count)), count, most)
    picked = vectors.orderBy(draw(seed, F.col("g")), F.col("g")).limit(m).select("v").collect()
    centres = Centroids(np.arange(m, dtype=np.int32), np.array([r["v"] for r in picked], dtype=np.float64))
    placed = stage(assign_codebook(vectors, centres, "v", "cell", "radius"), f"{name}-placed")
    shape = stage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.max("radius").alias("reach")), f"{name}-cells")
    reaches = np.full(m, -1.0)
    for r in shape.select("cell", "reach").collect():  # one row per pivot at most
        reaches[r["cell"]] = r["reach"]
    member = _in_blocks(placed, shape, rows).select("g", "v", "cell", "block")
    packed = stage(_packed(member, "cell", "block"), f"{name}-blocks")
    blocks = stage(packed.select("cell", "block"), f"{name}-block-names")
    return Cells(member, packed, blocks, centres, reaches, width)


VISIT = "g long, cell int, block int, other int, gap double, nth int"


def _gaps(points: np.ndarray, centres: np.ndarray, reaches: np.ndarray) -> np.ndarray:
    """Least distance of anything in a cell around each of ``centres`` to each of ``points``."""
    half = np.einsum("ij,ij->i", centres, centres) / 2.0
    square = np.einsum("ij,ij->i", points, points)[:, None] - 2.0 * (points @ centres.T - half)
    return np.maximum(np.sqrt(np.maximum(square, 0.0)) - reaches[None, :], 0.0)


def _block_visits(centres: np.ndarray, reaches: np.ndarray):
    """Arrow pass over (cell, block, ids, points, bounds): a row per block and cell that may hold something within a query's bound.

    ``g`` is the query with the least ``gap`` to the cell; ``nth`` is the cell's place in the order of
    the query for which it comes first, ``NEAR_CELLS`` if it comes later for all.
    """
    width = centres.shape[1]

    def run(batches):
        height = max(1, BLOCK_CELLS // max(1, len(centres)))
        for batch in batches:
            for i in range(batch.num_rows):
                names, cell = _list(batch.column("ids"), i, np.int64), batch.column("cell")[i].as_py()
                points, bounds = _list(batch.column("points"), i, np.float64).reshape(len(names), width), _list(batch.column("bounds"), i, np.float64)
                gap, g, nth = np.full(len(centres), np.inf), np.zeros(len(centres), np.int64), np.full(len(centres), NEAR_CELLS, np.int32)
                for top in range(0, len(names), height):
                    far = _gaps(points[top : top + height], centres, reaches)
                    far[:, cell] = -1.0  # the own cell before all others
                    far[:, reaches < 0] = np.inf
                    first = np.argsort(far, axis=1, kind="stable")[:, :NEAR_CELLS]
                    far[far > bounds[top : top + height, None] + 1e-6 + SLACK * far] = np.inf
                    row, place = np.nonzero(np.isfinite(np.take_along_axis(far, first, axis=1)))
                    np.minimum.at(nth, first[row, place], place.astype(np.int32))
                    at = far.argmin(axis=0)
                    least = far[at, np.arange(len(centres))]
                    closer = least < gap
                    gap[closer], g[closer] = least[closer], names[top + at[closer]]
                other = np.flatnonzero(np.isfinite(gap))
                block = batch.column("block")[i].as_py()
                yield pa.record_batch(
                    [
                        pa.array(g[other]),
                        pa.array(np.full(len(other), cell, np.int32)),
                        pa.array(np.full(len(other), block, np.int32)),
                        pa.array(other.astype(np.int32)),
                        pa.array(gap[other]),
                        pa.array(nth[other]),
                    ],
                    names=["g", "cell", "block", "other", "gap", "nth"],
                )

    return run


def _group_search(keep: int, centres: np.ndarray, reaches: np.ndarray):
    """Arrow pass over rows of one (qs, bs) after another, blocks to search before those that search: hits within the bounds.

    A query's bound falls to the distance of the last of ``keep`` others found in the task.
    """
    width = centres.shape[1]

    def nearest(names, points, bounds, others, held):
        kept, fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []
        bounds = bounds.copy()

        def merged():
            g, hit, d = (np.concatenate(x) for x in zip(kept, *fresh))
            order = np.lexsort((hit, d, g))
            g, hit, d = g[order], hit[order], d[order]
            place = np.arange(len(g)) - np.searchsorted(g, g)
            last, near = place == keep - 1, place < keep
            at = np.searchsorted(names, g[last])
            bounds[at] = np.minimum(bounds[at], d[last])
            return g[near], hit[near], d[near]

        for other in others:
            cell = other["other"]
            ids, base = held[cell, other["other_block"]]
            gap = _gaps(points, centres[cell : cell + 1], reaches[cell : cell + 1])[:, 0]
            want = np.flatnonzero(gap <= bounds + 1e-6 + SLACK * gap)
            if not len(want):
                continue
            fresh.append(_best(points[want], names[want], bounds[want], base, ids, keep))
            if sum(len(x[0]) for x in fresh) >= keep * len(names):
                kept, fresh = merged(), []
        return merged() if fresh else kept

    def run(batches):
        now, held = None, {}
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                key, at = (tuple(col[c][i].as_py() for c in pair) for pair in (("qs", "bs"), ("cell", "block")))
                if key != now:
                    now, held = key, {}
                names = _list(col["ids"], i, np.int64)
                points = _list(col["points"], i, np.float64).reshape(len(names), width)
                if not col["asks"][i].as_py():
                    held[at] = names, points
                    continue
                best = nearest(names, points, _list(col["bounds"], i, np.float64), col["others"][i].as_py(), held)
                yield pa.record_batch([pa.array(x) for x in best], names=["g", "id", "d"])

    return run


def _exact_found(space: Groups, k: int, pivots: int | None = None, seed: int = 7) -> DataFrame:
    """(g, id, d): the k+1 nearest of every distinct vector, itself among them, and others met on the way."""
    cells = cells_of(space.groups.select("g", "v"), space.count, space.width, pivots, seed, "knn")
    packed, centres, reaches = cells.packed, cells.pivots.matrix, cells.reaches
    lies = cells.member.select("g", "cell", "block")
    size = space.count * space.width * 8
    groups = max(math.ceil(size / GROUP_BYTES), math.isqrt(TASKS * packed.sparkSession.sparkContext.defaultParallelism))

    def group(cell: str, block: str) -> Column:
        return F.pmod(F.xxhash64(cell, block), F.lit(groups)).cast("int")

    def searched(visits: DataFrame, bounded: DataFrame, name: str) -> DataFrame:
        met = visits.join(cells.blocks.select(F.col("cell").alias("other"), F.col("block").alias("other_block")), "other")
        met = met.where((F.col("cell") != F.col("other")) | (F.col("block") != F.col("other_block")))
        met = met.withColumn("qs", group("cell", "block")).withColumn("bs", group("other", "other_block"))
        met = stage(met.select("cell", "block", "other", "other_block", "qs", "bs", "gap"), f"{name}-pairs")
        others = F.sort_array(F.collect_list(F.struct("gap", "other", "other_block"))).alias("others")
        asking = met.groupBy("cell", "block", "qs", "bs").agg(others).join(bounded, ["cell", "block"])
        asked = met.select("qs", "bs", F.col("other").alias("cell"), F.col("other_block").alias("block")).distinct().join(packed, ["cell", "block"])
        rows = asking.withColumn("asks", F.lit(True)).unionByName(asked.withColumn("asks", F.lit(False)), allowMissingColumns=True)
        dealt = rows.repartition(groups * groups, "qs", "bs").sortWithinPartitions("qs", "bs", "asks", "cell", "block")
        dealt = dealt.select("qs", "bs", "asks", "cell", "block", "ids", "points", "bounds", "others")
        return stage(dealt.mapInArrow(_group_search(k, centres, reaches), HITS), name)

    def visited(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        listed = F.transform(F.sort_array(F.collect_list(F.struct("g", "bound"))), lambda x: x["bound"])
        bounds = lies.join(_bounds(found, k), "g").groupBy("cell", "block").agg(listed.alias("bounds"))
        bounded = packed.join(stage(bounds, "knn-bounds"), ["cell", "block"])
        return stage(bounded.mapInArrow(_block_visits(centres, reaches), VISIT), "knn-visits"), bounded

    own = packed.select("ids", "points", F.col("ids").alias("ids_own"), F.col("points").alias("points_own"))
    found = stage(own.mapInArrow(_search(k + 1, space.width), HITS), "knn-own")
    visits, bounded = visited(found)
    first = visits.where(F.col("nth") < NEAR_CELLS)
    found = found.unionByName(searched(first, bounded, "knn-near"))
    visits, bounded = visited(found)
    rest = visits.join(first.select("cell", "block", "other"), ["cell", "block", "other"], "left_anti")
    return found.unionByName(searched(rest, bounded, "knn-rest"))


def knn_exact(
    vectors: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    key: str = "row_id",
    pivots: int | None = None,
    seed: int = 7,
    queries: Column | None = None,
) -> DataFrame:
    """(id, neighbor_rank, neighbor_id, distance): k nearest, self left out, ties by id.

    ``queries`` tells the rows that search among all rows, by default every row.
    """
    if queries is not None:
        return _exact_scan(vectors, queries, k, metric, key)
    space = _groups(vectors, key, metric)
    return _ranked(space, _exact_found(space, k, pivots, seed), k, metric)


# --- approximate ---


def _codes(planes: np.ndarray, middles: np.ndarray, first: int):
    """Arrow pass: (t, code, g, q, v) per table: bits tell on which side of the middle a random projection lies."""
    tables, bits, width = planes.shape
    weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def run(batches):
        for batch in batches:
            points = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for t in range(tables):
                code = ((points @ planes[t].T) > middles[t]) @ weight
                table = pa.array(np.full(batch.num_rows, first + t, np.int32))
                yield pa.record_batch([table, pa.array(code), *(batch.column(c) for c in "gqv")], names=["t", "code", "g", "q", "v"])

    return run


def _sampled(space: Groups, k: int, seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of sampled queries, as many as ``SAMPLE_BYTES`` hold."""
    rows = min(size, max(1, SAMPLE_BYTES // (8 * max(1, space.width))))
    got = space.groups.orderBy(draw(f"recall-{seed}", F.col("g")), F.col("g")).limit(rows).select("g", "v").collect()
    return np.array([r["g"] for r in got], np.int64), np.array([r["v"] for r in got], np.float64)


def _exact_for(space: Groups, names: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(g, id, d): the k+1 nearest of a few queries among all vectors, in one scan."""
    width = space.width

    def run(batches):
        for batch in batches:
            ids = batch.column("g").to_numpy(zero_copy_only=False)
            base = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
            g, hit, d = _best(queries, names, np.full(len(names), np.inf), base, ids, k + 1)
            yield pa.record_batch([pa.array(g), pa.array(hit), pa.array(d)], names=["g", "id", "d"])

    return _top(space.groups.select("g", "v").mapInArrow(run, HITS), k + 1)


def _along(rows: int, keep: int, width: int):
    """Arrow pass over (t, g, q, v) in a table's order: hits of the queries of each block of ``rows`` among it and its two neighbours."""

    def blocks(batches):
        now, size = [], 0
        for batch in batches:
            table = batch.column("t").to_numpy()
            cuts = [0, *(np.flatnonzero(table[1:] != table[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                while a < b:
                    if now and (size == rows or now[0][0] != table[a]):
                        yield joined(now)
                        now, size = [], 0
                    part = batch.slice(a, min(rows - size, b - a))
                    now.append((table[a], *(part.column(c).to_numpy(zero_copy_only=False) for c in "gq"), part.column("v").flatten().to_numpy(zero_copy_only=False)))
                    size, a = size + part.num_rows, a + part.num_rows
        if now:
            yield joined(now)

    def joined(parts):
        return (parts[0][0], *(np.concatenate([p[i] for p in parts]) for i in (1, 2)), np.concatenate([p[3] for p in parts]).reshape(-1, width))

    def run(batches):
        before = now = None
        for after in chain(blocks(batches), [None]):
            if now is not None and now[2].any():
                met = [x for x in (before, now, after) if x is not None and x[0] == now[0]]
                base, ids = np.concatenate([x[3] for x in met]), np.concatenate([x[1] for x in met])
                asks = now[2].astype(bool)
                g, hit, d = _best(now[3][asks], now[1][asks], np.full(int(asks.sum()), np.inf), base, ids, keep)
                yield pa.record_batch([pa.array(g), pa.array(hit), pa.array(d)], names=["g", "id", "d"])
            before, now = now, after

    return run


def _table_hits(space: Groups, planes: np.ndarray, middles: np.ndarray, first: int, k: int) -> DataFrame:
    """Hits of the queries of each block among it and its neighbours in every table's order."""
    rows = space.groups.select("g", "q", "v").mapInArrow(_codes(planes, middles, first), "t int, code long, g long, q boolean, v array<double>")
    dealt = rows.repartitionByRange("t", "code", "g").sortWithinPartitions("t", "code", "g")
    return dealt.select("t", "g", "q", "v").mapInArrow(_along(space.block_rows, k + 1, space.width), HITS)


@dataclass(frozen=True)
class Approximate:
    """Result of the approximate search, with the recall of its sample."""

    neighbors: DataFrame
    recall: float
    sampled: int
    tables: int


def knn_approx(
    vectors: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    key: str = "row_id",
    recall: float = 0.9,
    sample: int = 256,
    step: int = 4,
    most: int = 64,
    seed: int = 7,
    queries: Column | None = None,
) -> Approximate:
    """Approximate neighbours by random-projection order.

    ``queries`` tells the rows that search among all rows, by default every row.
    ``step`` tables at a time are added until all the queries told, or ``sample`` rows
    where none are, searched exactly against all rows, find ``recall`` of
    their neighbours; more than ``most`` tables raise, since then the data has no
    order to use and ``knn_exact`` is the way. A table costs one range partition
    of the distinct vectors and three block products per block, whatever the
    data's density.
    """
    space = _groups(vectors, key, metric, queries)
    names, sampled = _sampled(space, k, seed, sample)
    if queries is None:
        exact, held = _exact_for(space, names, sampled, k), len(names)
    elif space.queries == space.count:
        exact, held = _top(_exact_found(space, k, seed=seed), k + 1), space.queries
    else:
        asked = space.groups.where("q").select("g", "v")
        exact, held = _scan(space.groups, asked, space.queries, space.width, k + 1), space.queries
    exact = stage(exact.select("g", "id"), "knn-sample").where(F.col("g") != F.col("id"))
    pairs = exact.count()
    rng = np.random.default_rng(seed)
    # deep enough that a code names less than a block, were the rows spread evenly
    bits = min(48, 8 + max(1, math.ceil(math.log2(1 + space.count / space.block_rows))))
    found, tables, reached = None, 0, 0.0
    while True:
        planes = rng.normal(size=(step, bits, space.width))
        middles = np.array([np.median(sampled @ p.T, axis=0) for p in planes])
        hits = _top(_table_hits(space, planes, middles, tables, k).distinct(), k + 1)
        found = stage(hits if found is None else _top(found.unionByName(hits).distinct(), k + 1), "knn-found")
        tables += step
        reached = exact.join(found.select("g", "id"), ["g", "id"]).count() / pairs if pairs else 1.0
        if reached >= recall:
            return Approximate(_ranked(space, found, k, metric), reached, held, tables)
        if tables >= most:
            raise ValueError(f"recall {reached:.3f} after {tables} tables")


def with_neighbor_text(neighbors: DataFrame, rosters: DataFrame) -> DataFrame:
    """Hash and species of both sides and the neighbour's occurrence count.

    ``rosters`` is (row_id, roster_hash, species, occurrence_count).
    """
    query = rosters.select(
        F.col("row_id").alias("id"),
        F.col("roster_hash").alias("query_hash"),
        F.col("species").alias("query_species"),
    )
    other = rosters.select(
        F.col("row_id").alias("neighbor_id"),
        F.col("roster_hash").alias("neighbor_hash"),
        F.col("species").alias("neighbor_species"),
        F.col("occurrence_count").alias("neighbor_occurrence_count"),
    )
    return neighbors.join(query, "id").join(other, "neighbor_id")


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbour pairs that the approximate result also holds."""
    hit = approximate.select("id", "neighbor_id", F.lit(1).alias("hit"))
    return (
        exact.select("id", "neighbor_id")
        .join(hit, ["id", "neighbor_id"], "left")
        .agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )
