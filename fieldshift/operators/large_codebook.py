"""Codebooks beyond the driver's memory: nearest entry and fit by blocks.

Entries lie in coarse cells around pivots that are entries themselves, so the
distance to the nearest pivot bounds the distance to the nearest entry, and the
triangle inequality rules out every cell that lies farther off. Blocks of vectors meet
blocks of entries; what decides which ones meet carries ids only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.functions.draws import first_k
from fieldshift.functions.vectors import as_double
from fieldshift.operators import neighbors as near
from fieldshift.operators.codebook import CODEBOOK_BYTES, Centroids, assign_codebook, distances
from fieldshift.session import stage


@dataclass(frozen=True)
class CodebookTable:
    """Entries (id, vec) of one kind, in any number; equal vectors are one entry, the lowest id."""

    cells: near.Cells

    @staticmethod
    def build(entries: DataFrame, seed: int = 7) -> CodebookTable:
        distinct = entries.groupBy(as_double(F.col("vec")).alias("v")).agg(F.min("id").cast("long").alias("g"))
        distinct = stage(distinct.select("g", "v"), "codebook-entries")
        shape = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
        if not shape["n"]:
            raise ValueError("the codebook has no entries of this kind")
        return CodebookTable(near.cells_of(distinct, shape["n"], shape["w"], None, seed, "codebook"))


def load_codebook(codebook: DataFrame, kind: str, max_bytes: int = CODEBOOK_BYTES) -> Centroids | CodebookTable:
    """Entries of a kind: held by the driver up to ``max_bytes``, else as a table that no one holds whole."""
    entries = codebook.where(F.col("kind") == kind).select("id", "vec")
    size = entries.agg(F.sum(8 * F.size("vec") + 8)).first()[0] or 0
    return CodebookTable.build(entries) if size > max_bytes else Centroids.load(codebook, kind, max_bytes)


def _queries(vectors: DataFrame, table: CodebookTable, vec: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with a number ``_g`` (written, so that it holds), and their vectors in cells and in packed blocks."""
    rows = stage(vectors.where(F.col(vec).isNotNull()).withColumn("_g", F.monotonically_increasing_id()), "codebook-rows")
    points = rows.select(F.col("_g").alias("g"), as_double(F.col(vec)).alias("v"))
    placed = stage(assign_codebook(points, table.cells.pivots, "v", "cell", "bound"), "codebook-queries")
    shape = stage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")), "codebook-query-cells")
    member = near._in_blocks(placed, shape, max(1, near.BLOCK_BYTES // (8 * table.cells.width)))
    return rows, member, stage(near._packed(member.select("g", "v", "cell", "block"), "cell", "block"), "codebook-query-blocks")


def assign_table(vectors: DataFrame, table: CodebookTable, vec: str, out: str, distance: str | None = None) -> DataFrame:
    """Nearest entry of every row, the lowest id among equals; rows without a vector are left out.

    A row visits the nearest cells first; what it finds there tightens its bound for the rest.
    """
    cells = table.cells
    rows, member, packed = _queries(vectors, table, vec)
    # a pivot is an entry: nothing beyond the nearest pivot can be nearest
    bounded = member.withColumn("bound", F.col("bound") * (1 + 1e-12))
    visits = stage(bounded.select("g", "v", "cell", "block", "bound").mapInArrow(near._visits(cells.pivots.matrix, cells.reaches), near.VISIT), "codebook-visits")

    def searched(part: DataFrame, name: str) -> DataFrame:
        pairs = near._pairs(part.select("g", "cell", "block", "other", "bound"), cells.blocks, skip_own=False)
        both = pairs.join(packed, ["cell", "block"]).join(near._named(cells.packed, "_other", other="cell", other_block="block"), ["other", "other_block"])
        return stage(both.select("want", "ids", "points", "ids_other", "points_other").mapInArrow(near._search(1, cells.width), near.HITS), name)

    limits = member.select("g", (F.col("bound") * (1 + 1e-12)).alias("bound"))
    found = searched(visits.where(F.col("nth") < near.NEAR_CELLS).join(limits, "g"), "codebook-near")
    best = found.groupBy("g").agg(F.min("d").alias("bound"))
    rest = visits.where(F.col("nth") >= near.NEAR_CELLS).join(best, "g").where(F.col("gap") <= F.col("bound") + 1e-6)
    found = found.unionByName(searched(rest, "codebook-rest"))
    closest = found.groupBy("g").agg(F.min(F.struct("d", "id")).alias("_n"))
    named = closest.select(F.col("g").alias("_g"), F.col("_n.id").cast("int").alias(out), *([F.col("_n.d").alias(distance)] if distance else []))
    return rows.join(named, "_g").drop("_g")


def fit_table(vectors: DataFrame, table: CodebookTable, key: str, top: int = 8, temperature: float = 2.0, vec: str = "embedding") -> DataFrame:
    """(key, rank, unit, fit, distance): the best-fitting entries of every row, fit = softmax(-distance / T) over all entries.

    The softmax needs every entry: each pair of blocks leaves a row's least
    distance, its sum of exponents and its nearest entries, which are then added up.
    """
    heat, width = max(temperature, 1e-6), table.cells.width
    rows, _, packed = _queries(vectors, table, vec)
    names = [(r["cell"], r["block"]) for r in table.cells.blocks.collect()]  # a row per block of entries
    salts = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(names))
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("other"), F.lit(b).alias("other_block")) for c, b in names]))
    spread = packed.withColumn("salt", F.pmod(F.xxhash64("cell", "block"), F.lit(salts)).cast("int")).withColumn("_o", listed)
    spread = spread.select("ids", "points", "salt", "_o.*")
    entries = near._named(table.cells.packed, "_other", other="cell", other_block="block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def score(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                g, ids = near._list(col["ids"], i, np.int64), near._list(col["ids_other"], i, np.int64)
                d = distances(near._list(col["points"], i, np.float64).reshape(-1, width), near._list(col["points_other"], i, np.float64).reshape(-1, width))
                least = d.min(axis=1)
                total = np.exp((least[:, None] - d) / heat).sum(axis=1)
                order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :top]
                best = np.take_along_axis(d, order, axis=1)
                kept = pa.StructArray.from_arrays([pa.array(best.ravel()), pa.array(ids[order].ravel())], ["d", "id"])
                ends = pa.array(np.arange(0, best.size + 1, best.shape[1]), pa.int32())
                yield pa.record_batch([pa.array(g), pa.array(least), pa.array(total), pa.ListArray.from_arrays(ends, kept)], names=["g", "m", "z", "best"])

    parts = spread.join(entries, ["other", "other_block", "salt"]).select("ids", "points", "ids_other", "points_other")
    parts = stage(parts.mapInArrow(score, "g long, m double, z double, best array<struct<d:double,id:bigint>>"), "codebook-fit")
    low = parts.groupBy("g").agg(F.min("m").alias("low"))
    sums = parts.join(low, "g").groupBy("g", "low").agg(F.sum(F.col("z") * F.exp((F.col("low") - F.col("m")) / heat)).alias("z"))
    ranked = first_k(parts.select("g", F.explode("best").alias("b")).select("g", "b.*"), ["g"], [F.col("d"), F.col("id")], top, rank="rank")
    fit = F.exp((F.col("low") - F.col("d")) / heat) / F.col("z")
    found = ranked.join(sums, "g").select(F.col("g").alias("_g"), "rank", F.col("id").cast("int").alias("unit"), fit.alias("fit"), F.col("d").alias("distance"))
    return rows.select(key, "_g").join(found, "_g").drop("_g")
