"""Distributions over anchors and units: histograms, shift tables, families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.functions.draws import first_k
from fieldshift.functions.simplex import kl_bits, normalized
from fieldshift.operators.codebook import Centroids, assign_codebook

MIN_SHARE_FOR_PCT = 0.01


def histogram_arrays(
    rows: DataFrame, size: int, keys: Sequence[str] = (), smoothing: float = 1.0, weight: Column | None = None
) -> DataFrame:
    """One row per key with ``dist``, an array over the fixed domain 0..size-1.

    Rows are summed per (key, anchor) before the shuffle; the second grouping
    gathers at most ``size`` sums per key. Smoothing is added to every entry.
    """
    weight = F.col("weight") if weight is None else weight
    sums = rows.groupBy(*keys, "anchor").agg(F.sum(weight.cast("double")).alias("_w"))
    held = F.map_from_entries(F.collect_list(F.struct("anchor", "_w")))
    gathered = sums.groupBy(*keys).agg(held.alias("_m"))
    outside = F.exists(F.map_keys("_m"), lambda a: (a < 0) | (a >= size))
    problem = F.raise_error(F.lit(f"an anchor lies outside 0..{size - 1}")).cast(gathered.schema["_m"].dataType)
    gathered = gathered.withColumn("_m", F.when(outside, problem).otherwise(F.col("_m")))
    raised = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.coalesce(F.try_element_at("_m", i.cast("int")), F.lit(0.0)) + F.lit(float(smoothing)),
    )
    return gathered.select(*keys, normalized(raised).alias("dist"))


def anchor_histogram(rows: DataFrame, size: int, keys: Sequence[str] = (), smoothing: float = 1.0) -> DataFrame:
    """(keys, anchor, p): weighted, smoothed and normalised on the full domain."""
    arrays = histogram_arrays(rows.where(F.col("anchor").isNotNull()), size, keys, smoothing)
    return arrays.select(*keys, F.posexplode("dist").alias("anchor", "p"))


def weekly_anchor_matrix(rows: DataFrame, size: int, smoothing: float = 1.0) -> DataFrame:
    """(season, period, period_ix, anchor, p): one distribution per season's period."""
    arrays = histogram_arrays(rows, size, ["season", "period"], smoothing)
    order = Window.partitionBy("season").orderBy("period")
    indexed = arrays.withColumn("period_ix", (F.row_number().over(order) - 1).cast("int"))
    return indexed.select("season", "period", "period_ix", F.posexplode("dist").alias("anchor", "p"))


def anchor_distribution(
    vectors: DataFrame, anchors: Centroids, keys: Sequence[str] = (), smoothing: float = 1.0
) -> DataFrame:
    """Distribution straight from standardised vectors (assign, then histogram)."""
    assigned = assign_codebook(vectors, anchors, "embedding", "anchor")
    return anchor_histogram(assigned, len(anchors), keys, smoothing)


def most_common_anchor(rows: DataFrame) -> DataFrame:
    """Unweighted mode, the lowest id on a tie."""
    return (
        rows.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("anchor"))
        .limit(1)
    )


def unit_distribution(
    dist: DataFrame, mapping: DataFrame, keys: Sequence[str] = (), p: str = "p", units: DataFrame | None = None
) -> DataFrame:
    """Anchor mass summed to units and renormalised; ``units`` lists units to show even at zero."""
    sums = dist.join(mapping, "anchor").groupBy(*keys, "unit").agg(F.sum(p).alias("_s"))
    if units is not None:
        if keys:
            raise ValueError("a unit list goes with a single distribution")
        sums = units.select("unit").join(sums, "unit", "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    share = F.col("_s") / F.sum("_s").over(Window.partitionBy(*keys))
    return sums.select(*keys, "unit", share.alias("share"))


def shift_table(
    current: DataFrame,
    predicted: DataFrame,
    keys: Sequence[str] = (),
    labels: DataFrame | None = None,
    min_share: float = MIN_SHARE_FOR_PCT,
) -> DataFrame:
    """Current and predicted share, change, and relative change where the share is not tiny."""
    cur = current.select(*keys, "unit", F.col("share").alias("current_share"))
    nxt = predicted.select(*keys, "unit", F.col("share").alias("predicted_share"))
    table = cur.join(nxt, [*keys, "unit"], "full").fillna(0.0, ["current_share", "predicted_share"])
    return _finish_shift(table, labels, min_share)


def _finish_shift(table: DataFrame, labels: DataFrame | None, min_share: float = MIN_SHARE_FOR_PCT) -> DataFrame:
    table = table.withColumn("delta", F.col("predicted_share") - F.col("current_share"))
    table = table.withColumn(
        "pct_change", F.when(F.col("current_share") >= min_share, F.col("delta") / F.col("current_share"))
    )
    if labels is not None:
        named = labels.select("unit", "representative")
        table = table.join(named, "unit", "left").withColumn("representative", F.coalesce("representative", F.lit("")))
    return table.orderBy(F.col("delta").desc(), F.col("unit"))


def unit_shift(
    dist: DataFrame, mapping: DataFrame, labels: DataFrame | None = None, keys: Sequence[str] = (), p: str = "p", p_hat: str = "p_hat"
) -> DataFrame:
    """Shift table from one frame that holds both masses per anchor: one grouping, no join of two."""
    sums = dist.join(mapping, "anchor").groupBy(*keys, "unit").agg(F.sum(p).alias("_c"), F.sum(p_hat).alias("_n"))
    whole = Window.partitionBy(*keys)
    table = sums.select(
        *keys,
        "unit",
        (F.col("_c") / F.sum("_c").over(whole)).alias("current_share"),
        (F.col("_n") / F.sum("_n").over(whole)).alias("predicted_share"),
    )
    return _finish_shift(table, labels)


def family_of_anchor(rows: DataFrame) -> DataFrame:
    """(anchor, family): the modal family of an anchor's rosters, ties by name."""
    counts = rows.where(F.col("family").isNotNull()).groupBy("anchor", "family").agg(F.count(F.lit(1)).alias("_n"))
    return first_k(counts, ["anchor"], [F.col("_n").desc(), F.col("family")], 1).select("anchor", "family")


def family_shares(dist: DataFrame, families: DataFrame, p: str = "p", p_hat: str = "p_hat") -> DataFrame:
    """Current and predicted mass by family, over anchors that have one."""
    sums = dist.join(families, "anchor").groupBy("family").agg(F.sum(p).alias("_c"), F.sum(p_hat).alias("_n"))
    whole = Window.partitionBy()
    shares = sums.select(
        "family",
        (F.col("_c") / F.sum("_c").over(whole)).alias("current_share"),
        (F.col("_n") / F.sum("_n").over(whole)).alias("predicted_share"),
    )
    return shares.withColumn("delta", F.col("predicted_share") - F.col("current_share"))


def risers_fallers(
    shift: DataFrame, n: int = 3, min_share: float = MIN_SHARE_FOR_PCT, keys: Sequence[str] = ()
) -> DataFrame:
    """The n strongest gains and losses among units with a share worth naming, per key."""
    shown = shift.where(F.col("current_share") >= min_share)
    up = first_k(shown, keys, [F.col("delta").desc(), F.col("unit")], n).withColumn("side", F.lit("rising"))
    down = first_k(shown, keys, [F.col("delta"), F.col("unit")], n).withColumn("side", F.lit("falling"))
    return up.unionByName(down)


def top_shares(shift: DataFrame, n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """The n largest current shares among units with a representative, per key."""
    named = shift.where(F.col("representative") != "")
    return first_k(named, keys, [F.col("current_share").desc(), F.col("unit")], n)


def kl_divergence(p: DataFrame, q: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """KL(p || q) in bits between two long distributions on the same anchors."""
    pair = p.select(*keys, "anchor", F.col("p").alias("_p")).join(
        q.select(*keys, "anchor", F.col("p").alias("_q")), [*keys, "anchor"]
    )
    return pair.groupBy(*keys).agg(kl_bits(F.col("_p"), F.col("_q")).alias("kl"))
