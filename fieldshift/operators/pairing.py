"""Who beats whom: antisymmetric win-probability models, matrices, ratings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldshift.functions.draws import draw, first_k, numbered
from fieldshift.functions.vectors import as_double, dot, double_array, let, mean_vector
from fieldshift.session import stage

SAMPLE_PER_UNIT = 25
EDGE_THRESHOLD = 0.53
# A field of up to so many bytes is held by the driver; a larger one is a table of blocks.
FIELD_BYTES = 32 << 20
# Logits formed at once.
FIELD_CELLS = 1 << 20
# Bytes of a block of rosters and of a block of opponents that meet in one row.
ROSTER_BLOCK, OPPONENT_BLOCK = 256 << 10, 1 << 20


# --- models ---


@dataclass(frozen=True)
class PairModel:
    """logit(a beats b) = w.(a - b) + a'Gb with G antisymmetric (or absent).

    Swapping the sides flips the sign, so P(a, b) + P(b, a) = 1 and
    P(a, a) = 1/2 hold for any weights.
    """

    weights: tuple[float, ...]
    gain: tuple[tuple[float, ...], ...] | None = None

    def strength(self, vec: Column) -> Column:
        return dot(as_double(vec), double_array(self.weights))

    def logit(self, a: Column, b: Column) -> Column:
        a, b = as_double(a), as_double(b)
        line = dot(F.zip_with(a, b, lambda x, y: x - y), double_array(self.weights))
        if self.gain is None:
            return line
        g = F.array(*[double_array(r) for r in self.gain])
        turned = F.transform(g, lambda row: dot(row, b))
        return line + dot(a, turned)

    def win_prob(self, a: Column, b: Column) -> Column:
        return sigmoid(self.logit(a, b))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def pair_features(a: Column, b: Column, crossed: bool) -> Column:
    """a - b and, if asked for, the antisymmetric products a_i b_j - a_j b_i for i < j."""

    def difference() -> Column:
        return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)

    if not crossed:
        return difference()

    @F.arrow_udf("array<double>")
    def features(left: pa.Array, right: pa.Array) -> pa.Array:
        if len(left) == 0:
            return pa.array([], pa.list_(pa.float64()))
        x = left.flatten().to_numpy(zero_copy_only=False).reshape(len(left), -1)
        y = right.flatten().to_numpy(zero_copy_only=False).reshape(len(right), -1)
        i, j = np.triu_indices(x.shape[1], 1)
        wide = np.concatenate([x - y, x[:, i] * y[:, j] - x[:, j] * y[:, i]], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, wide.size + 1, wide.shape[1]), pa.int32()), pa.array(wide.ravel()))

    return features(as_double(a), as_double(b))


def _fit(pairs: DataFrame, features: Column, label: str, reg: float) -> list[float]:
    """Logistic regression without intercept; a positive ridge makes the optimum unique."""
    ready = pairs.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(fitIntercept=False, regParam=reg, standardization=False, maxIter=500, tol=1e-10).fit(ready)
    return [float(x) for x in model.coefficients]


def gradient_norm(pairs: DataFrame, features: Column, weights: Sequence[float], label: str, reg: float) -> float:
    """Length of the gradient of the penalised mean log loss: zero at the optimum."""
    w = double_array(weights)
    rows = pairs.select(features.alias("_x"), F.col(label).cast("double").alias("_y"))
    miss = sigmoid(dot(F.col("_x"), w)) - F.col("_y")
    terms = let(miss, lambda m: F.transform("_x", lambda x: x * m))
    mean = np.array(rows.agg(mean_vector(terms).alias("g")).first()["g"])
    return float(np.linalg.norm(mean + reg * np.array(weights)))


def fit_strength(pairs: DataFrame, a: str = "a", b: str = "b", label: str = "label", reg: float = 1e-4) -> PairModel:
    """Bradley-Terry on vectors: logistic regression on a - b without intercept."""
    return PairModel(tuple(_fit(pairs, pair_features(F.col(a), F.col(b), False), label, reg)))


def fit_interactions(
    pairs: DataFrame, a: str = "a", b: str = "b", label: str = "label", reg: float = 1e-3
) -> PairModel:
    """Adds the antisymmetric products, still without intercept."""
    return _model(_fit(pairs, pair_features(F.col(a), F.col(b), True), label, reg), True)


def _model(coef: Sequence[float], crossed: bool) -> PairModel:
    """Model of d weights, followed by the d (d - 1) / 2 of the products if ``crossed``."""
    if not crossed:
        return PairModel(tuple(float(x) for x in coef))
    size = int((math.isqrt(8 * len(coef) + 1) - 1) // 2)
    gain = np.zeros((size, size))
    gain[np.triu_indices(size, 1)] = coef[size:]
    gain -= gain.T
    return PairModel(tuple(float(x) for x in coef[:size]), tuple(tuple(float(v) for v in row) for row in gain))


def first_step_model(pairs: DataFrame, a: str = "a", b: str = "b", label: str = "label", crossed: bool = True, rate: float = 4.0) -> PairModel:
    """The first gradient step of the same regression, from zero weights: one mean over the pairs, no iteration.

    At zero the gradient of the log loss is minus half the mean of the features,
    signed by the outcome.
    """
    sign = F.when(F.col(label) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    ready = pairs.select(pair_features(F.col(a), F.col(b), crossed).alias("_x"), sign.alias("_s"))
    mean = ready.agg(mean_vector(F.transform("_x", lambda x: x * F.col("_s"))).alias("m")).first()["m"]
    return _model([0.5 * rate * x for x in mean], crossed)


def pca_project(fit_on: DataFrame, others: DataFrame, k: int = 3, vec: str = "vec") -> DataFrame:
    """Principal components of one vector set, applied to another.

    Vectors are centred on the fitted set; a component's largest loading is
    made positive so that the signs are stable.
    """
    centre = fit_on.agg(mean_vector(F.col(vec)).alias("m")).first()["m"]
    shift = double_array(centre)

    def centred(df: DataFrame) -> DataFrame:
        moved = F.zip_with(as_double(F.col(vec)), shift, lambda x, m: x - m)
        return df.withColumn("_x", array_to_vector(moved))

    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(centred(fit_on))
    load = model.pc.toArray()
    sign = [1.0 if load[np.abs(load[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    flipped = F.zip_with(vector_to_array("_p"), double_array(sign), lambda x, s: x * s)
    return model.transform(centred(others)).withColumn("xyz", flipped).drop("_x", "_p")


# --- scoring ---


def win_probability(pairs: DataFrame, model: PairModel, a: str = "a", b: str = "b", out: str = "win_prob") -> DataFrame:
    return pairs.withColumn(out, model.win_prob(F.col(a), F.col(b)))


def score_pairs(pairs: DataFrame, rosters: DataFrame, model: PairModel, out: str = "win_prob") -> DataFrame:
    """Win probability of (roster_a, roster_b) pairs from a roster table.

    With a linear model a roster is reduced to one number before the joins, so
    the shuffles carry strengths instead of vectors.
    """
    linear = model.gain is None
    value = model.strength(F.col("embedding")) if linear else as_double(F.col("embedding"))
    slim = rosters.select("roster_id", value.alias("_v"))
    for side in ("a", "b"):
        named = slim.select(F.col("roster_id").alias(f"roster_{side}"), F.col("_v").alias(f"_{side}"))
        pairs = pairs.join(named, f"roster_{side}")
    prob = sigmoid(F.col("_a") - F.col("_b")) if linear else model.win_prob(F.col("_a"), F.col("_b"))
    return pairs.withColumn(out, prob).drop("_a", "_b")


def train_val_split(pairs: DataFrame, val_frac: float = 0.15, seed: int = 0, key: str = "pairing_id") -> DataFrame:
    """Exactly floor(n * val_frac) seeded validation pairs; ``key`` is unique.

    Positions in draw order are counted on the keys alone, per block of draws; the last
    validation pair's draw is the threshold, so whole pairs are not moved.
    """
    drawn = draw(seed, F.col(key))
    ids = stage(pairs.select(key).withColumn("_d", drawn), "draws")
    cut = math.floor(ids.count() * float(val_frac))
    placed = numbered(ids, [], [F.substring("_d", 1, 4)], [F.col("_d"), F.col(key)], "_pos")
    last = placed.where(F.col("_pos") == cut).select("_d", key).first()
    if last is None:
        return pairs.withColumn("is_val", F.lit(False))
    at = F.lit(last[key]).cast(pairs.schema[key].dataType)
    return pairs.withColumn("is_val", (drawn < last["_d"]) | ((drawn == last["_d"]) & (F.col(key) <= at)))


def auc(scored: DataFrame, prob: str = "win_prob", label: str = "label") -> DataFrame:
    """Area under the ROC curve by average ranks (ties count one half).

    Equal scores collapse first. Distinct scores are range-partitioned, in as many
    parts as their volume asks for; each part knows how many negatives lie below it,
    so no task ranks the whole column.
    """
    is_pos = (F.col(label) == 1).cast("long")
    ties = scored.groupBy(F.col(prob).alias("s")).agg(
        F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")
    )
    ties = stage(ties.repartitionByRange("s").withColumn("_b", F.spark_partition_id()), "scores")
    below = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        ties.groupBy("_b")
        .agg(F.sum("neg").alias("_n"))
        .withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(blocks, "_b")
    won = F.sum(F.col("pos") * (F.col("_below") + F.col("_in") + F.col("neg") / 2.0))
    return ranked.agg((won / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def pairing_metrics(scored: DataFrame, prob: str = "win_prob", label: str = "label") -> DataFrame:
    """AUC, accuracy, log loss and Brier score, with the coin-flip row beside them."""
    p, y = F.col(prob), F.col(label).cast("double")
    # The logarithm is bounded like in the usual binary cross-entropy (at -100).
    log_p = F.greatest(F.log(F.greatest(p, F.lit(1e-300))), F.lit(-100.0))
    log_q = F.greatest(F.log(F.greatest(1 - p, F.lit(1e-300))), F.lit(-100.0))
    one = scored.agg(
        F.avg(F.when((p > 0.5) == (y > 0.5), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(-(y * log_p + (1 - y) * log_q)).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(y).alias("_rate"),
    )
    area = auc(scored, prob, label).select("auc").scalar()
    model = one.select(F.lit("model").alias("method"), area.alias("auc"), "accuracy", "log_loss", "brier", "_rate")
    rows = F.array(
        F.struct("method", "auc", "accuracy", "log_loss", "brier"),
        F.struct(
            F.lit("coin flip").alias("method"),
            F.lit(0.5).alias("auc"),
            F.greatest(F.col("_rate"), 1 - F.col("_rate")).alias("accuracy"),
            F.log(F.lit(2.0)).alias("log_loss"),
            F.lit(0.25).alias("brier"),
        ),
    )
    return model.select(F.explode(rows).alias("r")).select("r.*")


# --- fields, matrices, ratings ---


def unit_samples(rows: DataFrame, unit: str = "unit", k: int = SAMPLE_PER_UNIT, seed: int = 0, key: str = "roster_id") -> DataFrame:
    """At most k seeded rosters per unit (or family)."""
    return first_k(rows.where(F.col(unit).isNotNull()), [unit], [draw(seed, F.col(key)), F.col(key)], k)


@dataclass(frozen=True)
class Field:
    """Sampled opponents by unit, held by the driver."""

    keys: tuple
    starts: np.ndarray
    counts: np.ndarray
    points: np.ndarray

    @staticmethod
    def load(samples: DataFrame, unit: str = "unit", value: str = "embedding", max_bytes: int | None = None) -> Field | FieldTable:
        """The field of the samples; beyond ``max_bytes`` as a table that no one holds whole."""
        limit = FIELD_BYTES if max_bytes is None else max_bytes
        samples = samples.select(F.col(unit).alias("u"), as_double(F.col(value)).alias("v"))
        size = samples.agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.size("v") + 32).alias("b")).first()
        if not size["n"]:
            raise ValueError("no sampled opponents")
        if size["b"] > limit:
            return FieldTable.packed(samples)
        rows = sorted(((r["u"], r["v"]) for r in samples.collect()))
        keys, counts = [], []
        for u, _ in rows:
            if not keys or keys[-1] != u:
                keys.append(u)
                counts.append(0)
            counts[-1] += 1
        points = np.array([v for _, v in rows], dtype=np.float64)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return Field(tuple(keys), starts, np.array(counts), points)

    def key_at(self, position: Column) -> Column:
        return F.get(F.array(*[F.lit(k) for k in self.keys]), position)


@dataclass(frozen=True)
class FieldTable:
    """A field of any size: rows of blocks (block, units, counts, points), opponents of one unit side by side."""

    blocks: DataFrame
    numbers: tuple[int, ...]
    unit_type: str

    @staticmethod
    def packed(samples: DataFrame) -> FieldTable:
        """``samples`` (u, v), range-partitioned by unit and cut into blocks of ``OPPONENT_BLOCK`` bytes."""
        kind = dict(samples.dtypes)["u"]
        dealt = samples.repartitionByRange("u", F.xxhash64("v")).sortWithinPartitions("u", "v")

        def run(batches):
            for batch in batches:
                width = _width(batch.column("v"))
                step = max(1, OPPONENT_BLOCK // (8 * width))
                for top in range(0, batch.num_rows, step):
                    part = batch.slice(top, step)
                    runs = pc.run_end_encode(part.column("u"))
                    ends = runs.run_ends.to_numpy(zero_copy_only=False)
                    counts = pa.array(np.diff(np.r_[0, ends]), pa.int64())
                    yield pa.record_batch(
                        [_one(runs.values), _one(counts), _one(part.column("v").flatten())], names=["units", "counts", "points"]
                    )

        rows = dealt.mapInArrow(run, f"units array<{kind}>, counts array<bigint>, points array<double>")
        blocks = stage(rows.withColumn("block", F.monotonically_increasing_id()), "field-blocks")
        return FieldTable(blocks, tuple(r["block"] for r in blocks.select("block").collect()), kind)


def _width(vectors: pa.Array) -> int:
    return max(1, len(vectors.flatten()) // max(1, len(vectors)))


def _one(values: pa.Array) -> pa.Array:
    """A list array of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _table_rates(rosters: DataFrame, field: FieldTable, model: PairModel, unit: str, key: str) -> DataFrame:
    """(key, unit, win_rate) against a field table by partial sums.

    Rosters are packed into blocks where they lie; each block meets each block
    of opponents, dealt over salts so that a task holds one pair at a time, and
    leaves a sum per (roster, unit), which are then added up. Work is rosters x
    opponents, as the result asks; no row of either side is paired on its own.
    """
    weights = np.array(model.weights)
    gain = None if model.gain is None else np.array(model.gain)
    slim = rosters.select(F.col(key).alias("k"), as_double(F.col("embedding")).alias("v"))
    kind = slim.schema["k"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            step = max(1, ROSTER_BLOCK // (8 * _width(batch.column("v"))))
            for top in range(0, batch.num_rows, step):
                part = batch.slice(top, step)
                yield pa.record_batch([_one(part.column("k")), _one(part.column("v").flatten())], names=["ks", "mine"])

    # as many (block, salt) tasks as shuffles have: a block of opponents is copied no further
    salts = -(-int(rosters.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(field.numbers))
    packed = slim.mapInArrow(pack, f"ks array<{kind}>, mine array<double>")
    packed = packed.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int"))
    packed = packed.withColumn("block", F.explode(F.array(*[F.lit(b) for b in field.numbers])))
    opponents = field.blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, units = batch.column("ks")[i].values, batch.column("units")[i].values
                counts = batch.column("counts")[i].values.to_numpy(zero_copy_only=False)
                mine = batch.column("mine")[i].values.to_numpy(zero_copy_only=False).reshape(len(keys), -1)
                theirs = batch.column("points")[i].values.to_numpy(zero_copy_only=False).reshape(int(counts.sum()), -1)
                turned = mine @ gain if gain is not None else None
                starts, sums = np.cumsum(counts) - counts, np.empty((len(keys), len(counts)))
                step = max(1, FIELD_CELLS // len(theirs))
                for top in range(0, len(keys), step):
                    rows = slice(top, top + step)
                    logit = (mine[rows] @ weights)[:, None] - (theirs @ weights)[None, :]
                    if turned is not None:
                        logit = logit + turned[rows] @ theirs.T
                    sums[rows] = np.add.reduceat(1.0 / (1.0 + np.exp(-logit)), starts, axis=1)
                row, col = np.divmod(np.arange(sums.size), len(counts))
                yield pa.record_batch(
                    [keys.take(pa.array(row)), units.take(pa.array(col)), pa.array(sums.ravel()), pa.array(counts[col])], names=["k", "u", "s", "n"]
                )

    met = packed.join(opponents, ["block", "salt"]).select("ks", "mine", "units", "counts", "points")
    sums = met.mapInArrow(score, f"k {kind}, u {field.unit_type}, s double, n bigint")
    rates = sums.groupBy("k", "u").agg((F.sum("s") / F.sum("n")).alias("win_rate"))
    return rates.select(F.col("k").alias(key), F.col("u").alias(unit), "win_rate")


def _mean_rates(field: Field, logits) -> Column:
    """Arrow function: array column of mean win probabilities, one per unit of the field."""
    starts, counts = field.starts, field.counts
    width, units = int(counts.sum()), len(counts)
    step = max(1, FIELD_CELLS // width)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def rates(column: pa.Array) -> pa.Array:
        n = len(column)
        if n == 0:
            return pa.array([], pa.list_(pa.float64()))
        nested = pa.types.is_list(column.type)
        flat = (column.flatten() if nested else column).to_numpy(zero_copy_only=False).astype(np.float64)
        mine = flat.reshape(n, -1) if nested else flat
        out = np.empty((n, units))
        for i in range(0, n, step):
            p = 1.0 / (1.0 + np.exp(-logits(mine[i : i + step])))
            out[i : i + step] = np.add.reduceat(p, starts, axis=1) / counts
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * units + 1, units), pa.int32()), pa.array(out.ravel()))

    return rates


def field_rates(vec: Column, field: Field, model: PairModel) -> Column:
    """Array of expected win rates of a vector against every unit of the field.

    One matrix product per Arrow batch: rosters are neither shuffled nor
    multiplied by their opponents.
    """
    w = np.array(model.weights)
    gain = None if model.gain is None else np.array(model.gain)
    theirs = field.points @ w
    points = field.points

    def logits(mine: np.ndarray) -> np.ndarray:
        line = (mine @ w)[:, None] - theirs[None, :]
        return line if gain is None else line + (mine @ gain) @ points.T

    return _mean_rates(field, logits)(as_double(vec))


def expected_winrate(
    rosters: DataFrame, field: Field | FieldTable, model: PairModel, unit: str = "unit", key: str = "roster_id"
) -> DataFrame:
    """(key, unit, win_rate): every roster against every unit's sample."""
    if isinstance(field, FieldTable):
        return _table_rates(rosters, field, model, unit, key)
    rated = rosters.select(key, F.posexplode(field_rates(F.col("embedding"), field, model)).alias("_u", "win_rate"))
    return rated.select(key, field.key_at(F.col("_u")).alias(unit), "win_rate")


def share_weights(shares: DataFrame, field: Field, unit: str = "unit", column: str = "share", min_share: float = 0.0) -> list[float]:
    """Shares in the field's unit order, scaled to sum to one; a unit without a share weighs nothing."""
    kept = shares.where((F.col(column) >= min_share) & F.col(unit).isin(list(field.keys)))
    held = {r[unit]: float(r[column]) for r in kept.select(unit, column).collect()}
    raw = [held.get(k, 0.0) for k in field.keys]
    whole = sum(raw) or 1.0
    return [x / whole for x in raw]


def weighted_rates(
    rosters: DataFrame,
    field: Field | FieldTable,
    shares: DataFrame,
    columns: dict[str, str],
    model: PairModel,
    unit: str = "unit",
    key: str = "roster_id",
) -> DataFrame:
    """(key, one column per entry of ``columns``): win rate against the whole field, units weighted by a share column.

    Shares are scaled to sum to one over the field's units. With a held field it
    is one pass over the rosters without a shuffle; with a table the rates are
    joined to the shares.
    """
    if isinstance(field, FieldTable):
        met = _table_rates(rosters, field, model, unit, key).join(shares.select(unit, *set(columns.values())), unit)
        # as with a held field: no unit with a share, no win
        rate = lambda c: F.coalesce(F.sum(F.col(c) * F.col("win_rate")) / F.nullif(F.sum(c), F.lit(0.0)), F.lit(0.0))
        found = met.groupBy(key).agg(*[rate(c).alias(out) for out, c in columns.items()])
        return rosters.select(key).join(found, key, "left").select(key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
    rated = rosters.select(key, field_rates(F.col("embedding"), field, model).alias("_r"))
    return rated.select(key, *[dot(F.col("_r"), double_array(share_weights(shares, field, unit, c))).alias(out) for out, c in columns.items()])


def advantage_matrix(samples: DataFrame, model: PairModel, unit: str = "unit", key: str = "roster_id") -> DataFrame:
    """(unit_a, unit_b, win_prob) for every ordered pair of units, diagonal 1/2.

    The result is units x units by definition.
    """
    field = Field.load(samples, unit)
    named = samples.withColumnRenamed(unit, "unit_a").withColumn("_k", F.struct("unit_a", key))
    rows = expected_winrate(named, field, model, unit, "_k")
    means = rows.groupBy(F.col("_k.unit_a").alias("unit_a"), F.col(unit).alias("unit_b")).agg(
        F.avg("win_rate").alias("win_prob")
    )
    return means.withColumn(
        "win_prob", F.when(F.col("unit_a") == F.col("unit_b"), F.lit(0.5)).otherwise(F.col("win_prob"))
    )


def advantage_nodes(matrix: DataFrame, shares: DataFrame, min_share: float = 0.0) -> DataFrame:
    """Units with their share and share-weighted win rate against the other units."""
    active = shares.where(F.col("share") >= min_share)
    other = active.select(F.col("unit").alias("unit_b"), F.col("share").alias("_s"))
    faced = matrix.where(F.col("unit_a") != F.col("unit_b")).join(other, "unit_b")
    field = faced.groupBy("unit_a").agg(
        (F.sum(F.col("_s") * F.col("win_prob")) / F.nullif(F.sum("_s"), F.lit(0.0))).alias("_w")
    )
    units = matrix.select(F.col("unit_a").alias("unit")).distinct().join(active, "unit")
    joined = units.join(field.withColumnRenamed("unit_a", "unit"), "unit", "left")
    return joined.select("unit", "share", F.coalesce("_w", F.lit(0.5)).alias("field_winrate"))


def advantage_edges(matrix: DataFrame, shares: DataFrame, min_share: float = 0.0, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    """Directed edges source -> target whose advantage exceeds the threshold."""
    active = shares.where(F.col("share") >= min_share).select("unit")
    return (
        matrix.where((F.col("unit_a") != F.col("unit_b")) & (F.col("win_prob") > threshold))
        .join(active.select(F.col("unit").alias("unit_a")), "unit_a", "left_semi")
        .join(active.select(F.col("unit").alias("unit_b")), "unit_b", "left_semi")
        .select(F.col("unit_a").alias("source"), F.col("unit_b").alias("target"), F.col("win_prob").alias("advantage"))
    )


def worst_matchups(
    rosters: DataFrame, field: Field | FieldTable, model: PairModel, n: int = 3, unit: str = "unit", key: str = "roster_id"
) -> DataFrame:
    """The n lowest win rates per roster with their mean, one row per matchup.

    With a held field rates stay in the roster's row until they are sorted, so
    nothing is shuffled; with a table each roster's rates are cut to n.
    """
    if isinstance(field, FieldTable):
        rows = _table_rates(rosters, field, model, unit, key).withColumn("win_rate", F.round("win_rate", 12))
        low = first_k(rows, [key], [F.col("win_rate"), F.col(unit)], n, rank="rank")
        mean = F.avg("win_rate").over(Window.partitionBy(key))
        return low.select(key, "rank", unit, "win_rate", mean.alias("worst_mean"))
    rates = field_rates(F.col("embedding"), field, model)
    pairs = F.transform("_r", lambda w, i: F.struct(F.round(w, 12).alias("w"), i.alias("i")))
    low = rosters.select(key, rates.alias("_r")).select(key, F.slice(F.sort_array(pairs), 1, n).alias("_l"))
    mean = F.aggregate("_l", F.lit(0.0), lambda t, x: t + x["w"]) / F.size("_l")
    rows = low.select(key, mean.alias("worst_mean"), F.posexplode("_l").alias("_p", "_x"))
    return rows.select(
        key,
        (F.col("_p") + 1).alias("rank"),
        field.key_at(F.col("_x.i")).alias(unit),
        F.col("_x.w").alias("win_rate"),
        "worst_mean",
    )
