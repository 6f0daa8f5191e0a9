"""Completion: what real rosters hold, and what an unfinished one lacks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldshift.functions.draws import first_k
from fieldshift.functions.text import UNKNOWN, bare_id, canonical_id
from fieldshift.functions.vectors import as_double, double_array
from fieldshift.operators.pairing import FIELD_CELLS, Field, PairModel
from fieldshift.operators.tokens import TEAM_SIZE, attribute_tokens, dimension_lookup
from fieldshift.session import stage

# How many alternatives of each kind are offered unless the caller says otherwise.
POOL_SIZE = 150
OPTION_LIMITS = {"item": 6, "ability": 3, "move": 12}
#: How many of these are scored once what the roster holds is left out.
OFFERS = {"member": 120, "item": 6, "ability": 3, "move": 6}
TOP_OPTIONS = 5
FULL_MOVES = 4
WORST = 3
# A token table up to this size travels with the tasks; a larger one is joined.
VOCABULARY_BYTES = 64 << 20
# Rosters whose candidates are scored at once, rosters that meet the pool cell by cell at once, and cells scored exactly at once.
ROSTER_ROWS, POOL_ROWS, EXACT_CELLS = 2048, 64, 1 << 16
# Win rates in single precision lie well within this of the exact ones; what may be among the best is scored again exactly.
SCREEN = 1e-4
# Terms of a series of win rates: as few as keep it within this error, at most so many.
SERIES_ERROR, SERIES = 1e-9, 5
PER_FAMILY = "array<struct<family:string,base:double,rate:double>>"


def member_pool(members: DataFrame, size: int = POOL_SIZE) -> DataFrame:
    """The most frequent member configurations with the first-seen member of each.

    ``members`` is one row per member with (roster_id, slot) for "first seen".
    Ties in frequency go by the configuration itself.
    """
    fields = ["species", "item", "ability", "moves", "nature"]
    # equal members are counted as they are written; identifiers are formed per distinct one
    written = members.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("roster_id", "slot")).alias("_at"))
    moves = F.sort_array(F.transform("moves", lambda m: bare_id(m)))
    keyed = written.select(
        bare_id(F.col("species")).alias("species_id"),
        bare_id(F.coalesce("item", F.lit(""))).alias("item_id"),
        bare_id(F.coalesce("ability", F.lit(""))).alias("ability_id"),
        moves.alias("move_ids"),
        "_at",
        F.struct(*fields).alias("member"),
        "n",
    )
    key = ["species_id", "item_id", "ability_id", "move_ids"]
    return (
        keyed.groupBy(*key)
        .agg(F.sum("n").alias("n"), F.min_by("member", "_at").alias("member"))
        .orderBy(F.col("n").desc(), *key)
        .limit(size)
    )


def member_options(members: DataFrame, limits: dict[str, int] = OPTION_LIMITS) -> DataFrame:
    """(species_id, kind, rank, value, n): most used items, abilities and moves per species.

    Empty values and "none" are ignored; ties go by value.
    """
    values = F.flatten(
        F.array(
            F.array(F.struct(F.lit("item").alias("kind"), F.col("item").alias("value"))),
            F.array(F.struct(F.lit("ability").alias("kind"), F.col("ability").alias("value"))),
            F.transform("moves", lambda m: F.struct(F.lit("move").alias("kind"), m.alias("value"))),
        )
    )
    # counted as written; identifiers are formed per distinct value
    written = members.select("species", F.explode(values).alias("v")).select("species", "v.*").groupBy("species", "kind", "value")
    counts = (
        written.agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("value").isNotNull() & (F.col("value") != "") & (F.lower("value") != "none"))
        .groupBy(bare_id(F.col("species")).alias("species_id"), "kind", "value")
        .agg(F.sum("n").alias("n"))
    )
    order = [F.col("n").desc(), F.col("value")]
    ranked = first_k(counts, ["species_id", "kind"], order, max(limits.values()), rank="rank")
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in limits.items()])
    return ranked.where(F.col("rank") <= limit).select("species_id", "kind", "rank", "value", "n")


def exclude_owned(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates (roster_id, species_id, ...) that the roster does not hold already.

    A roster's species come as one set, by roster: candidates that lie by roster already are not moved again.
    """
    owned = members.groupBy(F.col("roster_id").alias("_roster")).agg(F.collect_set(bare_id(F.col("species"))).alias("_owned"))
    both = candidates.join(owned, F.col("roster_id") == F.col("_roster"), "left")
    lacks = ~F.coalesce(F.array_contains("_owned", F.col("species_id")), F.lit(False))
    return both.where(lacks).select(*[candidates[c] for c in candidates.columns])


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with their vectors, held by the driver."""

    tokens: pa.Array
    matrix: np.ndarray

    @staticmethod
    def load(vectors: DataFrame, max_bytes: int = VOCABULARY_BYTES) -> Vocabulary | None:
        """The table (token, vec), or None if it is larger than ``max_bytes``."""
        size = F.octet_length("token") + 8 * F.size("vec") + 16
        if (vectors.agg(F.sum(size)).first()[0] or 0) > max_bytes:
            return None
        rows = sorted(vectors.select("token", as_double(F.col("vec")).alias("vec")).collect())
        return Vocabulary(pa.array([r["token"] for r in rows], pa.string()), np.array([r["vec"] for r in rows], np.float64))

    def summed(self, tokens: Column) -> Column:
        """Sum of the vectors of a token array; unknown tokens add nothing."""
        known, matrix = self.tokens, np.vstack([self.matrix, np.zeros((1, self.matrix.shape[1]))])
        width = matrix.shape[1]

        @F.arrow_udf("array<double>")
        def sums(column: pa.Array) -> pa.Array:
            flat = column.flatten()
            at = pc.fill_null(pc.index_in(flat, value_set=known), len(known)).to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            out = np.zeros((len(column), width))
            some = np.flatnonzero(lengths)
            if len(some):
                out[some] = np.add.reduceat(matrix[at], (np.cumsum(lengths) - lengths)[some], axis=0)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width), pa.int32()), pa.array(out.ravel()))

        return sums(tokens)


def vector_sum(vec: str, width: int) -> Column:
    """Aggregate: element-wise sum of an array column; short arrays are summed as columns, which stay in generated code."""
    if width <= 32:
        return F.array(*[F.sum(F.get(vec, F.lit(i))) for i in range(width)])
    return vector_to_array(Summarizer.sum(array_to_vector(vec)))


def with_tokens(members: DataFrame, dimension: DataFrame, stats: Sequence[str]) -> DataFrame:
    """Members with their attribute tokens in one array."""
    ready = dimension_lookup(members, dimension, stats)
    return ready.select(*members.columns, attribute_tokens(stats, text_only=True).alias("tokens"))


def token_sums(members: DataFrame, vectors: DataFrame, held: Vocabulary | None = None) -> DataFrame:
    """Members (``with_tokens``) with ``s``, the sum of their tokens' vectors, and ``n``, the number of tokens.

    Mean pooling makes a roster's vector the quotient of the sums over its
    members, so a changed member or token is an update of one vector and one
    number. With a vocabulary ``held`` by the driver tokens are looked up inside
    the member's row; without, they are joined by token.
    """
    kept = [c for c in members.columns if c != "tokens"]
    ready = members.withColumn("n", F.size("tokens"))
    if held is not None:
        return ready.select(*kept, "n", held.summed(F.col("tokens")).alias("s"))
    ready = stage(ready, "member-tokens")
    width = vectors.select(F.size("vec")).first()[0]
    rows = ready.select("roster_id", "slot", F.explode("tokens").alias("token")).join(vectors.select("token", as_double(F.col("vec")).alias("vec")), "token")
    sums = rows.groupBy("roster_id", "slot").agg(vector_sum("vec", width).alias("s"))
    none = F.array_repeat(F.lit(0.0), width)
    return ready.select(*kept, "n").join(sums, ["roster_id", "slot"], "left").withColumn("s", F.coalesce("s", none))


def roster_sums(member_sums: DataFrame, width: int) -> DataFrame:
    """(roster_id, s, n) over a roster's members."""
    return member_sums.groupBy("roster_id").agg(vector_sum("s", width).alias("s"), F.sum("n").alias("n"))


def pooled(total: Column, count: Column) -> Column:
    """Mean token vector of a roster."""
    return F.transform(total, lambda x: x / count)


def recommend_completions(
    members: DataFrame,
    dimension: DataFrame,
    vectors: DataFrame,
    frame: DataFrame,
    model: PairModel,
    field: Field,
    corpus: DataFrame,
    stats: Sequence[str],
    top: int = TOP_OPTIONS,
    team_size: int = TEAM_SIZE,
    pool_size: int = POOL_SIZE,
    limits: dict[str, int] = OPTION_LIMITS,
    offers: dict[str, int] = OFFERS,
    full_moves: int = FULL_MOVES,
    max_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """Best additions to unfinished rosters against their three worst families.

    ``members``: rosters to complete, a row per member (roster_id, slot, species,
    item, ability, nature, moves). ``vectors`` is (token, vec), ``frame`` the
    mean and std of pooled vectors (``feature_stats``), ``model`` any pair model
    on standardised vectors, ``field`` the sampled opponents by family,
    ``corpus`` the members of real rosters the options come from.

    Every candidate is scored by the model on the re-pooled vector. The logit of
    a roster x against opponent y is x.(w + G y) - w.y, linear in x, so a
    roster is projected on its opponents once and a candidate adds its own
    projection: one Arrow pass, in which a roster's row brings all its gaps and
    meets the pool and the options of its members' species. Win rates with the
    whole pool come from series with a known error; what may be among the best
    is scored exactly. Rosters are grouped once and neither multiplied by their
    gaps or the pool nor shuffled by candidate; only options beyond
    ``max_bytes`` are joined, a row per gap. Returns (roster_id, slot, rank,
    label, winrate_vs_worst, delta, per_family: family, base, rate); a family is
    named by the text of its key.
    """
    shape = frame.select("mean", "std").first()
    mean, std = (np.array(shape[c], np.float64) for c in ("mean", "std"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    species_id = bare_id(F.col("species"))
    have = F.transform("moves", lambda m: bare_id(m))

    def slot(kind: str, missing: Column, known: Column | None = None) -> Column:
        where = F.concat_ws(" ", F.lit(f"{kind} on"), "species", F.col("slot").cast("string"))
        held = F.lit(None).cast("array<string>") if known is None else known
        return F.when(missing, F.struct(F.lit(kind).alias("kind"), where.alias("slot"), species_id.alias("species_id"), held.alias("have")))

    gaps = F.array(
        slot("item", empty(F.col("item"))), slot("ability", empty(F.col("ability"))), slot("move", F.size("moves") < full_moves, have)
    )
    held = Vocabulary.load(vectors, max_bytes)
    summed = token_sums(with_tokens(members, dimension, stats), vectors, held)
    rows = summed.select("roster_id", species_id.alias("species_id"), "s", "n", F.filter(gaps, lambda g: g.isNotNull()).alias("gaps"))
    whole = rows.groupBy("roster_id").agg(
        vector_sum("s", len(mean)).alias("s"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("size"),
        F.collect_set("species_id").alias("owned"),
        F.flatten(F.collect_list("gaps")).alias("gaps"),
    )
    none = F.lit(None).cast("string")
    further = F.array(F.struct(F.lit("member").alias("kind"), F.lit("member").alias("slot"), none.alias("species_id"), F.lit(None).cast("array<string>").alias("have")))
    whole = whole.withColumn("gaps", F.when(F.col("size") < team_size, F.concat("gaps", further)).otherwise(F.col("gaps")))

    ready = whole.where(F.size("gaps") > 0).select("roster_id", "s", "n", "owned", "gaps")
    table = _options(corpus, vectors, limits, len(mean))
    choices = _Choices.load(table, max_bytes)
    if choices is None:
        ready = _joined(ready, table, offers)
    pool = _pool(corpus, dimension, vectors, stats, pool_size, held)
    kind = dict(members.dtypes)["roster_id"]
    schema = f"roster_id {kind}, slot string, rank int, label string, winrate_vs_worst double, delta double, per_family {PER_FAMILY}"
    return ready.mapInArrow(_scorer(field, model, mean, std, pool, choices, top, offers), schema)


def _joined(rosters: DataFrame, table: DataFrame, offers: dict[str, int]) -> DataFrame:
    """A row per gap with what may fill it (labels, vecs), for a table of options that is not held."""
    opened = rosters.select("roster_id", "s", "n", "owned", F.explode("gaps").alias("g")).select(
        "*", F.col("g.kind").alias("kind"), F.col("g.species_id").alias("species_id")
    )
    offered = opened.join(table, ["species_id", "kind"], "left")
    free = F.filter("options", lambda o: F.col("g.have").isNull() | ~F.array_contains("g.have", o["value_id"]))
    most = F.element_at(F.create_map(*[x for k, v in offers.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    offered = offered.where((F.col("kind") == "member") | (F.size("options") > 0)).withColumn("options", F.slice(free, F.lit(1), most))
    return offered.select(
        "roster_id", "s", "n", "owned", F.array("g").alias("gaps"),
        F.transform("options", lambda o: o["label"]).alias("labels"),
        F.transform("options", lambda o: o["vec"]).alias("vecs"),
    )


def _options(corpus: DataFrame, vectors: DataFrame, limits: dict[str, int], width: int) -> DataFrame:
    """(species_id, kind, options) in rank order: label, value_id and what filling the gap adds to the token sum."""
    blanks = {f"{k}:{UNKNOWN}" for k in limits if k != "move"}  # a missing move has no token
    held = {r["token"]: r["vec"] for r in vectors.where(F.col("token").isin(sorted(blanks))).collect()}
    zero = [0.0] * width
    less = None
    for k in limits:
        vec = double_array(held.get(f"{k}:{UNKNOWN}", zero))
        less = F.when(F.col("kind") == k, vec) if less is None else less.when(F.col("kind") == k, vec)
    ranked = member_options(corpus, limits).withColumn("token", F.concat_ws(":", "kind", canonical_id(F.col("value"))))
    known = ranked.join(vectors.select("token", as_double(F.col("vec")).alias("vec")), "token", "left")
    change = F.zip_with(F.coalesce("vec", double_array(zero)), less, lambda a, b: a - b)
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col("value").alias("label"), bare_id(F.col("value")).alias("value_id"), change.alias("vec"))))
    return stage(known.groupBy("species_id", "kind").agg(listed.alias("options")), "completion-options")


@dataclass(frozen=True)
class _Choices:
    """The options of every (species, kind), held by the driver: those of a key lie side by side in rank order."""

    keys: pa.Array
    starts: np.ndarray
    sizes: np.ndarray
    labels: pa.Array
    order: np.ndarray  # place of the label among all labels
    values: pa.Array  # distinct value ids
    value: np.ndarray  # index of the option's among them
    vecs: np.ndarray

    @staticmethod
    def load(table: DataFrame, max_bytes: int) -> _Choices | None:
        """The table (``_options``), or None if it is larger than ``max_bytes``."""
        size = F.aggregate("options", F.lit(0), lambda n, o: n + F.octet_length(o["label"]) + F.octet_length(o["value_id"]) + 8 * F.size(o["vec"]) + 32)
        if (table.agg(F.sum(size)).first()[0] or 0) > max_bytes:
            return None
        rows = sorted(table.where(F.col("species_id").isNotNull()).collect(), key=lambda r: (r["species_id"], r["kind"]))
        flat = [o for r in rows for o in r["options"]]
        sizes = np.array([len(r["options"]) for r in rows], dtype=int)
        labels = np.array([o["label"] for o in flat], dtype=object)
        values = np.array([o["value_id"] for o in flat], dtype=object)
        order = np.unique(labels, return_inverse=True)[1] if flat else np.zeros(0, int)
        names, value = np.unique(values, return_inverse=True) if flat else (values, np.zeros(0, int))
        keys = pa.array([f"{r['species_id']} {r['kind']}" for r in rows], pa.string())  # an identifier has no blank
        vecs = np.array([o["vec"] for o in flat], np.float64)
        return _Choices(keys, np.cumsum(sizes) - sizes, sizes, pa.array(labels, pa.string()), order, pa.array(names, pa.string()), value, vecs)


@dataclass(frozen=True)
class _Pool:
    """Frequent members in order of frequency: at most ``pool_size`` rows."""

    species: list[str]
    labels: list[str]
    sums: np.ndarray
    counts: np.ndarray


def _pool(corpus: DataFrame, dimension: DataFrame, vectors: DataFrame, stats: Sequence[str], size: int, held: Vocabulary | None) -> _Pool:
    key = ["species_id", "item_id", "ability_id", "move_ids"]
    # configurations are unique, so their hash serves as the row key of the sums
    rows = member_pool(corpus, size).select(*key, F.xxhash64(*key).alias("roster_id"), F.lit(1).alias("slot"), "member.*", F.col("n").alias("uses"))
    rows = token_sums(with_tokens(stage(rows, "completion-pool"), dimension, stats), vectors, held)
    label = F.concat_ws(" @ ", "species", "item")
    got = rows.orderBy(F.col("uses").desc(), *key).select("species_id", label.alias("label"), "s", "n").collect()
    return _Pool([r[0] for r in got], [r[1] for r in got], np.array([r[2] for r in got], np.float64), np.array([r[3] for r in got], np.float64))


def _sigmoid_terms(most: int) -> tuple[list[np.polynomial.Polynomial], list[float]]:
    """Derivatives 1 to ``most`` of the sigmoid over their factorials, as polynomials in its value, and the largest value of each."""
    step = np.polynomial.Polynomial([0.0, 1.0, -1.0])
    grid, term = np.linspace(0.0, 1.0, 20001), np.polynomial.Polynomial([0.0, 1.0])
    terms, largest = [], []
    for k in range(1, most + 1):
        term = term.deriv() * step / k
        terms.append(term)
        largest.append(1.001 * float(np.abs(term(grid)).max()))
    return terms, largest


TERMS, LARGEST = _sigmoid_terms(SERIES + 1)


def series_rates(mine: np.ndarray, count: np.ndarray, gain: np.ndarray, added: float, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean win rates of all candidates for all rows (rows x candidates), and by how much each row's may be wrong at most.

    A candidate's logit against an opponent is (mine + gain) / (count + added) +
    constant. The win rate is a Taylor series about the logit of the middle of
    the candidates' gains; its terms are products of a row's and a candidate's
    part, so a term is one matrix product and no cell needs an exponential.
    """
    centre = (gain.min(axis=0) + gain.max(axis=0)) / 2
    apart = gain - centre
    share = 1.0 / (count + added)
    reach = share * np.abs(apart).max()
    terms = next((k for k in range(1, SERIES) if LARGEST[k] * reach.max() ** (k + 1) <= SERIES_ERROR), SERIES)
    p = 1.0 / (1.0 + np.exp(-((mine + centre) * share[:, None] + constant)))
    rates = np.repeat(p.mean(axis=1)[:, None], len(gain), axis=1)
    power, scale = apart, share / mine.shape[1]
    for k in range(terms):
        rates += (TERMS[k](p) * scale[:, None]) @ power.T
        power, scale = power * apart, scale * share
    return rates, LARGEST[terms] * reach ** (terms + 1) + SERIES_ERROR


def _scorer(field: Field, model: PairModel, mean: np.ndarray, std: np.ndarray, pool: _Pool, choices: _Choices | None, top: int, offers: dict[str, int]):
    """Arrow pass over rosters (roster_id, s, n, owned, gaps): the ``top`` candidates of every gap with their win rates against the roster's worst families.

    Without ``choices`` a row has one gap, with its options in (labels, vecs).
    """
    weights = np.array(model.weights)
    turned = weights[:, None] + (0.0 if model.gain is None else np.array(model.gain) @ field.points.T)
    turned = np.broadcast_to(turned, (len(weights), len(field.points))) / std[:, None]
    constant = -(field.points @ weights) - mean @ turned
    blocks = [slice(int(a), int(a + c)) for a, c in zip(field.starts, field.counts)]
    # the pool in the order of its labels, so that a stable sort by win rate breaks ties by label
    by_label = np.array(sorted(range(len(pool.labels)), key=lambda i: pool.labels[i]), dtype=int)
    names, species = np.unique(np.array(pool.species, dtype=object), return_inverse=True) if pool.species else (np.array([], object), np.array([], int))
    names, pool_labels = pa.array(names, pa.string()), pa.array(np.array(pool.labels, dtype=object)[by_label], pa.string())
    families = pa.array([str(k) for k in field.keys], pa.string())
    pool_gain = (pool.sums.reshape(len(pool.labels), -1) @ turned if pool.labels else np.zeros((0, turned.shape[1])))[by_label]
    pool_counts = pool.counts[by_label]
    step = max(1, min(ROSTER_ROWS, FIELD_CELLS // turned.shape[1]))

    def numbers(column: pa.Array, rows: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)

    def whole_numbers(column: pa.Array) -> np.ndarray:
        return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def won(total: np.ndarray, size: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Mean win rate for projected sums (..., opponents), which are overwritten."""
        total *= (-1.0 / size)[..., None]
        total -= shift
        np.exp(total, out=total)
        total += 1.0
        return np.reciprocal(total, out=total) @ np.full(total.shape[-1], 1.0 / total.shape[-1], total.dtype)

    def exact(row: np.ndarray, gain: np.ndarray, at: np.ndarray, size: np.ndarray, mine: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Win rates of candidates (their row, place in ``gain`` and token count) against the row's worst families."""
        rates = np.empty((len(row), worst.shape[1]))
        for k in range(worst.shape[1]):
            for f in np.unique(worst[:, k]):
                held, among = np.flatnonzero(worst[row, k] == f), blocks[f]
                near, theirs = np.ascontiguousarray(mine[:, among]), np.ascontiguousarray(gain[:, among])
                most = max(1, EXACT_CELLS // near.shape[1])
                for start in range(0, len(held), most):
                    some = held[start : start + most]
                    total = np.take(near, row[some], axis=0)
                    total += np.take(theirs, at[some], axis=0)
                    rates[some, k] = won(total, size[some], constant[among])
        return rates

    def ordered(gap: np.ndarray, value: np.ndarray, name_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` candidates of every gap and their places, ties by label."""
        order = np.lexsort((name_rank, -np.round(value, 12), gap))
        place = np.arange(len(order)) - np.searchsorted(gap[order], gap[order])
        return order[place < top], place[place < top]

    def screened(count: np.ndarray, mine: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row's win rate with each of the pool, and by how much it may be wrong: by series, or cell by cell where these leave too much open."""
        height, width = len(mine), len(pool_labels)
        rough, slack = np.zeros((height, width)), np.zeros(height)
        for f in np.unique(worst):
            row, among = np.flatnonzero((worst == f).any(axis=1)), blocks[f]
            part, wrong = np.empty((len(row), width)), np.zeros(len(row))
            for added in np.unique(pool_counts):
                same = np.flatnonzero(pool_counts == added)
                part[:, same], off = series_rates(mine[row, among], count[row], pool_gain[same, among], added, constant[among])
                wrong = np.maximum(wrong, off)
            rough[row] += part / worst.shape[1]
            slack[row] += wrong / worst.shape[1]
        wide = np.flatnonzero(~(slack <= SCREEN))
        for start in range(0, len(wide), POOL_ROWS):
            some = wide[start : start + POOL_ROWS]
            rough[some], slack[some] = 0.0, SCREEN
            size = (count[some, None] + pool_counts[None, :]).astype(np.float32)
            for f in np.unique(worst[some]):
                near, among = np.flatnonzero((worst[some] == f).any(axis=1)), blocks[f]
                total = mine[some[near], None, among].astype(np.float32) + pool_gain[None, :, among].astype(np.float32)
                rough[some[near]] += won(total, size[near], constant[among].astype(np.float32)) / worst.shape[1]
        return rough, slack

    def members(owned: pa.Array, row: np.ndarray, count: np.ndarray, mine: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the first members of the pool whose species a row lacks, those that may be among its best: place of the row, of the member, win rates."""
        height, width = len(row), len(pool_labels)
        sizes = whole_numbers(pc.list_value_length(owned))
        at = pc.fill_null(pc.index_in(owned.flatten(), value_set=names), len(names)).to_numpy(zero_copy_only=False)
        holds = np.zeros((height, len(names) + 1), bool)
        holds[np.repeat(np.arange(height), sizes), at] = True
        fresh = ~holds[:, species]
        fresh &= np.cumsum(fresh, axis=1) <= offers["member"]
        fresh = fresh[:, by_label]
        rough, slack = screened(count[row], mine[row], worst[row])
        rough = np.where(fresh, rough, -np.inf)
        least = np.partition(rough, max(0, width - top), axis=1)[:, max(0, width - top)]
        held, pick = np.nonzero(fresh & (rough >= (least - 2 * slack)[:, None]))
        return held, pick, exact(row[held], pool_gain, pick, count[row[held]] + pool_counts[pick], mine, worst)

    def offered(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """What comes with the rows: per option its gap, label, place of the label, what it adds, and where that lies."""
        gap = np.repeat(np.arange(part.num_rows), whole_numbers(pc.list_value_length(part.column("labels"))))
        labels = part.column("labels").flatten()
        order = np.unique(np.array(labels.to_pylist(), dtype=object), return_inverse=True)[1]
        vecs = part.column("vecs").flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(gap), -1)
        return gap, labels, order, vecs, np.arange(len(gap))

    def chosen(gaps: pa.StructArray, fill: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The same from the options held, for the gaps ``fill``: the first of them that the member lacks."""
        own = gaps.take(pa.array(fill))
        kinds, have = own.field("kind"), own.field("have")
        names = pc.binary_join_element_wise(own.field("species_id"), kinds, " ")
        key = pc.fill_null(pc.index_in(names, value_set=choices.keys, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        whose = np.repeat(np.arange(len(fill)), whole_numbers(pc.list_value_length(have)))
        held = have.flatten()
        known = pc.fill_null(pc.index_in(held, value_set=choices.values, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        sizes = np.where(key < 0, 0, choices.sizes[key])
        sizes[whose[pc.is_null(held).to_numpy(zero_copy_only=False)]] = 0  # beside a move without a name none is known to be lacking
        at = np.repeat(np.arange(len(fill)), sizes)
        first = np.cumsum(sizes) - sizes
        pick = np.arange(len(at)) - first[at] + choices.starts[key[at]]
        base = len(choices.values) + 1
        free = ~np.isin(at * base + choices.value[pick], (whose * base + known)[known >= 0])
        upto = np.cumsum(free)
        most = np.array([offers[k] for k in kinds.to_pylist()], dtype=int)
        kept = np.flatnonzero(free & (upto - np.r_[0, upto][first[at]] <= most[at]))
        some, place = np.unique(pick[kept], return_inverse=True)
        return fill[at[kept]], choices.labels.take(pa.array(pick[kept])), choices.order[pick[kept]], choices.vecs[some], place

    def rates_of(mine: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Win rate of every row against every family."""
        return np.stack([won(np.array(mine[:, among]), count, constant[among]) for among in blocks], axis=1)

    def scored(part: pa.RecordBatch):
        """Record batches with the best of every gap of the rosters."""
        height = part.num_rows
        count = part.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
        mine = numbers(part.column("s"), height) @ turned
        rates = rates_of(mine, count)
        worst = np.argsort(np.round(rates, 12), axis=1, kind="stable")[:, :WORST]
        base = np.take_along_axis(rates, worst, axis=1)
        row = np.repeat(np.arange(height), whole_numbers(pc.list_value_length(part.column("gaps"))))
        gaps = part.column("gaps").flatten()
        adds = pc.equal(gaps.field("kind"), "member").to_numpy(zero_copy_only=False)

        def batch(gap: np.ndarray, place: np.ndarray, labels: pa.Array, rates: np.ndarray) -> pa.RecordBatch:
            of, value = row[gap], rates.mean(axis=1)
            fields = [families.take(pa.array(worst[of].ravel())), pa.array(base[of].ravel()), pa.array(rates.ravel())]
            each = pa.StructArray.from_arrays(fields, ["family", "base", "rate"])
            ends = pa.array(np.arange(0, rates.size + 1, rates.shape[1]), pa.int32())
            return pa.record_batch(
                [
                    part.column("roster_id").take(pa.array(of)), gaps.field("slot").take(pa.array(gap)), pa.array(place + 1, pa.int32()), labels,
                    pa.array(value), pa.array(value - base[of].mean(axis=1)), pa.ListArray.from_arrays(ends, each),
                ],
                names=["roster_id", "slot", "rank", "label", "winrate_vs_worst", "delta", "per_family"],
            )

        gap = np.flatnonzero(adds)
        if len(gap) and len(pool_labels):
            held, pick, found = members(part.column("owned").take(pa.array(row[gap])), row[gap], count, mine, worst)
            best, place = ordered(gap[held], found.mean(axis=1), pick)
            yield batch(gap[held[best]], place, pool_labels.take(pa.array(pick[best])), found[best])
        fill = np.flatnonzero(~adds)
        if len(fill) and (choices is None or len(choices.keys)):
            gap, labels, order, vecs, at = offered(part) if choices is None else chosen(gaps, fill)
            if len(gap):
                moves = pc.equal(gaps.field("kind"), "move").to_numpy(zero_copy_only=False)
                size = count[row[gap]] + moves[gap]  # an item or ability takes the place of a blank token
                found = exact(row[gap], vecs @ turned, at, size, mine, worst)
                best, place = ordered(gap, found.mean(axis=1), order)
                yield batch(gap[best], place, labels.take(pa.array(best)), found[best])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                yield from scored(whole.slice(start, step))

    return run
