"""Attribute tokens, vocabulary, encoded rosters and masked examples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.functions.draws import draw, ranked
from fieldshift.functions.text import canonical_id
from fieldshift.functions.vectors import let
from fieldshift.session import stage

# The usual roster size (no limit unless passed as one) and the reserved vocabulary entries.
TEAM_SIZE = 6
SPECIALS = ("<PAD>", "<MASK>", "<UNK>", "<PKMN_CLS>", "<TEAM_CLS>")
PAD_ID, MASK_ID, UNK_ID = 0, 1, 2
STATS = ("hp", "atk", "def", "spa", "spd", "spe")

# Family rules in order of precedence (label, text, needle).
FAMILY_RULES = (
    ("Sun", "ability", "drought"),
    ("Sun", "species", "torkoal"),
    ("Rain", "ability", "drizzle"),
    ("Rain", "species", "pelipper"),
    ("Rain", "species", "politoed"),
    ("Sand", "ability", "sandstream"),
    ("Snow", "ability", "snowwarning"),
    ("Snow", "species", "ninetales-alola"),
    ("Trick Room", "moves", "trickroom"),
    ("Tailwind", "moves", "tailwind"),
    ("Redirection", "moves", "followme"),
    ("Redirection", "moves", "ragepowder"),
)
FAMILY_DEFAULT = "Balance"


def classify_family(
    members: Column, rules: Sequence[tuple[str, str, str]] = FAMILY_RULES, default: str = FAMILY_DEFAULT
) -> Column:
    """First matching rule on the concatenated abilities, species or moves.

    Abilities and moves are joined without separators and without spaces, so a
    needle may straddle two values; species keep a space between them.
    """
    bare = F.lit(" "), F.lit("")
    texts = F.struct(
        F.replace(
            F.lower(F.array_join(F.transform(members, lambda m: F.coalesce(m["ability"], F.lit(""))), "")), *bare
        ).alias("ability"),
        F.lower(F.array_join(F.transform(members, lambda m: m["species"]), " ")).alias("species"),
        F.replace(
            F.lower(F.array_join(F.transform(members, lambda m: F.array_join(m["moves"], " ")), "")), *bare
        ).alias("moves"),
    )

    def first_match(text: Column) -> Column:
        branches = None
        for label, source, needle in rules:
            test = F.contains(text[source], F.lit(needle))
            branches = F.when(test, label) if branches is None else branches.when(test, label)
        return branches.otherwise(F.lit(default))

    return let(texts, first_match)


def dimension_lookup(members: DataFrame, dimension: DataFrame, stats: Sequence[str] = STATS) -> DataFrame:
    """Left join the attribute dimension on the canonical species id.

    The dimension holds (id, types, <stats>); absent species get no types and
    zero stats. No hint: the planner broadcasts it only if it is small.
    """
    joined = members.withColumn("id", canonical_id(F.col("species"))).join(dimension, "id", "left")
    joined = joined.withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    return joined.withColumns({s: F.coalesce(F.col(s), F.lit(0)) for s in stats})


def attribute_tokens(stats: Sequence[str] = STATS, text_only: bool = False) -> Column:
    """Tokens of one member row (after the lookup): all types, stats, item, ability, nature, all moves.

    Structs of kind, token and maskable, or with ``text_only`` the token alone.
    """

    def token(kind: str, text: Column, maskable: bool) -> Column:
        if text_only:
            return text
        return F.struct(F.lit(kind).alias("kind"), text.alias("token"), F.lit(maskable).alias("maskable"))

    def named(kind: str, value: Column) -> Column:
        return token(kind, F.concat(F.lit(f"{kind}:"), canonical_id(value)), kind != "type")

    types = F.transform("types", lambda t: named("type", t))
    numbers = [
        token("base_stat", F.concat(F.lit(f"base_stat:{s}:"), F.col(s).cast("int").cast("string")), False)
        for s in stats
    ]
    fixed = [named("item", F.col("item")), named("ability", F.col("ability")), named("nature", F.col("nature"))]
    moves = F.transform("moves", lambda m: named("move", m))
    return F.concat(types, F.array(*numbers), F.array(*fixed), moves)


def token_rows(
    members: DataFrame,
    dimension: DataFrame,
    stats: Sequence[str] = STATS,
    team_size: int | None = None,
    attr_size: int | None = None,
) -> DataFrame:
    """(roster_id, slot, pos, kind, token, maskable) of every member and attribute.

    ``team_size`` and ``attr_size`` keep the first members and tokens only, for
    models of a fixed shape.
    """
    kept = members if team_size is None else members.where(F.col("slot") <= team_size)
    tokens = attribute_tokens(stats) if attr_size is None else F.slice(attribute_tokens(stats), 1, attr_size)
    ready = dimension_lookup(kept, dimension, stats)
    return ready.select("roster_id", "slot", F.posexplode(tokens).alias("pos", "t")).select(
        "roster_id", "slot", "pos", "t.kind", "t.token", "t.maskable"
    )


def build_vocab(tokens: DataFrame) -> DataFrame:
    """(token, id): reserved entries first, then tokens by first appearance.

    Appearance is (roster, slot, position). Distinct tokens are numbered inside
    range partitions and shifted by the partitions before.
    """
    first = tokens.groupBy("token").agg(F.min(F.struct("roster_id", "slot", "pos")).alias("_at"))
    numbered = ranked(first, ["_at", "token"], "_rank")
    learned = numbered.select("token", (F.col("_rank") + len(SPECIALS) - 1).cast("int").alias("id"))
    special = tokens.sparkSession.createDataFrame(list(zip(SPECIALS, range(len(SPECIALS)))), "token string, id int")
    return special.unionByName(learned)


def build_kind_vocab(tokens: DataFrame) -> DataFrame:
    """(kind, kind_id) by first appearance; 0 is padding."""
    first = tokens.groupBy("kind").agg(F.min(F.struct("roster_id", "slot", "pos")).alias("_at"))
    learned = first.select("kind", F.row_number().over(Window.orderBy("_at", "kind")).cast("int").alias("kind_id"))
    return tokens.sparkSession.createDataFrame([("pad", 0)], "kind string, kind_id int").unionByName(learned)


def encode_tokens(
    tokens: DataFrame, vocab: DataFrame, kinds: DataFrame, attr_size: int | None = None, team_size: int | None = None
) -> DataFrame:
    """Per roster flat arrays of members x attr_size cells: kind ids, value ids, mask, maskable positions.

    ``attr_size`` is the cells of a member, by default as many as the longest
    member of ``tokens`` has. A roster has the cells of its own members, or of
    ``team_size`` members (padded) if given. Unseen tokens become UNK, unseen
    kinds padding. A roster's cells are one row, like the roster itself.
    """
    shape = tokens.agg(F.max("pos").alias("pos"), F.max("slot").alias("slot")).first()
    if attr_size is None:
        attr_size = (shape["pos"] or 0) + 1
    values, kinds_ = (df.agg(F.max(c)).first()[0] or 0 for df, c in ((vocab, "id"), (kinds, "kind_id")))
    values, kinds_ = max(values, UNK_ID) + 1, kinds_ + 1
    rows = tokens.join(vocab, "token", "left").join(kinds, "kind", "left")
    at = (F.col("slot").cast("long") - 1) * attr_size + F.col("pos")
    cell = [F.coalesce("id", F.lit(UNK_ID)), F.coalesce("kind_id", F.lit(PAD_ID)), F.coalesce("maskable", F.lit(False)).cast("int")]
    if (shape["slot"] or 0) * (attr_size + (shape["pos"] or 0)) * values * kinds_ * 2 < 1 << 63:
        # a cell travels as one number
        cells = F.collect_list(((at * values + cell[0]) * kinds_ + cell[1]) * 2 + cell[2]).alias("_c")
    else:
        cells = F.flatten(F.collect_list(F.array(at, *[c.cast("long") for c in cell]))).alias("_c")
        values = None
    grouped = rows.groupBy("roster_id").agg(F.max("slot").cast("long").alias("_slots"), cells)
    slots = F.col("_slots") if team_size is None else F.lit(team_size).cast("long")
    key = tokens.schema["roster_id"].dataType.simpleString()
    schema = f"roster_id {key}, kind_ids array<int>, value_ids array<int>, attr_mask array<boolean>, maskable_at array<int>"
    return grouped.select("roster_id", (slots * attr_size).alias("_n"), "_c").mapInArrow(_laid_out(values, kinds_), schema)


def _laid_out(values: int | None, kinds: int):
    """Arrow pass over (roster_id, _n, _c): the cells of every roster in its arrays of _n places.

    ``values`` and ``kinds`` are the bases of packed cells; without them a cell is four numbers.
    """

    def run(batches):
        for batch in batches:
            size = batch.column("_n").to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            row = np.repeat(np.arange(batch.num_rows), batch.column("_c").value_lengths().to_numpy(zero_copy_only=False))
            flat = batch.column("_c").flatten().to_numpy(zero_copy_only=False)
            if values is None:
                row = row[::4]
                at, value, kind, free = flat.reshape(-1, 4).T
            else:
                rest, free = np.divmod(flat, 2)
                rest, kind = np.divmod(rest, kinds)
                at, value = np.divmod(rest, values)
            held = at < size[row]
            place = (start[row] + at)[held]
            total = int(size.sum())
            mask = np.zeros(total, bool)
            mask[place] = True
            if np.count_nonzero(mask) != len(place):
                raise ValueError("two tokens of a roster have the same place")
            value_ids, kind_ids, maskable = np.full(total, PAD_ID, np.int32), np.full(total, PAD_ID, np.int32), np.zeros(total, bool)
            value_ids[place], kind_ids[place], maskable[place] = value[held], kind[held], free[held] == 1
            whose = np.repeat(np.arange(batch.num_rows), size)
            ends = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            some = np.flatnonzero(maskable)
            found = pa.array(np.r_[0, np.cumsum(np.bincount(whose[some], minlength=batch.num_rows))], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (kind_ids, value_ids, mask)]
            lists.append(pa.ListArray.from_arrays(found, pa.array((some - start[whose[some]]).astype(np.int32))))
            yield pa.record_batch([batch.column("roster_id"), *lists], names=["roster_id", "kind_ids", "value_ids", "attr_mask", "maskable_at"])

    return run


def masked_examples(encoded: DataFrame, seed: int = 0) -> DataFrame:
    """One seeded maskable position per roster replaced by MASK, the target kept.

    The position with the smallest draw wins; rosters without one are dropped.
    """
    position = F.array_min(
        F.transform(
            "maskable_at", lambda i: F.struct(draw(seed, F.col("roster_id"), i).alias("d"), i.alias("at"))
        )
    )["at"]

    def example(at: Column) -> Column:
        hidden = F.transform("value_ids", lambda v, i: F.when(i == at, F.lit(MASK_ID)).otherwise(v))
        return F.struct(
            at.alias("target_at"),
            F.get("value_ids", at).alias("target_value_id"),
            F.get("kind_ids", at).alias("target_kind_id"),
            hidden.alias("value_ids"),
        )

    chosen = encoded.where(F.size("maskable_at") > 0)
    return chosen.select("roster_id", let(position, example).alias("_e"), "kind_ids", "attr_mask").select(
        "roster_id", "_e.*", "kind_ids", "attr_mask"
    )


def stored_vocab(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both vocabularies as staged tables, to be reused across encodings."""
    return stage(build_vocab(tokens), "vocab"), stage(build_kind_vocab(tokens), "kind-vocab")
