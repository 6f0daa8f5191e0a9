"""The given tables read in the roles of the data model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldshift.functions.draws import draw, uniform
from fieldshift.functions.periods import iso_period
from fieldshift.functions.vectors import mean_vector
from fieldshift.operators import codebook as cb
from fieldshift.operators.dists import weekly_anchor_matrix
from fieldshift.operators.pairing import PairModel
from fieldshift.operators.seasons import season_windows
from fieldshift.operators.tokens import classify_family
from fieldshift.session import fresh_path

# Rules for the family role: (label, text, needle) in order of precedence.
RULES = (
    ("Chain", "ability", "anr"),
    ("Seven", "species", "brand#7"),
    ("Red", "moves", "redwidget"),
    ("Hot", "moves", "hot"),
    ("Pair", "species", "brand#1 brand#2"),
)
ROLE_STATS = ("hp",)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def roster(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rosters."""
    vectors = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("roster_id"),
        F.col("o_custkey").alias("player"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("won"),
        F.col("o_orderpriority").alias("unit"),
        (F.col("o_custkey") % vectors).alias("vec_id"),
        F.when(urgent, "tournament").otherwise("ladder").alias("source"),
        F.when(urgent, 8.0).otherwise(1.0).alias("weight"),
    )


def with_period(rows: DataFrame) -> DataFrame:
    return rows.withColumn("period", iso_period(F.col("ts")))


def seasons(spark: SparkSession) -> DataFrame:
    """One closed window per year; the last day counts only at midnight."""
    year = F.col("id").cast("int")
    return spark.range(1995, 2002).select(
        F.concat(F.lit("y"), year.cast("string")).alias("season"),
        F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("start_ts"),
        F.make_timestamp(year, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("end_ts"),
    )


def seasoned(spark: SparkSession, sf: str) -> DataFrame:
    return with_period(season_windows(roster(spark, sf), seasons(spark)))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their part's attributes, one row per member; moves are words of a text."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("roster_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("at"),
        F.col("p_brand").alias("species"),
        F.col("p_type").alias("item"),
        F.col("l_returnflag").alias("ability"),
        F.col("p_name").alias("move_text"),
        F.col("l_linestatus").alias("nature"),
        F.col("l_quantity").cast("int").alias("level"),
    )


MEMBER = ("species", "item", "ability", "moves", "nature", "level")


def member_lists(spark: SparkSession, sf: str, fields: Sequence[str] = MEMBER) -> DataFrame:
    """(roster_id, members): a roster is one record holding its members in slot order.

    Only the ``fields`` asked for are moved, and moves as one text that is split behind the shuffle.
    """
    moved = F.struct(*["move_text" if f == "moves" else f for f in fields])
    ordered = F.sort_array(F.collect_list(F.struct("at", moved.alias("m"))))

    def member(x: Column) -> Column:
        return F.struct(*[(F.split(x["m"]["move_text"], " ") if f == "moves" else x["m"][f]).alias(f) for f in fields])

    return lines(spark, sf).groupBy("roster_id").agg(ordered.alias("_l")).select("roster_id", F.transform("_l", member).alias("members"))


def members(spark: SparkSession, sf: str, size: str | None = None) -> DataFrame:
    """(roster_id, slot, member fields), with the number of the roster's members if ``size`` names a column for it.

    The rows of ``member_lists``, numbered where they lie sorted by roster: no list is built to be taken apart again.
    """
    moved = ["move_text" if f == "moves" else f for f in MEMBER]
    rows = lines(spark, sf)
    at = [f"at.{f}" for f in rows.schema["at"].dataType.names]
    whose = Window.partitionBy("roster_id")
    slots = rows.withColumn("slot", F.row_number().over(whose.orderBy(*at, *moved)))
    if size is not None:
        slots = slots.withColumn(size, F.count(F.lit(1)).over(whose).cast("int"))
    fields = [F.split("move_text", " ").alias(f) if f == "moves" else F.col(f) for f in MEMBER]
    return slots.select("roster_id", "slot", *fields, *[c for c in (size,) if c])


def roster_with_members(spark: SparkSession, sf: str) -> DataFrame:
    return roster(spark, sf).join(member_lists(spark, sf), "roster_id")


def dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute dimension by canonical species: one type and one stat per brand."""
    from fieldshift.functions.text import canonical_id

    return (
        table(spark, sf, "part")
        .groupBy(canonical_id(F.col("p_brand")).alias("id"))
        .agg(F.array(F.min("p_type")).alias("types"), F.min("p_size").alias("hp"))
    )


def token_vectors(rows: DataFrame, size: int = 8) -> DataFrame:
    """(token, vec): a seeded random vector per distinct token of the members."""
    seeded = F.array(*[uniform(draw(i, F.col("token"))) - 0.5 for i in range(size)])
    return rows.select(F.explode("tokens").alias("token")).distinct().select("token", seeded.alias("vec"))


def families(spark: SparkSession, sf: str) -> DataFrame:
    read = member_lists(spark, sf, ("species", "ability", "moves"))
    return read.select("roster_id", classify_family(F.col("members"), RULES).alias("family"))


# --- the frozen space ---


@dataclass(frozen=True)
class Space:
    vectors: DataFrame  # vec_id, label, embedding (standardised)
    stats: DataFrame
    codebook: DataFrame
    units: cb.Centroids
    anchors: cb.Centroids

    @property
    def size(self) -> int:
        return len(self.anchors)

    def mapping(self) -> DataFrame:
        """(anchor, unit)."""
        return cb.anchor_to_unit(self.codebook, self.units)

    def anchored(self) -> DataFrame:
        """Vectors with their anchor."""
        return cb.assign_codebook(self.vectors, self.anchors, "embedding", "anchor")


def space(spark: SparkSession, sf: str) -> Space:
    """Deterministic codebook over every vector: label means, and means per (label, vec_id % 4)."""
    raw = table(spark, sf, "embeddings")
    stats = cb.feature_stats(raw)
    vectors = cb.standardize(raw, stats)

    def centroids(kind: str, key: Column) -> DataFrame:
        return vectors.groupBy(key.cast("int").alias("id")).agg(mean_vector(F.col("embedding")).alias("vec")).select(
            F.lit(kind).alias("kind"), "id", "vec"
        )

    table_ = centroids("unit", F.col("label")).unionByName(
        centroids("anchor", F.col("label") * 4 + F.col("vec_id") % 4)
    )
    kinds = cb.Centroids.load_all(table_)
    rows = [
        (kind, int(i), [float(x) for x in v]) for kind, c in kinds.items() for i, v in zip(c.ids, c.matrix)
    ]
    small = spark.createDataFrame(rows, "kind string, id int, vec array<double>")
    return Space(vectors, stats, small, kinds["unit"], kinds["anchor"])


def features(spark: SparkSession, sf: str, frozen: Space, vectors: bool = False) -> DataFrame:
    """Rosters inside a season with their anchor.

    Anchors are assigned once per distinct vector, then joined to the rosters.
    """
    found = frozen.anchored().select("vec_id", "anchor", *(["embedding"] if vectors else []))
    return seasoned(spark, sf).join(found, "vec_id")


def weekly_p(spark: SparkSession, sf: str, frozen: Space) -> DataFrame:
    return weekly_anchor_matrix(features(spark, sf, frozen), frozen.size)


def roster_vectors(spark: SparkSession, sf: str, frozen: Space) -> DataFrame:
    """Every roster with its standardised vector."""
    return roster(spark, sf).join(frozen.vectors.select("vec_id", "embedding"), "vec_id")


def mean_difference_model(spark: SparkSession, sf: str, frozen: Space) -> PairModel:
    """Weights without training: winners' mean vector minus losers' mean vector.

    Outcomes are counted per vector first, so vectors are not copied per roster.
    """
    outcomes = roster(spark, sf).groupBy("vec_id").agg(
        F.count_if("won").cast("double").alias("won"), F.count_if(~F.col("won")).cast("double").alias("lost")
    )
    cells = frozen.vectors.join(outcomes, "vec_id").select("won", "lost", F.posexplode("embedding").alias("i", "z"))
    w = cells.groupBy("i").agg(
        (
            F.sum(F.col("z") * F.col("won")) / F.sum("won") - F.sum(F.col("z") * F.col("lost")) / F.sum("lost")
        ).alias("w")
    )
    return PairModel(tuple(r["w"] for r in w.orderBy("i").collect()))


def pairings(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring orders as the two sides of a battle, the dearer order wins."""
    first = F.col("o_orderkey") % 2 == 0

    def of(side, column: str):
        return F.max(F.when(side, F.col(column)))

    both = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 2).alias("pairing_id")).agg(
        of(first, "o_orderkey").alias("roster_a"),
        of(~first, "o_orderkey").alias("roster_b"),
        of(first, "o_totalprice").alias("_a"),
        of(~first, "o_totalprice").alias("_b"),
        F.count_if(F.col("o_orderstatus") != "P").alias("_decided"),
    )
    kept = both.where((F.col("_decided") > 0) & (F.col("_a") != F.col("_b")))
    return kept.select("pairing_id", "roster_a", "roster_b", (F.col("_a") > F.col("_b")).cast("int").alias("label"))


def pairing_vectors(spark: SparkSession, sf: str, frozen: Space) -> DataFrame:
    """Pairings with both sides' vectors (a, b)."""
    ids = roster(spark, sf).select("roster_id", "vec_id")
    vec = frozen.vectors.select("vec_id", "embedding")
    rows = pairings(spark, sf)
    names = rows.columns
    # both sides' ids first: a vector moves once per pairing, not per roster
    for name in ("a", "b"):
        rows = rows.join(ids.select(F.col("roster_id").alias(f"roster_{name}"), F.col("vec_id").alias(f"_{name}")), f"roster_{name}")
    for name in ("a", "b"):
        rows = rows.join(vec.select(F.col("vec_id").alias(f"_{name}"), F.col("embedding").alias(name)), f"_{name}")
    return rows.select(*names, "a", "b")


# --- text forms of the same records ---


def packed_text() -> Column:
    """Member list to packed text."""

    def one(m: Column) -> Column:
        blank = F.lit("")
        return F.concat_ws(
            "|", m["species"], blank, m["item"], m["ability"], F.array_join(m["moves"], ","), m["nature"],
            blank, F.when(m["ability"] == "N", "F").otherwise(""), blank, blank, m["level"].cast("string"), blank,
        )

    return F.array_join(F.transform("members", one), "]")


def export_text() -> Column:
    """Member list to export text; every form of header and some ignored lines occur."""

    def one(m: Column) -> Column:
        named = F.when(m["nature"] == "O", F.concat(F.lit("Nick ("), m["species"], F.lit(")"))).otherwise(m["species"])
        head = F.concat(named, F.when(m["ability"] == "N", " (F)").otherwise(""), F.lit(" @ "), m["item"])
        return F.concat(
            head,
            F.lit("\nAbility: "), m["ability"],
            F.lit("\nLevel: "), m["level"].cast("string"),
            F.lit("\nEVs: 4 HP / 252 Spe\n"), m["nature"],
            F.lit(" Nature\n- "), F.array_join(m["moves"], "\n- "),
        )

    return F.array_join(F.transform("members", one), "\n\n")


def battle_logs(spark: SparkSession, sf: str) -> DataFrame:
    """(battle_id, ts, season, log): two neighbouring rosters per log, the dearer order wins."""
    orders = table(spark, sf, "orders")
    shown = orders.join(
        member_lists(spark, sf).select("roster_id", packed_text().alias("packed")),
        F.col("o_orderkey") == F.col("roster_id"),
    )
    tag = F.concat(F.lit("p"), (F.col("o_orderkey") % 2 + 1).cast("string"))
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    side = F.struct(
        tag.alias("tag"),
        F.concat_ws("\n", F.concat(F.lit("|player|"), tag, F.lit("|"), name, F.lit("|"))).alias("player_line"),
        F.concat(F.lit("|showteam|"), tag, F.lit("|"), F.col("packed")).alias("team_line"),
        F.col("o_totalprice").alias("price"),
        name.alias("name"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.col("o_orderstatus").alias("status"),
    )
    # a battle has one row per side: order keys are unique, so two at most
    both = shown.groupBy(F.floor(F.col("o_orderkey") / 2).alias("battle_id")).agg(
        F.sort_array(F.collect_list(side)).alias("s")
    )
    decided = F.exists("s", lambda x: x["status"] != "P")
    winner = F.array_max(F.transform("s", lambda x: F.struct(x["price"], x["name"])))["name"]
    log = F.concat_ws(
        "\n",
        F.array_join(F.transform("s", lambda x: x["player_line"]), "\n"),
        F.lit("|start"),
        F.array_join(F.transform("s", lambda x: x["team_line"]), "\n"),
        F.lit("|turn|1"),
        F.when(decided, F.concat(F.lit("|win|"), winner)),
    )
    ts = F.get("s", F.lit(0))["ts"]
    return both.select(
        F.col("battle_id").cast("string").alias("battle_id"),
        ts.alias("ts"),
        F.concat(F.lit("y"), F.year(F.timestamp_seconds(ts)).cast("string")).alias("season"),
        log.alias("log"),
    )


def standings_json(spark: SparkSession, sf: str) -> str:
    """Write customers as events with their orders as standings; returns the folder.

    An event's standings go out in documents of at most 1,000 order keys, so a
    customer with a large part of all orders does not become one document.
    """
    path = fresh_path(spark, "standings")
    orders = table(spark, sf, "orders").join(member_lists(spark, sf), F.col("o_orderkey") == F.col("roster_id"))
    entry = F.transform(
        "members",
        lambda m: F.struct(
            F.when(m["nature"] == "F", m["species"]).alias("id"),
            m["species"].alias("name"),
            m["item"].alias("item"),
            m["ability"].alias("ability"),
            m["moves"].alias("attacks"),
            m["nature"].alias("nature"),
        ),
    )
    standing = F.struct(
        F.col("o_orderkey").cast("string").alias("player"),
        F.floor(F.col("o_totalprice") / 10000).cast("string").alias("placing"),
        F.when(F.col("o_orderstatus") != "P", entry).alias("decklist"),
    )
    docs = (
        orders.withColumn("standing", standing)
        .groupBy("o_custkey", F.floor(F.col("o_orderkey") / 1000))
        .agg(F.collect_list("standing").alias("standings"), F.min("o_orderdate").cast("timestamp").alias("d"))
    )
    docs.select(
        F.struct(
            F.col("o_custkey").cast("string").alias("id"),
            F.concat(F.lit("Event "), F.col("o_custkey").cast("string")).alias("name"),
            F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        ).alias("tournament"),
        "standings",
    ).write.json(path)
    return path


def event_index(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as events: name with segment, players = orders, date of the first order."""
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("int").alias("players"), F.min("o_orderdate").cast("timestamp").alias("ts")
    )
    return people.join(counts, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        "ts",
        "players",
    )


def latest_season(rows: DataFrame) -> str:
    """Season of the latest period among the rows (season, period)."""
    return rows.agg(F.max_by("season", "period")).first()[0]
