"""Rosters out of text: packed strings, battle logs, exports, standings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldshift.functions.vectors import let

FULL_SIZE = 6
SOURCE_WEIGHT = 8.0
DIGITS = "^[0-9]+$"
BLANKS = " \t\n\x0b\f\r"

# Positions of the fields in a packed member.
PACKED = {"species": 0, "item": 2, "ability": 3, "moves": 4, "nature": 5, "gender": 7, "level": 10}


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _lines(text: Column) -> Column:
    """Lines without white space at their ends, empty ones left out."""
    ended = F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n")
    return F.filter(F.transform(ended, _strip), lambda s: s != "")


def _level(text: Column) -> Column:
    return F.when(text.rlike(DIGITS), text.cast("int"))


def parse_packed(packed: Column) -> Column:
    """Packed text to an array of members; absent fields are empty strings."""

    def member(fields: Column) -> Column:
        def at(name: str) -> Column:
            return _strip(F.coalesce(F.get(fields, F.lit(PACKED[name])), F.lit("")))

        moves = F.filter(F.transform(F.split(at("moves"), ","), _strip), lambda m: m != "")
        return F.struct(
            at("species").alias("species"),
            at("item").alias("item"),
            at("ability").alias("ability"),
            moves.alias("moves"),
            at("nature").alias("nature"),
            _level(at("level")).alias("level"),
            F.nullif(at("gender"), F.lit("")).alias("gender"),
        )

    parts = F.filter(F.transform(F.split(packed, "]"), _strip), lambda p: p != "")
    return F.transform(F.transform(parts, lambda p: F.split(p, r"\|", -1)), member)


def rosters_of_logs(battles: DataFrame) -> DataFrame:
    """(battle_id, ts, season, log) to one roster per shown side.

    The lines of a log stay inside its row: a side's last shown team and last
    player win, and so does the last winner line. No line is shuffled.
    """
    lines = _lines(F.col("log"))

    def events(kind: str, least: int) -> Column:
        """Fields of the lines of one kind, with or without the bar that opens a line; no other line is cut."""
        bare = F.transform(
            F.filter("_lines", lambda s: F.startswith(s, F.lit(f"|{kind}|")) | F.startswith(s, F.lit(f"{kind}|"))),
            lambda s: F.when(F.startswith(s, F.lit("|")), F.substring(s, 2, 1 << 30)).otherwise(s),
        )
        return F.filter(F.transform(bare, lambda s: F.split(s, r"\|", -1)), lambda p: F.size(p) >= least)

    def team(rest: Column) -> Column:
        """Side and packed team behind the kind of a line; both are empty where no bar parts them."""
        side = F.substring_index(rest, "|", 1)
        packed = F.substring(rest, F.char_length(side) + 2, F.lit(1 << 30))
        parted = F.contains(rest, F.lit("|"))
        return F.struct(F.when(parted, side).otherwise("").alias("side"), F.when(parted, packed).otherwise("").alias("packed"))

    teams = F.filter("_lines", lambda s: s.startswith("|showteam|"))
    shown = F.transform(F.transform(teams, lambda s: F.substring(s, len("|showteam|") + 1, 1 << 30)), team)
    players = F.transform(
        events("player", 3),
        lambda p: F.struct(F.get(p, F.lit(1)).alias("side"), F.get(p, F.lit(2)).alias("player")),
    )
    df = battles.select("battle_id", "ts", "season", lines.alias("_lines"))
    df = df.select(
        "battle_id",
        "ts",
        "season",
        shown.alias("_sides"),
        players.alias("_players"),
        _last(F.transform(events("win", 2), lambda p: F.get(p, F.lit(1)))).alias("_winner"),
    )
    names = F.array_distinct(F.transform("_sides", lambda s: s["side"]))
    df = df.withColumn("side", F.explode(names))
    df = df.withColumn("player", _last(F.filter("_players", lambda p: p["side"] == F.col("side")))["player"])
    df = df.withColumn("packed", _last(F.filter("_sides", lambda s: s["side"] == F.col("side")))["packed"])
    known = (F.col("_winner") != "") & (F.col("player") != "")
    return df.select(
        "battle_id",
        "side",
        "player",
        "ts",
        "season",
        F.when(known, F.col("player") == F.col("_winner")).alias("won"),
        parse_packed(F.col("packed")).alias("members"),
    )


def _last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def parse_export(text: Column) -> Column:
    """Export text to an array of members.

    Blocks are separated by blank lines; the first line is
    ``nickname (species) (gender) @ item``, other lines are recognised by form
    and unknown ones ignored.
    """

    def begins(line: Column, word: str) -> Column:
        return F.lower(F.left(line, F.lit(len(word)))) == word

    def after(line: Column, word: str) -> Column:
        return _strip(F.substring(line, len(word) + 1, 1 << 30))

    def in_last(head: Column) -> Column:
        """What the parentheses that end a head hold, else nothing."""
        closed = F.endswith(head, F.lit(")")) & F.contains(head, F.lit("("))
        return F.when(closed, let(F.rtrim(F.substring_index(head, "(", -1)), held_in)).otherwise("")

    def held_in(end: Column) -> Column:
        held = F.substring(end, F.lit(1), F.char_length(end) - 1)
        return F.when(~F.contains(held, F.lit(")")), held).otherwise("")

    def before_last(head: Column) -> Column:
        return _strip(F.substring(head, F.lit(1), F.char_length(head) - F.char_length(F.substring_index(head, "(", -1)) - 1))

    def without_gender(left: Column) -> Column:
        """Gender and what stands before it."""
        return let(
            in_last(left),
            lambda held: F.when(held.isin("M", "F", "N"), F.struct(held.alias("gender"), before_last(left).alias("named"))).otherwise(
                F.struct(F.lit("").alias("gender"), left.alias("named"))
            ),
        )

    def member(lines: Column) -> Column:
        return let(
            F.struct(
                F.get(lines, F.lit(0)).alias("head"),
                let(_strip(F.substring_index(F.get(lines, F.lit(0)), "@", 1)), without_gender).alias("left"),
                F.slice(lines, 2, 1 << 30).alias("rest"),
            ),
            fields,
        )

    def fields(p: Column) -> Column:
        bullet = lambda s: F.startswith(s, F.lit("- ")) | F.startswith(s, F.lit("-\t"))
        ability = _last(F.filter(p["rest"], lambda s: begins(s, "ability:")))
        digits = F.filter(
            F.transform(F.filter(p["rest"], lambda s: begins(s, "level:")), lambda s: after(s, "level:")), lambda v: v.rlike(DIGITS)
        )
        nature = _last(
            F.filter(
                p["rest"],
                lambda s: F.contains(F.lower(s), F.lit("nature"))
                & ~bullet(s) & ~begins(s, "ability:") & ~begins(s, "level:") & s.rlike(r"(?i)nature$"),
            )
        )
        moves = F.transform(F.filter(p["rest"], bullet), lambda s: after(s, "-"))
        return F.struct(
            let(in_last(p["left"]["named"]), lambda inner: F.when(inner != "", _strip(inner)).otherwise(p["left"]["named"])).alias("species"),
            _strip(F.regexp_extract(p["head"], r"^[^@]*@(.*)$", 1)).alias("item"),
            F.coalesce(let(ability, lambda s: after(s, "ability:")), F.lit("")).alias("ability"),
            moves.alias("moves"),
            F.coalesce(_strip(F.regexp_replace(nature, r"(?i)nature$", "")), F.lit("")).alias("nature"),
            _last(digits).cast("int").alias("level"),
            F.nullif(p["left"]["gender"], F.lit("")).alias("gender"),
        )

    blocks = F.filter(F.split(_strip(text), r"\n\s*\n"), lambda b: _strip(b) != "")
    return F.filter(F.transform(F.transform(blocks, _lines), member), lambda m: m["species"] != "")


def placement_weight(placing: Column, source_weight: float = SOURCE_WEIGHT) -> Column:
    """``source_weight * (1 + 1/rank)``; an unknown or non-positive rank adds nothing."""
    rank = placing.try_cast("int")
    return F.lit(source_weight) * F.when(rank > 0, 1.0 + 1.0 / rank).otherwise(F.lit(1.0))


def standing_rosters(standings: DataFrame, source_weight: float = SOURCE_WEIGHT) -> DataFrame:
    """Standings with a decklist to weighted rosters; the canonical id beats the name."""

    def member(entry: Column) -> Column:
        def text(name: str) -> Column:
            return F.coalesce(entry[name], F.lit(""))

        species = F.coalesce(F.nullif(entry["id"], F.lit("")), F.nullif(entry["name"], F.lit("")), F.lit(""))
        return F.struct(
            species.alias("species"),
            text("item").alias("item"),
            text("ability").alias("ability"),
            F.coalesce(entry["attacks"], F.array().cast("array<string>")).alias("moves"),
            text("nature").alias("nature"),
        )

    members = F.filter(F.transform("decklist", member), lambda m: m["species"] != "")
    return (
        standings.withColumn("members", members)
        .where(F.size("members") > 0)
        .select(
            F.col("event.id").alias("source_id"),
            F.coalesce("player", "name").alias("player"),
            F.unix_timestamp(F.to_timestamp("event.date")).alias("ts"),
            F.lit(None).cast("boolean").alias("won"),
            placement_weight(F.col("placing"), source_weight).alias("weight"),
            "members",
        )
    )


def full_rosters(rosters: DataFrame, size: int = FULL_SIZE) -> DataFrame:
    return rosters.where(F.size("members") == size)


def extract_pairings(
    rosters: DataFrame, max_battles: int | None = None, size: int | None = FULL_SIZE
) -> DataFrame:
    """Battles with exactly two (full) rosters and one winner.

    A battle has as many rows as it has sides, so the group is a handful of
    rows whatever the data size; only ids and outcomes are shuffled.
    """
    kept = rosters if size is None else full_rosters(rosters, size)
    sides = kept.groupBy("battle_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("side", "roster_id", "won")).alias("_a"),
        F.max(F.struct("side", "roster_id", "won")).alias("_b"),
    )
    decided = sides.where(
        (F.col("_n") == 2) & F.col("_a.won").isNotNull() & ~F.col("_a.won").eqNullSafe(F.col("_b.won"))
    )
    pairs = decided.select(
        F.col("battle_id").alias("pairing_id"),
        F.col("_a.roster_id").alias("roster_a"),
        F.col("_b.roster_id").alias("roster_b"),
        F.col("_a.won").cast("int").alias("label"),
    )
    return pairs if max_battles is None else pairs.limit(max_battles)
