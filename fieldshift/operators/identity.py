"""Roster identity: canonical hash, de-duplication, inspection text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldshift.functions.draws import numbered

HASH_LENGTH = 16
SEQ_BLOCK = 1 << 20


def roster_hash(members: Column) -> Column:
    """SHA-256 prefix over members and moves in canonical order."""
    signature = F.transform(
        members,
        lambda m: F.to_json(
            F.struct(
                m["ability"].alias("ability"),
                m["item"].alias("item"),
                F.sort_array(m["moves"]).alias("moves"),
                m["nature"].alias("nature"),
                m["species"].alias("species"),
            )
        ),
    )
    payload = F.concat(F.lit("["), F.array_join(F.sort_array(signature), ","), F.lit("]"))
    return F.substring(F.sha2(payload, 256), 1, HASH_LENGTH)


def dedupe_rosters(rosters: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per distinct roster: the first seen by ``seq`` (unique), and how often it occurred.

    A roster is hashed once; only hashes and sequence numbers are aggregated, and each hash's first number fetches its roster.
    """
    fields = [c for c in rosters.columns if c != "roster_hash"]
    hashed = rosters.select(seq, roster_hash(F.col("members")).alias("roster_hash"))
    firsts = hashed.groupBy("roster_hash").agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias("occurrence_count"))
    return rosters.select(*fields).join(firsts, seq).select("roster_hash", *fields, "occurrence_count")


def duplicate_row_keys(rosters: DataFrame, seq: str = "seq") -> DataFrame:
    """Every row keyed ``<hash>-<running occurrence>``; hot hashes are numbered in blocks."""
    hashed = rosters.withColumn("roster_hash", roster_hash(F.col("members")))
    ranked = numbered(
        hashed, ["roster_hash"], [F.floor(F.col(seq) / SEQ_BLOCK)], [F.col(seq)], "_occurrence"
    )
    return ranked.withColumn("row_key", F.concat_ws("-", "roster_hash", F.col("_occurrence").cast("string"))).drop(
        "_occurrence"
    )


def inspection_fields(rosters: DataFrame) -> DataFrame:
    """Readable columns: joined species, items, abilities, natures, moves."""

    def joined(field: str) -> Column:
        return F.array_join(F.transform("members", lambda m: m[field]), " | ")

    moves = F.transform("members", lambda m: F.concat(m["species"], F.lit(": "), F.array_join(m["moves"], ", ")))
    return rosters.select(
        *[c for c in rosters.columns if c != "members"],
        joined("species").alias("species"),
        joined("item").alias("items"),
        joined("ability").alias("abilities"),
        joined("nature").alias("natures"),
        F.array_join(moves, " | ").alias("moves"),
    )
