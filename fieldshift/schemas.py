"""Schemas of the records that enter from files."""

from __future__ import annotations

from pyspark.sql import types as T

MEMBER = T.StructType(
    [
        T.StructField("species", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("ability", T.StringType()),
        T.StructField("moves", T.ArrayType(T.StringType())),
        T.StructField("nature", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("gender", T.StringType()),
    ]
)

ROSTER = T.StructType(
    [
        T.StructField("roster_id", T.StringType()),
        T.StructField("season", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("player", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("members", T.ArrayType(MEMBER)),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("players", T.IntegerType()),
    ]
)

DECK_ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("ability", T.StringType()),
        T.StructField("attacks", T.ArrayType(T.StringType())),
        T.StructField("nature", T.StringType()),
    ]
)

# placing is text: absent and non-numeric placings occur
STANDINGS = T.StructType(
    [
        T.StructField("tournament", EVENT),
        T.StructField(
            "standings",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("player", T.StringType()),
                        T.StructField("placing", T.StringType()),
                        T.StructField("decklist", T.ArrayType(DECK_ENTRY)),
                    ]
                )
            ),
        ),
    ]
)

PANEL = "period string, unit string, n bigint, weight double, share double, win_rate double"
