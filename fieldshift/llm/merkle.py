"""Merkle manifest of a dataset: leaf digests, group roots, one root, and a proof per row.

Leaves of a group are numbered by key. The number's digits are grouped away one
after the other inside blocks of ``2 ** (DIGIT * DIGITS)`` leaves: a grouping
collects the structs that share the remaining digits, hashes them level by level
and nests them in one struct of the next digit. A block is hashed by one
exchange, since all its groupings keep the block as a key. A last transform and
two explodes unnest the structs and hand every leaf its siblings; leaves are
joined with nothing. Block digests, one per block, are numbered leaves again, so
the tree above is built by the same step until one node is left, and its paths
come back to the blocks by their number: a nested row is bounded at any size.

Defined cases: a null field is ``-``; null keys come first, rows with one key
are ordered by leaf digest and repeated rows keep a leaf each; a null group is a
group of its own, before all others; empty text is a value of 0 bytes; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.llm.tables import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a digit, and digits of a block: 1,024 leaves.
DIGIT, DIGITS = 5, 2


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _levels(n: Column) -> Column:
    """How often a run of n nodes is halved until one is left."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")


def _placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds (n, r): nodes of the group and the node's number in it, without one task per group.

    ``nodes`` is a written table with the group in ``g``. It is dealt by ranges
    of (group, order) and written; nodes are numbered inside (range, group) and
    shifted by the group's earlier ranges.
    """
    dealt = nodes.repartitionByRange("g", *order).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt, f"{name}-dealt")
    whole = Window.partitionBy("g")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = starts.select("g", "_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"), F.sum("_c").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("g", "_part").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(starts, ["g", "_part"]).withColumn("r", F.col("_in") + F.col("_off")).drop("_in", "_off", "_part")


def _halved(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.lit(""))))


def _entry(level: Column, place: Column) -> Column:
    """Sibling of a node: ``L`` or ``R`` for its side and its digest; empty for a lone node."""
    left = F.concat(F.lit("L"), F.get(level, place - 1))
    right = F.concat(F.lit("R"), F.get(level, place + 1))
    return F.when(place % 2 == 1, left).otherwise(F.coalesce(right, F.lit("")))


def _grouped(nodes: DataFrame, keys: list[str], pos: str, payload: list[str], digit: int, bits: int) -> DataFrame:
    """Group one digit away: (keys, kids, l1.., hash), kids in the digit's order."""
    kids = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), "hash", *payload)))
    rows = nodes.groupBy(*keys).agg(kids.alias("kids"))
    rows = rows.withColumn("l0", F.transform("kids", lambda k: k["hash"]))
    steps = _levels(F.col("n")) - digit * bits
    for k in range(bits):
        rows = rows.withColumn(f"l{k + 1}", F.when(steps > k, _halved(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return rows.withColumn("hash", F.get(F.col(f"l{bits}"), 0))


def _paths(rows: DataFrame, digit: int, bits: int, above: Column) -> Column:
    """Path of every kid of a grouped row: its siblings inside the digit, then the path above."""
    steps = F.greatest(F.least(_levels(F.col("n")) - digit * bits, F.lit(bits)), F.lit(0))

    def path(pos: Column) -> Column:
        inside = F.array(*[_entry(F.col(f"l{k}"), F.shiftright(pos, k)) for k in range(bits)])
        return F.concat(F.slice(inside, F.lit(1), steps), above)

    return F.transform("kids", lambda k: F.struct(k.alias("kid"), path(k["pos"]).alias("path")))


def _built(nodes: DataFrame, payload: list[str], bits: int, digits: int, name: str) -> list[DataFrame]:
    """Tables of nested blocks (g, n, block, hash, ...) of ``nodes`` (g, n, r, hash, payload), then of their digests, up to one block a group."""
    size = 1 << (bits * digits)
    most = nodes.agg(F.max("n")).first()[0] or 0
    tables = []
    while True:
        rows = nodes.withColumn("block", F.floor(F.col("r") / size)).repartition("g", "block")
        names = [f"d{d}" for d in range(digits)]
        for d, column in enumerate(names):
            rows = rows.withColumn(column, (F.shiftright("r", d * bits) % (1 << bits)).cast("int"))
        held = payload
        for d in range(digits):
            rows = _grouped(rows, ["g", "n", "block", *names[d + 1 :]], names[d], held, d, bits)
            held = ["kids", *[f"l{k}" for k in range(bits)]]
        rows = stage(rows.select("g", "n", "block", "hash", *held), f"{name}-blocks")
        tables.append(rows)
        if most <= size:
            return tables
        nodes = rows.select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("r"), "hash")
        payload, most = ["r"], -(-most // size)


def _opened(tables: list[DataFrame], payload: list[str], carried: list[str], crown: DataFrame, bits: int, digits: int) -> DataFrame:
    """Unnest the tables from the top down: (g, carried, path, payload) per node; ``crown`` is (g, carried, path)."""
    above, keys = crown, ["g"]
    for level, rows in reversed(list(enumerate(tables))):
        rows = rows.join(above, keys)
        for d in reversed(range(digits)):
            fields = [f"o.kid.{c}" for c in (["kids", *[f"l{k}" for k in range(bits)]] if d else payload if level == 0 else ["r"])]
            rows = rows.select("g", "n", *carried, F.explode(_paths(rows, d, bits, F.col("path"))).alias("o"))
            rows = rows.select("g", "n", *carried, "o.path", *fields)
        above, keys = rows.drop("n").withColumnRenamed("r", "block"), ["g", "block"]
    return above


def siblings(path: Column) -> Column:
    """Digests of a path, from the leaf up, in one string."""
    return F.array_join(F.transform(path, lambda e: F.substr(e, F.lit(2))), "")


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its siblings lead to."""

    def step(node: Column, e: Column) -> Column:
        other = F.substr(e, F.lit(2))
        return F.when(F.startswith(e, F.lit("L")), digest(other, node)).otherwise(digest(node, other))

    return F.aggregate(path, leaf, step)


def tampered(key: str) -> Column:
    """Rows that the check of the proofs alters: one key in seven, by CRC-32 of its decimal digits."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    altered: str = "n_chars",
    bits: int = DIGIT,
    digits: int = DIGITS,
) -> DataFrame:
    """(key, group, leaf, altered_leaf, subroot, root, path) per row.

    ``altered_leaf`` is the leaf of the row with one more in the ``altered``
    column, for the rows that ``tampered`` picks, else null. ``path`` holds the
    siblings up to the root, ``L`` or ``R`` before each, empty where a node is alone.
    """
    one_more = {altered: (F.col(altered).cast("decimal(38,0)") + 1)}
    other = digest(*[encoded(one_more.get(f, F.col(f))) for f in fields])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("v"), F.col(group)), F.lit("n")).alias("g"),  # null comes first
        F.col(key).alias("key"),
        digest(*[encoded(F.col(f)) for f in fields]).alias("hash"),
        F.when(tampered(key) & F.col(altered).isNotNull(), other).alias("altered_leaf"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = _placed(stage(leaves, "merkle-leaves"), ["key", "hash", "row"], "merkle")
    leaves = stage(leaves.select("g", "n", "r", "key", "hash", "altered_leaf"), "merkle-numbered")
    payload = ["key", "altered_leaf"]
    blocks = _built(leaves, payload, bits, digits, "merkle")
    tops = blocks[-1].select(F.lit("").alias("g"), "hash", F.col("g").alias("name"))
    tops = _placed(stage(tops, "merkle-tops"), ["name"], "merkle-groups")
    crowns = _built(stage(tops.select("g", "n", "r", "hash", "name"), "merkle-subroots"), ["name"], bits, digits, "merkle-root")
    root = crowns[-1].select("g", F.col("hash").alias("root"), F.expr("array()").cast("array<string>").alias("path"))
    crown = _opened(crowns, ["name", "hash"], ["root"], root, bits, digits)
    crown = crown.select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "root", "path")
    rows = _opened(blocks, [*payload, "hash"], ["subroot", "root"], crown, bits, digits)
    name = F.when(F.startswith("g", F.lit("v")), F.substr("g", F.lit(2)))
    return rows.select(
        F.col("key").alias(key), name.alias(group), F.col("hash").alias("leaf"), "altered_leaf", "subroot", "root", "path"
    )
