"""Mixing sources to target weights by packed blocks and index permutations.

Each source's documents form one stream of words, cut into blocks of ``BLOCK``
words. Targets are source weights' shares of ``budget`` times all words, no
source above ``max_repeats`` times its size; what is above goes to the others by
weight. A source's number of slots is its expected count, rounded, so it comes to its
target within a block. The output is a sequence of shards of about ``SLOTS``
slots; a source puts the whole part of its mean in each and deals the rest by a
multinomial draw. Its slots are numbered across shards, and slot q takes block
``permutation(q mod n)`` of pass ``q div n``, so every block is used once before
any is used again, and at most ``max_repeats`` times.

Draws and permutations depend on seed, shard and source only. Sources are
counted per stream bucket and never gathered in one task; the table of sources
itself (a row each, like the weights) is held by the driver up to ``MAX_SOURCES``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldshift.llm.tables import as_bytes, mapped, stage

BLOCK = 32
SLOTS = 4096
RUN = 1000
BUDGET = 1.5
MAX_REPEATS = 2
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20
BUCKET_ROWS = 20_000
MAX_SOURCES = 100_000
SLICE = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fill(sizes: np.ndarray, weights: np.ndarray, budget: float, most: float) -> np.ndarray:
    """Targets: ``budget`` shared by weight, none above ``most`` times its size."""
    room = most * sizes
    target = np.zeros(len(sizes))
    free = sizes > 0
    left = min(budget, float(room.sum()))
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share >= room)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = room[over]
        left -= float(room[over].sum())
        free &= ~over
    return target


def permuted(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at the given places: a four-round Feistel network, walked until below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.sha256(key.encode()).digest(), "<u8")
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            x = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((x >> np.uint64(29)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """__row, doc_id, source, size in words and text hash of every row; written. ``docs`` has __row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        counts = pa.array([len(t.split()) for t in part.column(4).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), counts], ["__row", "doc_id", "source", "h", "size"])

    rows = docs.select("__row", "doc_id", "source", F.xxhash64("text").alias("h"), as_bytes().alias("t"))
    return stage(mapped(rows, "t", fn, f"__row long, doc_id {kind}, source string, h long, size long", SLICE), "sizes")


def plan(sizes: DataFrame, weights: Callable[[int], float], budget: float, most: int) -> list[dict]:
    """Number, name, size, target, blocks and expected slots of each source, in code point order, null last."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    size = np.array([r["size"] for r in rows], np.float64)
    target = fill(size, np.array([weights(i) for i in range(len(rows))], np.float64), budget * float(size.sum()), most)
    blocks = np.ceil(size / BLOCK)
    slots = np.where(size > 0, target * blocks / np.maximum(size, 1), 0.0)
    return [
        {"ix": i, "source": r["source"], "size": r["size"], "target": float(t), "blocks": int(b), "slots": float(k)}
        for i, (r, t, b, k) in enumerate(zip(rows, target, blocks, slots))
    ]


def totals(sources: list[dict]) -> np.ndarray:
    """Slots of each source: the expected count, rounded up or down along the running sum of the fractions.

    All together come to the rounded sum. The cap is a whole number of slots, so rounding stays within it.
    """
    expected = np.array([s["slots"] for s in sources], np.float64)
    whole = np.floor(expected + 1e-6)
    upto = np.floor(np.cumsum(np.maximum(expected - whole, 0.0)) + 0.5)
    return (whole + np.diff(upto, prepend=0.0)).astype(np.int64)


def shard_counts(ix: int, slots: int, shards: int, seed: int):
    """(first shard, slots of it and the following) per run of ``RUN`` shards; all counts of a source add up to ``slots``.

    The whole part of the mean in every shard, and the rest by a multinomial draw:
    first over the runs, then inside each run.
    """
    whole, rest = divmod(slots, shards)
    begin = np.arange(0, shards, RUN)
    width = np.minimum(RUN, shards - begin)
    extra = np.random.default_rng([seed, ix]).multinomial(rest, width / shards)
    for f, w, e in zip(begin.tolist(), width.tolist(), extra.tolist()):
        if whole or e:
            yield f, whole + np.random.default_rng([seed, ix, f]).multinomial(e, np.full(w, 1 / w))


def drawn(spark, sources: list[dict], most: int, seed: int) -> DataFrame:
    """ix, block, passes: the blocks taken, with a bit for each pass that takes them."""
    slots_of = totals(sources)
    shards = max(1, int(np.ceil(slots_of.sum() / SLOTS)))

    def counts(batches):
        for batch in batches:
            for ix in batch.column(0).to_pylist():
                base = 0
                for _, n in shard_counts(ix, int(slots_of[ix]), shards, seed):
                    # first slot number of each (source, shard)
                    first = base + np.cumsum(n) - n
                    base += int(n.sum())
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), ix)), pa.array(first[at]), pa.array(n[at])], ["ix", "first", "n"]
                    )

    placed = spark.range(len(sources)).mapInArrow(counts, "ix long, first long, n long")
    blocks = [s["blocks"] for s in sources]

    def slots(batches):
        for batch in batches:
            for ix, first, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                q = np.arange(first, first + n)
                for e in np.unique(q // blocks[ix]).tolist():
                    block = permuted(q[q // blocks[ix] == e] % blocks[ix], blocks[ix], f"{seed}:{ix}:{e}")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(block), ix, np.int32)),
                            pa.array(block),
                            pa.array(np.full(len(block), 1 << e, np.int32)),
                        ],
                        ["ix", "block", "passes"],
                    )

    rows = placed.repartition("ix", "first").mapInArrow(slots, "ix int, block long, passes int")
    return rows.groupBy("ix", "block").agg(F.bit_or("passes").alias("passes"))


def taken_pieces(
    sizes: DataFrame,
    weights: Callable[[int], float] = lambda i: WEIGHTS[i % len(WEIGHTS)],
    budget: float = BUDGET,
    most: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """Every row's blocks: __row, doc_id, size, source_size, target, start (word in the text), words, passes (null: not taken).

    A row without words has one block of no words. Within a source the stream runs by
    (hash bucket of doc_id, doc_id, text hash).
    """
    spark = sizes.sparkSession
    sources = plan(sizes, weights, budget, most)
    schema = "ix int, __source string, source_size long, target double"
    table = spark.createDataFrame([(s["ix"], s["source"], s["size"], s["target"]) for s in sources], schema)
    # the driver holds this table already, at most MAX_SOURCES rows: no shuffle by source, one of which may be hot
    rows = sizes.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
    buckets = max(1, -(-sizes.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("ix", "bucket").agg(F.sum("size").alias("sum"))
    base = F.coalesce(F.sum("sum").over(before.partitionBy("ix").orderBy("bucket")), F.lit(0))
    sums = sums.withColumn("base", base).drop("sum")
    inside = F.coalesce(F.sum("size").over(before.partitionBy("ix", "bucket").orderBy("doc_id", "h")), F.lit(0))
    rows = rows.withColumn("inside", inside).join(sums, ["ix", "bucket"]).withColumn("at", F.col("base") + F.col("inside"))
    end = F.col("at") + F.col("size")
    last = F.when(F.col("size") > 0, F.floor((end - 1) / BLOCK)).otherwise(F.floor(F.col("at") / BLOCK))
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), last)))
    low, high = F.greatest(F.col("at"), F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    rows = rows.select(
        "__row", "doc_id", "size", "source_size", "target", "ix", "block", (low - F.col("at")).alias("start"), (high - low).alias("words")
    )
    # both sides are as long as the corpus; the planner can't see how many rows a function makes, so it is told to sort
    return rows.join(drawn(spark, sources, most, seed).hint("merge"), ["ix", "block"], "left")


def with_rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.monotonically_increasing_id())


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; a null text has no words, a null source is a source."""
    pieces = taken_pieces(sized(with_rows(docs)), **options)
    times = F.col("words") * F.coalesce(F.bit_count("passes"), F.lit(0))
    out = pieces.groupBy("__row", "doc_id", "size", "source_size", "target").agg(F.sum(times).cast("long").alias("taken"))
    return out.drop("__row")


def _text_of(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The stretches of text from word a to word b (exclusive), a line each."""
    spans = [m.span() for m in WORD.finditer(text)]
    if ranges == [(0, len(spans))]:
        return text
    return b"\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The input's columns; a row for each pass that takes words of a document, with the text it takes.

    A document taken whole keeps its text; of others, each stretch of taken words
    is a line. n_chars, if there, is the new length. Documents of which nothing is taken go.
    """
    kept = stage(with_rows(docs), "mixed_input")
    pieces = taken_pieces(sized(kept), **options).where("passes is not null and words > 0")
    lists = pieces.groupBy("__row").agg(F.collect_list(F.struct("start", "words", "passes")).alias("__pieces"))
    others = [c for c in docs.columns if c != "text"]
    both = kept.join(lists.hint("merge"), "__row").select(as_bytes().alias("__t"), "__pieces", *others)

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = [], []
        for i, (text, pieces) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
            for e in range(max(p["passes"] for p in pieces).bit_length()):
                ranges: list[list[int]] = []
                for start, words in sorted((p["start"], p["words"]) for p in pieces if p["passes"] >> e & 1):
                    if ranges and ranges[-1][1] == start:
                        ranges[-1][1] += words
                    else:
                        ranges.append([start, start + words])
                if ranges:
                    rows.append(i)
                    texts.append(_text_of(text, [tuple(r) for r in ranges]).decode("utf-8", "replace"))
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()), *(part.column(i).take(at) for i in range(2, part.num_columns))], ["__text", *others]
        )

    schema = ", ".join(["__text string"] + [f"`{c}` {both.schema[c].dataType.simpleString()}" for c in others])
    out = mapped(both, "__t", fn, schema, SLICE).withColumnRenamed("__text", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
