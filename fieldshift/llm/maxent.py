"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

A token is a word, A-Z lower-cased, or the end of its text. The ``HEAD`` most frequent training
tokens are outcomes of their own, ``WIDTH`` to a class; all other words fall into
``TAILS`` classes by a hash of their last two bytes. The model is

    P(token | h) = P(class | h) * P(token | class, h)

with a softmax over classes, and in head classes one over the class's tokens. In a tail
class a word has probability (c + 1) / (n + v + 1), c being its training
count, n and v the class's tokens and distinct words; one share is left for
unseen words. Features are the previous word, the words two and three back (skips), the pair
of the two previous words, and class with previous or second-last word; each
hashes to a row of weights, starting from log unigram probabilities.

Training passes once over all training texts, in ``ROUNDS`` slices. In a round
every task runs AdaGrad from the current weights over its texts, and the tasks'
weights are averaged, by text volume, in Spark. The model's size is fixed.

Counts of the ``KNOWN`` most frequent words travel to the scoring tasks; counts of
rarer words are joined in by word.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.substring_dedup import tag_of
from fieldshift.llm.tables import as_bytes, mapped, pieces, stage

END = b""
HEAD, WIDTH, TAILS = 1024, 64, 16
CLASSES = HEAD // WIDTH + TAILS
CONTEXTS = 2 * HEAD
START = CONTEXTS - 1
PAIRS, INNER = 4096, 4096
KNOWN = 1 << 18
KNOWN_BYTES = 64
REMEMBERED = 400_000
ROUNDS = 4
BATCH = 16_384
#: Tokens scored at once: what they need stays in a core's cache.
PART = 4096
#: Bytes of text whose tokens are worked on at once.
SLICE = 2 << 20
RATE = 0.25
#: Rows of a run that are added one by one.
LONG = 32
#: Rows of each weight table, and whether they score classes or the tokens of a class.
SHAPES = {
    "previous": (CONTEXTS, CLASSES),
    "second": (CONTEXTS, CLASSES),
    "third": (CONTEXTS, CLASSES),
    "pair": (PAIRS, CLASSES),
    "inner_previous": (INNER, WIDTH),
    "inner_second": (INNER, WIDTH),
}
OUTER, INSIDE = tuple(SHAPES)[:4], tuple(SHAPES)[4:]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts (bytes), A-Z lower-cased, one text after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    flat = split.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at a text's ends leaves empty words
    if not full.all():
        flat, text = flat.filter(pa.array(full)), text[full]
    return flat.view(pa.binary()), np.bincount(text, minlength=len(texts))


def listed(words: pa.Array) -> list[bytes]:
    """Words as Python bytes; none holds white space, so they are joined by a line break and split."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")
    return joined[0].as_py().split(b"\n") if len(words) else []


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts, the end token being the empty word. Each task sums before it sends."""

    def count(batches):
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
            )
            total.clear()
            return out

        for part in pieces(batches, "t"):
            held = words_of(part.column(0))[0].value_counts()
            total.update(dict(zip(listed(held.field(0)), held.field(1).to_pylist())))
            total[END] += part.num_rows
            if len(total) > REMEMBERED:
                yield flush()
        yield flush()

    rows = docs.select(as_bytes().alias("t")).mapInArrow(count, "word binary, n long")
    return stage(rows.groupBy("word").agg(F.sum("n").alias("n")), "word_counts")


class Vocabulary:
    """Frequent words with their counts, outcomes and context ids; totals of the training tokens."""

    def __init__(self, known: list[tuple[bytes, int]], tokens: int, distinct: int, tails: dict[int, tuple[int, int]]):
        known = sorted(known, key=lambda x: (-x[1], x[0]))
        self.rank = {w: i for i, (w, _) in enumerate(known)}
        self.counts = np.array([0] + [c for _, c in known], np.int64)
        self.tokens, self.distinct = tokens, distinct
        self.head = min(HEAD, len(known))
        tail = [tails.get(g, (0, 0)) for g in range(TAILS)]
        self.tail_tokens = np.array([n for n, _ in tail], np.float64)
        self.tail_words = np.array([v for _, v in tail], np.float64)

    def pack(self, word: bytes) -> int:
        """Outcome, context id and place among the known words (0: not known) in one number."""
        at = self.rank.get(word, -1)
        if 0 <= at < self.head:
            return at | at % START << 11 | (at + 1) << 23
        context = HEAD + zlib.crc32(word[-3:]) % (CONTEXTS - HEAD - 1)
        return HEAD + tail_class(word) | context << 11 | (at + 1) << 23


class Packed(dict):
    """Packed words of a worker; only known words are remembered, so it is no larger than the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        value = self.vocabulary.pack(word)
        if value >> 23:
            self[word] = value
        return value


_PACKED: list[Packed] = []


def packed_words(shared: Broadcast) -> Packed:
    """The worker's table for a broadcast vocabulary, kept between tasks."""
    if not _PACKED or _PACKED[0].vocabulary is not shared.value:
        _PACKED[:] = [Packed(shared.value)]
    return _PACKED[0]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collects at most ``KNOWN`` words of at most ``KNOWN_BYTES`` bytes, the end, and totals."""
    tail = F.crc32(F.expr("substring(word, -2, 2)")) % TAILS
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    short = counts.where(F.length("word") <= KNOWN_BYTES)
    # counts fall into bins of an eighth of an octave: the bins that fit as a whole are collected
    bins = short.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("v")).collect()
    least, taken = None, 0
    for row in sorted(bins, key=lambda r: -r["bin"]):
        if taken + row["v"] > KNOWN:
            break
        least, taken = row["bin"], taken + row["v"]
    # the end is no word of a text, so its count can't be joined in: it is known however rare
    kept = F.length("word") == 0 if least is None else (F.length("word") == 0) | (F.floor(F.log2("n") * 8) >= least)
    known = [(bytes(r["word"]), r["n"]) for r in short.where(kept).collect()]
    heads = {w for w, _ in sorted(known, key=lambda x: (-x[1], x[0]))[:HEAD]}
    groups = counts.groupBy(tail.alias("g")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tails = {r["g"]: [r["n"], r["v"]] for r in groups}
    for word, n in known:
        if word in heads:
            tails[tail_class(word)][0] -= n
            tails[tail_class(word)][1] -= 1
    return Vocabulary(known, total["n"] or 0, total["v"], {g: tuple(x) for g, x in tails.items()})


def sums_of_rows(values: np.ndarray, order: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of runs of the float32 rows ``values[order]``; a width is even.

    Long runs are added row by row, which is contiguous. Of short ones two columns
    are added at once, as the parts of a complex number.
    """
    out = np.empty((len(start), values.shape[1]), np.float32)
    long = length > LONG
    for i in np.flatnonzero(long).tolist():
        values.take(order[start[i] : start[i] + length[i]], axis=0).sum(axis=0, out=out[i])
    short = length[~long]
    if len(short):
        rows = values.take(order[np.repeat(~long, length)], axis=0).view(np.complex64)
        out[~long] = np.add.reduceat(rows, np.cumsum(short) - short, axis=0).view(np.float32)
    return out


class Model:
    """Weights, and their use on arrays of tokens."""

    def __init__(self, vocabulary: Vocabulary, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights or {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        counts = np.zeros(HEAD)
        counts[: vocabulary.head] = vocabulary.counts[1 : vocabulary.head + 1]
        inner = counts.reshape(-1, WIDTH)
        outer = np.r_[inner.sum(axis=1), vocabulary.tail_tokens + 1]
        with np.errstate(divide="ignore"):
            self.outer_bias = np.maximum(np.log(outer / outer.sum()), -30).astype(np.float32)
            self.inner_bias = np.maximum(np.log(inner / np.maximum(inner.sum(axis=1, keepdims=True), 1)), -30).astype(np.float32)

    @staticmethod
    def sequence(words: np.ndarray, context: np.ndarray, lengths: np.ndarray, end: int):
        """Outcomes, an end after each text, and the three words before each."""
        doc = np.repeat(np.arange(len(lengths)), lengths)
        padded = np.full(len(words) + 3 * len(lengths), START, np.int64)
        padded[np.arange(len(words)) + 3 * (doc + 1)] = context
        doc_out = np.repeat(np.arange(len(lengths)), lengths + 1)
        outcome = np.full(len(doc_out), end, np.int64)
        outcome[np.arange(len(words)) + doc] = words
        g = np.arange(len(doc_out)) + 2 * doc_out
        return outcome, padded[g + 2], padded[g + 1], padded[g]

    @staticmethod
    def rows(outcome, one, two, three) -> dict[str, np.ndarray]:
        group = np.where(outcome < HEAD, outcome // WIDTH, 0)
        return {
            "previous": one,
            "second": two,
            "third": three,
            "pair": (one * 40503 + two * 2654435761 >> 7) % PAIRS,
            "inner_previous": (group * 2246822519 + one * 3266489917 >> 5) % INNER,
            "inner_second": (group * 668265263 + two * 374761393 >> 5) % INNER,
        }

    @staticmethod
    def exps(x: np.ndarray):
        """exp(x - shift), its sum over each row, and the shift: a row's largest value, or zero if all stay within single precision."""
        ones = np.ones(x.shape[1], np.float32)
        if x.size and x.max() < 60:
            out = np.exp(x)
            total = out.dot(ones)
            if total.min() > 1e-20:
                return out, total, np.float32(0)
        shift = x.max(axis=1, keepdims=True)
        out = np.exp(x - shift)
        return out, out.dot(ones), shift[:, 0]

    @classmethod
    def softmax(cls, x: np.ndarray) -> np.ndarray:
        x, total, _ = cls.exps(x)
        x /= total[:, None]
        return x

    def outer(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = self.weights[OUTER[0]].take(rows[OUTER[0]], axis=0)
        x += self.outer_bias
        taken = np.empty_like(x)
        for k in OUTER[1:]:
            x += np.take(self.weights[k], rows[k], axis=0, out=taken, mode="clip")
        return self.softmax(x)

    def inner(self, rows: dict[str, np.ndarray], head: np.ndarray, group: np.ndarray) -> np.ndarray:
        x = self.inner_bias.take(group, axis=0)
        taken = np.empty_like(x)
        for k in INSIDE:
            x += np.take(self.weights[k], rows[k][head], axis=0, out=taken, mode="clip")
        return self.softmax(x)

    def logs(self, tables: tuple[str, ...], rows: dict[str, np.ndarray], bias: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of place ``at`` of every row; no other is normalised."""
        x = self.weights[tables[0]].take(rows[tables[0]], axis=0)
        x += bias
        taken = np.empty_like(x)
        for k in tables[1:]:
            x += np.take(self.weights[k], rows[k], axis=0, out=taken, mode="clip")
        _, total, shift = self.exps(x)
        return (x[np.arange(len(at)), at] - shift).astype(np.float64) - np.log(total)

    def log10(self, outcome, one, two, three=None) -> np.ndarray:
        """log10 P(class) and, for head tokens, P(token | class), of each token; without ``three`` texts start at ``two``."""
        three = np.full(len(outcome), START) if three is None else three
        out = np.empty(len(outcome))
        for i in range(0, len(outcome), PART):
            part = slice(i, i + PART)
            o = outcome[part]
            rows = self.rows(o, one[part], two[part], three[part])
            at = np.where(o < HEAD, o // WIDTH, o - HEAD + HEAD // WIDTH)
            log = self.logs(OUTER, rows, self.outer_bias, at)
            head = np.flatnonzero(o < HEAD)
            log[head] += self.logs(INSIDE, {k: rows[k][head] for k in INSIDE}, self.inner_bias.take(at[head], axis=0), o[head] % WIDTH)
            out[part] = np.maximum(log / np.log(10.0), -300.0)
        return out

    def train(self, outcome, one, two, three, squares: dict[str, np.ndarray]) -> None:
        """AdaGrad steps over batches of tokens; a row moves by its mean gradient in the batch."""
        for i in range(0, len(outcome), BATCH):
            part = slice(i, i + BATCH)
            o = outcome[part]
            rows = self.rows(o, one[part], two[part], three[part])
            at = np.where(o < HEAD, o // WIDTH, o - HEAD + HEAD // WIDTH)
            gradient = self.outer(rows)
            gradient[np.arange(len(o)), at] -= 1
            for k in OUTER:
                self.step(k, rows[k], gradient, squares)
            head = np.flatnonzero(o < HEAD)
            if len(head):
                gradient = self.inner(rows, head, at[head])
                gradient[np.arange(len(head)), o[head] % WIDTH] -= 1
                for k in INSIDE:
                    self.step(k, rows[k][head], gradient, squares)

    def step(self, name: str, row: np.ndarray, gradient: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        order = np.argsort(row.astype(np.int16), kind="stable")
        sorted_ = row[order]
        start = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        touched = sorted_[start]
        length = np.diff(np.r_[start, len(order)])
        sums = sums_of_rows(gradient, order, start, length)
        sums /= np.sqrt(length, dtype=np.float32)[:, None]
        square = squares[name].take(touched, axis=0)
        square += sums * sums
        squares[name][touched] = square
        square += 1e-6
        sums *= RATE
        sums /= np.sqrt(square, out=square)
        self.weights[name][touched] -= sums

    def pack(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    @staticmethod
    def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, (a, b) in SHAPES.items():
            out[k] = flat[at : at + a * b].reshape(a, b).astype(np.float32)
            at += a * b
        return out


BLOCK = 1 << 16


def averaged(rows: DataFrame) -> np.ndarray:
    """Mean of the tasks' weights by volume; rows: block, salt, volume, values (float32).

    Summed per (block, salt), then per block; what reaches the driver is one model.
    """

    def summed(batches):
        now, total, volume = None, None, 0.0
        for batch in batches:
            for block, salt, v, values in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (block, salt) != now:
                    if now is not None and volume:
                        yield row(now, volume, total / volume)
                    now, total, volume = (block, salt), 0.0, 0.0
                total = total + v * np.frombuffer(values, np.float32).astype(np.float64)
                volume += v
        if now is not None and volume:
            yield row(now, volume, total / volume)

    def row(key, volume, values):
        values = [values.astype(np.float32).tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([volume]), pa.array(values, pa.binary())],
            ["block", "salt", "volume", "bytes"],
        )

    schema = "block int, salt int, volume double, bytes binary"
    once = rows.repartition("block", "salt").sortWithinPartitions("block", "salt").mapInArrow(summed, schema)
    once = once.withColumn("salt", F.lit(0)).repartition("block").sortWithinPartitions("block", "volume")
    parts = sorted((r["block"], bytes(r["bytes"])) for r in once.mapInArrow(summed, schema).collect())
    return np.frombuffer(b"".join(b for _, b in parts), np.float32)


def _slices(batches, words: Packed, column: int):
    """(record batch, words, packed words, lengths) of slices of bounded size; a slice's distinct words are packed once."""
    for part in pieces(batches, "t", SLICE):
        flat, lengths = words_of(part.column(column))
        coded = flat.dictionary_encode()
        distinct = np.fromiter(map(words.__getitem__, listed(coded.dictionary)), np.int64, len(coded.dictionary))
        yield part, flat, distinct[coded.indices.to_numpy(zero_copy_only=False)], lengths


def fit(docs: DataFrame, shared: Broadcast, rounds: int = ROUNDS) -> Model:
    """Model trained on every text of ``docs`` once; ``shared`` is the broadcast vocabulary."""
    model = Model(shared.value)
    sliced = docs.select(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rounds)).alias("round"), as_bytes().alias("t"))
    for r in range(rounds):
        weights = model.weights

        def task(batches):
            from pyspark import TaskContext

            vocabulary_ = shared.value
            own = Model(vocabulary_, {k: w.copy() for k, w in weights.items()})
            squares = {k: np.full(s, 0.1, np.float32) for k, s in SHAPES.items()}
            end, volume = vocabulary_.pack(END) & 2047, 0
            for _, _, packed, lengths in _slices(batches, packed_words(shared), 0):
                tokens = own.sequence(packed & 2047, packed >> 11 & 4095, lengths, end)
                own.train(*tokens, squares)
                volume += len(tokens[0])
            if volume:
                flat = own.pack()
                blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
                salt = TaskContext.get().partitionId() % 64
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(len(blocks)), pa.int32()),
                        pa.array([salt] * len(blocks), pa.int32()),
                        pa.array([float(volume)] * len(blocks)),
                        pa.array(blocks, pa.binary()),
                    ],
                    ["block", "salt", "volume", "bytes"],
                )

        rows = sliced.where(F.col("round") == r).select("t").mapInArrow(task, "block int, salt int, volume double, bytes binary")
        flat = averaged(rows)
        if len(flat):
            model = Model(shared.value, Model.unpack(flat))
    return model


def score(docs: DataFrame, model: Model, shared: Broadcast, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row; null text is empty.

    Rows equal in doc_id and text are summed together and parted again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        vocabulary_ = shared.value
        log_all = float(np.log10(vocabulary_.tokens + vocabulary_.distinct + 1))
        log_tail = np.log10(vocabulary_.tail_tokens + vocabulary_.tail_words + 1)
        log_count = np.log10(vocabulary_.counts + 1.0)
        end = vocabulary_.pack(END)
        at, words = 0, packed_words(shared)
        for part, flat, packed, lengths in _slices(batches, words, 2):
            n_docs = len(lengths)
            tokens = model.sequence(packed & 2047, packed >> 11 & 4095, lengths, end & 2047)
            logs = model.log10(*tokens)
            first = np.cumsum(lengths + 1) - (lengths + 1)
            scores = np.add.reduceat(logs, first)
            doc = np.repeat(np.arange(n_docs), lengths)
            known = packed >> 23
            tail = (packed & 2047) - HEAD
            each = log_count[known]
            base = np.bincount(doc, each, n_docs) + log_count[end >> 23] - (lengths + 1) * log_all
            scores += np.bincount(doc, np.where(tail >= 0, each - log_tail[np.maximum(tail, 0)], 0.0), n_docs)
            if end & 2047 >= HEAD:
                scores += log_count[end >> 23] - log_tail[(end & 2047) - HEAD]
            n_known = np.bincount(doc, known > 0, n_docs).astype(np.int64) + bool(end >> 23)
            # rows of documents get words that no text holds, so that they spread over the join's tasks
            marks = [b" %d %d" % (at, i) for i in range(n_docs)]
            at += 1
            rare = np.flatnonzero(known == 0)
            who = np.r_[np.arange(n_docs), doc[rare]]
            zeros = np.zeros(len(rare))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(who)),
                    part.column(1).take(pa.array(who)),
                    pa.concat_arrays([pa.array(marks, pa.binary()), flat.take(pa.array(rare))]),
                    pa.array(np.r_[np.ones(n_docs, np.int32), np.zeros(len(rare), np.int32)]),
                    pa.array(np.r_[lengths + 1, zeros.astype(np.int64)]),
                    pa.array(np.r_[n_known, zeros.astype(np.int64)]),
                    pa.array(np.r_[base, zeros]),
                    pa.array(np.r_[scores, zeros]),
                ],
                ["doc_id", "tag", "word", "rows", "n_tokens", "n_known", "base", "score"],
            )

    keyed = docs.select("doc_id", tag_of(as_bytes()).alias("tag"), as_bytes().alias("t"))
    rows = keyed.mapInArrow(
        task, f"doc_id {kind}, tag long, word binary, rows int, n_tokens long, n_known long, base double, score double"
    )
    rare = F.log10(F.coalesce("n", F.lit(0)) + 1.0)
    joined = rows.join(counts, "word", "left").groupBy("doc_id", "tag").agg(
        F.sum("rows").alias("rows"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.count("n")).alias("n_known"),
        (F.sum("base") + F.sum(rare)).alias("base_score"),
        (F.sum("score") + F.sum(rare)).alias("score"),
    )
    one = lambda c: (F.col(c) / F.col("rows")).alias(c)
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        "doc_id", one("n_tokens").cast("long"), one("n_known").cast("long"), one("base_score"), one("score")
    )


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows that are not held out, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    train = docs.where(~held_out())
    counts = word_counts(train)
    words = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most KNOWN words of KNOWN_BYTES bytes
    model = fit(train, shared, rounds)
    out = score(docs, model, shared, counts)
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
