"""Line dedup by a segment-partition edit join.

A line of a text (cut at newlines) that holds a word is removed when an equal
line, or one within ``EDITS`` byte edits, stands earlier: in a document with a
smaller doc_id or above it in the same one. Lines under ``MIN_BYTES`` bytes
are only compared for equality. Everything is judged on the input, so removal
does not depend on what else is removed.

Equal lines are found by hash. For the others, a line is split into EDITS + 1
segments. Two lines within EDITS edits share a segment of the shorter one as a
substring of the longer one at a place that the lengths leave possible; each
line is indexed under its segments and probes those substrings, for every
length it can meet. Lines whose keys meet are verified with a banded
bit-parallel edit distance over all pairs of a batch at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.runs import grouped, lagged, whole
from fieldshift.llm.substring_dedup import tag_of
from fieldshift.llm.tables import as_bytes, mapped, stage

EDITS = 2
MIN_BYTES = 30
INDEX, PROBE = 1, 2


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of edits + 1 nearly even segments, longer ones last."""
    k = edits + 1
    short, longer = length // k, length % k
    sizes = [short] * (k - longer) + [short + 1] * longer
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes))


def substrings(length: int, edits: int) -> dict[tuple[int, int, int], int]:
    """(segment, start, length) of the pieces a line is indexed and probed under, with their roles.

    Probed are, for each shorter or equal length, the places where segment i
    can stand if at most i edits lie left of it and edits - i right of it.
    """
    out: dict[tuple[int, int, int], int] = {}
    for i, (start, size) in enumerate(segments(length, edits)):
        out[i, start, size] = INDEX
    for gap in range(min(edits, length) + 1):
        for i, (start, size) in enumerate(segments(length - gap, edits)):
            right = edits - i
            low = max(0, start - i, start + gap - right)
            high = min(length - size, start + i, start + gap + right)
            for at in range(low, high + 1):
                out[i, at, size] = out.get((i, at, size), 0) | PROBE
    return out


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many bytes agree from the places a[i] and b[i] on, going by ``step``, ``limit`` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    ahead = np.arange(64)
    while len(live):
        at = out[live][:, None] + ahead
        left, right = ((x[live][:, None] + step * at).clip(0, len(data) - 1) for x in (a, b))
        equal = (data[left] == data[right]) & (at < limit[live][:, None])
        run = np.where(equal.all(axis=1), 64, equal.argmin(axis=1))
        out[live] += run
        live = live[run == 64]
    return out


def within(data: np.ndarray, a: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray, edits: int) -> np.ndarray:
    """Whether the strings a[i] and b[i] of a flat buffer are within ``edits`` edits.

    Common ends are cut off, then a banded bit-parallel dynamic program runs: bit k of
    a column stands for the row k - edits below the diagonal; all pairs
    advance one column per step, and leave when their score is out of reach.
    """
    out = np.zeros(len(a), bool)
    live = np.flatnonzero(np.abs(size[a] - size[b]) <= edits)
    if not len(live):
        return out
    m, n = size[a[live]], size[b[live]]
    row0, col0 = begin[a[live]], begin[b[live]]
    head = _common(data, row0, col0, np.minimum(m, n), 1)
    tail = _common(data, row0 + m - 1, col0 + n - 1, np.minimum(m, n) - head, -1)
    row0, col0, m, n = row0 + head, col0 + head, m - head - tail, n - head - tail
    one, width = np.uint64(1), 2 * edits + 1
    full, top = np.uint64((1 << width) - 1), np.uint64(2 * edits)
    plus = np.full(len(live), full & ~np.uint64((1 << edits) - 1), np.uint64)
    minus = np.zeros(len(live), np.uint64)
    score = np.minimum(edits, m)
    j = 0
    while len(live):
        ended = (n == j) | (score > 3 * edits)
        if ended.any():
            out[live[ended & (score <= edits)]] = True
            go = ~ended
            live, m, n, row0, col0, plus, minus, score = (x[go] for x in (live, m, n, row0, col0, plus, minus, score))
            if not len(live):
                break
        letter = data[col0 + j]
        equal = np.zeros(len(live), np.uint64)
        for k in range(width):
            i = j - edits + k
            if i >= 0:
                equal |= ((data[(row0 + np.minimum(i, m - 1)).clip(0)] == letter) & (i < m)).astype(np.uint64) << np.uint64(k)
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        up = (minus | ~(diagonal | plus)) & full
        down = diagonal & plus
        j += 1
        inside = j + edits <= m
        last = (m - j + edits).clip(0, 2 * edits).astype(np.uint64)
        step = np.where(
            inside,
            1 - ((diagonal >> top) & one).astype(np.int64),
            ((up >> last) & one).astype(np.int64) - ((down >> last) & one).astype(np.int64),
        )
        score += step
        plus = (down | ~((diagonal >> one) | up)) & full
        minus = (diagonal >> one) & up
    return out


def _lines(part: pa.RecordBatch):
    """(doc_id, place, line) of the lines with a word; place is (tag << 32) + line number."""
    for doc, tag, text in zip(*(part.column(i).to_pylist() for i in range(3))):
        base = tag << 32
        for number, line in enumerate(text.split(b"\n")):
            if line and not line.isspace():
                yield doc, base + number, line


def _occurrences(part: pa.RecordBatch) -> pa.RecordBatch:
    """First place of each line of a slice; the other places, which are settled as repeated (h2 null)."""
    first: dict[bytes, tuple[int, int]] = {}
    again: list[tuple[int, int]] = []
    for doc, place, line in _lines(part):
        here = (doc, place)
        there = first.setdefault(line, here)
        if here < there:
            first[line], here = here, there
        if here != first[line]:
            again.append(here)
    h = np.array([xxhash.xxh3_128_digest(line) for line in first], dtype="V16") if first else np.zeros(0, "V16")
    h = np.frombuffer(h.tobytes(), "<i8").reshape(-1, 2)
    spread = np.array([p for _, p in again], np.int64)
    at = list(first.values()) + again
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[h[:, 0], spread]),
            pa.concat_arrays([pa.array(h[:, 1].copy(), pa.int64()), pa.nulls(len(again), pa.int64())]),
            pa.array([d for d, _ in at], pa.int64()),
            pa.array([p for _, p in at], pa.int64()),
        ],
        ["h1", "h2", "doc_id", "place"],
    )


def _firsts(batches):
    """Sorted occurrences with ``repeated``: false for the first place of each line (and for that place met again)."""
    last, first = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        settled = batch.column(1).is_null()
        ready, batch = batch.filter(settled), batch.filter(pa.compute.invert(settled))
        h1, h2, doc, place = (batch.column(i).to_numpy() for i in range(4))
        repeated = np.zeros(len(h1), bool)
        if len(h1):
            new = np.r_[(h1[0], h2[0]) != last, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
            lead_doc, lead_place = doc[at], place[at]
            if not new[0]:
                lead_doc[at < 0], lead_place[at < 0] = first
            repeated = (doc != lead_doc) | (place != lead_place)
            last, first = (h1[-1], h2[-1]), (lead_doc[-1], lead_place[-1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch.column(0), ready.column(0)]),
                pa.concat_arrays([batch.column(2), ready.column(2)]),
                pa.concat_arrays([batch.column(3), ready.column(3)]),
                pa.array(np.r_[repeated, np.ones(ready.num_rows, bool)]),
            ],
            ["h1", "doc_id", "place", "repeated"],
        )


def _keys(edits: int, min_bytes: int):
    shapes: dict[int, list[tuple[bytes, int, int, int]]] = {}

    def shape(length: int):
        got = [(bytes([i]), at, at + size, role) for (i, at, size), role in substrings(length, edits).items()]
        if len(shapes) < 20_000:
            shapes[length] = got
        return got

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids, roles = [], [], []
        digest = xxhash.xxh3_64_intdigest
        for line in {line for _, _, line in _lines(part) if len(line) >= min_bytes}:
            own = xxhash.xxh3_128_digest(line)[:8]
            pieces = shapes.get(len(line)) or shape(len(line))
            keys.extend([digest(line[a:b], i[0]) for i, a, b, _ in pieces])
            roles.extend([role for _, _, _, role in pieces])
            ids.append(own * len(pieces))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(keys, np.uint64).view(np.int64)),
                pa.array(np.frombuffer(b"".join(ids), "<i8").copy()),
                pa.array(np.array(roles, np.int8)),
            ],
            ["key", "h1", "role"],
        )

    return fn


def _met(batches):
    """Rows of the keys under which two different lines meet, one as index and one as probe.

    A run may be of any length: its rows wait only until it has shown both, and
    repeated lines are sorted together and waiting rows differ in line or role.
    """
    key, waiting, roles, lines, lead = None, [], 0, 0, None
    for batch in batches:
        keys, ids, role = (batch.column(i).to_numpy() for i in range(3))
        if not len(keys):
            continue
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        end = np.r_[start[1:], len(keys)]
        out = []
        # runs of one row that touch no neighbouring batch hold no pair
        whole_single = (end - start == 1) & (start > 0) & (end < len(keys))
        for a, b in zip(start[~whole_single].tolist(), end[~whole_single].tolist()):
            if keys[a] != key:
                key, waiting, roles, lines, lead = keys[a], [], 0, 0, ids[a]
            own = np.flatnonzero(np.r_[True, (ids[a + 1 : b] != ids[a : b - 1]) | (role[a + 1 : b] != role[a : b - 1])]) + a
            roles |= int(np.bitwise_or.reduce(role[a:b]))
            lines = lines or int((ids[a:b] != lead).any())
            fresh = np.c_[keys[own], ids[own]]
            if roles == INDEX | PROBE and lines:
                out.extend([*waiting, fresh])
                waiting = []
            else:
                waiting.append(fresh)
                if len(waiting) > 64:
                    waiting = [np.unique(np.concatenate(waiting), axis=0)]
        rows = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], ["key", "h1"])


def _cut(part: pa.RecordBatch) -> pa.RecordBatch:
    """h1, order and text of the wanted lines of each document."""
    rows = []
    for doc, text, wanted in zip(*(part.column(i).to_pylist() for i in range(3))):
        lines = text.split(b"\n")
        rows.extend((w["h1"], doc, w["place"], lines[w["place"] & 0xFFFFFFFF]) for w in wanted)
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h1", "doc_id", "place", "line"])


def _near(batches, edits: int):
    """Lines with an earlier one within ``edits`` edits, among the pairs of each group."""
    for batch in whole(batches):
        names = batch.schema.names
        get = lambda c: batch.column(names.index(c)).to_numpy(zero_copy_only=False)
        group, block, same, doc, place = get("__g"), get("__b"), get("__same"), get("doc_id"), get("place")
        lines = batch.column(names.index("line")).to_pylist()
        size = np.array([len(x) for x in lines], np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(lines), np.uint8)
        near = np.zeros(len(lines), bool)
        for a, b in lagged(group, 1 << 16):
            # rows are sorted by (doc_id, place) within a group: a is the earlier line
            open_ = ~near[b] & (same[a] | (block[a] != block[b])) & ((doc[a] != doc[b]) | (place[a] != place[b]))
            a, b = a[open_], b[open_]
            near[b[within(data, a, b, begin, size, edits)]] = True
        at = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(place[at])], ["doc_id", "place"])


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id and place, (tag << 32) + line number, of every line that goes."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), tag_of(as_bytes()).alias("tag"), as_bytes().alias("t")
    )
    found = mapped(keyed, "t", _occurrences, "h1 long, h2 long, doc_id long, place long")
    found = found.repartition("h1").sortWithinPartitions("h1", "h2", "doc_id", "place")
    found = stage(found.mapInArrow(_firsts, "h1 long, doc_id long, place long, repeated boolean"), "lines")

    keys = mapped(keyed, "t", _keys(edits, min_bytes), "key long, h1 long, role byte")
    met = keys.repartition("key").sortWithinPartitions("key", "h1").mapInArrow(_met, "key long, h1 long")
    met = stage(met.distinct(), "met")

    wanted = found.where("not repeated").join(met.select("h1").distinct(), "h1")
    wanted = wanted.groupBy("doc_id", F.shiftright("place", 32).alias("tag")).agg(F.collect_list(F.struct("h1", "place")).alias("wanted"))
    texts = mapped(
        keyed.join(wanted, ["doc_id", "tag"]).select("doc_id", "t", "wanted"), "t", _cut, "h1 long, doc_id long, place long, line binary"
    )
    rows = met.join(stage(texts, "line_texts"), "h1").withColumn("__o", F.struct("doc_id", "place"))
    near = grouped(rows, ["key"], "__o", size=1024).mapInArrow(lambda b: _near(b, edits), "doc_id long, place long")
    return found.where("repeated").select("doc_id", "place").unionByName(near)


def cleaned(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, rest: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_sha256, and with ``rest`` the kept text and other columns.

    Null and empty texts have no lines and stay; rows with a null doc_id are left
    alone. Rows that repeat both doc_id and text are one document.
    """
    gone = repeated_lines(docs, edits, min_bytes).groupBy("doc_id", F.shiftright("place", 32).alias("__tag"))
    gone = gone.agg(F.collect_set(F.col("place").bitwiseAND(0xFFFFFFFF)).alias("__gone"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if rest else []
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("__doc"), tag_of(as_bytes()).alias("__tag"), "doc_id", as_bytes().alias("__t"), *others
    )
    both = keyed.join(gone.withColumnRenamed("doc_id", "__doc"), ["__doc", "__tag"], "left")
    both = both.select("__t", "__gone", "doc_id", *others)
    result = ("__n_lines", "__n_removed", "__kept_sha256") + (("__text",) if rest else ())

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, digests, texts = [], [], [], []
        for text, places in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            lines = text.split(b"\n")
            places = set(places or ())
            kept = b"\n".join([x for i, x in enumerate(lines) if i not in places]) if places else text
            counts.append(sum(1 for x in lines if x and not x.isspace()))
            removed.append(len(places))
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "replace"))
        made = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        made += [pa.array(texts, pa.string())] if rest else []
        return pa.RecordBatch.from_arrays(
            [*made, *(part.column(i) for i in range(2, part.num_columns))], [*result, *part.schema.names[2:]]
        )

    kinds = dict(zip(result, ("long", "long", "string", "string")))
    schema = ", ".join([f"{c} {k}" for c, k in kinds.items()] + [f"`{c}` {both.schema[c].dataType.simpleString()}" for c in ["doc_id", *others]])
    return mapped(both, "__t", fn, schema)


def digest(docs: DataFrame) -> DataFrame:
    out = cleaned(docs, rest=False)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__kept_sha256").alias("kept_sha256"))


def keep(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The input's columns with the kept text; n_chars, if there, is its new length.

    Documents that lose every line with a word go; those without any stay as they are.
    """
    out = cleaned(docs, edits, min_bytes).where("__n_lines = 0 or __n_removed < __n_lines").withColumnRenamed("__text", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
