"""Substring dedup by relative Lempel-Ziv parsing.

The reference is every text of a document with a smaller doc_id. Its index is
cut into blocks by *anchor*: each window of ``WINDOW`` words names its anchor,
the leftmost of its word ``GRAM``-grams with the smallest hash, so equal windows
name equal anchors, and a block holds every window of its anchors. A factor of
at least WINDOW words can only be found in the blocks of its windows'
anchors, so a document is parsed against exactly these.

1. Per slice of documents: word hashes, windows, anchors. Windows that already
   occur in a smaller document of the slice are settled there; only anchors
   with other windows are sent on, so a passage that a third of all
   documents share sends one row per slice, not per document.
2. Per block, in order of doc_id: the first document of each window is its
   source; consecutive windows with one source make a factor, which ends where
   the next window has another source or none.
3. Per document, factors that continue each other with one source are joined
   greedily. Words under a factor are duplicates, the rest are literals.

Windows are compared by the anchor's 48-bit and their own 40-bit hash, at
every place of a factor, its boundaries included.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.tables import as_bytes, binary, mapped

WINDOW = 13
GRAM = 6
CHECK_BYTES = 5
ANCHOR_BITS = 48
REMEMBERED = 400_000

#: checks holds CHECK_BYTES for each window; of settled windows it holds their number in 4 bytes.
_ROWS = "bucket long, doc_id long, place long, checks binary"
_FACTORS = "doc_id long, place long, n int, source long"


class WordHashes(dict):
    """64-bit hash of a word, remembered up to ``REMEMBERED`` words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))


_HASHES = WordHashes()


def _coefficients(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all 64 bits over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n words from each place."""
    size = len(words) - n + 1
    out = np.zeros(max(0, size), np.uint64)
    for j, c in enumerate(_coefficients(n, seed)):
        if size > 0:
            out += words[j : j + size] * c
    return mixed(out)


def tag_of(text: Column) -> Column:
    """16 bits of the text, so that rows that share a doc_id but not a text stay apart."""
    return F.xxhash64(text).bitwiseAND(0xFFFF)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs in which all columns stay equal."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def anchored(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of one slice: anchors with their windows' checks, and settled windows, under their source."""
    ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    tags = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((tags, ids))
    texts = part.column(2).to_pylist()
    words = [texts[i].split() for i in order]
    ids, tags = ids[order], tags[order]
    lengths = np.array([len(w) for w in words], np.int64)
    hashes = _HASHES.of(words)
    doc = np.repeat(np.arange(len(words)), lengths)
    begin = np.cumsum(lengths) - lengths
    size = max(0, len(hashes) - WINDOW + 1)
    valid = doc[:size] == doc[WINDOW - 1 :] if size else np.zeros(0, bool)
    at = np.flatnonzero(valid)
    grams = gram_hashes(hashes, GRAM, 1)
    best = grams[at]
    offset = np.zeros(len(at), np.int64)
    for j in range(1, WINDOW - GRAM + 1):
        other = grams[at + j]
        less = other < best
        best[less] = other[less]
        offset[less] = j
    check = gram_hashes(hashes, WINDOW, 2)[at]
    doc = doc[at]
    key, place = ids[doc], (tags[doc] << 32) + at - begin[doc]
    anchor = at + offset
    by = np.argsort(check, kind="stable")
    first = np.zeros(len(at), np.int64)
    starts = _runs(check[by])
    first[by] = np.repeat(by[starts], np.diff(np.r_[starts, len(by)]))
    settled = key[first] < key
    source = key[first]

    edge = _runs(anchor, doc)
    per_row = np.diff(np.r_[edge, len(at)])
    open_row = np.add.reduceat(~settled, edge) > 0 if len(edge) else np.zeros(0, bool)
    keep = np.repeat(open_row, per_row)
    data = check[keep].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHECK_BYTES]
    anchors = (best[edge][open_row] >> np.uint64(64 - ANCHOR_BITS)).view(np.int64)
    rows = [anchors, key[edge][open_row], place[edge][open_row]]
    checks = binary(data, per_row[open_row] * CHECK_BYTES)

    done = np.flatnonzero(settled)
    cut = _runs(at[done] - np.arange(len(done)), doc[done], source[done])
    runs = done[cut]
    per_run = np.diff(np.r_[cut, len(done)]).astype("<i4")
    out = [np.r_[rows[0], source[runs]], np.r_[rows[1], key[runs]], np.r_[rows[2], place[runs]]]
    checks = pa.concat_arrays([checks, binary(per_run.view(np.uint8), np.full(len(runs), 4))])
    return pa.RecordBatch.from_arrays([*map(pa.array, out), checks], ["bucket", "doc_id", "place", "checks"])


def _checks(column: pa.Array) -> np.ndarray:
    """The 40-bit checks in a column of binaries, in order."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CHECK_BYTES)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :CHECK_BYTES] = data
    return out.view("<u8").ravel()


def parsed(batches):
    """Factors of every document against the blocks of a partition sorted by (bucket, doc_id, place).

    Kept between batches: the last anchor's distinct windows and their sources.
    """
    last, seen, sources = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        settled = pa.compute.equal(pa.compute.binary_length(batch.column(3)), 4)
        if pa.compute.any(settled).as_py():
            ready = batch.filter(settled)
            n = pa.array(np.frombuffer(b"".join(ready.column(3).to_pylist()), "<i4"))
            yield pa.RecordBatch.from_arrays([ready.column(1), ready.column(2), n, ready.column(0)], ["doc_id", "place", "n", "source"])
            batch = batch.filter(pa.compute.invert(settled))
        if batch.num_rows == 0:
            continue
        bucket, doc, place = (batch.column(i).to_numpy() for i in range(3))
        n = pa.compute.binary_length(batch.column(3)).to_numpy() // CHECK_BYTES
        edge = _runs(bucket)
        run = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(bucket)]))
        row = np.repeat(np.arange(len(bucket)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        check = _checks(batch.column(3))
        key = (run[row].astype(np.uint64) << np.uint64(8 * CHECK_BYTES)) | check
        by = np.argsort(key, kind="stable")
        starts = _runs(key[by])
        source = np.empty(len(row), np.int64)
        own = doc[row[by[starts]]]
        if last == bucket[0] and len(seen):
            front = starts[run[row[by[starts]]] == 0]
            at = np.minimum(np.searchsorted(seen, check[by[front]]), len(seen) - 1)
            known = seen[at] == check[by[front]]
            own[: len(front)][known] = sources[at[known]]
        source[by] = np.repeat(own, np.diff(np.r_[starts, len(by)]))

        tail = starts[run[row[by[starts]]] == len(edge) - 1]
        new, new_source = check[by[tail]], own[len(own) - len(tail) :]
        if len(edge) == 1 and last == bucket[0] and len(seen):
            new, new_source = np.r_[seen, new], np.r_[sources, new_source]
            new, keep = np.unique(new, return_index=True)
            new_source = new_source[keep]
        last, seen, sources = bucket[-1], new, new_source

        found = np.flatnonzero(source < doc[row])
        if len(found):
            cut = _runs(row[found], step[found] - np.arange(len(found)), source[found])
            head = found[cut]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[row[head]]),
                    pa.array(place[row[head]] + step[head]),
                    pa.array(np.diff(np.r_[cut, len(found)]).astype(np.int32)),
                    pa.array(source[head]),
                ],
                ["doc_id", "place", "n", "source"],
            )


def factors(docs: DataFrame) -> DataFrame:
    """doc_id, place (tag and first word), n (windows), source: long factors before they are joined."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), tag_of(as_bytes()).alias("tag"), as_bytes().alias("t")
    )
    rows = mapped(keyed, "t", anchored, _ROWS)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "place").mapInArrow(parsed, _FACTORS)


def joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Greedy parse: (start, n_words, source) of a document from its (start, windows, source)."""
    out: list[list[int]] = []
    for start, n, source in sorted(pieces):
        if out and out[-1][2] == source and start <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], start + n - 1)
        else:
            out.append([start, start + n - 1, source])
    return [(a, b - a + WINDOW, s) for a, b, s in out]


def kept_words(words: list[bytes], spans: list[tuple[int, int, int]]) -> list[bytes]:
    kept, at = [], 0
    for start, n, _ in spans:
        kept.extend(words[at:start])
        at = max(at, start + n)
    kept.extend(words[at:])
    return kept


def parse(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, factors
    array<struct<start, n_words, source>>, and, if asked for, the kept words joined by spaces.

    Null and empty texts have no words; rows with a null doc_id are neither reference nor cut.
    Rows that repeat a doc_id don't duplicate each other.
    """
    spans = factors(docs).groupBy("doc_id", F.shiftright("place", 32).alias("tag")).agg(
        F.collect_list(F.struct(F.col("place").bitwiseAND(0xFFFFFFFF).alias("start"), "n", "source")).alias("spans")
    )
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(as_bytes()).alias("tag"), as_bytes().alias("t"))
    both = keyed.join(spans, ["doc_id", "tag"], "left").select("doc_id", "t", "spans")
    factor_type = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("source", pa.int64())]))

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, removed, digests, found, kept_texts = [], [], [], [], []
        for text, pieces in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            words = text.split()
            spans = joined([(p["start"], p["n"], p["source"]) for p in pieces or ()])
            kept = kept_words(words, spans)
            body = b" ".join(kept)
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(body).hexdigest())
            found.append([{"start": a, "n_words": n, "source": s} for a, n, s in spans])
            kept_texts.append(body.decode("utf-8", "replace") if texts else None)
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(found, factor_type),
                pa.array(kept_texts, pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept_text"],
        )

    out = mapped(
        both,
        "t",
        fn,
        "doc_id long, n_words long, n_removed long, kept_sha256 string, "
        "factors array<struct<start:long,n_words:long,source:long>>, kept_text string",
    )
    return out if texts else out.drop("kept_text")
