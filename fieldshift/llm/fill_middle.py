"""Fill-in-middle transformation by wavelet matrices over character classes.

The bytes of a slice of texts become one sequence of four classes, held as a
wavelet matrix of two bit levels with running counts. A token ends before each
blank that follows a word byte and at the end of its text, so differences of
ranks count tokens, and the k-th boundary is a select. Code points are bytes
less the rank of continuation bytes. No text is split into token objects.

Defined cases: null text is empty text; an empty text and one that holds a
marker stay plain; a null key draws like the empty string; repeated rows are
rewritten alike, each in its own row; columns other than key and text are left
out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.tables import as_bytes, mapped

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts so many are rewritten, and of 100 rewritten ones so many with the suffix first.
FIM_RATE, SPM_RATE = 50, 80
#: Classes: a blank right behind a word byte, any other blank, a word's first byte of a code point, a continuation byte.
BREAK, BLANK, LEAD, CONTINUED = range(4)


class Bits:
    """Bit vector with rank and select over 64-bit words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(packed) // 8 + 2, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.ones = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.ones[1:])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self.n_zeros = int(len(bits) - self.ones[-1])

    def rank(self, bit: int, at: np.ndarray) -> np.ndarray:
        """Bits equal to ``bit`` before each place."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        ones = self.ones[word] + np.bitwise_count(below)
        return ones if bit else at - ones

    def select(self, bit: int, nth: np.ndarray) -> np.ndarray:
        """Place of the nth bit (from 0) equal to ``bit``: by bisection, first over words, then inside one."""
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, nth, side="right") - 1
        left = nth - before[word]
        held = self.words[word] if bit else ~self.words[word]
        place = np.zeros(len(nth), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = held & np.uint64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            right = left >= count
            left = np.where(right, left - count, left)
            held = np.where(right, held >> np.uint64(width), low)
            place += np.where(right, width, 0)
        return word * 64 + place


class Wavelet:
    """Wavelet matrix of a sequence of numbers below four: the high bits, then the low bits stably sorted by the high one."""

    def __init__(self, symbols: np.ndarray):
        high = symbols >> 1
        self.high = Bits(high)
        self.low = Bits(np.concatenate([symbols[high == 0], symbols[high == 1]]) & 1)

    def _start(self, symbol: int) -> int:
        return self.high.n_zeros if symbol >> 1 else 0

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol before each place."""
        start = self._start(symbol)
        down = start + self.high.rank(symbol >> 1, at)
        first = self.low.rank(symbol & 1, np.array([start]))[0]
        return self.low.rank(symbol & 1, down) - first

    def select(self, symbol: int, nth: np.ndarray) -> np.ndarray:
        """Place of the nth occurrence (from 0) of a symbol."""
        start = self._start(symbol)
        first = self.low.rank(symbol & 1, np.array([start]))[0]
        return self.high.select(symbol >> 1, self.low.select(symbol & 1, first + nth) - start)


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every byte; ``starts`` are the places where a text begins."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    after_word = np.empty(len(data), bool)
    after_word[:1] = False
    np.logical_not(blank[:-1], out=after_word[1:])
    after_word[starts] = False
    word = np.where((data & 0xC0) == 0x80, CONTINUED, LEAD)
    return np.where(blank, np.where(after_word, BREAK, BLANK), word).astype(np.uint8)


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per text, the byte places of both cuts (rows x 2), code points of prefix and middle."""
    begin, end = offsets[:-1], offsets[1:]
    held = Wavelet(classes(data, begin[begin < end]))
    base = held.rank(BREAK, begin)
    n = held.rank(BREAK, end) - base + (end > begin)
    units = np.sort(draws % (n[:, None] + 1), axis=1)
    place = np.where(units == 0, begin[:, None], end[:, None])
    row, side = np.nonzero((units > 0) & (units < n[:, None]))
    place[row, side] = held.select(BREAK, base[row] + units[row, side] - 1)
    bounds = np.column_stack([begin, place])
    points = bounds - held.rank(CONTINUED, bounds.ravel()).reshape(bounds.shape)
    return n, place, points[:, 1] - points[:, 0], points[:, 2] - points[:, 1]


def _draws(key: str | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


_SCHEMA = pa.schema(
    [("_k", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def _rewriter(seed: int, fim_rate: int, spm_rate: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("_t")
        lengths = np.fromiter((len(t) for t in (x.as_buffer() for x in texts)), np.int64, len(texts))
        raw = b"".join(texts.to_pylist())
        offsets = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        drawn = np.array([_draws(k, seed) for k in batch.column("_k").to_pylist()], np.int64).reshape(-1, 4)
        n, place, prefix, middle = cuts(np.frombuffer(raw, np.uint8), offsets, drawn[:, :2])
        forms, outputs = [], []
        for i in range(len(lengths)):
            a, z = int(offsets[i]), int(offsets[i + 1])
            whole = raw[a:z]
            if not whole or drawn[i, 2] % 100 >= fim_rate or any(x in whole for x in marks):
                forms.append("plain")
                outputs.append(whole)
                continue
            b, c = (int(x) for x in place[i])
            first, mid, last = raw[a:b], raw[b:c], raw[c:z]
            suffix_first = drawn[i, 3] % 100 < spm_rate
            forms.append("spm" if suffix_first else "psm")
            outputs.append(b"".join([s, last, p, first, m, mid] if suffix_first else [p, first, s, last, m, mid]))
        plain = np.array([f == "plain" for f in forms], bool)
        return pa.record_batch(
            [
                batch.column("_k"),
                pa.array(n),
                pa.array(forms, pa.string()),
                pa.array(prefix, mask=plain),
                pa.array(middle, mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ],
            schema=_SCHEMA,
        )

    return run


def rewritten(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output), a row per document.

    Prefix and middle end after the smaller and the larger of two seeded draws
    of a token count; the form is drawn from the same hash, so a rerun agrees on
    any layout. No shuffle: every text is rewritten where it is read.
    """
    kind = dict(docs.dtypes)[key]
    ready = docs.select(F.col(key).cast("string").alias("_k"), as_bytes(text).alias("_t"))
    schema = "_k string, n long, form string, prefix_chars long, middle_chars long, output string"
    out = mapped(ready, "_t", _rewriter(seed, fim_rate, spm_rate), schema)
    return out.select(F.col("_k").cast(kind).alias(key), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(form: Column | str = "form", output: Column | str = "output") -> Column:
    """The text that a rewritten output came from.

    A rewritten text holds no marker of its own, and markers share no end with
    another's start, so the first occurrence of each is the one written.
    """
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    width = F.lit(len(PREFIX))
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    one = F.substr(output, width + 1, second - width - 1)
    two = F.substr(output, second + width, third - second - width)
    middle = F.substr(output, third + width)
    both = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(both)
