"""SentencePiece encoding and decoding by a table of distinct marked words.

No piece of the model holds a whitespace marker behind another character, so
no piece crosses into the next marked word (markers, then anything but a
marker), and the ids of a text are the ids of its marked words in order. Every
distinct word is segmented once per worker, and ids are joined back by the
word's position. The table is a bounded memo: it is emptied when full, and
words over ``LONG`` characters are segmented but not remembered.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.tables import as_bytes, mapped

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
LONG = 256
#: Words that a worker remembers, and bytes of text that it works on at once.
TABLE_SIZE = 250_000
SLICE = 1 << 20


def load(path: str) -> bytes:
    """Serialized model, read on the driver and shipped with the tasks (under 1 MB for 32k pieces)."""
    with open(path, "rb") as file:
        return file.read()


class WordTable:
    """Distinct marked words of a worker with their ids and decoded text."""

    def __init__(self, model: bytes, size: int = TABLE_SIZE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces cross whitespace markers: words can't be segmented alone")
        if self.sp.encode(" ") != self.sp.encode(MARK) or not self.sp.encode(" "):
            raise ValueError("the model removes or adds whitespace otherwise than assumed")
        self.mark = self.sp.piece_to_id(MARK)
        self.size = size
        # ids of a word that decodes to itself, as nearly all do; else ids and decoded text
        self.words: dict[str, bytes | tuple[bytes, str]] = {}

    def _segment(self, words: list[str]) -> dict[str, bytes | tuple[bytes, str]]:
        # encode() puts one marker in front, which stands for the word's first marker
        encoded = self.sp.encode([w[1:] for w in words], num_threads=1)
        out = {}
        for word, ids in zip(words, encoded):
            ids = ids or [self.mark]
            # decode() takes one leading marker away
            text = " " + self.sp.decode(ids)
            joined = ",".join(map(str, ids)).encode()
            out[word] = joined if text == word.replace(MARK, " ") else (joined, text)
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Comma-joined ids and decoded text of each text."""
        split = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > self.size:
            self.words.clear()
        table = self.words
        missing = list({w for words in split for w in words if w not in table})
        extra = {}
        for i in range(0, len(missing), 10_000):
            found = self._segment(missing[i : i + 10_000])
            table.update((w, v) for w, v in found.items() if len(w) <= LONG)
            extra.update((w, v) for w, v in found.items() if len(w) > LONG)
        out = []
        for text, words in zip(texts, split):
            got = [table.get(w) or extra[w] for w in words]
            if MARK not in text and tuple not in set(map(type, got)):
                out.append((b",".join(got), text))
                continue
            pairs = [g if g.__class__ is tuple else (g, w.replace(MARK, " ")) for g, w in zip(got, words)]
            out.append((b",".join([g for g, _ in pairs]), "".join([t for _, t in pairs])[1:]))
        return out


_TABLES: dict[bytes, WordTable] = {}


def word_table(model: bytes) -> WordTable:
    """Table of this worker process, kept between tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = WordTable(model)
    return _TABLES[key]


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, ids array<int>, decoded string.

    Null text is empty; empty text has no ids and decodes to the empty text.
    Repeated rows give repeated rows.
    """
    model = load(model_path)
    schema = docs.select(key).schema.fields[0].dataType.simpleString()

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        got = word_table(model).encode([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()])
        ids = pa.array([[int(i) for i in a.split(b",")] if a else [] for a, _ in got], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([d for _, d in got], pa.string())], ["key", "ids", "decoded"])

    return mapped(
        docs.select(F.col(key).alias("key"), as_bytes(text).alias("t")), "t", fn, f"key {schema}, ids array<int>, decoded string", SLICE
    ).withColumnRenamed("key", key)


def digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Like ``encode_texts``, but n_tokens, ids_sha256 and decoded_sha256 in place of the sequences."""
    model = load(model_path)
    schema = docs.select(key).schema.fields[0].dataType.simpleString()

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        got = word_table(model).encode([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()])
        counts = pa.array([a.count(b",") + 1 if a else 0 for a, _ in got], pa.int64())
        ids = pa.array([hashlib.sha256(a).hexdigest() for a, _ in got], pa.string())
        decoded = pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got], pa.string())
        return pa.RecordBatch.from_arrays([part.column(0), counts, ids, decoded], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(
        docs.select(F.col(key).alias("key"), as_bytes(text).alias("t")),
        "t",
        fn,
        f"key {schema}, n_tokens long, ids_sha256 string, decoded_sha256 string",
        SLICE,
    ).withColumnRenamed("key", key)
