"""License scan: exact set-similarity join of text blocks with license templates.

A template is the set T of its words. A window is ``2 * n`` consecutive words of
a document at any place (a shorter document is one window), n being the
template's word count. The join finds every (window, template) with
``|window & T| >= need``, need = ceil(threshold * |T|), and returns runs of
consecutive windows as one block:

* words are ordered by their count in all documents, rarest first;
* prefix filter: a matching window holds one of T's ``|T| - need + 1`` rarest
  words, so only the windows around these are looked at, overlapping ones in one
  range;
* length filter: a range must hold ``need`` distinct template words;
* positional filter: let i be the least place in the ordered T of a word of the
  range, and j its place in the range's ordered words: at most
  ``1 + min(|T| - i - 1, |range| - j - 1)`` words can be shared;
* what is left is slid over by one word with running counts.

Templates are a bounded parameter and travel with the tasks; documents are
read twice (counts, join) and never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.tables import as_bytes, mapped

# Phrases whose every place counts, and the label each gives.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening or naming sentences of public licenses, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "licensed under the gnu general public license version": "gpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution international license": "cc-by",
    "free and unencumbered software released into the public domain": "unlicense",
    "no copyright dedicated to the public domain worldwide": "cc0",
}
MAX_TEMPLATE_WORDS = 100_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A-Z to lower case; what is no ASCII letter or digit and under 0x80 to space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def word_counts(docs: DataFrame, vocabulary: Sequence[bytes], text: str = "text") -> dict[bytes, int]:
    """Places of each given word in all documents; the result is bounded by the vocabulary."""
    known = frozenset(vocabulary)

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for value in part.column(0).to_pylist():
            total.update(w for w in words_of(value) if w in known)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
        )

    counted = mapped(docs.select(as_bytes(text).alias("t")), "t", fn, "word binary, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class TemplateIndex:
    """Templates with their words in global order, and the prefix words' lists."""

    def __init__(self, templates: Mapping[str, str], counts: Mapping[bytes, int], threshold: float):
        split = [(words_of(t.encode()), label) for t, label in templates.items()]
        if sum(len(w) for w, _ in split) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold over {MAX_TEMPLATE_WORDS} words")
        universe = sorted({w for words, _ in split for w in words}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(universe)}
        self.labels = [label for _, label in split]
        self.length = [len(words) for words, _ in split]
        self.ordered = [sorted({self.rank[w] for w in words}) for words, _ in split]
        self.need = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in self.ordered]
        self.places = [{universe[r]: i for i, r in enumerate(ranks)} for ranks in self.ordered]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, ranks in enumerate(self.ordered):
            for i, rank in enumerate(ranks[: len(ranks) - self.need[k] + 1]):
                self.prefix.setdefault(universe[rank], []).append((k, i))

    def blocks(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """Every run of matching windows: (template, first word, number of words, best containment)."""
        if self.prefix.keys().isdisjoint(words):
            return []
        seen: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            for k, _ in self.prefix.get(word, ()):
                if not seen.get(k) or seen[k][-1] != at:
                    seen.setdefault(k, []).append(at)
        found = []
        for k in sorted(seen):
            width = 2 * self.length[k]
            last = max(0, len(words) - width)
            ranges: list[list[int]] = []
            for at in seen[k]:
                low, high = max(0, at - width + 1), min(at, last)
                if ranges and low <= ranges[-1][1] + 1:
                    ranges[-1][1] = high
                else:
                    ranges.append([low, high])
            for low, high in ranges:
                found += self._slid(k, words[low : high + width], low, high, width)
        return found

    def _slid(self, k: int, words: list[bytes], low: int, high: int, width: int) -> list[tuple[int, int, int, float]]:
        """Runs among the windows that start at ``low`` to ``high``; ``words`` are those the windows cover."""
        template, need = self.places[k], self.need[k]
        ordered = sorted({self.rank[w] for w in words if w in self.rank})
        held = [template.get(w, -1) for w in words]
        present = {i for i in held if i >= 0}
        if len(present) < need:
            return []
        i = min(present)
        if 1 + min(len(template) - i - 1, len(ordered) - ordered.index(self.ordered[k][i]) - 1) < need:
            return []
        counts, shared, found = [0] * len(template), 0, []
        for at, i in enumerate(held):
            if i >= 0:
                counts[i] += 1
                shared += counts[i] == 1
            if at >= width:
                gone = held[at - width]
                if gone >= 0:
                    counts[gone] -= 1
                    shared -= counts[gone] == 0
            start = low + max(0, at - width + 1)
            if shared < need or (at < width - 1 and at < len(held) - 1):
                continue
            end = min(low + len(held), start + width)
            if found and start <= found[-1][1] + 1:
                found[-1][1:] = [start, end, max(found[-1][3], shared)]
            else:
                found.append([start, start, end, shared])
        return [(k, first, end - first, best / len(template)) for first, _, end, best in found]


def phrase_places(words: list[bytes], phrases: Mapping[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase stands."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, seen, word = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            found.append((word, label))
            at = joined.find(needle, at + 1)
    return sorted(found)


def scan(
    docs: DataFrame,
    threshold: float = 0.8,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per input row: key, n_words, phrases array<struct<word, label>>,
    blocks array<struct<label, word, n_words, containment>> (all runs of matching windows).

    Null and empty texts have no words, phrases or blocks.
    """
    vocabulary = sorted({w for t in templates for w in words_of(t.encode())})
    index = TemplateIndex(templates, word_counts(docs, vocabulary, text), threshold)
    places = dict(phrases)
    id_type = docs.select(key).schema.fields[0].dataType.simpleString()
    phrase_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    block_type = pa.list_(
        pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int32()), ("containment", pa.float64())])
    )

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, found, blocks = [], [], []
        for value in part.column(1).to_pylist():
            words = words_of(value)
            counts.append(len(words))
            found.append([{"word": w, "label": label} for w, label in phrase_places(words, places)])
            blocks.append(
                [
                    {"label": index.labels[k], "word": at, "n_words": n, "containment": share}
                    for k, at, n, share in index.blocks(words)
                ]
            )
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts, pa.int64()), pa.array(found, phrase_type), pa.array(blocks, block_type)],
            ["key", "n_words", "phrases", "blocks"],
        )

    return mapped(
        docs.select(F.col(key).alias("key"), as_bytes(text).alias("t")),
        "t",
        fn,
        f"key {id_type}, n_words long, phrases array<struct<word:long,label:string>>, "
        "blocks array<struct<label:string,word:long,n_words:int,containment:double>>",
    ).withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and labels of a scan; score is 1 with a phrase, else the best containment, else 0."""
    labels = F.array_sort(F.array_distinct(F.col("phrases.label")))
    every = F.array_sort(F.array_union(F.col("phrases.label"), F.col("blocks.label")))
    return found.select(
        key,
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )
