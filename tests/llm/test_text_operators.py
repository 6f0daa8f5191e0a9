"""Line dedup, substring dedup, SimHash and the license scan against brute force."""

import random

import numpy as np
import pytest
import xxhash

from fieldshift.llm import licenses, line_dedup, shingle_sets, simhash, substring_dedup
from tests.llm.conftest import ordered, sha, words_of


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def mutated(rng, text, edits, alphabet):
    text = list(text)
    for _ in range(edits):
        kind, at = rng.choice("isd"), rng.randrange(len(text))
        if kind == "i":
            text.insert(at, rng.choice(alphabet))
        elif kind == "s":
            text[at] = rng.choice(alphabet)
        elif len(text) > 5:
            text.pop(at)
    return bytes(text)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_and_keys(edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(6, 30)))
        pairs.append((a, mutated(rng, a, rng.randint(0, edits + 2), b"abc")))
    flat = [x for p in pairs for x in p]
    size = np.array([len(x) for x in flat])
    got = line_dedup.within(
        np.frombuffer(b"".join(flat), np.uint8), np.arange(0, 800, 2), np.arange(1, 800, 2), np.cumsum(size) - size, size, edits
    )
    want = [edit_distance(a, b) <= edits for a, b in pairs]
    assert got.tolist() == want and 50 < sum(want) < 400

    def keys(text):
        out = {}
        for (i, at, n), role in line_dedup.substrings(len(text), edits).items():
            out[i, text[at : at + n]] = out.get((i, text[at : at + n]), 0) | role
        return out

    for (a, b), near in zip(pairs, want):
        left, right = keys(a), keys(b)
        assert not near or any(k in right and left[k] | right[k] == 3 for k in left)


def lines_by_hand(rows):
    """(rows kept, removed) by comparing every line with every earlier one."""
    seen, gone = [], set()
    numbered = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    for doc, text in numbered:
        for i, line in enumerate(text.encode().split(b"\n")):
            if not line.strip():
                continue
            near = lambda x: abs(len(x) - len(line)) <= 2 and edit_distance(x, line) <= 2
            if any(x == line or min(len(x), len(line)) >= 30 and near(x) for x in seen):
                gone.add((doc, text, i))
            seen.append(line)
    out = []
    for doc, text in rows:
        lines = (text or "").encode().split(b"\n")
        kept = [x for i, x in enumerate(lines) if (doc, text, i) not in gone]
        out.append((doc, sum(1 for x in lines if x.strip()), len(lines) - len(kept), sha(b"\n".join(kept))))
    return out


def test_line_dedup(docs, corpus):
    rows = [r[:2] for r in corpus if r[0] != 123]
    small = docs.where("doc_id is null or doc_id != 123")
    assert ordered(line_dedup.digest(small).collect()) == ordered(lines_by_hand(rows))
    kept = line_dedup.keep(small)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 101 not in texts and 120 in texts and texts[None] == next(r[1] for r in corpus if r[0] is None) and texts[0].count("\n") >= 1


def test_line_dedup_splits_hot_keys(spark):
    head = "x" * 40
    rows = [(i, f"{head}{i:05d}{'y' * 40}") for i in range(2600)] + [(9999, f"{head}00017{'y' * 39}")]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, seen = {}, []
    for i, text in rows:
        digits = text[40:45]
        want[i] = int(any(sum(a != b for a, b in zip(digits, s)) <= 2 for s in seen))
        seen.append(digits)
    assert got == want


def substring_by_hand(rows):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words_of(text)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc)
    out = []
    for doc, text in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - 12):
            if doc is not None and first.get(tuple(w[i : i + 13]), doc) < doc:
                gone.update(range(i, i + 13))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), sha(b" ".join(kept))))
    return out


def test_substring_dedup(docs, corpus):
    got = substring_dedup.parse(docs)
    want = substring_by_hand([r[:2] for r in corpus])
    assert ordered(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == ordered(want)
    row = got.where("doc_id = 105").first()
    assert row["kept_text"] == "" and row["factors"][0]["source"] == 7 and row["factors"][0]["start"] == 0


def test_substring_dedup_across_batches(spark):
    """One passage in thousands of documents, in small batches: the anchor's windows are carried on."""
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"a{i} {passage} b{i}" if i % 2 else f"{passage} c{i}") for i in range(3000)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
        got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.parse(df, texts=False).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {i: 30 * (i > 0) for i in range(3000)}


def fingerprint_by_hand(text, n=3):
    w = [x.lower() for x in words_of(text)]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(prints, radius):
    """Smallest id reachable, ids being the keys."""
    ids, f = list(prints), np.array(list(prints.values()), np.uint64)
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= radius) for x in f]
    label = np.array(ids)
    while True:
        new = np.array([label[x].min() for x in near])
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_simhash(docs, corpus):
    got = simhash.near_duplicates(docs)
    prints = {r[0]: fingerprint_by_hand(r[1]) for r in corpus if r[0] is not None}
    want = classes_by_hand(prints, 3)
    rows = got.where("doc_id is not null").collect()
    assert len(rows) == len(corpus) - 1
    assert all(r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in rows)
    assert want[120] == want[121] == want[122] == 120


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_pigeonhole_finds_every_link(spark, radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = {}
    for i in range(600):
        x = int(centres[i % 60])
        for b in rng.integers(0, 64, rng.integers(0, radius + 3)):
            x ^= 1 << int(b)
        prints[x if x < 1 << 63 else x - (1 << 64)] = x
    df = spark.createDataFrame([(k,) for k in prints], "fp long")
    edges = [tuple(r) for r in simhash.links(df, radius).collect()]
    up = {k: k for k in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert {k: root(k) for k in prints} == classes_by_hand(prints, radius)


def test_thresholds_add_up():
    costs = np.array([[0, 5, 9, 20, 40], [0, 1, 2, 30, 60], [0, 7, 9, 11, 90.0]])
    cost, chosen = simhash.allocate(costs, 1)
    every = [(a, b, c) for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if a + b + c == 1]
    assert sum(chosen) == 1 and cost == min(costs[0][a + 1] + costs[1][b + 1] + costs[2][c + 1] for a, b, c in every)
    assert all(t >= 0 for _, t in simhash.plan(np.zeros(0, np.uint64), 0))


def license_blocks_by_hand(words, threshold):
    """All windows at every word, one after the other; runs of matching ones joined."""
    found = set()
    for template, label in licenses.TEMPLATES.items():
        t = set(licenses.words_of(template.encode()))
        width = 2 * len(licenses.words_of(template.encode()))
        run = None
        for start in range(max(0, len(words) - width) + 1):
            share = len(set(words[start : start + width]) & t) / len(t)
            end = min(len(words), start + width)
            if share >= threshold:
                run = (run[0], end, max(run[2], share)) if run else (start, end, share)
            elif run:
                found.add((label, run[0], run[1] - run[0], run[2]))
                run = None
        if run:
            found.add((label, run[0], run[1] - run[0], run[2]))
    return found


def test_license_windows_at_every_offset():
    """An altered notice is found whatever stands before it; random windows equal brute force."""
    rng = random.Random(12)
    index = licenses.TemplateIndex(licenses.TEMPLATES, {}, 0.8)
    blocks = lambda words: {(index.labels[k], at, n, share) for k, at, n, share in index.blocks(words)}
    notice = "licensed under the terms of the apache software license version 2 0".split()
    for before in range(0, 40):
        words = [w.encode() for w in [f"x{i}" for i in range(before)] + notice + ["y"] * (before % 5)]
        assert "apache" in {b[0] for b in blocks(words)}
        assert blocks(words) == license_blocks_by_hand(words, 0.8)
    pool = sorted({w for t in licenses.TEMPLATES for w in licenses.words_of(t.encode())}) + [b"x", b"y"]
    whole = [licenses.words_of(t.encode()) for t in licenses.TEMPLATES]
    hits = 0
    for _ in range(300):
        words = []
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(whole))
            for _ in range(rng.randint(0, 4)):
                part.insert(rng.randrange(len(part) + 1), rng.choice(pool))
            if part and rng.random() < 0.5:
                part.pop(rng.randrange(len(part)))
            words += part + [rng.choice(pool) for _ in range(rng.randint(0, 30))]
        index = licenses.TemplateIndex(licenses.TEMPLATES, {w: rng.randrange(50) for w in pool}, 0.8)
        assert blocks(words) == license_blocks_by_hand(words, 0.8)
        hits += len(blocks(words))
    assert hits > 100


def test_license_scan(spark, docs):
    texts = [
        "Intro words. All Rights Reserved. all rights\nreserved and CC-BY 4.0, cc by cc by",
        "Licensed under the Apache License, Version 2.0 (the licence).",
        "x " * 50 + "This program is free software: you can redistribute it and/or modify it freely",
        "Released under the MIT license " * 3 + "the general public license",
        "the of a software and you it",
        None,
        "",
        "é" * 70_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scan = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, text in enumerate(texts):
        words = licenses.words_of((text or "").encode())
        got = {(b["label"], b["word"], b["n_words"], b["containment"]) for b in scan[i]["blocks"]}
        assert got == license_blocks_by_hand(words, 0.8)
    rows = {r["doc_id"]: tuple(r)[1:] for r in licenses.digest(licenses.scan(df)).collect()}
    assert rows[0] == (17, 5, 2, 15, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert rows[1][1:] == (0, None, None, "", "apache", 1.0)
    assert rows[2][4:6] == ("", "gpl") and rows[3][4:6] == ("gpl", "gpl,mit")
    assert rows[4][5] == "" and rows[5] == rows[6] == (0, 0, None, None, "", "", 0.0) and rows[7][0] == 1
    assert licenses.digest(licenses.scan(docs)).count() == docs.count()


def test_keep_first_reaches_shingle_similarity(spark):
    """Brute force over five-word shingles: linked pairs are similar, and pairs of similarity 0.8 are linked."""
    rng = random.Random(8)
    rows = []
    for _ in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randrange(0, 5)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if i // 4 == j // 4]
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    place = {r["doc_id"]: r["component"] for r in shingle_sets.similar(docs, 5).collect()}
    linked = sum(place[i] == place[j] for i, j in alike)
    assert len(alike) > 150 and linked >= 0.99 * len(alike)
    up = list(range(len(rows)))
    for i, j in alike:
        a, b = up[i], up[j]
        up = [min(a, b) if x in (a, b) else x for x in up]
    assert all(up[i] == up[j] for i, j in pairs if place[i] == place[j])
    assert len(set(place.values())) >= len(set(up))
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept >= set(up) and len(kept) <= 1.01 * len(set(up))


def test_similar_splits_large_groups(spark):
    """Near copies in number and unlike texts under one candidate root are compared over several blocks."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: i % 70], f"x{i}", *base[i % 70 + 1 :]])) for i in range(2500)]
    docs = spark.createDataFrame([*rows, (9000, " ".join(f"z{i}" for i in range(80))), (9001, ""), (9002, " \n")], "doc_id long, text string")
    place = {r["doc_id"]: r["component"] for r in shingle_sets.similar(docs, 5).collect()}
    assert len({place[i] for i in range(2500)}) == 1 and len(set(place.values())) == 3 and place[9001] == place[9002]


def test_keep_first_keeps_rows_with_null_or_repeated_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[3]), (7, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4])]
    assert ordered(simhash.keep_first(docs).collect()) == ordered(want)


def test_keep_first_links_by_fingerprints(spark):
    """Texts that repeat a passage have near fingerprints and few shingles in common: no shingle key meets, fingerprints do."""
    passage = " ".join(f"p{i}" for i in range(7))
    tails = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(i, " ".join([passage] * 60 + [t])) for i, t in enumerate(tails)] + [(9, " ".join(f"z{i}" for i in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_first(docs, least=0.05).collect()} == {0, 9}
    assert simhash.keep_first(docs).count() == 5  # linked texts of lower similarity stay


def test_lm_sums_and_exponentials():
    """Sums of runs, long and short, and softmaxes of values far out of single precision's reach."""
    from fieldshift.llm import maxent

    rng = np.random.default_rng(3)
    for width in (32, 64):
        row = np.minimum((rng.pareto(0.6, 5000) * 5).astype(int), 999)
        values = rng.random((5000, width), dtype=np.float32)
        order = np.argsort(row, kind="stable")
        touched, start, length = np.unique(row[order], return_index=True, return_counts=True)
        assert length.min() <= maxent.LONG < length.max()
        got = maxent.sums_of_rows(values, order, start, length)
        want = np.stack([values[row == r].astype(float).sum(axis=0) for r in touched])
        assert np.allclose(got, want, rtol=1e-4)
    near = rng.normal(size=(8, 32)).astype(np.float32)
    for move in (0, 200, -200):
        x = near + np.float32(move)
        p = maxent.Model.softmax(x.copy())
        assert np.allclose(p, np.exp(near) / np.exp(near).sum(axis=1, keepdims=True), rtol=1e-3)


def test_lm_words_of_slices_are_the_split_bytes():
    """Words come from Arrow as bytes.split gives them, distinct ones packed once."""
    import pyarrow as pa

    from fieldshift.llm import maxent

    draw = random.Random(1)
    signs = [b"a", b"B", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x85", b"\xc2\xa0", b"\xc3\x84", b"\x00", b"Z"]
    texts = [b"".join(draw.choices(signs, k=draw.randint(0, 12))) for _ in range(3000)] + [b"", b" "]
    flat, lengths = maxent.words_of(pa.array(texts, pa.binary()).slice(5))
    want = [t.lower().split() for t in texts[5:]]
    assert flat.to_pylist() == maxent.listed(flat) == [w for t in want for w in t] and lengths.tolist() == [len(t) for t in want]
    asked = []

    class Words(dict):
        def __missing__(self, word):
            asked.append(word)
            return len(word)

    batch = pa.record_batch([pa.array(texts, pa.binary())], names=["t"])
    ((_, flat, packed, _),) = maxent._slices([batch], Words(), 0)
    assert packed.tolist() == [len(w) for w in flat.to_pylist()] and len(asked) == len(set(asked))
