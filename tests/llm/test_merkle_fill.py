"""Merkle manifest and fill-in-middle rows against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldshift.llm import fill_middle, merkle
from tests.llm.conftest import COLUMNS, ordered, sha


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row
    values = (doc_id, source, lang, None if n is None else n + more, text)
    return joined(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([joined(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, i):
    path = []
    for level in levels[:-1]:
        j = i ^ 1
        path.append((("L" if j < i else "R") + level[j]) if j < len(level) else "")
        i >>= 1
    return path


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = {}
    for lang, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = tree_of([leaf_of(r) for r in held])
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    crown = tree_of([trees[k][-1][0] for k in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            path = path_of(trees[lang], i) + path_of(crown, at)
            altered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(r, 1) if altered else leaf_of(r)
            for e in path:
                node = joined(e[1:], node) if e.startswith("L") else joined(node, e[1:])
            root = crown[-1][0]
            out.append((r[0], leaf_of(r), trees[lang][-1][0], root, joined(*[e[1:] for e in path]), node, node == root))
    return ordered(out)


def manifest_rows(df, **sizes):
    rows = merkle.manifest(df, **sizes)
    root = merkle.folded(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    proof = F.sha2(merkle.siblings(F.col("path")), 256)
    return ordered(rows.select("doc_id", "leaf", "subroot", "root", proof, root, root == F.col("root")).collect())


@pytest.mark.parametrize("bits,digits", [(1, 2), (5, 2)])
def test_manifest(spark, docs, corpus, bits, digits):
    rng = random.Random(3)
    rows = [(1000 + i, "t" * (i % 5), rng.choice([None, "", "é", "en"]), None, rng.choice([1, 2**40, None])) for i in range(70)]
    extra = spark.createDataFrame([(*r, 0, "x") for r in rows], docs.schema)
    assert manifest_rows(docs.union(extra), bits=bits, digits=digits) == brute_manifest(corpus + rows)


def test_manifest_small(spark, empty):
    assert merkle.manifest(empty).count() == 0
    row = (5, "a", "en", "s", 1)
    assert manifest_rows(spark.createDataFrame([row], COLUMNS)) == brute_manifest([row])


def test_wavelet():
    rng = np.random.default_rng(5)
    for size in (1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 4, size).astype(np.uint8)
        held = fill_middle.Wavelet(symbols)
        at = np.arange(size + 1)
        for s in range(4):
            places = np.flatnonzero(symbols == s)
            assert (held.rank(s, at) == np.searchsorted(places, at)).all()
            assert (held.select(s, np.arange(len(places))) == places).all()


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fill(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    spm = h[3] % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), out, text


def test_fill_middle(spark, docs, corpus):
    rng = random.Random(6)
    odd = ["a<", "<S", "P>", " ", "\n\t", "é", "日本", " ", "\xa0", "😀", "x", "<", ">", "", "b\x0bc"]
    rows = [(2000 + i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(3000, "see <P> here " * 9), (3001, "<M>"), (None, "a b c"), (None, None), (3002, " "), (3003, "end \n")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_middle.rewritten(docs.select("doc_id", "text").union(extra))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored()).collect()
    want = [brute_fill(r[0], r[1]) for r in [*corpus, *rows]]
    assert ordered(got) == ordered(want)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_fill_middle_long_text_and_columns(spark, docs, empty):
    text = "word é " * 900_000
    one = fill_middle.rewritten(spark.createDataFrame([(11, text)], "doc_id long, text string"))
    got = one.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fill_middle.restored(), 256)).first()
    want = brute_fill(11, text)
    assert tuple(got) == (*want[:5], sha(want[5].encode()), sha(want[6].encode()))
    assert fill_middle.rewritten(empty).count() == 0
    assert fill_middle.rewritten(docs.withColumn("output", F.lit(1)).withColumn("_k", F.lit(1))).columns[-1] == "output"
