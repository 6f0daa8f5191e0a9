"""Embeddings, URL filter, mixing, LM, quality and SentencePiece; empty tables; the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from fieldshift.llm import components, embedding_dedup, licenses, line_dedup, maxent, mixing, quality
from fieldshift.llm import sentencepieces, simhash, substring_dedup, url_filter
from fieldshift.llm.queries import tokenizer_path
from tests.llm.conftest import ordered, sha, words_of


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, 5000 + i) for i in range(200)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    rows = [(i, base[i % 60].tolist()) for i in range(60)]
    rows += [(100 + i, (base[i % 5] * 3).tolist()) for i in range(40)]
    rows += [(200 + i, (base[i % 20] + rng.normal(size=24) * 0.3).tolist()) for i in range(120)]
    rows += [(400, None), (401, [0.0] * 24), (402, [None] * 24), (403, [float("nan")] * 24), (404, [float("inf")] * 24)]
    rows += [(405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, []), (100, (base[0] * 3).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "x")
    links, near = defaultdict(int), defaultdict(set)
    unit = []
    for _, v in rows:
        v = np.array(v if v else [np.nan], float)
        unit.append(v / np.linalg.norm(v) if np.isfinite(v).all() and v.any() else None)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                links[i] += 1
                near[rows[i][0]].add(rows[j][0])
    label = {r[0]: r[0] for r in rows}
    for _ in rows:
        label = {k: min([v, *(label[x] for x in near[k])]) for k, v in label.items()}
    got = ordered(embedding_dedup.near_duplicates(df, recall=0.999).collect())
    want = ordered((r[0], links[i], label[r[0]], label[r[0]] == r[0]) for i, r in enumerate(rows))
    same = sum(a == b for a, b in zip(got, want))
    assert same >= 0.98 * len(rows) and [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_hadamard_is_orthogonal():
    h = embedding_dedup.transform(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_url_filter(spark):
    rows = [
        (1, "HTTP://Sub.Example.COM/en/x?q#f"),
        (2, "https://www.example.com/en/1"),
        (3, "http://a.net/fr/#x"),
        (4, "http://a.net?x://b/es/"),
        (5, None),
        (6, "no scheme"),
        (7, "http://bad.org/1"),
        (8, "http://www.good.co.uk/a\nb"),
        (9, "http://example.com"),
        (9, "http://example.com"),
    ]
    rows += [(100 + i, f"http://bad.org/{i}") for i in range(40)] + [(200 + i, f"http://h{i % 9}.good.org/{i}") for i in range(90)]
    labels = [(100 + i, 1) for i in range(40)] + [(200 + i, int(i % 30 == 0)) for i in range(90)] + [(300, None), (100, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = url_filter.judge(pages, spark.createDataFrame(labels, "page_id long, bad int"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("sub.example.com", "/en/x", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3] == ("a.net", "/fr/", "net/fr/", "block") and got[4] == ("a.net", "", None, "allow")
    assert got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7] == ("bad.org", "/1", None, "block") and got[8] == ("www.good.co.uk", "/a\nb", None, "allow")
    assert got[9] == ("example.com", "", None, "allow") and got[200][3] == "allow"
    domain = url_filter.domain_of
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.org",), ("localhost",), ("",)], "h string")
    assert [r[0] for r in hosts.select(domain(hosts.h)).collect()] == ["b.co.uk", "y.org", "localhost", ""]
    none = spark.createDataFrame([], "page_id long, bad int")
    assert {r["verdict"] for r in url_filter.judge(pages, none).where("rule is null").collect()} == {"allow"}


def test_fill_shares_the_excess():
    got = mixing.fill(np.array([10.0, 100, 100, 0]), np.array([5.0, 2, 1, 5]), 315.0, 2)
    assert got.tolist() == [20.0, pytest.approx(590 / 3), pytest.approx(295 / 3), 0.0]


def test_mixing(docs, corpus):
    rows = mixing.taken(docs).collect()
    assert ordered((r["doc_id"], r["size"]) for r in rows) == ordered((r[0], len(words_of(r[1]))) for r in corpus)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert ordered(rows) == ordered(mixing.taken(docs.repartition(3)).collect())
    total = sum(r["taken"] for r in rows)
    assert abs(total / (1.5 * sum(r["size"] for r in rows)) - 1) < 0.03
    mixed = mixing.mixed(docs)
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(words_of(r["text"]))
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["taken"]
    assert +words == +want and mixed.columns == docs.columns


def test_small_sources_come_to_their_targets():
    """Sources far below a slot a shard, at the cap of two passes: each gets its whole total over 980 shards."""
    sources = [{"slots": 4_000_000.3, "blocks": 4_000_000}] + [{"slots": 2.0 * b, "blocks": b} for b in (1, 5, 20) for _ in range(60)]
    slots = mixing.totals(sources)
    assert slots[1:].tolist() == [s["blocks"] * 2 for s in sources[1:]] and slots[0] == 4_000_000
    for ix, n in enumerate(slots.tolist()):
        runs = list(mixing.shard_counts(ix, n, 980, 1))
        assert sum(int(x.sum()) for _, x in runs) == n
    uneven = mixing.totals([{"slots": 10.4, "blocks": 9}] * 1000)
    assert uneven.sum() == 10_400 and set(uneven.tolist()) == {10, 11}


def test_mixing_many_small_sources(spark):
    """Every source's taken words come to its target within the words of a slot, over several shards."""
    rows = [(i, f"s{i % 60}", " ".join(f"w{j}" for j in range(64))) for i in range(600)]
    rows += [(1000 + i, "large", " ".join(f"w{j}" for j in range(3200))) for i in range(60)]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    source = {r[0]: r[1] for r in rows}
    taken, target = Counter(), {}
    for r in got.collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, "a").tolist()) == list(range(n))


def test_lm_base_and_held_out_gain(docs, corpus):
    rows = {(r["doc_id"], r["n_tokens"]): r for r in maxent.scored(docs, rounds=2).collect()}
    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for r in corpus:
        if not held(r[0]):
            counts.update([*words_of(r[1]), b""])
    n, v = sum(counts.values()), len(counts)
    for r in corpus:
        tokens = [*words_of(r[1]), b""]
        got = rows[r[0], len(tokens)]
        assert got["held_out"] == held(r[0]) and got["train_tokens"] == n
        assert got["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert got["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert got["score"] < 0
    assert maxent.scored(docs, rounds=1).count() == len(corpus)


def test_lm_lowers_ascii_letters_and_knows_the_end(spark, monkeypatch):
    """Words differ by other letters' case alone; the end counts even where more words than are known are as frequent."""
    texts = ["The the THE É", "the é A", None, "Ab aB \u0130"]
    rows = [(i, t) for i, t in enumerate(texts * 4)]
    lower = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in lower(t))
    n, v = sum(counts.values()), len(counts)
    for known in (maxent.KNOWN, 0):
        monkeypatch.setattr(maxent, "KNOWN", known)
        got = {r["doc_id"]: r for r in maxent.scored(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            want = [counts[w] for w in lower(t)]
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(want), sum(c > 0 for c in want), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in want))


def test_lm_learns_order(spark):
    """Words that follow each other always are worth more than their frequency."""
    cycle = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(cycle[(i + j) % 8] for j in range(60))) for i in range(300)]
    got = maxent.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).where("held_out").collect()
    assert got and all(r["score"] > 0.5 * r["base_score"] for r in got)


def test_lm_outcomes_sum_to_one():
    words = maxent.Vocabulary([(b"", 9), *((f"w{i}".encode(), 50 - i) for i in range(40))], 1284, 41, {})
    model = maxent.Model(words)
    rng = np.random.default_rng(0)
    model.weights = {k: rng.normal(size=w.shape).astype(np.float32) for k, w in model.weights.items()}
    every = np.arange(maxent.HEAD + maxent.TAILS)
    p = 10 ** model.log10(every, np.full(len(every), 3), np.full(len(every), 7))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_lm_uses_all_six_templates():
    """Words two and three back move the weights: classes by both skips, tokens of a class by the one two back."""
    words = maxent.Vocabulary([(b"", 9), *((f"w{i}".encode(), 50 - i) for i in range(40))], 1284, 41, {})
    model = maxent.Model(words)
    assert len(maxent.SHAPES) == 6
    squares = {k: np.full(w.shape, 0.1, np.float32) for k, w in model.weights.items()}
    outcome, *before = model.sequence(np.arange(1, 9), np.arange(1, 9), np.array([5, 3]), 0)
    assert before[2].tolist() == [maxent.START] * 3 + [1, 2, 3] + [maxent.START] * 3 + [6]
    model.train(outcome, *before, squares)
    assert all(np.any(w) for w in model.weights.values())
    far = [np.full(1, 3), np.full(1, 7)]
    rng = np.random.default_rng(0)
    model.weights = {k: rng.normal(size=w.shape).astype(np.float32) for k, w in model.weights.items()}
    assert model.log10(np.array([5]), *far, np.full(1, 1)) != model.log10(np.array([5]), *far, np.full(1, 2))


def test_quality(docs, corpus):
    rows = {(r["doc_id"], r["__q"]["n_words"]): r["__q"] for r in quality.judge(docs).collect()}
    for r in corpus:
        w = words_of(r[1])
        q = rows[r[0], len(w)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        counts = Counter(grams)
        covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r[1] or "").split("\n") if x.encode().strip()]
        assert q["n_repeat_words"] == len(covered)
        assert q["word_chars"] == sum(len(x.decode()) for x in w) and q["n_dup_lines"] == len(lines) - len(set(lines))
        assert q["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (q["kept"] and q["base_failed"])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 125 or doc_id = 120").count() == 0


def test_quality_cutoffs_adapt(spark):
    clean = [(i, "word " * 3 + " ".join(f"w{i}x{j}" for j in range(40)), "en", "a") for i in range(100)]
    symbols = [(200 + i, " ".join(f"$w{i}x{j}#" for j in range(40)), "en", "b") for i in range(100)]
    few = [(400, " ".join(f"$w{j}#" for j in range(40)), "en", "c"), (401, " ".join(f"$#$w{j}#" for j in range(40)), "en", "a")]
    df = spark.createDataFrame(clean + symbols + few, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.keep(df).collect()}
    assert set(range(100)) <= kept and set(range(200, 300)) <= kept and 401 not in kept and 400 in kept


def test_sentencepiece(docs, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    odd = ["▁▁a▁ b", "  two  spaces ", "\n\t\x00", "<s>▁</s>", "日本語 emoji 😀 ", "a" * 300, " "]
    rows = [*corpus, *((500 + i, t, "en", "s", 0) for i, t in enumerate(odd))]
    df = docs.sparkSession.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = ordered(sentencepieces.digests(df, tokenizer_path()).collect())
    want = []
    for doc, text, *_ in rows:
        ids = sp.encode(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids)).encode()), sha(sp.decode(ids).encode())))
    assert got == ordered(want)
    full = {r["doc_id"]: r for r in sentencepieces.encode_texts(df, tokenizer_path()).where("doc_id >= 500").collect()}
    assert all(full[500 + i]["ids"] == sp.encode(t) and full[500 + i]["decoded"] == sp.decode(sp.encode(t)) for i, t in enumerate(odd))


def test_empty_tables(spark, empty):
    assert line_dedup.digest(empty).count() == line_dedup.keep(empty).count() == 0
    assert substring_dedup.parse(empty).count() == simhash.near_duplicates(empty).count() == simhash.keep_first(empty).count() == 0
    assert mixing.taken(empty).count() == mixing.mixed(empty).count() == 0
    assert maxent.scored(empty).count() == 0
    assert quality.keep(empty).count() == licenses.digest(licenses.scan(empty)).count() == 0
    assert sentencepieces.digests(empty, tokenizer_path()).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_pipeline(spark, docs, empty):
    """Every stage keeps the columns, works on its predecessor's rows, and run() is the stages in order."""
    now = docs.drop("key", "t")
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = step(spark, before, "")
        assert i == len(corpus_pipeline.STAGES) - 1 or now.columns == before.columns
        assert step(spark, empty, "").count() == 0
    ids = [r["doc_id"] for r in now.collect()]
    assert 100 not in ids and 120 not in ids and 123 in ids and ids.count(3) <= 2
