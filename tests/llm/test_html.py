"""HTML extraction: scanner, gradient, held-out accuracy, hand-made pages, defined cases."""

import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from fieldshift.llm import html_layouts, html_lstm, html_text
from fieldshift.llm.html_blocks import blocks

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def pages():
    return [h or "" for h in pq.read_table(PAGES, columns=["html"]).column("html").to_pylist()]


@pytest.fixture(scope="module")
def model(pages):
    return html_text.fit(pages[:120])


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c<p>d<br>e &amp; f&nbsp;g</p>tail") == ["a b c", "d e & f g", "tail"]
    assert texts("<script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><div>yes") == ["yes"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul></li></ul>") == ["one", "two", "in"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p title='a>b'>x</p><p>3 < 4 &lt; 5</p>") == ["x", "3 < 4 < 5"]
    assert texts("<p>cut <a href='") == ["cut"] and texts("<!-- open <p>x") == [] and texts("<script>x") == []
    assert texts(None) == texts("") == texts(" \n ") == texts("<p></p>") == []
    found = blocks("<article class='post big'><p>a</p></article><nav><a href='/x'>menu</a></nav>")
    assert found[0].path == (("article", ".post", ".big"), ("p",)) and found[0].linked == 0
    assert found[1].path[0] == ("nav",) and found[1].linked == 4


def test_long_and_deep_pages():
    assert texts("<p>" + "word " * 400_000) == [("word " * 400_000).strip()]
    assert texts("<div>" * 3000 + "x") == ["x"]
    assert len(texts("<b <i " * 20_000)) <= 1


def test_gradient():
    page = blocks("<nav><a>a b</a><a>c</a></nav><article><h1>T</h1><p>one two.</p></article><p>end</p>")
    other = blocks("<div><p>x y</p></div>")
    batch = html_lstm.Batch([html_lstm.features(page), html_lstm.features(other)])
    label = np.array([0, 1, 1, 0, 1], np.float32)[: len(page) + len(other)]
    model = {k: v.astype(np.float64) for k, v in html_lstm.initial(3).items()}
    label = np.resize(label, len(page) + len(other))
    _, grads = html_lstm.gradient(model, batch, label)
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        spots = np.argwhere(np.abs(g) > np.abs(g).max() * 0.3)
        for spot in rng.permutation(spots)[:4]:
            at, step = tuple(spot), 1e-3
            moved = []
            for sign in (1, -1):
                shifted = {k: v.copy() for k, v in model.items()}
                shifted[name][at] += sign * step
                moved.append(html_lstm.gradient(shifted, batch, label)[0])
            assert (moved[0] - moved[1]) / (2 * step) == pytest.approx(float(g[at]), rel=0.05, abs=1e-5)


def test_held_out(pages, model):
    def wrong(examples):
        scored = html_lstm.scores(model, [p for p, _ in examples])
        return np.concatenate([(s > 0) != (label > 0) for s, (_, label) in zip(scored, examples)])

    own = [(p, html_layouts.by_markup(p)) for p in map(blocks, pages[120:])]
    assert wrong(own).mean() < 0.001
    made = html_text.examples(pages[120:200], layouts=2, seed=77)[80:]
    assert wrong(made).mean() < 0.02


def test_document_wide_context(pages, model):
    """One block alone is not told apart; the page around it decides."""
    article = [b.text for b in blocks(pages[130]) if len(b.text) > 150][0]
    page = f"<body><div><a href='/'>One</a> <a href='/'>Two</a></div><div><h1>Title</h1><p>{article}</p></div><div class='comments'><p>{article[:60]}</p></div></body>"
    assert article in html_text.main_texts(model, [page])[0].split("\n")


def test_hand_made_pages(model):
    body = "".join(f"<p>The {w} was seen again in the old town, and nobody could say why it had come back.</p>" for w in ("fox", "owl", "cat", "dog"))
    parts = [
        ("<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>", "Home"),
        ("<header><p>The Daily Example</p></header>", "Daily"),
        ("<div class='cookie-notice'>We use cookies on this site. Accept them to go on.</div>", "cookies"),
        ("<aside class='sidebar'><h3>Related</h3><ul><li><a href='/a'>Another tale</a></li></ul></aside>", "Another"),
        ("<div class='ad'>Buy two and pay for one only today.</div>", "Buy"),
        ("<form><label>Your mail</label><input name='m'><button>Send</button></form>", "mail"),
    ]
    for order in (parts, parts[::-1]):
        head, tail = "".join(p for p, _ in order[:3]), "".join(p for p, _ in order[3:])
        comments = "<section class='comments'><h2>Comments</h2><div class='comment'><p>What a lovely tale this is, thank you!</p></div></section>"
        page = f"<html><body>{head}<article><h1>A tale of the town</h1>{body}</article>{tail}{comments}<footer>&copy; 2024 Example</footer></body></html>"
        got = html_text.main_texts(model, [page])[0]
        want = "A tale of the town\n" + "\n".join(re.findall(r"<p>(.*?)</p>", body))
        assert got == want


def test_operator(spark, pages):
    rows = [(i, f"u{i}", h, 1) for i, h in enumerate(pages[:60])]
    rows += [(60, None, None, 1), (None, "u", "", 1), (61, "u", "  plain text  ", 1), rows[3], rows[3], (62, "u", pages[5] * 3, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html_text.extracted(df.repartition(3))
    assert out.columns == ["page_id", "url", "text"]
    got = sorted(((r[0], r[1], r[2]) for r in out.collect()), key=str)
    held = html_text.train(df)
    want = sorted(((r[0], r[1], t) for r, t in zip(rows, html_text.main_texts(held, [r[2] or "" for r in rows]))), key=str)
    assert got == want and len(got) == len(rows)
    by_id = {r[0]: r[2] for r in got}
    assert by_id[60] == "" and by_id[None] == ""
    heading = lambda page: html.unescape(re.search(r"<h1>(.*?)</h1>", page)[1])
    assert all(by_id[i].startswith(" ".join(heading(pages[i]).split())) for i in range(60))
    assert html_text.extracted(df.limit(0)).count() == 0
    # no page tells its main part: nothing to learn from
    plain = [(1, "u", None), (2, "u", ""), (3, None, "<nav>menu</nav><p>a &amp; b</p><div class='ad'>c</div>d")]
    rows = html_text.extracted(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()
    assert sorted((r[0], r[2]) for r in rows) == [(1, ""), (2, ""), (3, "a & b\nd")]
