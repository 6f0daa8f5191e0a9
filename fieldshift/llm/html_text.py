"""Main text of web pages by a recurrent block labeller.

Pages are cut into leaf blocks; a bidirectional LSTM reads the whole page and
labels every block; blocks of main text are joined in page order. The labeller
is fitted in one task on ``TRAIN_PAGES`` pages, those with the smallest hash of
their key whose markup tells its main part, and on as many random layouts of
their texts, so it does not rest on one template. The model is some 100,000
numbers. Every page is then labelled where it is read, without a shuffle.

Defined cases: null or empty html, and pages without main text, give the empty
string; text that stands in no element is a block like any other; a page cut
off anywhere is read to its end; repeated rows are repeated; if no sampled page
tells its main part there is nothing to learn from, and every block counts that
stands in no element named as something else; an empty table gives no rows; columns other than key and html pass if named in
``keep``.
"""

from __future__ import annotations

import pickle
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldshift.llm import html_layouts, html_lstm
from fieldshift.llm.html_blocks import Block, blocks
from fieldshift.llm.tables import as_bytes, pieces

#: Pages the labeller is fitted on, random layouts of each, and blocks of one page that a training step reads at once.
TRAIN_PAGES, LAYOUTS, WINDOW = 256, 4, 160
SLICE_BYTES = 2 << 20


def examples(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> list[tuple[list[Block], np.ndarray]]:
    """Labelled pages: those that tell their main part, and random layouts of their texts."""
    rng = Random(seed)
    read = [(page, label) for page in map(blocks, pages) if page and (label := html_layouts.by_markup(page)) is not None and label.any()]
    pool = [b.text for page, _ in read for b in page]
    out = list(read)
    for page, label in read:
        for _ in range(layouts):
            text, main = html_layouts.laid_out(rng, page, label, pool)
            made = blocks(text)
            out.append((made, np.array([b.text in main for b in made], np.float32)))
    return out


def _windows(page: tuple, label: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
    cut = range(0, len(label), WINDOW)
    return [(tuple(part[i : i + WINDOW] for part in page), label[i : i + WINDOW]) for i in cut]


def fit(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> dict[str, np.ndarray] | None:
    """Model of the labelled pages and their layouts; None without any."""
    ready = [w for page, label in examples(pages, layouts, seed) for w in _windows(html_lstm.features(page), label)]
    if not ready:
        return None
    return html_lstm.fit([r[0] for r in ready], [r[1] for r in ready], seed=seed)


def train(pages: DataFrame, key: str = "page_id", html: str = "html", size: int = TRAIN_PAGES, seed: int = 11) -> dict[str, np.ndarray] | None:
    """Model fitted on ``size`` pages in one task; None if none of them tells its main part."""
    picked = pages.select(F.xxhash64(F.col(key).cast("string"), as_bytes(html)).alias("_o"), as_bytes(html).alias("_h"))
    picked = picked.orderBy("_o").limit(size)

    def run(batches):
        rows = [r for b in batches for r in zip(b.column("_o").to_pylist(), b.column("_h").to_pylist())]
        if rows:
            texts = [h.decode("utf-8", "replace") for _, h in sorted(rows)]
            yield pa.record_batch([pa.array([pickle.dumps(fit(texts, seed=seed))], pa.binary())], names=["model"])

    found = picked.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def main_texts(model: dict[str, np.ndarray] | None, pages: list[str]) -> list[str]:
    read = [blocks(p) for p in pages]
    scored = [html_layouts.unnamed(page) for page in read] if model is None else html_lstm.scores(model, read)
    return ["\n".join(b.text for b, s in zip(page, score) if s > 0) for page, score in zip(read, scored)]


def extracted(
    pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), model: dict[str, np.ndarray] | None = None
) -> DataFrame:
    """(key, kept columns, text) per page."""
    model = model or train(pages, key, html)
    names = [key, *keep]
    ready = pages.select(F.struct(*names).alias("_r"), as_bytes(html).alias("_h"))
    session = pages.sparkSession
    held = session.sparkContext.broadcast(model)

    def run(batches):
        for part in pieces(batches, "_h", SLICE_BYTES):
            texts = [h.decode("utf-8", "replace") for h in part.column("_h").to_pylist()]
            yield pa.record_batch([part.column("_r"), pa.array(main_texts(held.value, texts), pa.string())], names=["_r", "text"])

    out = ready.mapInArrow(run, f"_r {ready.schema['_r'].dataType.simpleString()}, text string")
    return out.select(*[F.col(f"_r.{n}").alias(n) for n in names], "text")
