"""Bidirectional LSTM over the blocks of a page, in numpy.

A block enters as three sums of learned vectors (names on its element path,
names of its innermost element, hashed words of its text) and a few measures.
One LSTM reads a page's blocks forwards and one backwards; a block is judged
from both states, so from all of its page.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

from fieldshift.llm.html_blocks import Block

NAME_ROWS, WORD_ROWS, WIDTH, HIDDEN, MEASURES = 1024, 2048, 12, 24, 10
INPUT = 3 * WIDTH + MEASURES


def _measures(block: Block, at: int, n: int) -> list[float]:
    text = block.text
    size, words = len(text), text.count(" ") + 1
    return [
        np.log1p(size) / 8.0,
        np.log1p(words) / 6.0,
        block.linked / size,
        sum(text.count(c) for c in ".,;!?") / words,
        float(text[-1] in ".!?\"”…"),
        float("©" in text),
        sum(text.count(c) for c in "|/:>»") / words,
        at / n,
        1.0 / (1 + at),
        1.0 / (n - at),
    ]


def features(page: list[Block]) -> tuple[list[list[int]], list[list[int]], list[list[int]], np.ndarray]:
    """Rows of names on the path, names of the innermost element, words, and measures of every block of a page."""
    cache: dict[tuple, list[int]] = {}
    paths, leaves, words = [], [], []
    for b in page:
        for e in b.path[-1:] + b.path:
            if e not in cache:
                names = [*e, *[e[0] + n for n in e[1:]]]  # the tag, its words, and both together
                cache[e] = [crc32(n.encode()) % NAME_ROWS for n in names]
        paths.append([x for e in b.path for x in cache[e]] or [0])
        leaves.append(cache[b.path[-1]] if b.path else [0])
        words.append([crc32(w) % WORD_ROWS for w in b.text.lower().encode().split()] or [0])
    n = len(page)
    return paths, leaves, words, np.array([_measures(b, i, n) for i, b in enumerate(page)], np.float32).reshape(n, MEASURES)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, start of each list, and the square root of each length."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.fromiter((x for row in lists for x in row), np.int64, int(lengths.sum()))
    return values, np.cumsum(lengths) - lengths, np.sqrt(lengths).astype(np.float32)


class Batch:
    """Blocks of several pages, padded to the longest."""

    def __init__(self, pages: list[tuple]):
        self.lengths = np.array([len(p[3]) for p in pages])
        self.height, self.size = len(pages), int(self.lengths.max())
        row = np.repeat(np.arange(self.height), self.lengths)
        col = np.arange(len(row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.row, self.col = row, col
        self.back = self.lengths[row] - 1 - col  # the place in the backward reading
        self.names, self.leaf, self.words = (_flat([x for p in pages for x in p[k]]) for k in range(3))
        self.measures = np.concatenate([p[3] for p in pages])


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = lambda *shape, by: (rng.normal(size=shape) / np.sqrt(by)).astype(np.float32)
    bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
    bias[:, :, HIDDEN : 2 * HIDDEN] = 1.0
    return {
        "names": scale(NAME_ROWS, WIDTH, by=WIDTH),
        "words": scale(WORD_ROWS, WIDTH, by=4 * WIDTH),
        "in": scale(2, INPUT, 4 * HIDDEN, by=INPUT),
        "hidden": scale(2, HIDDEN, 4 * HIDDEN, by=HIDDEN),
        "bias": bias,
        "out": scale(2 * HIDDEN + INPUT, by=2 * HIDDEN + INPUT),
        "shift": np.zeros(1, np.float32),
    }


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def _summed(table: np.ndarray, flat) -> np.ndarray:
    values, starts, roots = flat
    return np.add.reduceat(table[values], starts, axis=0) / roots[:, None]


def forward(model: dict[str, np.ndarray], batch: Batch, keep: bool = False):
    """Score per block, above zero for main text; with ``keep`` also what the gradient needs."""
    x = np.concatenate(
        [_summed(model["names"], batch.names), _summed(model["names"], batch.leaf), _summed(model["words"], batch.words), batch.measures], axis=1
    )
    padded = np.zeros((2, batch.size, batch.height, INPUT), np.float32)
    padded[0, batch.col, batch.row] = x
    padded[1, batch.back, batch.row] = x
    z = padded @ model["in"][:, None] + model["bias"][:, None]
    h = np.zeros((2, batch.height, HIDDEN), np.float32)
    c = np.zeros_like(h)
    states = np.empty((2, batch.size, batch.height, HIDDEN), np.float32)
    trace = []
    for t in range(batch.size):
        gates = z[:, t] + h @ model["hidden"]
        soft = _sigmoid(gates[..., : 3 * HIDDEN])
        i, f, o = soft[..., :HIDDEN], soft[..., HIDDEN : 2 * HIDDEN], soft[..., 2 * HIDDEN :]
        g = np.tanh(gates[..., 3 * HIDDEN :])
        before = c
        c = f * c + i * g
        wide = np.tanh(c)
        if keep:
            trace.append((i, f, o, g, before, wide, h))
        h = o * wide
        states[:, t] = h
    read = np.concatenate([states[0, batch.col, batch.row], states[1, batch.back, batch.row], x], axis=1)
    score = read @ model["out"] + model["shift"][0]
    return (score, x, padded, read, trace) if keep else score


def gradient(model: dict[str, np.ndarray], batch: Batch, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss over the blocks and its gradient."""
    score, x, padded, read, trace = forward(model, batch, keep=True)
    p = _sigmoid(score)
    loss = float(np.mean(np.logaddexp(0.0, np.where(label > 0, -score, score))))
    d_score = ((p - label) / len(label)).astype(np.float32)
    grads = {"out": read.T @ d_score, "shift": np.array([d_score.sum()], np.float32)}
    d_read = d_score[:, None] * model["out"]
    d_x = d_read[:, 2 * HIDDEN :].copy()
    d_states = np.zeros((2, batch.size, batch.height, HIDDEN), np.float32)
    d_states[0, batch.col, batch.row] = d_read[:, :HIDDEN]
    d_states[1, batch.back, batch.row] = d_read[:, HIDDEN : 2 * HIDDEN]
    d_z = np.empty((2, batch.size, batch.height, 4 * HIDDEN), np.float32)
    d_h = np.zeros((2, batch.height, HIDDEN), np.float32)
    d_c = np.zeros_like(d_h)
    d_hidden = np.zeros_like(model["hidden"])
    turned = model["hidden"].transpose(0, 2, 1)
    for t in range(batch.size - 1, -1, -1):
        i, f, o, g, before, wide, h = trace[t]
        d_h = d_h + d_states[:, t]
        d_c = d_c + d_h * o * (1 - wide * wide)
        gate = np.concatenate(
            [d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * wide * o * (1 - o), d_c * i * (1 - g * g)], axis=2
        )
        d_z[:, t] = gate
        d_hidden += h.transpose(0, 2, 1) @ gate
        d_h, d_c = gate @ turned, d_c * f
    grads["hidden"] = d_hidden
    flat = d_z.reshape(2, -1, 4 * HIDDEN)
    grads["bias"] = flat.sum(axis=1, keepdims=True)
    grads["in"] = padded.reshape(2, -1, INPUT).transpose(0, 2, 1) @ flat
    d_in = d_z @ model["in"].transpose(0, 2, 1)[:, None]
    d_x += d_in[0, batch.col, batch.row] + d_in[1, batch.back, batch.row]
    for table, parts in (("names", ((batch.names, 0), (batch.leaf, 1))), ("words", ((batch.words, 2),))):
        grads[table] = np.zeros_like(model[table])
        for (values, starts, roots), k in parts:
            share = d_x[:, k * WIDTH : (k + 1) * WIDTH] / roots[:, None]
            counts = np.diff(np.r_[starts, len(values)])
            np.add.at(grads[table], values, np.repeat(share, counts, axis=0))
    return loss, grads


def fit(pages: list[tuple], labels: list[np.ndarray], epochs: int = 12, height: int = 24, rate: float = 0.01, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam on pages in seeded order; the same pages give the same model."""
    model = initial(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    rng = np.random.default_rng(seed)
    step, total = 0, epochs * -(-len(pages) // height)
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for top in range(0, len(order), height):
            picked = order[top : top + height]
            batch = Batch([pages[i] for i in picked])
            _, grads = gradient(model, batch, np.concatenate([labels[i] for i in picked]))
            step += 1
            pace = rate * (1.0 - 0.9 * step / total)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return model


def scores(model: dict[str, np.ndarray], pages: list[list[Block]], cells: int = 40_000) -> list[np.ndarray]:
    """Score of every block of every page; pages of like length are read together, ``cells`` blocks at most unless one page is longer."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    top = 0
    while top < len(order):
        end = top + 1
        while end < len(order) and (end + 1 - top) * len(pages[order[end]]) <= cells:
            end += 1
        picked = order[top:end]
        batch = Batch([features(pages[i]) for i in picked])
        score = forward(model, batch)
        for i, part in zip(picked, np.split(score, np.cumsum(batch.lengths)[:-1])):
            out[i] = part
        top = end
    return out
