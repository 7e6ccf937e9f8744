"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks. Each block is read as a vector: its tag path and its words, both
hashed, and a few figures. A bidirectional LSTM in numpy reads the sequence from both ends, so that
every block is labelled with the whole page as its context. It is trained here, on a bounded sample
of the pages: labels come from rules over tag paths, and every sample page is also shown with its
containers renamed and with foreign blocks (menus, notices, adverts, forms, comments) put in, so
that the labeller learns paths which the sample itself doesn't have.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.llm.page_blocks import Block, blocks
from geoalbums.llm.sampling import hash_sample
from geoalbums.llm.words import LETTERS, LOWER, U64, slices, words

PATH_WIDTH = 64
WORD_WIDTH = 16
WIDTH = PATH_WIDTH + WORD_WIDTH + 6

_ASIDE = frozenset(
    "nav header footer aside form button select option label dialog menu head title fieldset legend textarea .nav .navbar"
    " .navigation .menu .header .footer .sidebar .aside .ad .ads .advert .adverts .advertisement .banner .promo .sponsor"
    " .sponsored .cookie .cookies .consent .notice .alert .popup .modal .overlay .subscribe .newsletter .share .sharing"
    " .social .related .recommended .breadcrumb .breadcrumbs .comment .comments .reply .replies .respond .disqus"
    " .pagination .pager .tags .toolbar .login .signup .form .search .widget .complementary .contentinfo .copyright".split()
)
_MAIN = frozenset("article main .article .main .content .post .entry .story .body".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote td dd figcaption".split())
_FOREIGN = [
    ("nav", "ul", "li", "a"), ("header", "div"), ("footer", "p"), ("aside", "p"), ("aside", "div", "ul", "li"), ("form", "label"),
    ("form", "p"), ("button",), ("div", ".sidebar", "p"), ("div", ".ad"), ("div", ".ads", "p"), ("div", ".advert"), ("div", ".advertisement", "p"),
    ("div", ".cookie", ".notice"), ("div", ".cookie", "p"), ("div", ".notice", "p"), ("div", ".banner"), ("div", ".newsletter", "p"),
    ("div", ".subscribe", "form"), ("section", ".comments", "p"), ("div", ".comment", "p"), ("div", ".comments", "div", ".comment", "p"),
    ("ol", ".comments", "li"), ("ul", ".comments", "li", "p"), ("div", ".related", "ul", "li"), ("div", ".share"), ("div", ".social", "a"), ("ul", ".menu", "li", "a"),
    ("div", ".breadcrumbs"), ("div", ".widget", "p"), ("div", ".promo"), ("div", ".popup", "p"), ("section", ".comment", "div"),
    ("div", ".nav"), ("div", ".header"), ("div", ".footer"), ("div", ".menu"), ("div", ".search", "form"), ("div", ".reply", "p"),
]
_HOLDERS = [
    ("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("section", ".entry"), ("div", ".article", ".body"),
    ("div", ".main", ".content"), ("div", ".story"),
]


@dataclass(frozen=True)
class LabellerConfig:
    """train_pages bounds the sample (drawn by a hash, nine tenths of that on average); it is learned from as a whole,
    pages of more than train_blocks blocks in several sequences. Every page is labelled, whatever its length."""

    train_pages: int = 600
    train_blocks: int = 120
    hidden: int = 16
    rounds: int = 8
    batch: int = 32
    rate: float = 0.02
    seed: int = 11


@dataclass(frozen=True)
class Labeller:
    """Weights of both directions (input, recurrent, bias) and of the output."""

    ahead: tuple[np.ndarray, np.ndarray, np.ndarray]
    back: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray
    bias: float


def rule_labels(page: list[Block]) -> np.ndarray:
    """What the paths say: inside the main container, if there is one, and not inside anything aside."""
    held = [not _MAIN.isdisjoint(b.path) for b in page]
    out = np.zeros(len(page))
    for i, b in enumerate(page):
        if not _ASIDE.isdisjoint(b.path):
            continue
        prose = b.path and b.path[-1] in _PROSE or len(b.text) >= 80
        out[i] = held[i] if any(held) else (prose and 2 * b.linked < len(b.text))
    return out


def _varied(page: list[Block], others: list[str], rng: random.Random) -> list[Block]:
    """The page with its main container renamed and foreign blocks put in."""
    holder = rng.choice(_HOLDERS)
    out = []
    for b in page:
        path = tuple(x for name in b.path for x in (holder if name in ("article", "main") else (name,)))
        out.append(b._replace(path=tuple(dict.fromkeys(path))))
    for _ in range(rng.randrange(5)):
        inner = rng.random() < 0.5
        before = ("html", "body", *(holder if inner else ()))
        path = tuple(dict.fromkeys((*before, *rng.choice(_FOREIGN))))
        at = rng.randrange(len(out) + 1)
        for _ in range(rng.randrange(1, 4)):
            text = rng.choice(others)
            text = text if rng.random() < 0.6 else " ".join(text.split()[: rng.randrange(1, 8)])
            out.insert(at, Block(path, text or "x", len(text) if path[-1] == "a" else 0))
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    found = _paths.get(path)
    if found is None:
        found = np.zeros(PATH_WIDTH, dtype=np.float32)
        for name in path:
            for seed in (b"1", b"2"):
                h = crc32(seed + name.encode())
                found[h % PATH_WIDTH] += 1 if h & 0x10000 else -1
        if len(_paths) < 50_000:
            _paths[path] = found
    return found


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row per block of all pages."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), WIDTH), dtype=np.float32)
    if not flat:
        return out
    for i, b in enumerate(flat):
        out[i, :PATH_WIDTH] = _path_vector(b.path)
    counts = []
    for part in slices(pa.array([b.text for b in flat], pa.string())):
        w = words(part, LETTERS, LOWER)
        at = w.text * WORD_WIDTH + (w.key % U64(WORD_WIDTH)).astype(np.int64)
        found = np.bincount(at, minlength=part.texts * WORD_WIDTH).reshape(part.texts, WORD_WIDTH)
        counts.append(found / np.maximum(w.counts, 1)[:, None])
    out[:, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] = np.concatenate(counts)
    length = np.array([len(b.text) for b in flat])
    place = np.concatenate([np.arange(len(page)) / max(1, len(page) - 1) for page in pages])
    figures = [
        np.log1p(length) / 5,
        np.array([b.linked for b in flat]) / length,
        np.array([b.text.count(".") + b.text.count(",") for b in flat]) / length * 10,
        place,
        np.array([b.text[-1] in ".!?" for b in flat]),
        np.array([b.text[0] == "©" for b in flat]),
    ]
    out[:, PATH_WIDTH + WORD_WIDTH :] = np.stack(figures, axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, weights, keep: bool = False):
    """States of one direction: x is time x pages x width; masked steps hand their state on."""
    w, u, b = weights
    steps, pages, hidden = x.shape[0], x.shape[1], u.shape[0]
    pre = (x.reshape(-1, x.shape[2]) @ w + b).reshape(steps, pages, 4 * hidden)
    h = np.zeros((pages, hidden), dtype=x.dtype)
    c = np.zeros_like(h)
    out = np.zeros((steps, pages, hidden), dtype=x.dtype)
    tape = []
    for t in range(steps):
        z = pre[t] + h @ u
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tanh_c = np.tanh(c_new)
        if keep:
            tape.append((i, f, o, g, c, h, tanh_c))
        c = np.where(m, c_new, c)
        h = np.where(m, o * tanh_c, h)
        out[t] = h
    return (out, tape) if keep else out


def _lstm_gradients(x: np.ndarray, mask: np.ndarray, weights, tape, d_out: np.ndarray):
    w, u, b = weights
    hidden = u.shape[0]
    dh = np.zeros(d_out.shape[1:], dtype=x.dtype)
    dc = np.zeros_like(dh)
    dz_all = np.zeros((*d_out.shape[:2], 4 * hidden), dtype=x.dtype)
    du = np.zeros_like(u)
    for t in range(len(tape) - 1, -1, -1):
        i, f, o, g, c_before, h_before, tanh_c = tape[t]
        m = mask[t][:, None]
        dh = dh + d_out[t]
        dh_in = np.where(m, dh, 0)
        dc_in = np.where(m, dc, 0) + dh_in * o * (1 - tanh_c**2)
        dz = np.concatenate(
            [dc_in * g * i * (1 - i), dc_in * c_before * f * (1 - f), dh_in * tanh_c * o * (1 - o), dc_in * i * (1 - g**2)], axis=1
        )
        dz_all[t] = dz
        du += h_before.T @ dz
        dh = np.where(m, dz @ u.T, dh)
        dc = np.where(m, dc_in * f, dc)
    flat = dz_all.reshape(-1, 4 * hidden)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as time x pages x width, forward, and the mask of what is there."""
    steps = max(len(r) for r in rows)
    x = np.zeros((steps, len(rows), rows[0].shape[1]), dtype=np.float32)
    mask = np.zeros((steps, len(rows)), dtype=bool)
    for j, r in enumerate(rows):
        x[: len(r), j] = r
        mask[: len(r), j] = True
    return x, mask


def _logits(model: Labeller, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    h = np.concatenate([_lstm(x, mask, model.ahead), _lstm(x[::-1], mask[::-1], model.back)[::-1]], axis=2)
    return h @ model.out + model.bias


def fit(pages: list[list[Block]], cfg: LabellerConfig = LabellerConfig()) -> Labeller | None:
    """Train on the pages and their variants, by Adam over whole sequences.

    A page of more than `train_blocks` blocks is cut into sequences of like length after labels and
    vectors were taken of the whole page. None if no page has a block.
    """
    pages = [p for p in pages if p]
    if not pages:
        return None
    rng = random.Random(cfg.seed)
    draw = np.random.default_rng(cfg.seed)
    others = [b.text for page in pages for b in page]
    shown = pages + [_varied(page, others, rng) for page in pages for _ in range(3)]
    # a page and its variants, which are somewhat longer, are cut into as many sequences
    parts = [-(-len(page) // cfg.train_blocks) for page in pages]
    parts += [n for n in parts for _ in range(3)]
    x = [part for page, n in zip(shown, parts) for part in np.array_split(vectors([page]), n)]
    y = [part for page, n in zip(shown, parts) for part in np.array_split(rule_labels(page), n)]
    n = cfg.hidden

    def fresh(rows, columns):
        return (draw.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

    params = [
        fresh(WIDTH, 4 * n), fresh(n, 4 * n), np.zeros(4 * n, dtype=np.float32),
        fresh(WIDTH, 4 * n), fresh(n, 4 * n), np.zeros(4 * n, dtype=np.float32),
        fresh(2 * n, 1)[:, 0], np.zeros(1, dtype=np.float32),
    ]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(cfg.rounds):
        order = np.array(sorted(range(len(x)), key=lambda i: (len(x[i]) // 8, draw.random())))
        batches = [order[k : k + cfg.batch] for k in range(0, len(order), cfg.batch)]
        for k in draw.permutation(len(batches)):
            xs, mask = _padded([x[i] for i in batches[k]])
            ys, _ = _padded([y[i][:, None] for i in batches[k]])
            ahead, back = tuple(params[:3]), tuple(params[3:6])
            h1, tape1 = _lstm(xs, mask, ahead, keep=True)
            h2, tape2 = _lstm(xs[::-1], mask[::-1], back, keep=True)
            h = np.concatenate([h1, h2[::-1]], axis=2)
            error = np.where(mask, _sigmoid(h @ params[6] + params[7]) - ys[:, :, 0], 0) / mask.sum()
            error = error.astype(np.float32)
            dh = error[:, :, None] * params[6]
            grads = [
                *_lstm_gradients(xs, mask, ahead, tape1, dh[:, :, :n]),
                *_lstm_gradients(xs[::-1], mask[::-1], back, tape2, dh[::-1, :, n:]),
                np.tensordot(error, h, axes=([0, 1], [0, 1])), np.array([error.sum()]),
            ]
            step += 1
            rate = cfg.rate * 0.5 ** (epoch / 3)
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Labeller(tuple(params[:3]), tuple(params[3:6]), params[6], float(params[7][0]))


def label(model: Labeller | None, pages: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks of each page are main text; pages of like length are read together. Without a
    model the rules over tag paths decide."""
    if model is None:
        return [rule_labels(page).astype(bool) for page in pages]
    out = [np.zeros(len(page), dtype=bool) for page in pages]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * len(pages[order[high]]) <= 20_000:
            high += 1
        group = order[low:high]
        rows = np.split(vectors([pages[i] for i in group]), np.cumsum([len(pages[i]) for i in group])[:-1])
        x, mask = _padded(rows)
        found = _logits(model, x, mask) > 0
        for j, i in enumerate(group):
            out[i] = found[: len(pages[i]), j]
        low = high
    return out


def train(pages: DataFrame, cfg: LabellerConfig = LabellerConfig()) -> Labeller | None:
    """Fit on a sample of at most `train_pages` rows of `pages` (page_id, html)."""
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    sample = hash_sample(pages, key, cfg.train_pages * 9 // 10).where("html IS NOT NULL")
    drawn = sample.select(key.alias("key"), "html").limit(cfg.train_pages).collect()
    drawn.sort(key=lambda row: (row["key"], row["html"]))
    return fit([blocks(row["html"]) for row in drawn], cfg)


def main_text(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """Per row of `pages` (page_id, url, html; other columns are ignored): page_id, url, text,
    n_chars, n_blocks.

    text joins the blocks labelled as main, in page order, by two line feeds: whole, without a
    cap, empty if there are none (as for a null or empty page). Repeated rows give equal rows.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                found = [blocks(page or "") for page in part.column(2).to_pylist()]
                texts = ["\n\n".join(b.text for b, main in zip(page, own) if main) for page, own in zip(found, label(model, found))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in found], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars", "n_blocks"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_blocks long")
