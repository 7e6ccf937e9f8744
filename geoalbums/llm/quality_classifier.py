"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Statistics of every text are computed on the executors. A bounded sample of labelled rows is
fitted on the driver: values become bins, each level of a tree is grown from histograms of
gradients, all nodes at once. The trees are flattened into arrays of equal depth, so that scoring
moves all texts of a slice down one level by one array step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoalbums.llm.quality_rules import repeated_words, text_lines
from geoalbums.llm.sampling import hash_sample
from geoalbums.llm.words import U64, Slice, mix, row_sums, slices, words
from geoalbums.sources.shared import materialize

STATISTICS = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "stops", "other_marks", "beyond_ascii",
    "log_lines", "line_words", "longest_line", "short_lines", "repeated_lines", "repeated_5", "repeated_3",
    "distinct_words", "top_word", "ending_stop", "ending_comma", "capitalised", "short_words", "long_words", "at_signs",
)


@dataclass(frozen=True)
class BoostConfig:
    """train_rows bounds the labelled sample (drawn by a hash, nine tenths of that on average)."""

    train_rows: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    least_weight: float = 2.0
    ridge: float = 1.0


@dataclass(frozen=True)
class BoostedTrees:
    """Node i of a tree has children 2i + 1 and 2i + 2; beyond the last level come its leaves."""

    edges: np.ndarray  # statistics x (bins - 1)
    feature: np.ndarray  # trees x (2**depth - 1)
    bin: np.ndarray  # a value goes right if its bin is above
    leaf: np.ndarray  # trees x 2**depth
    base: float


def _mask(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters.encode())] = True
    return out


_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _mask("abcdefghijklmnopqrstuvwxyz")
_MARKS = [_mask("0123456789"), _mask("#*$%&|<>"), _mask("!?"), _mask(".,;:"), _mask("\"'()[]{}=+_/\\~^`-"), np.arange(256) >= 0x80]


def _extremes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    has = np.flatnonzero(np.diff(first) > 0)
    if len(has):
        out[has] = np.maximum.reduceat(values, first[has])
    return out


def statistics(part: Slice) -> np.ndarray:
    """One row per text, all zero without words."""
    w = words(part)
    n = w.counts.astype(float)
    some, size = np.maximum(n, 1), np.maximum(np.diff(part.at), 1)

    def in_bytes(mask):
        return row_sums(mask[part.data].astype(np.int64), part.at)

    def per_word(mask):
        return row_sums(mask.astype(np.int64), w.first) / some

    length = w.end - w.start
    text, _, raw, low, high = text_lines(part, w)
    line_first = np.searchsorted(text, np.arange(part.texts + 1))
    lines = np.maximum(np.diff(line_first), 1)
    in_line = high - low
    marked = np.sort(mix(raw + text.astype(U64)))
    later = np.zeros(len(raw), dtype=bool)
    order = np.argsort(mix(raw + text.astype(U64)), kind="stable")
    later[order[1:]] = marked[1:] == marked[:-1]

    own = w.key + mix(w.text.astype(U64))
    order = np.argsort(own)
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    begin = np.flatnonzero(new)
    run_text, run_length = w.text[order[begin]], np.diff(np.append(begin, len(own)))
    top = np.zeros(part.texts)
    np.maximum.at(top, run_text, run_length)
    distinct = np.bincount(run_text, minlength=part.texts)

    last = part.data[w.end - 1] if len(w.end) else part.data[:0]
    head = part.data[w.start] if len(w.start) else part.data[:0]
    columns = [
        np.log1p(n), row_sums(length, w.first) / some, in_bytes(_UPPER) / np.maximum(in_bytes(_LETTER), 1),
        *[in_bytes(mask) / size for mask in _MARKS],
        np.log1p(np.diff(line_first)), row_sums(in_line, line_first) / lines, np.log1p(_extremes(in_line, line_first)),
        row_sums((in_line < 3).astype(np.int64), line_first) / lines, row_sums(later.astype(np.int64), line_first) / lines,
        repeated_words(w) / some, repeated_words(w, 3) / some, distinct / some, top / some,
        per_word((last == 0x2E) | (last == 0x21) | (last == 0x3F)), per_word(last == 0x2C), per_word(_UPPER[head]),
        per_word(length <= 2), per_word(length >= 20), in_bytes(_mask("@")) / size,
    ]
    out = np.stack([np.asarray(c, dtype=float) for c in columns], axis=1)
    out[n == 0] = 0
    return out


def fit(x: np.ndarray, y: np.ndarray, cfg: BoostConfig = BoostConfig()) -> BoostedTrees:
    """Logistic boosting; with one class or no rows the score is that of the labels alone."""
    inner = 2**cfg.depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = np.quantile(x, np.linspace(0, 1, cfg.bins + 1)[1:-1], axis=0).T if len(x) else np.zeros((len(STATISTICS), cfg.bins - 1))
    trees = cfg.trees if len(y) and 0 < y.sum() < len(y) else 0
    feature = np.zeros((trees, inner), dtype=np.int64)
    above = np.full((trees, inner), cfg.bins, dtype=np.int64)
    leaf = np.zeros((trees, inner + 1))
    binned = to_bins(x, edges)
    rows, width = binned.shape
    cells = binned + np.arange(width) * cfg.bins
    score = np.full(rows, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)
        for level in range(cfg.depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * cfg.bins) + cells).ravel()
            shape = (count, width, cfg.bins)
            g = np.bincount(at, np.repeat(grad, width), np.prod(shape)).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, width), np.prod(shape)).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + cfg.ridge) + (g_all - g) ** 2 / (h_all - h + cfg.ridge) - g_all**2 / (h_all + cfg.ridge)
            gain[(h < cfg.least_weight) | (h_all - h < cfg.least_weight)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            feature[t, first : first + count] = best // cfg.bins
            above[t, first : first + count] = np.where(good, best % cfg.bins, cfg.bins)
            node = _step(node, binned, feature[t], above[t])
        own = node - inner
        g, h = np.bincount(own, grad, inner + 1), np.bincount(own, hess, inner + 1)
        leaf[t] = -cfg.rate * g / (h + cfg.ridge)
        score += leaf[t][own]
    return BoostedTrees(edges, feature, above, leaf, base)


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.int64)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[j], x[:, j], "left")
    return out


def _step(node: np.ndarray, binned: np.ndarray, feature: np.ndarray, above: np.ndarray) -> np.ndarray:
    return 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > above[node])


def scores(model: BoostedTrees, x: np.ndarray) -> np.ndarray:
    binned = to_bins(x, model.edges)
    total = np.full(len(x), model.base)
    inner = model.leaf.shape[1] - 1
    for feature, above, leaf in zip(model.feature, model.bin, model.leaf):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(inner.bit_length()):
            node = _step(node, binned, feature, above)
        total += leaf[node - inner]
    return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, cfg: BoostConfig = BoostConfig()) -> BoostedTrees:
    """Fit on texts of `docs` (doc_id, text) with `labels` (doc_id, quality: 0 or 1).

    At most `train_rows` labelled ids, and as many rows of statistics, take part. Other labels
    and null ids are ignored; of several labels of an id the higher counts.
    """
    drawn = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = hash_sample(drawn, F.col("doc_id"), cfg.train_rows * 9 // 10)
    drawn = materialize(drawn.limit(cfg.train_rows).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int")), "labelled")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                x = statistics(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.row, part.texts), *[pa.array(x[:, j]) for j in range(x.shape[1])]],
                    names=["quality", *STATISTICS],
                )

    # the labelled ids are at most train_rows, so their broadcast is bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(drawn), "id")
    measured = texts.select("quality", "text").mapInArrow(measure, "quality int, " + ", ".join(f"{s} double" for s in STATISTICS))
    sample = measured.limit(cfg.train_rows).toArrow().to_pandas().sort_values(list(STATISTICS)).reset_index(drop=True)
    return fit(sample[list(STATISTICS)].to_numpy(dtype=float).reshape(-1, len(STATISTICS)), sample["quality"].to_numpy(dtype=float), cfg)


def score_quality(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """Adds `score` (0 to 1, higher: quality 1 likelier) to every row of `docs` (text; other
    columns stay). Null and empty texts get the score of a text without words. A column `score`
    that is there already is replaced."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(model, statistics(part)) for part in slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(found) if found else [], pa.float64())],
                names=[*batch.schema.names, "score"],
            )

    fields = [f for f in docs.schema.fields if f.name != "score"]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(predict, schema)
