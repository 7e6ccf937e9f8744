"""Language identification: words first, then shorter and shorter n-grams of characters.

A word that training has seen counts by its log frequency in each language. An unseen word is
scored by its n-grams, beginning with the longest: the first length of which the model knows an
n-gram decides. The model is a set of sorted arrays of 64-bit keys with one row of log
frequencies each; a text's score is the sum over its words, computed for a whole slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoalbums.llm.sampling import hash_sample
from geoalbums.llm.words import LOWER, U64, Slice, keys, mix, row_sums, runs, slices
from geoalbums.sources.shared import materialize

#: Bytes of words: ASCII letters and all of a character beyond ASCII.
ALPHABETIC = np.zeros(256, dtype=bool)
ALPHABETIC[0x41:0x5B] = ALPHABETIC[0x61:0x7B] = True
ALPHABETIC[0x80:] = True
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    """train_documents is about the size of the labelled sample (drawn by a hash), which bounds the model:
    every word and n-gram of it is kept; grams: lengths in characters, longest first; smoothing is
    added to every count."""

    train_documents: int = 20_000
    grams: tuple[int, ...] = (5, 4, 3, 2, 1)
    smoothing: float = 0.5


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    known: tuple[np.ndarray, ...]  # sorted keys: of words, then of n-grams, longest first
    scores: tuple[np.ndarray, ...]  # one row per key, one column per language
    grams: tuple[int, ...]


def _gram_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pieces of n characters of the words, each framed by one space, and each word's first."""
    length = end - start + 2
    first = np.concatenate([[0], np.cumsum(length)])
    framed = np.full(first[-1], 0x20, dtype=np.uint8)
    inner = np.arange(first[-1]) - np.repeat(first[:-1], length)
    letters = (inner > 0) & (inner < np.repeat(length, length) - 1)
    source = np.repeat(start, length) + inner - 1
    framed[letters] = LOWER[data[source[letters]]]
    # a character is its first byte and those that go on with it
    places = np.flatnonzero((framed & 0xC0) != 0x80)
    size = np.diff(np.append(places, len(framed)))
    character = framed[places].astype(U64)
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        character[more] |= framed[places[more] + j].astype(U64) << U64(8 * j)
    first = np.searchsorted(places, first)
    per_word = np.maximum(np.diff(first) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(per_word)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], per_word)
    out = np.full(len(at), n, dtype=U64)
    for j in range(n):
        out = mix(out * U64(0xD6E8FEB86659FD93) + character[at + j])
    return out, bounds


def _counts(column: pa.Array, code: np.ndarray, grams: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, code, key, count) over a column's slices: kind 0 for words, else the place of the
    n-gram length. Each text has a code, its language's; a slice's equal words are counted first."""
    for part in slices(pc.utf8_lower(column)):
        start, end, first = runs(ALPHABETIC[part.data], part.at)
        own = code[part.row + np.repeat(np.arange(part.texts), np.diff(first))]
        own, key, n, at = _summed(own, keys(part.data, start, end, LOWER), np.ones(len(start), dtype=np.int64))
        yield 0, own, key, n
        for kind, length in enumerate(grams, 1):
            gram, bounds = _gram_keys(part.data, start[at], end[at], length)
            per_word = np.diff(bounds)
            yield kind, *_summed(np.repeat(own, per_word), gram, np.repeat(n, per_word))[:3]


def _summed(code: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal (code, key) added up: code, key, n, and the index of one of each."""
    order = np.lexsort((key, code))
    k, c = key[order], code[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n[order], at) if len(at) else n[:0]
    return c[at], k[at], total, order[at]


def train(labelled: DataFrame, cfg: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Fit on `labelled` (doc_id, text, lang): a sample of about `train_documents`, counted by Spark.

    Rows without text or lang are ignored. What reaches the driver is the sample's distinct words
    and n-grams, in lower case as Unicode has it.
    """
    grams = cfg.grams
    rows = labelled.where("lang IS NOT NULL")
    sample = hash_sample(rows, F.col("doc_id"), cfg.train_documents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code = np.unique(np.array(batch.column(0).to_pylist(), dtype=str), return_inverse=True)
            for kind, own, key, n in _counts(batch.column(1), code, grams):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[own].tolist(), pa.string()),
                        pa.array(np.full(len(own), kind, dtype=np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(n),
                    ],
                    names=["lang", "kind", "key", "n"],
                )

    counted = sample.select(F.col("lang").cast("string"), "text").mapInArrow(count, "lang string, kind int, key long, n long")
    counted = materialize(counted.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")), "language-counts")
    languages = tuple(sorted(r["lang"] for r in counted.select("lang").distinct().collect()))
    by_language = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(languages)]
    per_key = counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), *by_language)
    per_key = materialize(per_key, "key-counts")
    known, scores = [], []
    for kind in range(len(grams) + 1):
        table = per_key.where(F.col("kind") == kind).toArrow()
        key = table["key"].to_numpy().view(U64)
        n = np.array([table[f"n{i}"].to_numpy() for i in range(len(languages))], dtype=float).reshape(len(languages), len(key)).T
        total = n.sum(axis=0) + cfg.smoothing * (len(key) + 1)
        order = np.argsort(key)
        known.append(key[order])
        scores.append(np.log((n[order] + cfg.smoothing) / total))
    return LanguageModel(languages, tuple(known), tuple(scores), grams)


def _find(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each key among the known ones, -1 if it isn't there."""
    if not len(known):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return np.where(known[at] == key, at, -1)


def word_scores(model: LanguageModel, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row per word: log frequencies by language, from the word or its longest known n-grams.

    An n-gram's row counts as the mean over the word's known n-grams of that length.
    """
    out = np.zeros((len(start), len(model.languages)))
    key = keys(data, start, end, LOWER)
    at = _find(model.known[0], key)
    out[at >= 0] = model.scores[0][at[at >= 0]]
    left = np.flatnonzero(at < 0)
    for n, known, scores in zip(model.grams, model.known[1:], model.scores[1:]):
        if not len(left) or not len(known):
            continue
        gram, bounds = _gram_keys(data, start[left], end[left], n)
        at = _find(known, gram)
        hit = at >= 0
        hits = row_sums(hit.astype(np.int64), bounds)
        values = np.zeros((len(gram), out.shape[1]))
        values[hit] = scores[at[hit]]
        sums = np.stack([row_sums(values[:, j], bounds) for j in range(out.shape[1])], axis=1)
        some = hits > 0
        out[left[some]] = sums[some] / hits[some, None]
        left = left[~some]
    return out


def _lettered(part: Slice) -> np.ndarray:
    """Texts with a letter. Beyond ASCII, Unicode decides."""
    plain = ALPHABETIC & (np.arange(256) < 0x80)
    out = row_sums(plain[part.data].astype(np.int64), part.at) > 0
    for r in np.flatnonzero(~out).tolist():
        raw = part.data[part.at[r] : part.at[r + 1]].tobytes()
        out[r] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score (or `names`, which replace columns of that name) to every row of
    `docs` (text; other columns stay as they are).

    Whole texts are scored, in lower case. lang_pred is `und` with score 0 if the text is null, empty or has no
    letter, or nothing was learned; score is the share of the best language among all after
    normalising the mean word. Equal scores: the language first in the alphabet.
    """
    languages = np.array([*model.languages, UNKNOWN], dtype=object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, share = [], []
            for part in slices(pc.utf8_lower(batch.column("text"))):
                start, end, first = runs(ALPHABETIC[part.data], part.at)
                count = np.diff(first)
                b = np.full(part.texts, len(languages) - 1)
                s = np.zeros(part.texts)
                if len(start) and len(model.languages):
                    unique, inverse = np.unique(keys(part.data, start, end, LOWER), return_inverse=True)
                    sample = np.zeros(len(unique), dtype=np.int64)
                    sample[inverse] = np.arange(len(start))
                    order = np.argsort(start[sample])
                    scored = np.empty((len(unique), len(model.languages)))
                    scored[order] = word_scores(model, part.data, start[sample][order], end[sample][order])
                    total = np.stack([row_sums(scored[inverse, j], first) for j in range(scored.shape[1])], axis=1)
                    has = (count > 0) & _lettered(part)
                    mean = total[has] / count[has, None]
                    odds = np.exp(mean - mean.max(axis=1, keepdims=True))
                    b[has] = odds.argmax(axis=1)
                    s[has] = odds.max(axis=1) / odds.sum(axis=1)
                best.append(languages[b])
                share.append(s)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.concatenate(best) if best else [], pa.string()),
                    pa.array(np.concatenate(share) if share else [], pa.float64()),
                ],
                names=[*batch.schema.names, *names],
            )

    fields = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(predict, schema)


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """Rows that training must not see: crc32 of the id's text leaves that remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))
