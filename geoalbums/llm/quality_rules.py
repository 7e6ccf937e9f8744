"""Quality rules: text statistics, and lines that too many documents of a host share.

One pass over the texts gives the statistics and a key per normalised line (its words, A-Z
lower-cased, one space between). Distinct documents are counted per host and line; lines above the
limit are taken out of every document, and a document left with too little is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.llm.words import LOWER, SPACED, U64, Slice, Words, keys, mix, row_sums, runs, slices, words
from geoalbums.sources.shared import materialize

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_REPEATED = 5


@dataclass(frozen=True)
class QualityConfig:
    """Base rules: at least `least_words`; at most `repeat_percent` of words in repeated windows.

    A line is removed where more than `line_share` of its host's documents, and at least
    `line_documents` of them, have it. Rejected is a document with fewer than `least_words` words
    left or less than `left_percent` of them.
    """

    least_words: int = 10
    repeat_percent: int = 20
    line_share: float = 0.02
    line_documents: int = 10
    left_percent: int = 30


def repeated_words(w: Words, k: int = _REPEATED) -> np.ndarray:
    """Per text, the words inside k-word windows that the text has twice or more."""
    per_text = np.maximum(w.counts - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(per_text)])
    text = np.repeat(np.arange(len(per_text)), per_text)
    at = np.arange(first[-1]) + (w.first[:-1] - first[:-1])[text]
    window = text.astype(U64)
    for j in range(k):
        window = mix(window * U64(0xD6E8FEB86659FD93) + w.key[at + j])
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    again = np.zeros(len(order), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(w.key) + 1, dtype=np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + k, -1)
    return row_sums((np.cumsum(step)[:-1] > 0).astype(np.int64), w.first)


def text_lines(part: Slice, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that have a word: text, number in the text, raw key, first word, past the last word."""
    start, end, first = runs(part.data != 0x0A, part.at)
    low = np.searchsorted(w.start, start)
    high = np.searchsorted(w.start, end)
    text = np.repeat(np.arange(part.texts), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(part.data == 0x0A)])
    number = breaks[start] - breaks[part.at[text]]
    worded = high > low
    start, end, text, low, high = (x[worded] for x in (start, end, text, low, high))
    return text, number[worded], keys(part.data, start, end, np.arange(256, dtype=np.uint8)), low, high


def _sequence_keys(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A key for each line's words in order; every word is in one line, lines are in order."""
    place = np.arange(len(key)) - np.repeat(low, high - low)
    return mix(row_sums(mix(key + (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)), np.append(low, len(key))))


_SCHEMA = (
    "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, lines array<struct<number:int,key:long,words:int>>"
)


def _statistics(docs: DataFrame, with_text: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for part in slices(batch.column(2)):
                w = words(part)
                text, number, raw, low, high = text_lines(part, w)
                folded = keys(part.data, w.start, w.end, LOWER)
                line = _sequence_keys(folded, low, high)
                in_text = mix(raw + text.astype(U64))
                order = np.argsort(in_text, kind="stable")
                later = np.zeros(len(order), dtype=np.int64)
                later[order[1:]] = in_text[order[1:]] == in_text[order[:-1]]
                line_first = np.searchsorted(text, np.arange(part.texts + 1))
                points = ((part.data & 0xC0) != 0x80) & SPACED[part.data]
                lists = pa.StructArray.from_arrays(
                    [pa.array(number.astype(np.int32)), pa.array(line.view(np.int64)), pa.array((high - low).astype(np.int32))],
                    names=["number", "key", "words"],
                )
                arrays = [
                    pa.array(np.arange(row, row + part.texts)),
                    *[batch.column(c).slice(part.row, part.texts) for c in range(2)],
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(row_sums(points.astype(np.int64), part.at)),
                    pa.array(row_sums(_SYMBOLS[part.data].astype(np.int64), part.at)),
                    pa.array(row_sums(later, line_first)),
                    pa.array(repeated_words(w)),
                    pa.ListArray.from_arrays(pa.array(line_first.astype(np.int32)), lists),
                ]
                names = ["row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
                if with_text:
                    arrays.append(batch.column(2).slice(part.row, part.texts))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                row += part.texts

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), "text")
    return rows.mapInArrow(scan, _SCHEMA + (", text string" if with_text else ""))


def quality_rules(docs: DataFrame, cfg: QualityConfig = QualityConfig(), with_text: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, source, text; other columns are ignored): doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left, removed_lines (their
    numbers in the text, from 0), kept, and with `with_text` the text without those lines.

    Null and empty texts have no words and fail the base rules. A null source is a host of its own.
    Rows of one doc_id count as one document for line frequencies and are all returned; a row
    without doc_id is a document of its own. Copies under other ids are documents like any other. With equal line counts there is nothing to order: a line is
    above its host's limit or not.
    """
    drawn = materialize(_statistics(docs, with_text), "statistics")
    document = ["doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("alone")]
    lines = drawn.select("row", "host", *document, F.explode("lines").alias("x"))
    place = F.xxhash64("host", F.col("x.key"))
    seen = lines.select("host", place.alias("place"), "doc_id", "alone").distinct()
    frequency = seen.groupBy("host", "place").agg(F.count("*").alias("documents"))
    frequency = frequency.where(F.col("documents") >= cfg.line_documents)
    hosts = drawn.select("host", *document).distinct().groupBy("host").agg(F.count("*").alias("of"))
    hosts = hosts.withColumnRenamed("host", "name")
    frequent = frequency.join(hosts, F.col("host").eqNullSafe(F.col("name")))
    frequent = frequent.where(F.col("documents") > F.col("of") * cfg.line_share).select("place").distinct()
    frequent = materialize(frequent, "frequent-lines")

    removed = (
        lines.select("row", place.alias("place"), "x.number", "x.words")
        .join(frequent, "place")
        .groupBy("row")
        .agg(F.sum("words").alias("words"), F.array_sort(F.collect_list("number")).alias("removed_lines"))
    )
    left = F.col("n_words") - F.coalesce("words", F.lit(0))
    failed = (F.col("n_words") < cfg.least_words) | (
        100 * F.col("n_repeat_words") > cfg.repeat_percent * F.col("n_words")
    )
    depleted = (F.col("n_left") < cfg.least_words) | (100 * F.col("n_left") < cfg.left_percent * F.col("n_words"))
    out = drawn.drop("lines", "host").join(removed, "row", "left")
    out = out.withColumn("n_left", left).withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    out = out.withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    if with_text:
        kept_lines = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("removed_lines", i))
        columns.append(F.array_join(kept_lines, "\n").alias("text"))
    return out.select(*columns, "n_left", "removed_lines", "kept")
