"""Removing strings of bytes that stand in two places, by prefix-free parsing of the corpus.

Triggers cut texts into phrases (see `phrases`), and each start of a `length`-byte string is owned
by the trigger of its window. A run of starts with one owner is one entry of the parse: its span,
from the first start to the end of the last string, is a word of the dictionary. Equal spans
decide all of their starts at once, which is nearly all there is in repetitive text. A string
that stands elsewhere in part of another span has the same core, the bytes after its trigger that
every string of the run covers: runs whose core is in one place only hold no repeated string. What
is left lies at the edges of matches; there the strings themselves are compared.

Strings are compared by 64-bit keys over all of their bytes. Only whether 400 bytes are equal is
asked, never which come first, so classes of equal keys stand in for ranks in the corpus order:
they need no total sort, and a passage that a third of all texts share is combined before the
shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoalbums.llm.bits import bit_table, may_have
from geoalbums.llm.phrases import WINDOW, Rolling, phrase_runs
from geoalbums.llm.words import U64, mix, slices
from geoalbums.sources.shared import materialize

_PIECE = 1 << 20  # starts looked at together; runs cut at its ends are decided string by string


def _uid() -> Column:
    """Rows of equal doc_id and text are one and the same place for all that follows their counting."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def _runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """low, high, core, span of the runs of one text."""
    found = []
    for base in range(0, max(0, len(data) - length + 1), _PIECE):
        part = data[base : base + _PIECE + length - 1]
        rolling = Rolling.over(part)
        own, low, high = phrase_runs(part, length, rolling)
        core = rolling.keys(own, own + length - WINDOW + 1)
        span = mix(rolling.keys(low, high + length) + (own - low).astype(U64) * U64(0xD6E8FEB86659FD93))
        found.append((low + base, high + base, core, span))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty.view(U64), empty.view(U64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _parse(docs: DataFrame, length: int) -> DataFrame:
    """uid, low, high, core, span: the parse of every text, one row per run."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in slices(batch.column(1)):
                found = [_runs(part.data[a:b], length) for a, b in zip(part.at[:-1].tolist(), part.at[1:].tolist())]
                low, high, core, span = (np.concatenate(x) for x in zip(*found))
                uid = np.repeat(ids[part.row : part.row + part.texts], [len(x[0]) for x in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), pa.array(low), pa.array(high), pa.array(core.view(np.int64)), pa.array(span.view(np.int64))],
                    names=["uid", "low", "high", "core", "span"],
                )

    return docs.select(_uid().alias("uid"), "text").mapInArrow(parse, "uid long, low long, high long, core long, span long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (unique uid, ...) with the text; others hardly leave the scan."""
    table = bit_table(wanted.select(F.col("uid").alias("key")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_have(table, batch.column(0).to_numpy().view(U64))))

    texts = docs.select(_uid().alias("uid"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pick, "uid long, text string")
    return texts.groupBy("uid").agg(F.min("text").alias("text")).join(wanted, "uid")


def _strings(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """uid, low, open, keys: the keys of all strings of the runs."""
    listed = runs.groupBy("uid").agg(F.collect_list(F.struct("low", "high", "open")).alias("runs"))
    listed = materialize(listed, "open-runs")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs_of = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part in slices(batch.column(1)):
                uid, low, is_open, keys = [], [], [], []
                for r in range(part.texts):
                    data = part.data[part.at[r] : part.at[r + 1]]
                    for run in runs_of[part.row + r]:
                        stretch = data[run["low"] : run["high"] + length]
                        at = np.arange(run["high"] - run["low"] + 1)
                        uid.append(ids[part.row + r])
                        low.append(run["low"])
                        is_open.append(run["open"])
                        keys.append(Rolling.over(stretch).keys(at, at + length))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                values = np.concatenate(keys) if keys else np.zeros(0, dtype=U64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid, pa.int64()), pa.array(low, pa.int64()), pa.array(is_open, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64))),
                    ],
                    names=["uid", "low", "open", "keys"],
                )

    texts = _texts(docs, listed).select("uid", "text", "runs")
    return texts.mapInArrow(draw, "uid long, low long, open int, keys array<long>")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """uid, spans (low, high): stretches of bytes that repeated strings cover, as yet unmerged."""
    parsed = _parse(docs, length)
    cores = parsed.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    runs = materialize(parsed.join(materialize(cores, "repeated-cores"), "core"), "runs")

    spans = runs.groupBy("span").agg(F.count("*").alias("n"), F.min("uid").alias("keeper")).where("n > 1")
    spans = materialize(spans.select("span", "keeper"), "repeated-spans")
    whole = runs.join(spans, "span")
    edges = materialize(runs.join(spans, "span", "left_anti"), "edges")

    # a string at an edge may stand inside a repeated span too: one of each such span is looked at
    at_edges = materialize(edges.select("core").distinct(), "edge-cores")
    keepers = whole.where("uid = keeper").join(at_edges, "core", "left_semi")
    looked_at = edges.select("uid", "low", "high", F.lit(1).alias("open")).unionByName(
        keepers.select("uid", "low", "high", F.lit(0).alias("open")).distinct()
    )
    strings = materialize(_strings(docs, looked_at, length), "strings")
    keys = strings.select("open", F.explode("keys").alias("key"))
    twice = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 AND open = 1")
    twice = materialize(twice.select("key"), "repeated-strings")
    starts = strings.where("open = 1").select("uid", "low", F.posexplode("keys").alias("i", "key")).join(twice, "key")
    found = whole.select("uid", "low", (F.col("high") + length).alias("high")).unionByName(
        starts.select("uid", (F.col("low") + F.col("i")).alias("low"), (F.col("low") + F.col("i") + length).alias("high"))
    )
    return found.groupBy("uid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def _merged(spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    low = np.array([s["low"] for s in spans])
    high = np.array([s["high"] for s in spans])
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    begins = np.concatenate([[True], low[1:] > high[:-1]])
    return low[begins], high[np.append(np.flatnonzero(begins)[1:] - 1, len(high) - 1)]


def remove_repeats(docs: DataFrame, length: int = 400, with_bytes: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, spans (removed stretches, merged) and, `with_bytes`, the bytes that stay.

    Texts are UTF-8 bytes, null is empty. Every byte is removed that a string of `length` bytes
    covers which starts anywhere else too, in the same text or another, as they were before any
    removal. Repeated rows are places of their own: their texts are removed in all of them, as are
    those of rows without doc_id. Texts shorter than `length` stay whole.
    """
    spans = materialize(repeated_spans(docs, length), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                text = one.column(1)[0].as_py().encode()
                low, high = _merged(one.column(2)[0].as_py())
                bounds = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                out = {
                    "uid": one.column(0),
                    "n_removed": pa.array([len(text) - len(kept)], pa.int64()),
                    "spans": pa.array([[{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist())]], _SPANS),
                    "sha": pa.array([hashlib.sha256(kept).hexdigest()], pa.string()),
                }
                if with_bytes:
                    out["bytes"] = pa.array([kept], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "uid long, n_removed long, spans array<struct<low:long,high:long>>, sha string" + (", bytes binary" if with_bytes else "")
    removed = _texts(docs, spans).select("uid", "text", "spans").mapInArrow(cut, schema)
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _uid().alias("uid"), F.length(content).cast("long").alias("n_bytes"),
        F.sha2(content, 256).alias("whole"), *([content.alias("content")] if with_bytes else []),
    )
    out = rows.join(removed, "uid", "left")
    gone = F.coalesce("spans", F.array().cast("array<struct<low:bigint,high:bigint>>"))
    columns = [
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.size(gone).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"), gone.alias("spans"),
    ]
    if with_bytes:
        columns.append(F.coalesce("bytes", "content").alias("bytes"))
    return out.select(*columns)


_SPANS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
