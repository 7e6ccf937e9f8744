"""Benchmark decontamination by a prefix-filtered join of windows with documents.

A benchmark item's windows are sets of three-word shingles in sequence. For a window to occur in a
document all of its shingles must, so a prefix of one shingle is enough to find it: the one that
the fewest documents hold. Documents are read once: a bit table of all benchmark shingles (fixed
size, built by Spark) leaves the runs of consecutive shingles that may belong to windows, and from
these come the document counts that order shingles by rarity. Equal runs of many documents are
one row of the join. A run meets the windows of its prefix shingles; the window must lie inside
the run (length and position) and all of its shingles must be equal there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.llm.bits import bit_table, may_have
from geoalbums.llm.words import LETTERS, LOWER, U64, Words, mix, slices, words
from geoalbums.sources.shared import materialize

WINDOW = 10
SHINGLE = 3


def _shingle_keys(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all k-word windows of texts that have so many words, and each text's first."""
    per_text = np.maximum(w.counts - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], per_text)
    out = np.full(len(at), U64(k))
    for j in range(k):
        out = mix(out * U64(0xD6E8FEB86659FD93) + w.key[at + j])
    return out, first


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, k (words of a shingle), keys: one row per window of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: dict[str, list] = {"item_id": [], "k": [], "keys": []}
            for part in slices(batch.column(1)):
                w = words(part, LETTERS, LOWER)
                by_k = {k: _shingle_keys(w, k) for k in range(1, SHINGLE + 1)}
                for r, n in enumerate(w.counts.tolist()):
                    k, length = min(n, SHINGLE), min(n, window)
                    if not n:
                        continue
                    values, first = by_k[k]
                    keys = values[first[r] : first[r + 1]].view(np.int64)
                    for start in range(n - length + 1):
                        out["item_id"].append(ids[part.row + r])
                        out["k"].append(k)
                        out["keys"].append(keys[start : start + length - k + 1].tolist())
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": pa.array(out["item_id"], pa.string()),
                    "k": pa.array(out["k"], pa.int32()),
                    "keys": pa.array(out["keys"], pa.list_(pa.int64())),
                }
            )

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(cut, "item_id string, k int, keys array<long>")


_RUNS = "array<struct<k:int,start:int,keys:array<bigint>>>"


def _matching_runs(docs: DataFrame, table: np.ndarray, ks: list[int]) -> DataFrame:
    """Per document: doc_id, row (unique), n_words, runs of consecutive benchmark shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for part in slices(batch.column(1)):
                w = words(part, LETTERS, LOWER)
                runs: list[list] = [[] for _ in range(part.texts)]
                for k in ks:
                    keys, first = _shingle_keys(w, k)
                    hit = np.flatnonzero(may_have(table, keys))
                    if not len(hit):
                        continue
                    text = np.searchsorted(first, hit, "right") - 1
                    new = np.ones(len(hit), dtype=bool)
                    new[1:] = (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1])
                    begins = np.flatnonzero(new).tolist()
                    for low, high in zip(begins, [*begins[1:], len(hit)]):
                        r = int(text[low])
                        runs[r].append((k, int(hit[low] - first[r]), keys[hit[low:high]].view(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.row, part.texts),
                        pa.array(np.arange(row, row + part.texts)),
                        pa.array(w.counts.astype(np.int64)),
                        pa.array(
                            [[{"k": k, "start": s, "keys": v} for k, s, v in own] for own in runs],
                            pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int32()), ("keys", pa.list_(pa.int64()))])),
                        ),
                    ],
                    names=["doc_id", "row", "n_words", "runs"],
                )
                row += part.texts

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, f"doc_id long, row long, n_words long, runs {_RUNS}")


def _covered(spans: str) -> F.Column:
    """Numbers covered by an array of (low, high) spans, each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def add(s, x):
        high = F.greatest(s["end"], x["high"].cast("long"))
        more = high - F.greatest(s["end"], x["low"].cast("long"))
        return F.struct((s["n"] + F.greatest(more, F.lit(0).cast("long"))).alias("n"), high.alias("end"))

    return F.aggregate(F.array_sort(spans), start, add, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated.

    A-Z are lower-cased; words are runs of digits, letters and all beyond ASCII. An item's windows
    are its sequences of `window` words, or all its words if it has fewer; a word of a document
    inside any occurrence of a window is hit. Null and empty texts have no words and no windows.
    Repeated rows are judged one by one, all alike; a document without doc_id too. An item without
    item_id marks words but isn't counted or listed.
    """
    windows = materialize(
        benchmark_windows(benchmark, window).withColumn("window", F.xxhash64("k", "keys")), "windows"
    )
    ks = sorted(x["k"] for x in windows.select("k").distinct().collect())  # three values at most
    scanned = materialize(_matching_runs(docs, bit_table(windows.select(F.explode("keys").alias("key")).distinct()), ks), "runs")

    pieces = scanned.select("row", F.explode("runs").alias("x")).select("row", "x.*")
    pieces = pieces.withColumn("run", F.xxhash64("k", "keys"))
    shared = (
        pieces.groupBy("run").agg(F.count("*").alias("documents"), F.min("k").alias("k"), F.min("keys").alias("keys"))
    )
    shared = materialize(shared, "shared-runs")
    rarity = (
        shared.select("documents", F.explode(F.array_distinct("keys")).alias("key"))
        .groupBy("key").agg(F.sum("documents").alias("documents"))
    )

    distinct = windows.groupBy("window").agg(F.min("k").alias("k"), F.min("keys").alias("keys"))
    prefix = (
        distinct.select("window", F.posexplode("keys").alias("offset", "key"))
        .join(rarity, "key", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("documents", F.lit(0)).alias("n"), "key", "offset")).alias("p"))
    )
    prefix = distinct.join(prefix, "window").select(
        "window", "k", "keys", F.col("p.key").alias("key"), F.col("p.offset").alias("offset")
    )
    prefix = materialize(prefix.where(F.col("key").isNotNull()), "prefixes")

    shortest = prefix.groupBy("k").agg(F.min(F.size("keys")).alias("least"))
    runs = shared.join(shortest, "k").where(F.size("keys") >= F.col("least"))
    runs = runs.select("run", "k", F.col("keys").alias("run_keys"), F.posexplode("keys").alias("at", "key"))
    low = F.col("at") - F.col("offset")
    found = (
        runs.join(prefix, ["key", "k"])
        .where((low >= 0) & (low + F.size("keys") <= F.size("run_keys")))
        .where(F.slice("run_keys", F.greatest(low, F.lit(0)) + 1, F.size("keys")) == F.col("keys"))
        .select("run", "window", low.alias("low"), (low + F.size("keys") + F.col("k") - 1).alias("high"))
    )
    found = materialize(found, "occurrences")
    spans = found.groupBy("run").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    items = (
        found.select("run", "window").distinct().join(windows.select("window", "item_id").distinct(), "window")
        .groupBy("run").agg(F.collect_set("item_id").alias("items"))
    )
    of_run = materialize(spans.join(items, "run", "left"), "run-hits")

    hits = pieces.select("row", "run", "start").join(of_run, "run")
    shifted = F.transform("spans", lambda x: F.struct((x["low"] + F.col("start")).alias("low"), (x["high"] + F.col("start")).alias("high")))
    per_document = hits.groupBy("row").agg(
        F.flatten(F.collect_list(shifted)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("items", F.array().cast("array<string>")))))).alias("items"),
    )
    per_document = per_document.select("row", _covered("spans").alias("n_hit"), "items")
    out = scanned.select("doc_id", "row", "n_words").join(per_document, "row", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
