"""Fingerprints of documents: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so its size follows
the text and two sketches are comparable whatever the sizes of their texts: the share of one that
is in the other estimates containment, and the union of two sketches is the sketch of both texts.

A fingerprint is the sketch written out: 12 hex digits for each hash kept, in rising order. A text
with words none of which is below the threshold is stood for by `~` and its lowest hash, which
gives way to any hash that is below the threshold when sketches are merged. No words: empty.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoalbums.llm.words import LOWER, SPACED, U64, shingles, slices, words
from geoalbums.sources.shared import materialize

_DIGITS = 12
_STAND_IN = "~"
_COARSE = 128  # bounds of ranges are looked up in two steps, the first over every 128th


@dataclass(frozen=True)
class SketchConfig:
    shingle: int = 5  # words; a shorter text is one shingle
    one_in: int = 8  # a hash is kept if it is in the lowest 1 / one_in of the hash space
    chunk: int = 256  # documents whose texts are Python strings at a time
    broadcast_rows: int = 100_000  # repeated rows above this are joined by shuffle

    def __post_init__(self) -> None:
        if self.shingle < 1 or self.one_in < 1 or self.chunk < 1:
            raise ValueError("shingle, one_in and chunk must be at least 1")


@dataclass(frozen=True)
class Sketch:
    """Hashes kept, in rising order, or the one that stands in for them."""

    kept: np.ndarray
    stand_in: int | None = None

    @property
    def text(self) -> str:
        if self.stand_in is not None:
            return f"{_STAND_IN}{self.stand_in:0{_DIGITS}x}"
        return (self.kept << U64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes().hex()


def sketches(column: pa.Array, cfg: SketchConfig) -> list[Sketch]:
    """One sketch per text (null: empty). Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    limit = U64((1 << 48) // cfg.one_in)
    out: list[Sketch] = []
    for part in slices(column):
        values, first = shingles(words(part, SPACED, LOWER), cfg.shingle)
        values = values >> U64(16)
        low = np.flatnonzero(values < limit)
        bounds = np.searchsorted(low, first).tolist()
        kept = values[low]
        for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = np.unique(kept[a:b])
            if not len(own) and first[r + 1] > first[r]:
                out.append(Sketch(own, int(values[first[r] : first[r + 1]].min())))
            else:
                out.append(Sketch(own))
    return out


def _shared(a: Sketch, b: Sketch) -> int:
    return len(np.intersect1d(a.kept, b.kept, assume_unique=True))


def alike(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity; 1 for two without words, 0 for one without."""
    if a.stand_in is not None or b.stand_in is not None:
        return float(a.stand_in == b.stand_in)
    both = _shared(a, b)
    union = len(a.kept) + len(b.kept) - both
    return both / union if union else 1.0


def inside(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    if a.stand_in is not None:
        return float(a.stand_in == b.stand_in)
    return _shared(a, b) / len(a.kept) if len(a.kept) else 1.0


# --- fingerprints as columns ------------------------------------------------------------------------


def hashes(fingerprint: Column) -> Column:
    """The hashes kept, as an array of hex texts; a stand-in is not one of them."""
    places = F.sequence(F.lit(0), F.floor(F.length(fingerprint) / _DIGITS).cast("int") - 1)
    cut = F.transform(places, lambda i: F.substring(fingerprint, i * _DIGITS + 1, F.lit(_DIGITS)))
    some = (F.length(fingerprint) >= _DIGITS) & ~fingerprint.startswith(_STAND_IN)
    return F.when(some, cut).otherwise(F.array().cast("array<string>"))


def merge(a: Column, b: Column) -> Column:
    """Fingerprint of two texts' shingles together. Null counts as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    union = F.array_join(F.array_sort(F.array_union(hashes(a), hashes(b))), "")
    lowest = F.coalesce(F.least(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))), F.lit(""))
    return F.when(union != "", union).otherwise(lowest)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts behind two fingerprints, as `alike`."""
    both = F.size(F.array_intersect(hashes(a), hashes(b)))
    union = F.size(hashes(a)) + F.size(hashes(b)) - both
    return F.when(a == b, F.lit(1.0)).when(union > 0, both / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that are in the second, as `inside`."""
    own = F.size(hashes(a))
    both = F.size(F.array_intersect(hashes(a), hashes(b)))
    return F.when((a == b) | (a == ""), F.lit(1.0)).when(own > 0, both / own).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """Adds `fingerprint` to the rows of `docs` (text; null counts as empty).

    Every row has one, repeated rows have equal ones; a column `fingerprint` that is there already
    is replaced. Nothing is shuffled: one pass over the texts.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"]
    rows = docs.select(F.struct(*rest).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([s.text for s in sketches(batch.column(1), cfg)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "fingerprint"])

    schema = rows.select("row").schema.add("fingerprint", "string")
    return rows.mapInArrow(add, schema).select("row.*", "fingerprint")


# --- a document and the one that follows ------------------------------------------------------------

_KEY = ["_known", "_id", "_mark"]  # null ids first, then by id; rows of one id by the MD5 of the text
_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, inside_next double"
)


def _ranges(keys: DataFrame) -> list[tuple]:
    """The first key of each range of keys: as many as there are partitions, whatever the rows."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = (
        keys.repartitionByRange(n, *_KEY)
        .groupBy(F.spark_partition_id().alias("range"))
        .agg(F.min(F.struct(*_KEY)).alias("first"))
    )
    return sorted(tuple(row.first) for row in firsts.select("first").collect())


def _with_range(rows: DataFrame, firsts: list[tuple]) -> DataFrame:
    """Adds `_range` and `_halo`: a row goes to its range, and each range's first one also to the end of
    the range before, so that no range has to look into another."""

    def literal(some: list[tuple]) -> Column:
        text = json.dumps([dict(zip(_KEY, first)) for first in some])
        return F.from_json(F.lit(text), "array<struct<_known:int,_id:bigint,_mark:string>>")

    key, fine = F.struct(*_KEY), literal(firsts)
    block = F.size(F.filter(literal(firsts[::_COARSE]), lambda x: x <= key)) - 1
    near = F.slice(fine, block * _COARSE + 1, F.lit(_COARSE))
    placed = rows.withColumn("_block", block).withColumn(
        "_own", F.col("_block") * _COARSE + F.size(F.filter(near, lambda x: x <= key)) - 1
    )
    is_first = F.element_at(fine, F.col("_own") + 1) == key
    own = F.struct(F.col("_own").alias("_range"), F.lit(False).alias("_halo"))
    before = F.struct(F.pmod(F.col("_own") - 1, F.lit(len(firsts))).alias("_range"), F.lit(True).alias("_halo"))
    targets = F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own)))
    return placed.withColumn("_to", targets).select(*rows.columns, "_to.*")


def sketch_with_next(docs: DataFrame, cfg: SketchConfig = SketchConfig()) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, inside_next.

    The next document is the one that follows by doc_id, null ids first; rows of one id follow each
    other by the MD5 of their text, equal rows in any order; after the last comes the first. The
    edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    next document, or all it has. Null texts are empty: such a text is its own edited text and like
    nothing but other texts without words. Repeated rows come out as often as they went in.
    near_edited and near_next are Jaccard estimates, inside_next the share of this text in the next.

    Ranges of ids follow from the keys alone; texts then move once, each range is walked in order
    by one task, and the only text held is the one before.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").isNotNull().cast("int").alias("_known"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.md5(text.cast("binary")).alias("_mark"),
        text.alias("_text"),
    )
    keys = rows.groupBy(*_KEY).agg(F.count("*").alias("_copies"))
    keys = materialize(keys, "fingerprint-keys")
    firsts = _ranges(keys)
    if not firsts:
        return docs.sparkSession.createDataFrame([], _RESULT)
    repeated = materialize(keys.where("_copies > 1"), "fingerprint-repeated")
    n_repeated = repeated.count()
    rows = rows.withColumn("_copies", F.lit(1).cast("long"))
    if n_repeated:
        # copies of a row follow each other: one of them carries the number
        again = repeated.select(*_KEY)
        again = F.broadcast(again) if n_repeated <= cfg.broadcast_rows else again
        several = (
            rows.join(again, _KEY, "left_semi").groupBy(*_KEY)
            .agg(F.min("_text").alias("_text"), F.sum("_copies").alias("_copies"))
        )
        rows = rows.join(again, _KEY, "left_anti").unionByName(several)
    ranged = _with_range(rows, firsts).repartitionById(len(firsts), "_range")
    ordered = ranged.sortWithinPartitions("_halo", *_KEY)
    return ordered.select("_known", "_id", "_copies", "_halo", "_text").mapInArrow(_walk(cfg), _RESULT)


def _walk(cfg: SketchConfig):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list[str], list[Sketch]]]:
        for batch in batches:
            for low in range(0, batch.num_rows, cfg.chunk):
                part = batch.slice(low, cfg.chunk)
                found = sketches(part.column(4), cfg)
                yield *(part.column(i).to_pylist() for i in range(4)), part.column(4).to_pylist(), found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row whose next one is still to come
        for known, ids, copies, halo, texts, found in chunks(batches):
            pairs = []
            for i in range(len(texts)):
                if before is not None:
                    pairs.append((*before, texts[i], found[i]))
                before = None if halo[i] else (ids[i] if known[i] else None, copies[i], texts[i], found[i])
            yield from _compared(pairs, cfg)

    return walk


def _compared(pairs: list[tuple], cfg: SketchConfig) -> Iterator[pa.RecordBatch]:
    """(doc_id, copies, text, sketch, next text, next sketch) each: result rows."""
    todo = []  # (doc_id, rows, text, sketch, next text, next sketch)
    for doc_id, copies, text, sketch, next_text, next_sketch in pairs:
        if copies > 1:
            todo.append((doc_id, copies - 1, text, sketch, text, sketch))
        todo.append((doc_id, 1, text, sketch, next_text, next_sketch))
    if not todo:
        return
    edited = []
    for _, _, text, _, following, _ in todo:
        half = len(text) // 2
        edited.append(text[: len(text) - half] + following[:half])
    out: dict[str, list] = {field.split()[0]: [] for field in _RESULT.split(", ")}
    times = []
    for (doc_id, rows, text, own, _, following), other, sketch in zip(todo, edited, sketches(pa.array(edited, pa.string()), cfg)):
        times.append(rows)
        out["doc_id"].append(doc_id)
        out["n_chars"].append(len(text))
        out["edited_sha256"].append(hashlib.sha256(other.encode()).hexdigest())
        out["fingerprint"].append(own.text)
        out["edited_fingerprint"].append(sketch.text)
        out["near_edited"].append(alike(own, sketch))
        out["near_next"].append(alike(own, following))
        out["inside_next"].append(inside(own, following))
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(values, pa.string() if "sha" in name or "print" in name else pa.int64() if name in ("doc_id", "n_chars") else pa.float64())
            for name, values in out.items()
        ],
        names=list(out),
    )
    if max(times) == 1:
        yield batch
        return
    for i, rows in enumerate(times):
        for low in range(0, rows, 4096):
            yield batch.take(pa.array(np.full(min(4096, rows - low), i)))
