"""Embedding whitening: projections on the leading components, each scaled to variance one.

Vectors become whole numbers, so sums per dimension and sums of products (of entries less the whole
number next to their mean) are exact whatever the order tasks end in. Each task adds up one matrix
of dimensions squared; Spark adds up the tasks' matrices, and the driver sees a single one. What
goes back to the tasks is components times dimensions, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.llm.spectrum import leading_eigenpairs

_CHUNK = 2048  # vectors whose long form is held at a time
_LARGEST = float(1 << 40)  # entries beyond count as not finite: their products would not be exact


@dataclass(frozen=True)
class WhitenConfig:
    components: int = 32
    scale: int = 64
    shift: int = 1_000_000

    def __post_init__(self) -> None:
        if self.components < 1 or self.scale < 1:
            raise ValueError("components and scale must be at least 1")


@dataclass(frozen=True)
class Whitening:
    """What was fitted: sums per dimension, the leading eigenpairs, and how far the result is off."""

    n: int
    sums: list[int]
    centre: list[int]  # the whole number next to each dimension's mean
    values: np.ndarray
    vectors: np.ndarray  # columns
    trace: float
    identity_error: float

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    @property
    def offset(self) -> np.ndarray:
        """Means less `centre`, at most a half each."""
        return np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, self.centre)])


def whole_vectors(embeddings: DataFrame, cfg: WhitenConfig = WhitenConfig()) -> DataFrame:
    """vec_id, x (array of longs): rows that have a vector, all of whose entries are finite."""
    vector = F.col("embedding").cast("array<double>")
    # NaN is above all numbers here; an entry out of bounds becomes null before it is made whole
    x = F.transform(vector, lambda c: F.floor(F.when(F.abs(c) < _LARGEST, c) * cfg.scale) + cfg.shift)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull()))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _added_products(rows: DataFrame, dims: int, of_batch) -> np.ndarray:
    """Sum over all rows of wᵀw, where `of_batch` gives the w of a matrix of vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = of_batch(_matrix(batch.column(0), dims))
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            upper = [total[i, i:] for i in range(len(total))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper))), pa.array(upper, pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select("x").mapInArrow(add, "i long, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = sums.toArrow()  # dimensions squared, by two
    i, j = found["i"].to_numpy(), found["i"].to_numpy() + found["j"].to_numpy()
    out = np.zeros((int(j.max()) + 1,) * 2)
    out[i, j] = out[j, i] = found["v"].to_numpy()
    return out


def fit(rows: DataFrame, cfg: WhitenConfig = WhitenConfig()) -> Whitening | None:
    """From all of `rows` (x); None if there is none, or no two that differ."""
    places = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    places = sorted(places.collect())  # one row per dimension
    if not places:
        return None
    n, dims, sums = places[0].n, len(places), [row.s for row in places]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    near = np.array(centre)
    offset = np.array([(s - n * c) / n for s, c in zip(sums, centre)])
    covariance = _added_products(rows, dims, lambda x: (x - near).astype(float)) / n - np.outer(offset, offset)
    values, vectors = leading_eigenpairs(covariance, cfg.components)
    if not len(values):
        return None
    scaled = vectors / np.sqrt(values)
    spread = _added_products(rows, dims, lambda x: ((x - near) - offset) @ scaled) / n
    error = float(np.abs(spread - np.eye(len(values))).max())
    return Whitening(n, sums, centre, values, vectors, float(np.trace(covariance)), error)


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S)², exactly; null where that is beyond a long."""
    y = x - np.array(model.centre)
    rest = [s - model.n * c for s, c in zip(model.sums, model.centre)]
    most = model.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
    if most * most * len(rest) < 1 << 63:
        return ((y * model.n - np.array(rest)) ** 2).sum(axis=1).tolist()
    exact = ((y.astype(object) * model.n - np.array(rest, dtype=object)) ** 2).sum(axis=1).tolist()
    return [value if value < 1 << 63 else None for value in exact]


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row per row of `rows` (vec_id, x) and component."""
    count, dims = len(model.values), len(model.sums)
    near, offset, scaled = np.array(model.centre), model.offset, model.scaled
    explained = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(low, _CHUNK)
                x = _matrix(part.column(1), dims)
                place = pa.array(np.repeat(np.arange(len(x)), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(place),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(place), model.n)),
                        pa.array(_deviations(x, model), pa.int64()).take(place),
                        pa.array((((x - near) - offset) @ scaled).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(place), model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(project, _RESULT)


_RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(embeddings: DataFrame, cfg: WhitenConfig = WhitenConfig()) -> DataFrame:
    """Per usable row of `embeddings` (vec_id, embedding; other columns are ignored) and component:
    vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds a null or non-finite entry (or one of 2**40 or more in
    size) are left out; of vectors of different lengths those of the most frequent one are kept, the
    longer one if two are as frequent. Repeated rows and rows without vec_id count and come out like
    any other. There are as many components as asked for, or as the vectors have directions in which
    they differ (variance above 1e-10 of the largest); without one, and without vectors, there is no row.
    Eigenvalues that are equal share a subspace, of which some orthonormal basis is used for all rows.
    """
    rows = whole_vectors(embeddings, cfg)
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if usual is None:
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    rows = rows.where(F.size("x") == usual["size"])
    model = fit(rows, cfg)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    return apply(rows, model)
