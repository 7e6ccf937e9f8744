"""Connected components of links, by alternating large and small stars.

Links are contracted first, a bounded number of them in each task: links of one task become stars
around the lowest nodes that they connect. What fits one task is done then. Beyond that, each round
is two aggregations and two joins over the links; a node with very many links is combined before
the shuffle and split by adaptive execution at the join. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.sources.shared import materialize


TASK_LINKS = 1 << 16  # contracted in one task


def lowest_connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links u - v, and for each the lowest node it is connected with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """u, v: each node of a task's links, and the lowest one it is connected with there (itself, too)."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            found = lowest_connected(*(np.concatenate(column) for column in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in found], names=["u", "v"])

    dealt = links.coalesce(1) if tasks == 1 else links.repartition(tasks)
    return dealt.mapInArrow(contract, "u long, v long")


def _star(links: DataFrame, lows: DataFrame) -> DataFrame:
    """(u, v) beside the lowest node known to u."""
    return links.join(lows, "u")


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Labels of all linked nodes: node, label (the lowest node it is connected with).

    `links` has long columns a, b in any order and number; self links and nulls are ignored.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    links = materialize(links.where("a <> b").select(high.alias("u"), low.alias("v")), "links")
    n = links.count()
    if n > TASK_LINKS:
        links = _contracted(links, -(-n // TASK_LINKS)).where("u <> v").distinct()
        links = materialize(links, "contracted-links")
        n = links.count()
    if n <= TASK_LINKS:
        labels = materialize(_contracted(links, 1), "labels")
        return labels.withColumnsRenamed({"u": "node", "v": "label"})
    before = _checksum(links)
    while True:
        # large star: what is above u is linked with the lowest node around u
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        links = (
            _star(both, lows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        links = materialize(links, "large-stars")
        # small star: u and what is below it are linked with the lowest of them
        lows = links.groupBy("u").agg(F.min("v").alias("m"))
        below = _star(links, lows)
        links = below.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = links.unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        links = materialize(links, "small-stars")
        after = _checksum(links)
        if after == before:
            break
        before = after
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
