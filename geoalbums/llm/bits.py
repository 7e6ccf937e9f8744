"""A table of bits for 64-bit keys: says of a key that it is surely not among some, or may be.

Built by Spark, of a fixed size whatever the number of keys, so that it may be sent to every task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.llm.words import U64

LEAST_BITS, MOST_BITS = 20, 24  # powers of two: 128 KiB to 2 MiB


def bit_table(keys: DataFrame) -> np.ndarray:
    """`keys` has one long column, `key`; equal keys do no harm."""
    bits = min(max(LEAST_BITS, (64 * max(1, keys.count()) - 1).bit_length()), MOST_BITS)
    mask = (1 << bits) - 1
    places = keys.select(
        F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))).alias("b")
    )
    cells = places.groupBy(F.shiftright("b", 5).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("bits")
    )
    table = np.zeros(1 << (bits - 5), dtype=np.uint32)
    found = cells.toArrow()  # at most 2**19 cells
    table[found["cell"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return table


def may_have(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask = U64(len(table) * 32 - 1)

    def hit(b):
        return (table[(b >> U64(5)).astype(np.int64)] >> (b & U64(31)).astype(np.uint32)) & np.uint32(1) > 0

    out = hit(keys & mask)
    some = np.flatnonzero(out)
    out[some] = hit((keys[some] >> U64(32)) & mask)
    return out
