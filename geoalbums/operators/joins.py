"""A left join that does not send a hot key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_by_weight(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    weight: str,
    right_rows: int,
    broadcast_rows: int,
    hot_rows: int,
) -> DataFrame:
    """`left` LEFT JOIN `right` on `keys`; `weight` counts the left rows of each right key.

    A right side of at most `broadcast_rows` rows is broadcast. A larger one is split: keys of
    more than `hot_rows` left rows (there can be at most rows / hot_rows of them) are broadcast,
    and only the rest is shuffled.
    """
    if right_rows <= broadcast_rows:
        return left.join(F.broadcast(right.drop(weight)), list(keys), "left")
    hot = right.where(F.col(weight) > hot_rows).drop(weight)
    cold = right.where(F.col(weight) <= hot_rows).drop(weight)
    hot_part = left.join(F.broadcast(hot), list(keys))
    rest = left.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return hot_part.unionByName(rest.join(cold, list(keys), "left"))
