"""A sample of bounded size that is the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """All of `df` if it has at most `rows` rows, else the rows whose key's hash is in the lowest
    share rows / count: about `rows` of them. Nothing is sorted and nothing but a count is collected."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.xxhash64(key.cast("string")) < F.lit(int(rows / total * 2**64) - 2**63))
