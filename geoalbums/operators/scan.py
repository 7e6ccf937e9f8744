"""Ordered scans over sequences of any length, without a task that sees a whole sequence.

An album run walks each library in time order. One library, or one instant in it, may hold a
large share of all rows, so a window over the library would end in a single task. Instead:

1. `bucketed` range-partitions rows by the full order key (library, time, file name), which
   splits hot libraries and hot instants alike, sorts each range, cuts it into buckets of a bounded
   number of rows, and writes the result with its bucket number and each row's position in the
   order. Range bounds come from a sample, so they are fixed by that write and never worked out
   twice.
2. Windows run inside (bucket, library), ordered by that position: one whole number.
3. What a bucket must know of its neighbours (the previous row, a running sum, the next
   positioned row) is worked out on one summary row per bucket and library, and joined back
   on the same keys the windows are partitioned by.

Previous row, prefix sum, last value and next value are associative, so this is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from geoalbums.sources.shared import materialize

BUCKET = "_bucket"
POSITION = "_position"
WHOLE = "_library"  # stands in where the caller names no library columns
BUCKET_BITS = 13  # a bucket has 8192 rows at most
TASK_ROWS = 1 << 16  # of a task's windows, on average


def library_keys(library_cols: Sequence[str]) -> list[str]:
    return list(library_cols) or [WHOLE]


def bucketed(
    df: DataFrame,
    library_cols: Sequence[str],
    order_cols: Sequence[str],
    num_buckets: int | None = None,
) -> DataFrame:
    """Rows with `_bucket`, ranges of (library, order) that follow each other, and `_position`.

    Positions rise with the order, within and across buckets, but not by one. There are
    `num_buckets` ranges; without it the session's shuffle partitions apply, merged by adaptive
    execution where the data is small. A range of many rows is several buckets. Library columns
    must not be null; a null stops the run.
    """
    if not library_cols:
        df = df.withColumn(WHOLE, F.lit(0))
    for name in library_cols:
        stop = F.raise_error(F.lit(f"library column {name} is null")).cast(df.schema[name].dataType)
        df = df.withColumn(name, F.coalesce(F.col(name), stop))
    keys = [*library_keys(library_cols), *order_cols]
    ranged = (
        df.repartitionByRange(num_buckets, *keys) if num_buckets else df.repartitionByRange(*keys)
    )
    placed = ranged.sortWithinPartitions(*keys).withColumn(POSITION, F.monotonically_increasing_id())
    # a position counts the rows of its range in its low bits: cut short, it numbers the buckets
    cut = placed.select(*df.columns, F.shiftright(POSITION, BUCKET_BITS).alias(BUCKET), POSITION)
    return materialize(cut, "ranges")


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bucketed rows, put together as windows need them, in tasks of a bounded number of rows.

    Windows keep a task's rows in memory, several times over. Left to the session's shuffle
    partitions, their number would grow with the input.
    """
    return df.repartition(max(2, -(-df.count() // TASK_ROWS)), BUCKET, *keys)


def in_bucket(keys: Sequence[str], order: str = POSITION) -> WindowSpec:
    return Window.partitionBy(BUCKET, *keys).orderBy(order)


def up_to_here(keys: Sequence[str], order: str = POSITION) -> WindowSpec:
    return in_bucket(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_the_end(keys: Sequence[str]) -> WindowSpec:
    """Rows after the current one, as a growing frame over the reversed order.

    A frame that shrinks towards the end would be re-read for every row.
    """
    return (
        Window.partitionBy(BUCKET, *keys)
        .orderBy(F.col(POSITION).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def earlier_buckets(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def later_buckets(keys: Sequence[str]) -> WindowSpec:
    return (
        Window.partitionBy(*keys)
        .orderBy(F.col(BUCKET).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def last_row(row: Column, where: Column | None = None) -> Column:
    """Aggregate: `row` of the last item (that satisfies `where`)."""
    order = F.col(POSITION)
    return F.max_by(row, order if where is None else F.when(where, order))


def first_row(row: Column, where: Column | None = None) -> Column:
    order = F.col(POSITION)
    return F.min_by(row, order if where is None else F.when(where, order))


def join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring each bucket's carry-in to its rows.

    Both sides are partitioned by (bucket, library), so a shuffled join moves only the summary;
    Spark broadcasts the summary by itself while it is below its broadcast threshold.
    """
    return df.join(carry, [BUCKET, *keys], "left")


def carried_sum(keys: Sequence[str], column: str, name: str) -> Column:
    """Sum of a summary column over all earlier buckets."""
    return F.coalesce(F.sum(column).over(earlier_buckets(keys)), F.lit(0)).alias(name)


def ranked(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    num_buckets: int | None = None,
) -> DataFrame:
    """Adds `rank` (1, 2, 3 …) within each group; a group of any size is spread over buckets."""
    ranges = bucketed(df, group_cols, order_cols, num_buckets)
    summary = ranges.groupBy(BUCKET, *group_cols).agg(F.count("*").alias("rows"))
    carry = summary.select(BUCKET, *group_cols, carried_sum(group_cols, "rows", "carry_rows"))
    position = F.row_number().over(in_bucket(group_cols))
    return join_carry(ranges, carry, group_cols).select(
        *df.columns, (F.col("carry_rows") + position).alias("rank")
    )
