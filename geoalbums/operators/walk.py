"""The walk along a library in time order: missing positions filled, then the steps cut.

Filling. An item without position takes that of the nearest positioned neighbour in time, within
the time threshold. The walk goes forward and may use a position it has just filled itself, so
it cascades. In closed form, for an item without position:

* `gap` is the time since the previous item, `until` the time to the next item that came with a
  position, `reachable` says that `until` is within the threshold;
* the chain from the last positioned item breaks at an item whose `gap` is too long, or whose
  next positioned item is reachable and closer;
* while the chain holds, the item takes the last positioned item's place, handed on item by
  item; once it is broken, the next positioned item's place if that is reachable.

"While the chain holds" is: of all positioned items and chain breaks so far, the latest is a
positioned item. That makes it a last-value scan like the others.

Cutting. A step from one item to the next is a break if the time gap or the distance reaches its
threshold; the position an item ended up with counts.

One pass of windows inside buckets does all of this. What a bucket needs from its neighbours is
known beforehand: the previous item and the nearest positioned items on either side from one
aggregation, and the state of the chain from the items behind each bucket's last positioned one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.functions.dates import micros
from geoalbums.functions.geo import has_geo_any, has_geo_both, haversine_km
from geoalbums.functions.text import base_name, clock_text, fixed2
from geoalbums.operators.scan import (
    BUCKET,
    POSITION,
    WHOLE,
    carried_sum,
    dealt,
    earlier_buckets,
    first_row,
    from_the_end,
    in_bucket,
    join_carry,
    last_row,
    later_buckets,
    library_keys,
    up_to_here,
)
from geoalbums.sources.shared import materialize

ORDER = ["date_created", "file_name"]
AUDIT = {
    "source_file": "string", "source_gap": "bigint",
    "rejected_file": "string", "rejected_gap": "bigint", "rejected_name": "string",
}
_MICROS_PER_HOUR = 3_600_000_000
_PLACE = ["latitude", "longitude", "location_name"]
_INTERNAL = (BUCKET, WHOLE, POSITION, "local_breaks")


def _positioned() -> Column:
    return has_geo_any(F.col("latitude"), F.col("longitude"))


def _row() -> Column:
    """What an item passes on to others; `at` is its time in microseconds."""
    at = micros(F.col("date_created")).alias("at")
    return F.struct(at, "file_name", *_PLACE, _positioned().alias("positioned"))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _neighbours(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per bucket: the previous item, and the nearest positioned items before and after it."""
    summary = items.groupBy(BUCKET, *keys).agg(
        last_row(_row()).alias("last_item"),
        last_row(_row(), _positioned()).alias("last_fix"),
        first_row(_row(), _positioned()).alias("first_fix"),
        F.max(F.when(_positioned(), F.col(POSITION))).alias("last_fix_at"),
    )
    before, after = earlier_buckets(keys), later_buckets(keys)
    return summary.select(
        BUCKET,
        *keys,
        F.last("last_item", True).over(before).alias("carry_item"),
        F.last("last_fix", True).over(before).alias("carry_back"),
        F.last("first_fix", True).over(after).alias("carry_ahead"),
        "last_fix_at",
        F.col("last_fix.at").alias("last_fix_time"),
    )


def _chain_broken(gap: Column, until: Column, limit: int) -> Column:
    return gap.isNull() | (gap > limit) | _flag((until <= limit) & (until < gap))


def _chains(items: DataFrame, around: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Per bucket: whether the chain holds where it begins.

    Only the items behind a bucket's last positioned one matter for the next bucket, so no more
    than these are looked at.
    """
    tail = join_carry(items.select(BUCKET, POSITION, *keys, "date_created"), around, keys).where(
        F.col("last_fix_at").isNull() | (F.col(POSITION) > F.col("last_fix_at"))
    )
    tail = tail.withColumn("at", micros(F.col("date_created")))
    tail = tail.withColumn("previous", F.lag("at").over(in_bucket(keys)))
    tail = tail.withColumns(
        {
            "gap": F.col("at") - F.coalesce("previous", "last_fix_time", "carry_item.at"),
            "until": F.col("carry_ahead.at") - F.col("at"),
        }
    )
    broken = (
        tail.withColumn("broken", _chain_broken(F.col("gap"), F.col("until"), limit))
        .groupBy(BUCKET, *keys)
        .agg(F.max("broken").alias("broken"))
    )
    # False: broken in the tail; True: the bucket's last word is a positioned item; null: neither
    state = around.join(broken, [BUCKET, *keys], "left").withColumn(
        "state",
        F.when(F.col("broken"), F.lit(False)).when(F.col("last_fix_at").isNotNull(), F.lit(True)),
    )
    return state.select(
        BUCKET, *keys, F.last("state", True).over(earlier_buckets(keys)).alias("carry_chain")
    )


def _filled(items: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Items with positions filled, audit columns, and `prev`: the previous item as filled.

    Every intermediate value gets its own column once, so that it is worked out once.
    """
    around = materialize(_neighbours(items, keys), "neighbours")
    chains = _chains(items, around, keys, limit)
    carry = around.drop("last_fix_at", "last_fix_time").join(chains, [BUCKET, *keys])
    ordered, here = in_bucket(keys), up_to_here(keys)
    c = F.col

    df = join_carry(dealt(items, keys).withColumn("row", _row()), carry, keys)
    df = df.withColumn("fix", F.when(c("row.positioned"), c("row")))
    df = df.withColumn("next_fix", F.last("fix", True).over(from_the_end(keys)))
    df = df.withColumns({"prev_row": F.lag("row").over(ordered), "back": F.last("fix", True).over(here)})
    df = df.withColumns(
        {
            "edge": c("prev_row").isNull(),
            "prev_row": F.coalesce("prev_row", "carry_item"),
            "back": F.coalesce("back", "carry_back"),
            "next_fix": F.coalesce("next_fix", "carry_ahead"),
        }
    )
    df = df.withColumns(
        {
            "gap": c("row.at") - c("prev_row.at"),
            "until": c("next_fix.at") - c("row.at"),
        }
    )
    df = df.withColumn(
        "chain",
        F.when(c("row.positioned"), F.lit(True)).when(_chain_broken(c("gap"), c("until"), limit), F.lit(False)),
    )
    df = df.withColumn("holds", F.last("chain", True).over(here))
    df = df.withColumn("holds", _flag(F.coalesce("holds", "carry_chain")))
    df = df.withColumns(
        {
            "from_back": ~c("row.positioned") & c("holds"),
            "from_next": ~c("row.positioned") & ~c("holds") & _flag(c("until") <= limit),
        }
    )
    df = df.withColumn("taken", F.when(c("from_back"), c("back")).when(c("from_next"), c("next_fix")).otherwise(c("row")))
    df = df.withColumns(
        {"prev_holds": F.lag("holds").over(ordered), "prev_place": F.lag("taken").over(ordered)}
    )
    # The previous item has a position if it came with one, if its own chain held, or if the
    # next positioned item (this one, perhaps) was in its reach.
    df = df.withColumns(
        {
            "prev_holds": c("prev_row").isNotNull() & _flag(F.coalesce("prev_holds", "carry_chain")),
            "after_prev": F.when(c("row.positioned"), c("row")).otherwise(c("next_fix")),
        }
    )
    df = df.withColumn(
        "prev_from_next",
        c("prev_row").isNotNull()
        & ~c("prev_holds")
        & _flag(c("after_prev.at") - c("prev_row.at") <= limit),
    )
    # across a bucket's edge, the place the previous item ended up with
    edge_place = (
        F.when(c("carry_item.positioned"), c("carry_item"))
        .when(c("prev_holds"), c("carry_back"))
        .when(c("prev_from_next"), c("after_prev"))
        .otherwise(c("carry_item"))
    )
    df = df.withColumns(
        {
            "prev_place": F.when(c("edge"), edge_place).otherwise(c("prev_place")),
            "behind": _flag(c("gap") <= limit) & (c("prev_holds") | c("prev_from_next")),
        }
    )
    via_prev = c("from_back") | (
        c("from_next") & c("behind") & c("prev_from_next") & (c("gap") <= c("until"))
    )
    df = df.withColumn("via_prev", via_prev).withColumn("via_next", c("from_next") & ~c("via_prev"))
    df = df.withColumns(
        {
            "turned_next": c("via_prev") & _flag(c("until") <= limit),
            "turned_prev": c("via_next") & c("behind"),
        }
    )
    return df.select(
        *[c(f"taken.{name}").alias(name) if name in _PLACE else c(name) for name in items.columns],
        F.when(c("via_prev"), c("prev_row.file_name")).when(c("via_next"), c("next_fix.file_name")).alias("source_file"),
        F.when(c("via_prev"), c("gap")).when(c("via_next"), c("until")).alias("source_gap"),
        F.when(c("turned_next"), c("next_fix.file_name")).when(c("turned_prev"), c("prev_row.file_name")).alias("rejected_file"),
        F.when(c("turned_next"), c("until")).when(c("turned_prev"), c("gap")).alias("rejected_gap"),
        F.when(c("turned_next"), c("next_fix.location_name"))
        .when(c("turned_prev"), c("prev_place.location_name")).alias("rejected_name"),
        c("gap"),
        c("prev_row.file_name").alias("prev_file"),
        c("prev_place.latitude").alias("prev_lat"),
        c("prev_place.longitude").alias("prev_lon"),
    )


def _unfilled(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same columns without filling anything."""
    summary = items.groupBy(BUCKET, *keys).agg(last_row(_row()).alias("last_item"))
    carry = summary.select(
        BUCKET, *keys, F.last("last_item", True).over(earlier_buckets(keys)).alias("carry_item")
    )
    df = join_carry(dealt(items, keys).withColumn("row", _row()), carry, keys)
    df = df.withColumn("prev", F.lag("row").over(in_bucket(keys)))
    return df.withColumn("prev", F.coalesce("prev", "carry_item")).select(
        *items.columns,
        *[F.lit(None).cast(kind).alias(name) for name, kind in AUDIT.items()],
        (F.col("row.at") - F.col("prev.at")).alias("gap"),
        F.col("prev.file_name").alias("prev_file"),
        F.col("prev.latitude").alias("prev_lat"),
        F.col("prev.longitude").alias("prev_lon"),
    )


def with_step(df: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Gap, distance and the two break rules, from `gap` (micros) and the previous position."""
    lat, lon, prev_lat, prev_lon = (F.col(name) for name in ("latitude", "longitude", "prev_lat", "prev_lon"))
    located = has_geo_both(prev_lat, prev_lon) & has_geo_both(lat, lon)
    df = df.withColumns(
        {
            "gap_hours": F.col("gap") / _MICROS_PER_HOUR,
            "distance_km": F.when(located, haversine_km(lat, lon, prev_lat, prev_lon)),
        }
    )
    never = F.lit(False)
    by_time = _flag(F.col("gap_hours") >= cfg.time_hours) if cfg.time_hours > 0 else never
    by_distance = _flag(F.col("distance_km") >= cfg.distance_km) if cfg.distance_km > 0 else never
    return df.withColumns({"time_break": by_time, "distance_break": by_distance})


def walk(items: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Bucketed items after the walk: positions filled, audit of the filling, step and breaks.

    Adds `source_file` / `source_gap` (micros) of the item a position came from directly,
    `rejected_file` / `rejected_gap` / `rejected_name` of the other candidate in reach (all null
    for items that kept what they had; with no distance threshold nothing is filled), then
    `prev_file`, `gap_hours`, `distance_km`, `time_break`, `distance_break`.
    """
    keys = library_keys(cfg.library_cols)
    df = _filled(items, keys, cfg.time_micros) if cfg.distance_km > 0 else _unfilled(items, keys)
    is_break = (F.col("time_break") | F.col("distance_break")).cast("bigint")
    walked = with_step(df, cfg).withColumn("local_breaks", F.sum(is_break).over(up_to_here(keys)))
    return walked.select(
        *items.columns, *AUDIT, "prev_file",
        "gap_hours", "distance_km", "time_break", "distance_break", "local_breaks",
    )


def with_album_ids(walked: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """`album_id`: one more than the breaks so far. A sum per bucket, no second pass of windows."""
    keys = library_keys(cfg.library_cols)
    summary = walked.groupBy(BUCKET, *keys).agg(F.max("local_breaks").alias("breaks"))
    carry = materialize(
        summary.select(BUCKET, *keys, carried_sum(keys, "breaks", "carry_breaks")), "album-carry"
    )
    return join_carry(walked, carry, keys).select(
        *[name for name in walked.columns if name != "local_breaks"],
        (F.col("carry_breaks") + F.col("local_breaks") + 1).alias("album_id"),
    )


def imputation_audit(walked: DataFrame) -> DataFrame:
    """One row per filled item: where its position came from and what was turned down."""
    return walked.where(F.col("source_file").isNotNull()).select(
        *[name for name in walked.columns if name not in _INTERNAL],
        base_name(F.col("source_file")).alias("source_name"),
        clock_text(F.col("source_gap")).alias("source_gap_text"),
        clock_text(F.col("rejected_gap")).alias("rejected_gap_text"),
    )


def album_breaks(steps: DataFrame) -> DataFrame:
    """Audit of the cuts: between which files, by which rule, with the figures as text."""
    reason = F.concat_ws(
        " and ",
        F.when(F.col("time_break"), F.concat(F.lit("time ("), fixed2(F.col("gap_hours")), F.lit(" hrs)"))),
        F.when(F.col("distance_break"), F.concat(F.lit("distance ("), fixed2(F.col("distance_km")), F.lit(" km)"))),
    )
    return steps.where(F.col("time_break") | F.col("distance_break")).select(
        *[name for name in steps.columns if name not in _INTERNAL],
        base_name(F.col("prev_file")).alias("prev_name"),
        base_name(F.col("file_name")).alias("curr_name"),
        reason.alias("reason"),
    )
