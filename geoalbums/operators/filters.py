"""Which items take part: media type, date range, resume mark, hold-back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoalbums.config import LAST, AlbumConfig
from geoalbums.functions.text import extension
from geoalbums.operators.joins import left_join_by_weight
from geoalbums.sources.shared import materialize

# --- fixed values ---
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".heic", ".heif", ".avif")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".m4v")
# --------------------


def is_media(path: Column, no_photos: bool = False, no_videos: bool = False) -> Column:
    wanted = (() if no_photos else PHOTO_EXTENSIONS) + (() if no_videos else VIDEO_EXTENSIONS)
    return F.lower(extension(path)).isin(*wanted) if wanted else F.lit(False)


def _ntz(moment: dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _bound(value, mark: Column) -> Column | None:
    if value is None:
        return None
    return mark if value == LAST else _ntz(value)


def needs_mark(cfg: AlbumConfig) -> bool:
    return LAST in (cfg.date_from, cfg.date_to)


def with_mark(media: DataFrame, state: DataFrame | None, cfg: AlbumConfig) -> DataFrame:
    """Each item with its library's `last_processed`, null where nothing was saved."""
    if state is None:
        return media.withColumn("last_processed", F.lit(None).cast("timestamp_ntz"))
    if not cfg.library_cols:
        mark = state.agg(F.max("last_processed"))
        return media.withColumn("last_processed", mark.scalar())
    keys = list(cfg.library_cols)
    marks = materialize(
        state.groupBy(*keys).agg(F.max("last_processed").alias("last_processed")), "marks"
    )
    libraries = marks.count()
    if libraries <= cfg.broadcast_rows:
        return media.join(F.broadcast(marks), keys, "left")
    sizes = media.groupBy(*keys).agg(F.count("*").alias("items"))
    return left_join_by_weight(
        media, marks.join(sizes, keys), keys, "items", libraries, cfg.broadcast_rows, cfg.hot_rows
    )


def date_window(media: DataFrame, cfg: AlbumConfig, state: DataFrame | None = None) -> DataFrame:
    """Half-open date range `from <= date < to`, `last` resolved per library, recent held back.

    A library without a mark is not limited by `last`, as a first run would not be.
    """
    date, mark = F.col("date_created"), F.col("last_processed")
    marked = with_mark(media, state, cfg) if needs_mark(cfg) else media
    start, end = _bound(cfg.date_from, mark), _bound(cfg.date_to, mark)
    if cfg.exclude_recent:
        limit = _ntz(cfg.clock() - dt.timedelta(hours=cfg.time_hours))
        end = limit if end is None else F.least(end, limit)
    if start is not None:
        marked = marked.where(F.coalesce(date >= start, F.lit(True)))
    if end is not None:
        marked = marked.where(F.coalesce(date < end, F.lit(True)))
    return marked.select(*media.columns)


def late_items(media: DataFrame, cfg: AlbumConfig, state: DataFrame | None) -> DataFrame:
    """Items dated before their library's mark: a resumed run does not see them."""
    marked = with_mark(media, state, cfg)
    return marked.where(F.col("date_created") < F.col("last_processed"))
