"""A whole grouping run, in its fixed order of steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.operators.albums import (
    album_figures,
    album_pieces,
    avoid_existing,
    base_names,
    name_items,
    part_numbers,
    top_places,
    with_part_suffix,
)
from geoalbums.operators.filters import date_window, is_media
from geoalbums.operators.places import enrich, load_gazetteer
from geoalbums.operators.scan import BUCKET, POSITION, WHOLE, bucketed
from geoalbums.operators.walk import ORDER, album_breaks, imputation_audit, walk, with_album_ids
from geoalbums.sources.shared import materialize


@dataclass(frozen=True)
class AlbumRun:
    """What a run gives: named items, one row per album, and the two audits."""

    items: DataFrame
    albums: DataFrame
    breaks: DataFrame
    imputations: DataFrame
    places_total: int | None = None
    places_kept: int | None = None


def prepare(media: DataFrame, cfg: AlbumConfig, state: DataFrame | None = None) -> DataFrame:
    """Media of the wanted type and dates, unknown axes as 0, with a location name column."""
    wanted = media.where(is_media(F.col("file_name"), cfg.no_photos, cfg.no_videos))
    dated = date_window(wanted, cfg, state)
    if "location_name" not in dated.columns:
        dated = dated.withColumn("location_name", F.lit(None).cast("string"))
    return dated.withColumns(
        {axis: F.coalesce(axis, F.lit(0.0)) for axis in ("latitude", "longitude")}
    )


def public(df: DataFrame) -> DataFrame:
    """Without the columns of the physical layout; an item's number is its place in the order."""
    return df.withColumnRenamed(POSITION, "item_no").drop(BUCKET, WHOLE)


def name_albums(
    steps: DataFrame, cfg: AlbumConfig, with_places: bool, existing_folders: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(items with names, albums), both still with their bucket or library keys.

    Order of naming: places or dates, prefix, free name on disk, part number.
    """
    pieces = materialize(album_pieces(steps, cfg), "album-pieces")
    named = base_names(
        album_figures(pieces, cfg), top_places(steps, cfg) if with_places else None, cfg
    )
    if cfg.avoid_existing and existing_folders is not None:
        named = avoid_existing(materialize(named, "wished-names"), existing_folders, cfg)
    albums = with_part_suffix(part_numbers(named, cfg))
    if not cfg.use_part_numbers:
        albums = materialize(albums, "albums")
    return name_items(steps, pieces, albums, cfg), albums


def build_albums(
    media: DataFrame,
    cfg: AlbumConfig,
    places: DataFrame | None = None,
    state: DataFrame | None = None,
    existing_folders: DataFrame | None = None,
) -> AlbumRun:
    """Media rows (file_name, date_created, latitude, longitude, …) to albums.

    Steps: type and date filter, place names, filling of missing positions, cuts, names, parts.
    """
    if cfg.append_format and places is None:
        raise ValueError("append_format needs a gazetteer")
    ready = prepare(media, cfg, state)
    items = bucketed(ready, cfg.library_cols, ORDER, cfg.scan_buckets)
    total = count = None
    if places is not None:
        kept, total, count = load_gazetteer(places, items, cfg)
        items = materialize(enrich(items, kept, cfg), "named-media")
    walked = materialize(walk(items, cfg), "walked")
    steps = with_album_ids(walked, cfg)
    named, albums = name_albums(steps, cfg, places is not None, existing_folders)
    return AlbumRun(
        public(named), public(albums), public(album_breaks(steps)), public(imputation_audit(walked)),
        total, count,
    )
