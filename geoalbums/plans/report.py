"""Album catalog and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.functions.text import base_name, is_blank, name_violations, pluralise


def album_catalog(albums: DataFrame, cfg: AlbumConfig, destination: str = "") -> DataFrame:
    """Distinct non-blank album names with their path, files, and date (the earliest item's).

    Each library's albums are in a folder of its own.
    """
    steps = [F.lit(destination.rstrip("/"))] if destination else []
    path: Column = F.concat_ws("/", *steps, *[F.col(c).cast("string") for c in cfg.library_cols], "album_name")
    return (
        albums.where(~is_blank(F.col("album_name")))
        .groupBy(*cfg.library_cols, "album_name")
        .agg(F.sum("files").alias("files"), F.min("first_date").alias("album_date"))
        .withColumn("album_path", path)
        .withColumn("violations", name_violations(F.col("album_name"), cfg.invalid_chars))
    )


def album_preview(albums: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Albums in name order (by code point) with their file count as text."""
    return (
        albums.groupBy(*cfg.library_cols, "album_name")
        .agg(F.sum("files").alias("files"))
        .withColumn("files_text", pluralise(F.col("files"), "file", "files"))
        .orderBy(*cfg.library_cols, "album_name")
    )


def file_preview(items: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Every file with its album and the name it keeps; long, never a list per album."""
    return items.select(
        *cfg.library_cols, "album_name", "file_name", base_name(F.col("file_name")).alias("name")
    )


def run_totals(albums: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Total files and albums of a run."""
    per_album = albums.groupBy(*cfg.library_cols, "album_name").agg(F.sum("files").alias("files"))
    return per_album.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.count("*").alias("albums")
    )


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def missing_positions(media: DataFrame) -> DataFrame:
    missing = (F.col("latitude") == 0) & (F.col("longitude") == 0)
    return media.agg(F.count_if(missing).alias("missing"))
