"""Time-gap albums on a stream, per library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.functions.dates import micros


def session_albums(stream: DataFrame, cfg: AlbumConfig, watermark: str = "0 seconds") -> DataFrame:
    """One row per closed time-gap album: library, first_date, last_date, files.

    An album ends where the next item is at least the threshold away. A Spark session merges
    items exactly one gap apart, so the session gap is one microsecond shorter. Works on a stream
    (append mode) and on a batch alike.
    """
    gap = cfg.time_micros - 1
    if gap <= 0:
        raise ValueError("session albums need a time threshold")
    # Watermarks need an instant: the date read as UTC, so that no zone's clock change counts.
    instant = F.timestamp_micros(micros(F.col("date_created")))
    window = F.session_window("instant", f"{gap} microseconds")
    albums = (
        stream.withColumn("instant", instant)
        .withWatermark("instant", watermark)
        .groupBy(*cfg.library_cols, window)
        .agg(
            F.min("date_created").alias("first_date"),
            F.max("date_created").alias("last_date"),
            F.count("*").alias("files"),
        )
    )
    # Filter on first_date / last_date only: a filter on the window itself would be moved below
    # the merging of sessions.
    return albums.drop("session_window")
