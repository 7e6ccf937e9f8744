"""Capture date and position out of a table of metadata tags.

Input is long: (file_name, dir_ord, directory, tag_ord, tag, value), one row per tag. All
candidates of a file are reduced in one grouped pass with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoalbums.functions.dates import parse_tag_date
from geoalbums.functions.geo import is_valid_position
from geoalbums.functions.latlon import with_latlon
from geoalbums.functions.text import is_blank

# --- fixed values: directory and tag names, in order of precedence ---
DATE_TAGS = (
    ("ExifSubIFD", "DateTimeOriginal"),
    ("ExifSubIFD", "DateTimeDigitized"),
    ("ExifSubIFD", "DateTime"),
    ("QuickTimeMetadataHeader", "CreationDate"),
    ("QuickTimeMovieHeader", "Created"),
)
GPS_DIRECTORY, GPS_TAGS = "GPS", ("Latitude", "Longitude")
XMP_DIRECTORY, XMP_TAGS = "XMP", ("GPSLatitude", "GPSLongitude", "GPSPosition")
# ---------------------------------------------------------------------


def _first_value(directory: str, tag: str) -> Column:
    """struct(dir_ord, tag_ord, value) of the first such tag of the file."""
    here = (F.col("directory") == directory) & (F.col("tag") == tag)
    return F.min(F.when(here, F.struct("dir_ord", "tag_ord", "value")))


def _first_directory(directory: str) -> Column:
    return F.min(F.when(F.col("directory") == directory, F.col("dir_ord")))


def _in_first(found: str, first: str) -> Column:
    """Value of a tag, provided it sits in the first directory of its kind."""
    return F.when(F.col(f"{found}.dir_ord") == F.col(first), F.col(f"{found}.value"))


def tag_dates(tags: DataFrame, files: DataFrame) -> DataFrame:
    """file_name, date_created for every file of `files` (file_name, created_at, modified_at).

    The first date tag that parses counts; a file without one takes the earlier of its times.
    """
    names = [f"date_{at}" for at in range(len(DATE_TAGS))]
    directories = sorted({directory for directory, _ in DATE_TAGS})
    wanted = tags.where(F.col("directory").isin(*directories))
    found = wanted.groupBy("file_name").agg(
        *[_first_value(*key).alias(name) for name, key in zip(names, DATE_TAGS)],
        *[_first_directory(directory).alias(f"dir_{directory}") for directory in directories],
    )
    parsed = [
        parse_tag_date(_in_first(name, f"dir_{directory}"))
        for name, (directory, _) in zip(names, DATE_TAGS)
    ]
    dated = found.select("file_name", F.coalesce(*parsed).alias("tag_date"))
    times = [F.col(c).cast("timestamp_ntz") for c in ("created_at", "modified_at") if c in files.columns]
    fallback = F.least(*times) if len(times) > 1 else times[0]
    return files.join(dated, "file_name", "left").select(
        *files.columns, F.coalesce("tag_date", fallback).alias("date_created")
    )


def tag_locations(tags: DataFrame, files: DataFrame) -> DataFrame:
    """latitude, longitude for every file of `files`; (0, 0) where no tag gives a valid one.

    EXIF position, XMP pair, XMP combined position, then the first tag in file order that
    parses to a valid position. Every candidate is a row with its precedence; the least valid
    one of a file counts.
    """
    lat_tag, lon_tag = GPS_TAGS
    xmp_lat, xmp_lon, xmp_position = XMP_TAGS
    known = tags.where(F.col("directory").isin(GPS_DIRECTORY, XMP_DIRECTORY)).groupBy("file_name").agg(
        _first_directory(GPS_DIRECTORY).alias("gps"),
        _first_value(GPS_DIRECTORY, lat_tag).alias("gps_lat"),
        _first_value(GPS_DIRECTORY, lon_tag).alias("gps_lon"),
        _first_directory(XMP_DIRECTORY).alias("xmp"),
        _first_value(XMP_DIRECTORY, xmp_lat).alias("xmp_lat"),
        _first_value(XMP_DIRECTORY, xmp_lon).alias("xmp_lon"),
        _first_value(XMP_DIRECTORY, xmp_position).alias("xmp_position"),
    )
    known = known.select(
        "file_name",
        _in_first("gps_lat", "gps").try_cast("double").alias("lat"),
        _in_first("gps_lon", "gps").try_cast("double").alias("lon"),
        _in_first("xmp_lat", "xmp").alias("lat_text"),
        _in_first("xmp_lon", "xmp").alias("lon_text"),
        _in_first("xmp_position", "xmp").alias("position"),
    )
    pair = F.when(
        ~is_blank(F.col("lat_text")) & ~is_blank(F.col("lon_text")),
        F.concat("lat_text", F.lit(", "), "lon_text"),
    )
    order = [F.lit(0).alias("dir_ord"), F.lit(0).alias("tag_ord")]
    exif = known.select("file_name", F.lit(0).alias("rank"), *order, "lat", "lon")
    xmp = known.select("file_name", F.posexplode(F.array(pair, "position")).alias("at", "value")).select(
        "file_name", (F.col("at") + 1).alias("rank"), *order, "value"
    )
    walked = tags.select("file_name", F.lit(3).alias("rank"), "dir_ord", "tag_ord", "value")
    # every notation has two numbers at least; what has not is not looked at any closer
    texts = xmp.unionByName(walked).where(F.col("value").rlike("[0-9][^0-9]+[0-9]"))
    parsed = with_latlon(texts, "value").drop("value")
    # The test sits in the aggregate: as a filter it would be moved below and parse twice.
    valid = F.when(
        is_valid_position(F.col("lat"), F.col("lon")), F.struct("rank", "dir_ord", "tag_ord", "lat", "lon")
    )
    chosen = exif.unionByName(parsed).groupBy("file_name").agg(F.min(valid).alias("point"))
    return files.join(chosen, "file_name", "left").select(
        *files.columns,
        F.coalesce("point.lat", F.lit(0.0)).alias("latitude"),
        F.coalesce("point.lon", F.lit(0.0)).alias("longitude"),
    )


def media_from_tags(tags: DataFrame, files: DataFrame, cfg, state: DataFrame | None = None) -> DataFrame:
    """Files and tags to media rows; the date filter comes before positions are looked at."""
    from geoalbums.operators.filters import date_window

    dated = date_window(tag_dates(tags, files), cfg, state)
    wanted = tags.join(dated.select("file_name"), "file_name", "left_semi")
    return tag_locations(wanted, dated)
