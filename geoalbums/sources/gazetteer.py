"""Reader for the tab-separated GeoNames dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: field positions (from 0) and the least number of fields of a usable line ---
FIELDS = {
    "geonameid": 0, "name": 1, "latitude": 4, "longitude": 5, "feature_class": 6,
    "feature_code": 7, "country": 8, "admin1": 10, "population": 14,
}
MIN_FIELDS = 16
_FLOAT = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
_INTEGER = r"\A\s*[+-]?\d+\s*\z"
# ----------------------------------------------------------------------------------------------


def _number(text: Column, pattern: str, kind: str) -> Column:
    return F.when(text.rlike(pattern), F.trim(text).try_cast(kind))


def parse_lines(lines: DataFrame) -> DataFrame:
    """`value` lines to places; blank, `#`, short and un-positioned lines fall away.

    Not read as CSV: rows are ragged and quotes are part of names.
    """
    value = F.col("value")
    usable = lines.where(~value.rlike(r"(?U)\A\s*\z") & ~value.startswith("#"))
    parts = usable.select(F.split(value, "\t", -1).alias("part")).where(F.size("part") >= MIN_FIELDS)
    field = {name: F.col("part")[at] for name, at in FIELDS.items()}
    return parts.select(
        _number(field["geonameid"], _INTEGER, "bigint").alias("geonameid"),
        field["name"].alias("name"),
        _number(field["latitude"], _FLOAT, "double").alias("latitude"),
        _number(field["longitude"], _FLOAT, "double").alias("longitude"),
        field["feature_class"].alias("feature_class"),
        field["feature_code"].alias("feature_code"),
        field["country"].alias("country"),
        field["admin1"].alias("admin1"),
        F.coalesce(_number(field["population"], _INTEGER, "int"), F.lit(0)).alias("population"),
    ).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def read_geonames(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_lines(spark.read.text(path))
