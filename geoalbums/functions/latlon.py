"""Latitude / longitude out of free text, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the four notations, tried in this order -------------------------------
ISO_6709 = r"([+-]\d{1,2}(?:\.\d+)?)\s*,?\s*([+-]\d{1,3}(?:\.\d+)?)"
DECIMAL_HEMISPHERE = r"(?i)(-?\d{1,2}(?:\.\d+)?)\s*([NS])[, ]+\s*(-?\d{1,3}(?:\.\d+)?)\s*([EW])"
DEGREES_MINUTES = r"(?i)(\d{1,3}),(\d{1,2}(?:\.\d+)?)\s*([NSEW])"
DEGREES_MINUTES_SECONDS = r"""(?i)(\d{1,3})\s*deg\s*(\d{1,2})'\s*(\d{1,2}(?:\.\d+)?)"\s*([NSEW])"""
# -----------------------------------------------------------------------------------------


_HEMISPHERES = (("ns", ("N", "S")), ("ew", ("E", "W")))


def _number(text: Column, pattern: str, group: int) -> Column:
    """What a group matched is always a number; nothing matched is null, without a failed cast."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def _signed(value: Column, hemisphere: Column) -> Column:
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def _last_hit(text: Column, pattern: str, letters: tuple[str, str]) -> Column:
    """The last match that ends in one of the letters."""
    hits = F.filter(
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda hit: F.upper(F.right(hit, F.lit(1))).isin(*letters),
    )
    return F.try_element_at(hits, F.lit(-1))


def _units(hit: Column, pattern: str, scales: tuple[float, ...]) -> Column:
    """Degrees plus the scaled smaller units of one match, signed by its hemisphere."""
    value = _number(hit, pattern, 1)
    for group, scale in enumerate(scales, start=2):
        value = value + _number(hit, pattern, group) / scale
    return _signed(value, F.right(hit, F.lit(1)))


def with_latlon(df: DataFrame, text: str) -> DataFrame:
    """Adds `lat`, `lon`: the first notation found in the text column, else null; not range-checked.

    Worked out in stages, so that every match is made once per row.
    """
    clean = F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), "[°º]", " deg ")
    staged = df.withColumn("_clean", F.replace(clean, F.lit("  "), F.lit(" ")))
    clean = F.col("_clean")
    columns = {
        "_iso_ns": _number(clean, ISO_6709, 1),
        "_iso_ew": _number(clean, ISO_6709, 2),
        "_dec_ns": _signed(_number(clean, DECIMAL_HEMISPHERE, 1), F.regexp_extract(clean, DECIMAL_HEMISPHERE, 2)),
        "_dec_ew": _signed(_number(clean, DECIMAL_HEMISPHERE, 3), F.regexp_extract(clean, DECIMAL_HEMISPHERE, 4)),
    }
    staged = staged.withColumns(columns)
    # the later notations are searched for only where they can still count
    found = [F.col(f"{name}_ns").isNotNull() & F.col(f"{name}_ew").isNotNull() for name in ("_iso", "_dec")]
    still_open = ~(found[0] | found[1])
    hits, units = {}, {}
    for name, pattern, marker, scales in (
        ("_min", DEGREES_MINUTES, ",", (60.0,)),
        ("_sec", DEGREES_MINUTES_SECONDS, "deg", (60.0, 3600.0)),
    ):
        for axis, letters in _HEMISPHERES:
            hit = _last_hit(clean, pattern, letters)
            hits[f"{name}_hit_{axis}"] = F.when(still_open & F.lower(clean).contains(marker), hit)
            units[f"{name}_{axis}"] = _units(F.col(f"{name}_hit_{axis}"), pattern, scales)
    staged = staged.withColumns(hits).withColumns(units)

    def first_pair(axis: str) -> Column:
        pairs = [
            F.when(F.col(f"{name}_ns").isNotNull() & F.col(f"{name}_ew").isNotNull(), F.col(f"{name}_{axis}"))
            for name in ("_iso", "_dec", "_min", "_sec")
        ]
        return F.coalesce(*pairs).alias("lat" if axis == "ns" else "lon")

    return staged.select(*df.columns, first_pair("ns"), first_pair("ew"))
