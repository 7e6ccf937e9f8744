"""Dates as columns: ISO parsing, metadata dates, and .NET custom date patterns.

A pattern or template is constant for a run, so it is taken apart once on the driver into
literal and pattern pieces; the column is then a plain `concat` of `date_format` calls.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: exact ISO 8601 layouts, and the date layouts of photo metadata ---
ISO_LAYOUTS = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"
TAG_LAYOUTS = r"^(\d{4})[:.-](\d{2})[:.-](\d{2})(?:[ T](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?Z?$"
# .NET custom specifier -> Spark date_format pattern
NET_TO_SPARK = {
    "d": "d", "dd": "dd", "ddd": "EEE", "dddd": "EEEE",
    "M": "M", "MM": "MM", "MMM": "MMM", "MMMM": "MMMM",
    "yy": "yy", "yyyy": "yyyy",
    "H": "H", "HH": "HH", "h": "h", "hh": "hh",
    "m": "m", "mm": "mm", "s": "s", "ss": "ss", "tt": "a",
}
# -------------------------------------------------------------------------------------

Piece = tuple[str, str]  # ("text" | "date", value)


def _as_ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def micros(date: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    since = date - _as_ntz(F.lit("1970-01-01"))
    return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def parse_iso8601_col(text: Column) -> Column:
    """The five exact layouts (date, date + HH:mm[:ss] after a blank or `T`), else null."""
    return F.when(text.rlike(ISO_LAYOUTS), _as_ntz(text))


def parse_tag_date(text: Column) -> Column:
    """A capture date as metadata tags carry it (`yyyy:MM:dd HH:mm:ss` and kin), else null."""
    trimmed = F.trim(text)
    day = F.regexp_replace(trimmed, TAG_LAYOUTS, "$1-$2-$3")
    time = F.regexp_extract(trimmed, TAG_LAYOUTS, 4)
    iso = F.when(time == "", day).otherwise(F.concat(day, F.lit(" "), time))
    return F.when(trimmed.rlike(TAG_LAYOUTS), _as_ntz(iso))


def parse_iso8601(text: str) -> dt.datetime | None:
    """Driver-side twin of `parse_iso8601_col`, for options."""
    if not re.match(ISO_LAYOUTS, text):
        return None
    try:
        return dt.datetime.fromisoformat(text)
    except ValueError:
        return None


def net_pattern_pieces(pattern: str) -> list[Piece]:
    """Take a .NET custom date pattern apart; anything that is no specifier is text."""
    if not pattern or not pattern.strip():
        raise ValueError("date pattern is blank")
    if len(pattern) == 1:
        raise ValueError(f"{pattern!r} is a standard format; only custom patterns are supported")
    pieces: list[Piece] = []
    at = 0
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            if at + 1 == len(pattern):
                raise ValueError(f"date pattern {pattern!r} ends in a backslash")
            pieces.append(("text", pattern[at + 1]))
            at += 2
        elif char in "'\"":
            end = pattern.find(char, at + 1)
            if end < 0:
                raise ValueError(f"date pattern {pattern!r} has an open quote")
            pieces.append(("text", pattern[at + 1:end]))
            at = end + 1
        elif char == "%" and at + 1 < len(pattern):
            at += 1
        elif char in "dMyHhmsftFgKz":
            run = re.match(re.escape(char) + "+", pattern[at:]).group()
            pieces.append(("date", _spark_pattern(run)))
            at += len(run)
        else:
            pieces.append(("text", char))
            at += 1
    merged: list[Piece] = []
    for kind, value in pieces:
        if kind == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + value)
        else:
            merged.append((kind, value))
    return merged


def _spark_pattern(run: str) -> str:
    char, size = run[0], len(run)
    if run in NET_TO_SPARK:
        return NET_TO_SPARK[run]
    if char in "dM" and size > 4:
        return NET_TO_SPARK[char * 4]
    if char == "y":
        # a single y prints the two-digit year without its leading zero
        return "y1" if size == 1 else "y" * size
    if char in "Hhms" and size > 2:
        return NET_TO_SPARK[char * 2]
    if char == "f" and size <= 6:
        return "S" * size
    if char == "t":
        return "a1" if size == 1 else "a"
    raise ValueError(f"date specifier {run!r} is not supported")


def _piece_column(piece: Piece, date: Column) -> Column:
    kind, value = piece
    if kind == "text":
        return F.lit(value)
    if value == "y1":
        return (F.year(date) % 100).cast("string")
    if value == "a1":
        return F.substring(F.date_format(date, "a"), 1, 1)
    return F.date_format(date, value)


def net_format(date: Column, pattern: str) -> Column:
    """`date` in a .NET custom pattern, English names."""
    columns = [_piece_column(piece, date) for piece in net_pattern_pieces(pattern)]
    return columns[0].cast("string") if len(columns) == 1 else F.concat(*columns)


def split_template(template: str) -> list[list[Piece]]:
    """Segments between `/`, each as literal and `<pattern>` pieces; an open `<` stays text."""
    segments: list[list[Piece]] = []
    for segment in template.split("/"):
        pieces: list[Piece] = []
        for literal, pattern in re.findall(r"([^<]+|<(?![^>]+>))|<([^>]+)>", segment):
            pieces.extend([("text", literal)] if literal else net_pattern_pieces(pattern))
        segments.append(pieces)
    return segments


def sample_text(piece: Piece, date: dt.datetime) -> str:
    """One piece for one date on the driver, to check a template before a run starts."""
    kind, value = piece
    if kind == "text":
        return value
    names = {
        "EEE": "%a", "EEEE": "%A", "MMM": "%b", "MMMM": "%B", "MM": "%m", "dd": "%d",
        "HH": "%H", "hh": "%I", "mm": "%M", "ss": "%S", "a": "%p", "yy": "%y", "yyyy": "%Y",
    }
    return date.strftime(names[value]) if value in names else "0"


def expand_template(template: str, date: Column, name: Column) -> Column:
    """Prefix template applied to a name: a relative path, empty segments left out."""
    segments = split_template(template)
    columns: list[Column] = []
    for at, pieces in enumerate(segments):
        parts = [_piece_column(piece, date) for piece in pieces]
        if at == len(segments) - 1:
            parts.append(name)
        if parts:
            columns.append(parts[0].cast("string") if len(parts) == 1 else F.concat(*parts))
    filled = [F.when(column != "", column) for column in columns]
    return F.concat_ws("/", *filled)
