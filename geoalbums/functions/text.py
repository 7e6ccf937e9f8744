"""Names: sanitising, list formatting, counts, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoalbums.config import INVALID_CHARS_POSIX, RESERVED_NAMES

_SPACE = r"(?U)\s"


def trim_all(text: Column) -> Column:
    """Strip every kind of white space at both ends, not only blanks."""
    return F.regexp_replace(text, rf"{_SPACE}+\z|\A{_SPACE}+", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (trim_all(text) == "")


def sanitize_name(text: Column, invalid_chars: str = INVALID_CHARS_POSIX) -> Column:
    """Drop characters a folder name cannot hold, trim, make runs of blanks one blank."""
    kept = F.regexp_replace(text, f"[{invalid_chars}]", "")
    return F.regexp_replace(trim_all(kept), " {2,}", " ")


def format_list(items: Column, invalid_chars: str = INVALID_CHARS_POSIX) -> Column:
    """`A`, `A and B`, `A, B, and C`; items are sanitised and blank ones left out."""
    names = F.filter(
        F.transform(items, lambda item: sanitize_name(item, invalid_chars)),
        lambda name: name != "",
    )
    size = F.size(names)
    return (
        F.when(size <= 0, F.lit(""))
        .when(size <= 2, F.array_join(names, " and "))
        .otherwise(
            F.concat(
                F.array_join(F.slice(names, F.lit(1), F.greatest(size - 1, F.lit(0))), ", "),
                F.lit(", and "),
                F.element_at(names, -1),
            )
        )
    )


def pluralise(number: Column, singular: str, plural: str) -> Column:
    return F.when(number == 1, F.lit(f"1 {singular}")).otherwise(
        F.concat(F.format_number(number, 0), F.lit(f" {plural}"))
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot of the base name to its end, dot included; empty without a dot or after a final one."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(?s)\A(.*?)(\.[^.]*)?\z", 1)


def numbered_name(name: Column, number: Column) -> Column:
    """`stem (n).ext`; number 0 is the name itself."""
    return F.when(number == 0, name).otherwise(
        F.concat(stem(name), F.lit(" ("), number.cast("string"), F.lit(")"), extension(name))
    )


def clock_text(micros: Column) -> Column:
    """`hh:mm:ss` of a gap, hours within the day, as the imputation audit prints it."""
    seconds = F.floor(F.abs(micros) / 1_000_000)
    text = F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600) % 24,
        F.floor(seconds / 60) % 60,
        seconds % 60,
    )
    return F.when(micros.isNotNull(), text)


def fixed2(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("%.2f", number))


def name_violations(path: Column, invalid_chars: str = INVALID_CHARS_POSIX) -> Column:
    """Rules a relative album path breaks, as an array of rule names (empty = safe)."""
    segments = F.filter(F.split(path, "/"), lambda part: part != "")
    bad_chars = F.exists(segments, lambda part: part.rlike(f"[{invalid_chars}]"))
    reserved = F.exists(segments, lambda part: F.upper(part).isin(*RESERVED_NAMES))
    return F.array_compact(
        F.array(
            F.when(is_blank(path), F.lit("blank")),
            F.when(bad_chars, F.lit("invalid characters")),
            F.when(reserved, F.lit("reserved name")),
        )
    )
