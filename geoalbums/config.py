"""Options of a grouping run: validated on the driver, never shipped as mutable state."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from geoalbums.functions.dates import (
    net_pattern_pieces,
    parse_iso8601,
    sample_text,
    split_template,
)

# --- fixed values -----------------------------------------------------------
MODES = ("simulate", "copy", "move", "link")
RESERVED_NAMES = (
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
# Characters that may not occur in a file name, as a regex character class.
INVALID_CHARS_POSIX = "/\\x00"
INVALID_CHARS_PORTABLE = "/\\x00-\\x1f<>:\"\\\\|?*"
# Accepted spellings of the three digests, lower case.
HASH_SPELLINGS = {
    "crc": "crc", "crc64": "crc", "crc-64": "crc", "md5": "md5", "md-5": "md5",
    "sha": "sha", "sha512": "sha", "sha-512": "sha",
}
# ----------------------------------------------------------------------------

LAST = "last"


@dataclass(frozen=True)
class AlbumConfig:
    """Every option of a run; the defaults are those a user gets without asking."""

    time_hours: float = 48.0
    distance_km: float = 10.0
    recursive: bool = False
    date_format: str = "dd MMM yyyy"
    append_format: str = ""
    album_prefix: str = ""
    no_photos: bool = False
    no_videos: bool = False
    use_date_range: bool = True
    use_part_numbers: bool = True
    avoid_existing: bool = False
    precision: int = 3
    date_from: str | dt.datetime | None = None
    date_to: str | dt.datetime | None = None
    exclude_recent: bool = False
    now: dt.datetime | None = None
    hash_mode: str = "crc"
    mode: str = "simulate"
    library_cols: tuple[str, ...] = ()
    portable_names: bool = False
    require_places: bool = True
    # Physical layout only: results never depend on these.
    scan_buckets: int | None = None
    broadcast_rows: int = 500_000
    hot_rows: int = 1_000_000

    def __post_init__(self) -> None:
        object.__setattr__(self, "library_cols", tuple(self.library_cols))
        if self.hash_mode.lower() not in HASH_SPELLINGS:
            raise ValueError(f"unknown hash {self.hash_mode!r}: use crc, md5 or sha")
        object.__setattr__(self, "hash_mode", HASH_SPELLINGS[self.hash_mode.lower()])
        object.__setattr__(self, "date_from", self._bound(self.date_from, "date_from"))
        object.__setattr__(self, "date_to", self._bound(self.date_to, "date_to"))
        if self.time_hours < 0 or self.distance_km < 0:
            raise ValueError("thresholds cannot be negative")
        if self.time_hours == 0 and self.distance_km == 0:
            raise ValueError("at least one threshold must be greater than zero")
        if self.no_photos and self.no_videos:
            raise ValueError("photos and videos are both excluded")
        if self.precision not in (1, 2, 3):
            raise ValueError("precision must be 1, 2 or 3")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if isinstance(self.date_from, dt.datetime):
            if isinstance(self.date_to, dt.datetime) and self.date_from >= self.date_to:
                raise ValueError("date_from must be before date_to")
            if self.date_from > self.clock():
                raise ValueError("date_from cannot be in the future")
        net_pattern_pieces(self.date_format)
        if self.append_format:
            net_pattern_pieces(self.append_format)
        if self.album_prefix:
            self._check_prefix()

    @staticmethod
    def _bound(value, name: str):
        if value is None or isinstance(value, dt.datetime):
            return value
        if value.lower() == LAST:
            return LAST
        parsed = parse_iso8601(value)
        if parsed is None:
            raise ValueError(f"{name}: {value!r} is neither an ISO 8601 date nor 'last'")
        return parsed

    def _check_prefix(self) -> None:
        if not self.album_prefix.strip():
            raise ValueError("album_prefix is blank")
        for segment in split_template(self.album_prefix):
            if not segment:
                continue
            text = "".join(sample_text(piece, self.clock()) for piece in segment)
            if re.search(f"[{self.invalid_chars}]", text):
                raise ValueError(f"album_prefix gives {text!r}, which has invalid characters")
            if text.upper() in RESERVED_NAMES:
                raise ValueError(f"album_prefix gives the reserved name {text!r}")

    def clock(self) -> dt.datetime:
        return self.now or dt.datetime.now()

    @property
    def invalid_chars(self) -> str:
        return INVALID_CHARS_PORTABLE if self.portable_names else INVALID_CHARS_POSIX

    @property
    def time_micros(self) -> int:
        """The time threshold in whole microseconds (100 ns ticks, cut off)."""
        return int(self.time_hours * 36_000_000_000) // 10
