import datetime as dt

import pytest

from geoalbums import AlbumConfig
from geoalbums.functions.dates import net_pattern_pieces, split_template


def test_defaults():
    cfg = AlbumConfig()
    assert (cfg.time_hours, cfg.distance_km, cfg.date_format) == (48.0, 10.0, "dd MMM yyyy")
    assert (cfg.precision, cfg.hash_mode, cfg.mode) == (3, "crc", "simulate")
    assert cfg.use_date_range and cfg.use_part_numbers
    assert AlbumConfig(time_hours=0.25).time_micros == 900_000_000


@pytest.mark.parametrize(
    "options",
    [
        {"time_hours": -1}, {"distance_km": -1}, {"time_hours": 0, "distance_km": 0},
        {"no_photos": True, "no_videos": True}, {"precision": 4}, {"mode": "delete"},
        {"hash_mode": "blake"}, {"date_from": "01/02/2024"}, {"date_format": ""}, {"date_format": "d"},
        {"date_from": "2024-02-01", "date_to": "2024-02-01"},
        {"date_from": "2024-02-02", "now": dt.datetime(2024, 2, 1)},
        {"album_prefix": "   "}, {"album_prefix": "x/<'con'>/"}, {"album_prefix": "a:b", "portable_names": True},
    ],
)
def test_refused(options):
    with pytest.raises(ValueError):
        AlbumConfig(**options)


def test_last_and_hash_names():
    assert AlbumConfig(date_from="LAST").date_from == "last"
    assert [AlbumConfig(hash_mode=t).hash_mode for t in ("CRC64", "md5", "SHA-512")] == ["crc", "md5", "sha"]


def test_patterns():
    assert net_pattern_pieces("dd 'of' MMM\\d") == [
        ("date", "dd"), ("text", " of "), ("date", "MMM"), ("text", "d"),
    ]
    assert net_pattern_pieces("YYYY") == [("text", "YYYY")]
    assert net_pattern_pieces("dddd tt") == [("date", "EEEE"), ("text", " "), ("date", "a")]
    assert split_template("<yyyy>/<MM>_") == [[("date", "yyyy")], [("date", "MM"), ("text", "_")]]
    assert split_template("a<yyyy") == [[("text", "a"), ("text", "<"), ("text", "yyyy")]]
