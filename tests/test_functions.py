import binascii
import datetime as dt

import pytest
from pyspark.sql import functions as F

from geoalbums.functions import dates, text
from geoalbums.functions.hashing import content_digest, crc64_hex
from geoalbums.functions.latlon import with_latlon
from geoalbums.operators.filters import is_media

LATLON = [
    ("+48.8577+002.2950/", (48.8577, 2.295)),
    ("40.6892 N, 74.0445 W", (40.6892, -74.0445)),
    ("-40.5 S 10 E", (40.5, 10.0)),
    ("40,41.355N, 74,2.67W", (40 + 41.355 / 60, -(74 + 2.67 / 60))),
    ("40 deg 41' 21.30\" N, 74 deg 2' 40.20\" W", (40 + 41 / 60 + 21.3 / 3600, -(74 + 2 / 60 + 40.2 / 3600))),
    ("40°41'21.3\" N 74°2'40.2\" W", (40 + 41 / 60 + 21.3 / 3600, -(74 + 2 / 60 + 40.2 / 3600))),
    ("+99.0+010", (99.0, 10.0)),
    ("2024-05-10T12:00:00", (-5.0, -10.0)),
    ("2024:05:10 12:00:00", None),
    ("10,1N 20,2n 30,3E", (20 + 2 / 60, 30 + 3 / 60)),
    ("10,1N 20,2S", None),
    ("", None),
]


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_latlon(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LATLON)], "i int, t string")
    for row in with_latlon(rows, "t").collect():
        expected = LATLON[row.i][1]
        if expected is None:
            assert row.lat is None and row.lon is None, row.t
        else:
            assert (row.lat, row.lon) == pytest.approx(expected, abs=1e-12), row.t


def test_names(spark):
    dirty = [" a / b ", " x ", "a   b/  c", "/", "plain"]
    assert column(spark, dirty, "string", text.sanitize_name) == ["a b", "x", "a b c", "", "plain"]
    lists = [[], ["A"], ["A", " ", "B"], ["A", "B", "C"], ["A", "B", "C", "D"], ["/"]]
    assert column(spark, lists, "array<string>", text.format_list) == [
        "", "A", "A and B", "A, B, and C", "A, B, C, and D", "",
    ]
    assert column(spark, [0, 1, 1234], "int", lambda n: text.pluralise(n, "file", "files")) == [
        "0 files", "1 file", "1,234 files",
    ]


def test_paths(spark):
    paths = ["/a/b.c/IMG.x.JPG", "/a/noext", ".jpg", "file."]
    assert column(spark, paths, "string", text.extension) == [".JPG", "", ".jpg", ""]
    assert column(spark, paths, "string", text.stem) == ["IMG.x", "noext", "", "file"]
    assert column(spark, ["a.b.jpg", "x"], "string", lambda p: text.numbered_name(p, F.lit(2))) == [
        "a.b (2).jpg", "x (2)",
    ]
    kinds = ["a.JPG", "b.m4v", "c.txt", "jpg", "d.jpeg/x"]
    assert column(spark, kinds, "string", is_media) == [True, True, False, False, False]
    assert column(spark, kinds, "string", lambda p: is_media(p, no_photos=True)) == [False, True, False, False, False]


def test_dates(spark):
    texts = ["2024-03-10", "2024-03-10 02:30", "2024-03-10T02:30:15", "2024-3-1", "2024-02-30", "2024-03-10 02:30:15.5"]
    day = dt.datetime(2024, 3, 10)
    assert column(spark, texts, "string", dates.parse_iso8601_col) == [
        day, dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 2, 30, 15), None, None, None,
    ]
    tags = ["2024:03:10 02:30:15", "2024:03:10", "0000:00:00 00:00:00", "soon"]
    assert column(spark, tags, "string", dates.parse_tag_date) == [dt.datetime(2024, 3, 10, 2, 30, 15), day, None, None]
    # an hour that the session zone skips counts as any other
    gap = column(spark, [dt.datetime(2024, 3, 10, 2, 30)], "timestamp_ntz", dates.micros)
    assert gap == [int(dt.datetime(2024, 3, 10, 2, 30, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000]


def test_templates(spark):
    date = dt.datetime(2025, 4, 5, 13, 7, 9)

    def expand(template):
        return column(spark, [date], "timestamp_ntz", lambda d: dates.expand_template(template, d, F.lit("Paris")))[0]

    assert expand("Trip to ") == "Trip to Paris"
    assert expand("<yyyy>/") == "2025/Paris"
    assert expand("<yyyy>/<MM>_") == "2025/04_Paris"
    assert expand("Year <yyyy>/<MMMM>/") == "Year 2025/April/Paris"
    assert expand("/abs") == "absParis"
    assert expand("<yyyy") == "<yyyyParis"
    form = lambda p: column(spark, [date], "timestamp_ntz", lambda d: dates.net_format(d, p))[0]
    assert form("ddd d.M.y h:mm:ss t") == "Sat 5.4.25 1:07:09 P"


def test_violations(spark):
    paths = ["a/b", "con", "x/Lpt1", " ", "a\x00b"]
    assert column(spark, paths, "string", text.name_violations) == [
        [], ["reserved name"], ["reserved name"], ["blank"], ["invalid characters"],
    ]


def slow_crc64(data):
    value = 2**64 - 1
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = (value >> 1) ^ (0xC96C5795D7870F42 if value & 1 else 0)
    return f"{value ^ (2**64 - 1):016X}"


def test_crc64():
    assert crc64_hex([b"123456789"]) == ["995DC9BBDF1939FA"]
    blobs = [bytes((i * j) % 251 for j in range(i * 7)) for i in range(90)] + [b"", b"x" * 3000, bytes(range(256)) * 300]
    assert crc64_hex(blobs) == [slow_crc64(blob) for blob in blobs]


def test_digests(spark):
    head = b"a" * 65536
    blobs = [bytearray(head + b"x"), bytearray(head + b"y"), bytearray(b"123456789"), None]
    crc = column(spark, blobs, "binary", lambda c: content_digest(c, "crc"))
    assert crc[0] != crc[1] and crc[2] == "995DC9BBDF1939FA" and crc[3] is None
    md5 = column(spark, blobs, "binary", lambda c: content_digest(c, "md5"))
    assert md5[0] != md5[1] and len(binascii.unhexlify(md5[0])) == 16
    assert len(column(spark, blobs, "binary", lambda c: content_digest(c, "sha"))[0]) == 128
