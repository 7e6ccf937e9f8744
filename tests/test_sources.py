import datetime as dt
import hashlib
import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoalbums import AlbumConfig
from geoalbums.functions.hashing import Crc64Part, chunked_digest, crc64_hex, crc64_of_parts
from geoalbums.operators.content import digest_candidates, duplicate_files, duplicate_groups
from geoalbums.operators.filters import date_window, late_items
from geoalbums.sources.gazetteer import parse_lines
from geoalbums.sources.listing import _ENTRY, _complete
from geoalbums.sources.media_files import (
    distinct_paths, existing_files, existing_folders, failed_files, list_files, list_tree, scan_counts, scan_media,
    skipped_roots, with_content, with_file_digest,
)
from geoalbums.sources.stores import store_of
from geoalbums.sources import state
from geoalbums.sources.shared import materialize, path_exists, scratch
from geoalbums.sources.state import compact_marks, merge_marks, read_marks, save_marks
from geoalbums.sources.tags import tag_dates, tag_locations


def tree(root, files):
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(data)


def test_listing_holds_one_page_at_a_time():
    """Of a batch of many pages only one is ever there as objects."""
    pages, size = 200, 1000
    entries = pa.array([{"name": f"folder-{i}", "folder": True} for i in range(size)], _ENTRY)
    entries = pa.ListArray.from_arrays(pa.array(range(0, pages * size + 1, size), pa.int32()), pa.concat_arrays([entries] * pages))
    batch = pa.RecordBatch.from_arrays([pa.array(["/r"] * pages), pa.nulls(pages, pa.string()), entries], names=["parent", "error", "entries"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in _complete(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == pages * size and peak < 10e6


def test_scan(spark, tmp_path):
    root = str(tmp_path)
    tree(root, {"a.JPG": b"1", "b.txt": b"22", "sub/c.mp4": b"333", "sub/deep/d.heic": b"4444"})
    names = lambda frame: sorted(os.path.basename(r.file_name) for r in frame.collect())
    assert names(scan_media(spark, [root])) == ["a.JPG"]
    assert names(scan_media(spark, [root, f"{root}/sub", f"{root}/nowhere"], recursive=True)) == ["a.JPG", "c.mp4", "d.heic"]
    assert names(scan_media(spark, [root], recursive=True, no_photos=True)) == ["c.mp4"]
    assert scan_media(spark, [f"{root}/nowhere"]).count() == 0
    assert [tuple(r) for r in skipped_roots(spark, [root, f"{root}/nowhere"]).collect()] == [(f"{root}/nowhere", "not found")]
    twice = list_files(spark, [root, f"{root}/sub"], recursive=True)
    counts = scan_counts(twice).first()
    assert (counts.files, counts.duplicates, counts.total_bytes) == (4, 2, 10)
    assert distinct_paths(twice).count() == 4
    plan = scan_media(spark, [root], recursive=True)._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan


def test_existing(spark, tmp_path):
    tree(str(tmp_path), {"x/a.jpg": b"1", "x/y/b.jpg": b"22", "top.jpg": b"3"})
    files = existing_files(spark, f"file:{tmp_path}")
    assert {(r.folder, r.name, r.length) for r in files.collect()} == {("x", "a.jpg", 1), ("x/y", "b.jpg", 2), ("", "top.jpg", 1)}
    assert sorted(r.folder for r in existing_folders(files).collect()) == ["x", "x/y"]


def test_duplicates(spark, tmp_path):
    head = b"h" * 70000
    tree(str(tmp_path), {
        "a": head + b"1", "b": head + b"2", "c": b"same", "d": b"same", "e": b"lone"[:3], "f": b"diff", "g": head + b"1",
        "huge": head * 3,
    })
    files = list_files(spark, [str(tmp_path)]).select("path", "length")
    contents = with_content(list_files(spark, [str(tmp_path)]))
    name = F.regexp_extract("first_path", r"([^/]*)$", 1)
    for mode in ("crc", "md5", "sha"):
        for cfg in (AlbumConfig(hash_mode=mode), AlbumConfig(hash_mode=mode, broadcast_rows=0, hot_rows=0)):
            for listed in (files, contents):
                digests = digest_candidates(listed, cfg)
                assert digests.count() == 6
                groups = duplicate_groups(digests).select(name.alias("n"), "files").collect()
                assert {r.n: r.files for r in groups} == {"a": 2, "c": 2}
                assert duplicate_files(digests, cfg).count() == 4


def test_lone_lengths_are_not_read(spark, tmp_path):
    """A file of a length of its own may be unreadable: nobody asks."""
    tree(str(tmp_path), {"a": b"1", "b": b"1"})
    lone = spark.createDataFrame([("nowhere://store/huge", 5000)], "path string, length long")
    listed = list_files(spark, [str(tmp_path)]).select("path", "length").unionByName(lone)
    assert digest_candidates(listed, AlbumConfig(hash_mode="md5")).count() == 2


def test_listing_is_made_by_the_executors(spark, tmp_path):
    root = tmp_path / "root"
    names = [f"d{i}/e{j}/f{k}.jpg" for i in range(3) for j in range(2) for k in range(5)]
    names += [f"flat/{k}.mp4" for k in range(2500)] + [".hidden/_x.jpg", "a b%20c/ü.heic", "top.jpg"]
    tree(str(root), {name: name.encode() for name in names})
    (root / "empty").mkdir()
    os.symlink(root, root / "d0" / "back")  # a folder that leads back is not followed
    os.symlink(root / "top.jpg", root / "d0" / "link.jpg")
    os.symlink(root / "nothing", root / "d1" / "broken.jpg")
    with open(os.fsencode(str(root)) + b"/bad\xff.jpg", "wb") as out:
        out.write(b"1")
    listed = list_tree(spark, [str(root), f"{tmp_path}/nowhere", "nowhere://store/x", f"{root}/top.jpg"], recursive=True, page=100)
    rows = listed.collect()
    good = {r.path.removeprefix(f"file:{root}/"): r.length for r in rows if r.error is None}
    assert good == {name: len(name.encode()) for name in names} | {"d0/link.jpg": len("top.jpg")}
    assert all(r.modified_at is not None for r in rows if r.error is None)
    failed = {r.path: r.reason for r in failed_files(listed).collect()}
    assert failed.pop("nowhere://store/x").startswith("cannot be read")
    bad = failed.pop(f"file:{root}")
    assert bad.startswith("a name is not UTF-8")
    assert failed == {
        f"file:{tmp_path}/nowhere": "not found", f"file:{root}/top.jpg": "not a folder", f"file:{root}/d1/broken.jpg": "not found",
    }
    # what is planned is tables of folders and files, no index of them
    plan = list_tree(spark, [str(root)], recursive=True)._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "LocalTableScan" not in plan.split("Physical Plan")[1]
    flat = list_tree(spark, [str(root)])
    assert {os.path.basename(r.path) for r in flat.where("error IS NULL").collect()} == {"top.jpg"}


def test_quarantine(spark, tmp_path):
    tree(str(tmp_path), {"a.jpg": b"1", "b.jpg": b"2"})
    (tmp_path / "folder.jpg").mkdir()
    files = spark.createDataFrame(
        [(f"{tmp_path}/{name}", "old") for name in ("a.jpg", "b.jpg", "gone.jpg", "folder.jpg")] + [("nowhere://s/x", None)],
        "file_name string, error string",
    )
    digests = with_file_digest(files, "md5", quarantine=True)
    assert {os.path.basename(r.file_name) for r in digests.where("digest IS NOT NULL AND error IS NULL").collect()} == {"a.jpg", "b.jpg"}
    failed = {os.path.basename(r.path): r.reason for r in failed_files(digests).collect()}
    assert failed["gone.jpg"] == "not found" and failed["x"].startswith("cannot be read") and len(failed) == 3


def test_file_digest(spark, tmp_path):
    head = b"h" * 70000
    tree(str(tmp_path), {"a.jpg": head + b"1", "b.jpg": head + b"2", "c.jpg": b"123456789"})
    files = scan_media(spark, [str(tmp_path)]).select("file_name")
    gone = spark.createDataFrame([(f"{tmp_path}/gone.jpg",)], "file_name string")
    for mode in ("crc", "md5", "sha"):
        rows = with_file_digest(files.unionByName(gone), mode).collect()
        digests = {os.path.basename(r.file_name): r.digest for r in rows}
        assert digests["a.jpg"] != digests["b.jpg"] and digests["gone.jpg"] is None
    assert {os.path.basename(r.file_name): r.digest for r in with_file_digest(files, "crc").collect()}["c.jpg"] == "995DC9BBDF1939FA"
    heads = {os.path.basename(r.file_name): r.digest for r in with_file_digest(files, "crc", prefix=True).collect()}
    assert heads["a.jpg"] == heads["b.jpg"]


def test_unreadable_files_are_errors(spark, tmp_path):
    """Without quarantine, only a file that is gone has no digest."""
    (tmp_path / "folder.jpg").mkdir()
    files = spark.createDataFrame([(f"{tmp_path}/folder.jpg", 5), (f"{tmp_path}/folder.jpg", 5)], "path string, length long")
    with pytest.raises(Exception):
        duplicate_groups(digest_candidates(files, AlbumConfig(hash_mode="md5"))).collect()


def test_stores_of_paths():
    assert store_of("s3a://bucket/a b/c%20.jpg") == ("s3://bucket/", "a b/c%20.jpg")
    assert store_of("wasbs://box@acc.blob.core.windows.net/x/y") == ("abfss://box@acc.dfs.core.windows.net/", "x/y")
    assert store_of("dbfs:/mnt/a.jpg") == ("", "/dbfs/mnt/a.jpg")
    assert store_of("hdfs://node:8020/a/b") == ("hdfs://node:8020/", "a/b")
    assert store_of("file:/tmp/a.jpg") == store_of("file:///tmp/a.jpg") == store_of("/tmp/a.jpg") == ("", "/tmp/a.jpg")
    assert store_of("/tmp/10:30.jpg") == ("", "/tmp/10:30.jpg")


def test_chunks_add_up():
    data = bytes(range(256)) * 37
    for mode, whole in (("crc", crc64_hex([data])[0]), ("md5", hashlib.md5(data).hexdigest())):
        digest = chunked_digest(mode)
        for at in range(0, len(data), 1000):
            digest.update(data[at : at + 1000])
        assert digest.hexdigest() == whole


def test_parts_add_up():
    data = os.urandom(5003)
    for cuts in ([], [1], [17, 4096], [1024, 2048, 3072], [0, 5003]):
        bounds = [0, *cuts, len(data)]
        parts = []
        for low, high in zip(bounds, bounds[1:]):
            part = Crc64Part()
            part.update(data[low:high])
            parts.append((high - low, part.state))
        assert crc64_of_parts(parts) == crc64_hex([data])[0]


def test_long_files_in_ranges(spark, tmp_path):
    data = {f"f{i}.jpg": os.urandom(size) for i, size in enumerate([0, 1, 999, 1000, 1001, 25_000])}
    tree(str(tmp_path), data)
    files = list_files(spark, [str(tmp_path)]).select("path", "length")
    files = files.unionByName(files.where("length = 25000"))
    rows = with_file_digest(files, "crc", "path", length_col="length", range_bytes=1000).collect()
    assert len(rows) == 7
    assert {os.path.basename(r.path): r.digest for r in rows} == {name: crc64_hex([blob])[0] for name, blob in data.items()}
    wrong = spark.createDataFrame([(f"{tmp_path}/f5.jpg", 24_000), (f"{tmp_path}/gone.jpg", 5000)], "path string, length long")
    bad = with_file_digest(wrong, "crc", "path", quarantine=True, length_col="length", range_bytes=1000)
    failed = {os.path.basename(r.path): r.reason for r in failed_files(bad).collect()}
    assert failed == {"f5.jpg": "cannot be read: not of the length it was listed with", "gone.jpg": "not found"}
    with pytest.raises(Exception):
        with_file_digest(wrong, "crc", "path", length_col="length", range_bytes=1000).collect()


def test_dump_lines(spark):
    good = ["7", 'The "Inn"', "", "", " 1.5", "-2e1", "P", "PPL", "XX", "", "01", "", "", "", "n/a", "", "", "", ""]
    change = lambda **at: "\t".join(at.get(f"f{i}", v) for i, v in enumerate(good))
    lines = [
        change(), "", "  \t ", "# x" + change(), "\t".join(good[:10]), change(f4="abc"), change(f5="1.0d"),
        change(f0="8", f14="12"), change(f0="9", f14="3000000000"), "\t".join(good[:16]),
    ]
    rows = parse_lines(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [(r.geonameid, r.population) for r in rows] == [(7, 0), (8, 12), (9, 0), (7, 0)]
    assert (rows[0].name, rows[0].latitude, rows[0].longitude, rows[0].admin1) == ('The "Inn"', 1.5, -20.0, "01")


def test_tags(spark):
    tags = [
        ("a", 1, "ExifSubIFD", 1, "DateTimeOriginal", "bad"), ("a", 1, "ExifSubIFD", 2, "DateTime", "2024:01:02 03:04:05"),
        ("b", 1, "ExifSubIFD", 1, "Other", "x"), ("b", 2, "ExifSubIFD", 1, "DateTimeOriginal", "2020:01:01 00:00:00"),
        ("b", 3, "QuickTimeMovieHeader", 1, "Created", "2024:02:02 00:00:00"),
        ("a", 3, "GPS", 1, "Latitude", "99"), ("a", 3, "GPS", 2, "Longitude", "5"),
        ("a", 4, "V", 1, "Out", "+95.0+010.0"), ("a", 4, "V", 2, "In", "+45.0+010.0"), ("a", 5, "V", 1, "Later", "+1.0+1.0"),
        ("b", 4, "XMP", 1, "GPSLatitude", "10,30N"), ("b", 4, "XMP", 2, "GPSLongitude", "20,30W"),
        ("b", 4, "XMP", 3, "GPSPosition", "1 N, 2 E"),
    ]
    frame = spark.createDataFrame(tags, "file_name string, dir_ord int, directory string, tag_ord int, tag string, value string")
    early, late = dt.datetime(2023, 5, 5), dt.datetime(2023, 6, 6)
    files = spark.createDataFrame([(f, late, early) for f in "abc"], "file_name string, created_at timestamp_ntz, modified_at timestamp_ntz")
    dated = {r.file_name: r.date_created for r in tag_dates(frame, files).collect()}
    assert dated == {"a": dt.datetime(2024, 1, 2, 3, 4, 5), "b": dt.datetime(2024, 2, 2), "c": early}
    located = {r.file_name: (r.latitude, r.longitude) for r in tag_locations(frame, files).collect()}
    assert located == {"a": (45.0, 10.0), "b": (10.5, -20.5), "c": (0.0, 0.0)}


def test_scratch(spark):
    held = lambda frame: path_exists(spark, frame.inputFiles()[0])
    with scratch(spark):
        outer = materialize(spark.range(3), "outer")
        with scratch(spark):
            inner = materialize(spark.range(3), "inner")
            result = materialize(inner.where("id > 0"), "result", outlives=True)
            assert held(inner)
        with pytest.raises(Exception):
            inner.collect()
        assert result.count() == 2 and outer.count() == 3
        last = materialize(result, "last", outlives=True)
    with pytest.raises(Exception):
        result.collect()
    assert last.count() == 2


def test_marks_compacted(spark, tmp_path, monkeypatch):
    path, cfg = str(tmp_path / "marks"), AlbumConfig(library_cols=("library",), mode="copy")
    day = lambda d: dt.datetime(2024, 1, d)
    compact_marks(spark, path, ("library",))
    for d in range(1, 6):
        rows = [(1, day(d)), (2, day(6 - d))]
        save_marks(spark.createDataFrame(rows, "library int, date_created timestamp_ntz"), path, cfg)
    files = lambda: [f for f in os.listdir(path) if f.endswith(".parquet")]
    held = lambda: {r.library: r.last_processed for r in read_marks(spark, path, ("library",)).collect()}
    before = len(files())
    assert before > 1
    with monkeypatch.context() as patch:  # stopped before the old files go
        patch.setattr(state, "remove_files", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            compact_marks(spark, path, ("library",))
    assert len(files()) > before and held() == {1: day(5), 2: day(5)}
    compact_marks(spark, path, ("library",))
    assert len(files()) == 1 and held() == {1: day(5), 2: day(5)}


def test_marks(spark, tmp_path):
    path = str(tmp_path / "marks")
    day = lambda d: dt.datetime(2024, 1, d)
    media = spark.createDataFrame([(1, day(3)), (1, day(5)), (2, day(4))], "library int, date_created timestamp_ntz")
    cfg = AlbumConfig(library_cols=("library",), mode="move")
    assert read_marks(spark, path, ("library",)) is None
    save_marks(media, path, cfg)
    save_marks(media.where("library = 1").withColumn("date_created", F.lit("2024-01-01").cast("timestamp_ntz")), path, cfg)
    marks = read_marks(spark, path, ("library",))
    assert {r.library: r.last_processed for r in marks.collect()} == {1: day(5), 2: day(4)}
    assert {r.library: r.last_processed for r in merge_marks(media, marks, ("library",)).collect()} == {1: day(5), 2: day(4)}
    # inclusive at the mark; a library without mark is not limited
    more = spark.createDataFrame([(1, day(4)), (1, day(5)), (3, day(1))], "library int, date_created timestamp_ntz")
    resumed = AlbumConfig(library_cols=("library",), date_from="last")
    assert sorted((r.library, r.date_created) for r in date_window(more, resumed, marks).collect()) == [(1, day(5)), (3, day(1))]
    assert [(r.library, r.date_created) for r in late_items(more, resumed, marks).collect()] == [(1, day(4))]
    # one library for all
    whole = AlbumConfig(date_from="last")
    assert date_window(more, whole, marks).count() == 1
    assert date_window(more, whole, None).count() == 3
