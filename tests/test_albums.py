"""Names, parts and whole runs."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from geoalbums import AlbumConfig, build_albums
from geoalbums.operators.albums import avoid_existing, part_numbers, top_places, with_part_suffix
from geoalbums.plans.outputs import publish_run, read_published, write_run
from geoalbums.plans.report import album_catalog, album_preview, file_preview, run_totals
from geoalbums.sources.media_files import existing_files, scan_media, with_file_digest
from geoalbums.sources.state import read_marks
from geoalbums.sources.tags import media_from_tags
from workload import fixtures as fx

SF = "/root/testdata/sf0.01"
GOLDEN = [  # hours, km, imputed, albums, time breaks, distance breaks, highest part
    (0.25, 10, 3351, 1119, 364, 810, 43),
    (0.25, 0, 0, 365, 364, 0, 19),
    (0, 10, 0, 431, 0, 430, 17),
]


@pytest.mark.parametrize("hours,km,imputed,albums,by_time,by_distance,part", GOLDEN)
def test_golden_counts(spark, hours, km, imputed, albums, by_time, by_distance, part):
    media = fx.derived(spark, SF, fx.MEDIA, "events")
    run = build_albums(media, AlbumConfig(time_hours=hours, distance_km=km, scan_buckets=11))
    items = run.items
    assert items.count() == 9000
    assert run.imputations.count() == imputed
    assert run.albums.count() == albums
    assert items.where("time_break").count() == by_time
    assert items.where("distance_break").count() == by_distance
    assert run.albums.agg({"part": "max"}).first()[0] == part
    assert run.breaks.count() == albums - 1


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_against_loop(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for library in range(3):
        last, part, bucket = None, 0, 0
        for album in range(1, 80 if library == 0 else 6):
            bucket += rng.choice([0, 0, 0, 1, 3])
            name = rng.choice(["A", "B"]) if library else rng.choice(["A"] * 9 + ["B"])
            part = part + 1 if name == last else 1
            last = name
            rows.append((library, album, name, bucket))
            expected[library, album] = (part, name if part == 1 else f"{name} (part {part})")
    cfg = AlbumConfig(library_cols=("library",))
    frame = spark.createDataFrame(rows, "library int, album_id bigint, album_name string, _bucket int")
    got = with_part_suffix(part_numbers(frame, cfg)).collect()
    assert {(r.library, r.album_id): (r.part, r.album_name) for r in got} == expected


def test_free_names(spark):
    names = ["free", "taken", "gap", "odd", "deep/er"]
    folders = ["taken", "gap", "gap (1)", "gap (3)", "odd", "odd (01)", "odd (0)", "free (1)", "deep/er", "deep/er (1)"]
    named = spark.createDataFrame([(1, n, i) for i, n in enumerate(names)], "library int, album_name string, album_id int")
    there = spark.createDataFrame([(f,) for f in folders], "folder string")
    for cfg in (AlbumConfig(library_cols=("library",)), AlbumConfig(library_cols=("library",), broadcast_rows=0, hot_rows=0)):
        got = [r.album_name for r in avoid_existing(named, there, cfg).orderBy("album_id").collect()]
        assert got == ["free", "taken (1)", "gap (2)", "odd (1)", "deep/er (2)"]


def test_top_places(spark):
    albums = {
        1: ["x", "b", "b", "c", "a", "a", "d", "e"],  # b a, then x c before d e
        2: [" ", "", None],
        3: ["q ", " q", "r"],
    }
    rows, position = [], 0
    for album, seen in albums.items():
        for name in seen:
            rows.append((0, album, position, name))
            position += 1
    frame = spark.createDataFrame(rows, "_library int, album_id bigint, _position bigint, location_name string")
    got = {r.album_id: r.places for r in top_places(frame, AlbumConfig()).collect()}
    assert got == {1: ["x", "b", "c", "a"], 3: ["q", "r"]}


MEDIA = "library int, file_name string, date_created timestamp_ntz, latitude double, longitude double, length bigint, digest string"
PLACES = "geonameid bigint, name string, latitude double, longitude double, feature_class string, feature_code string"


def small(spark):
    day = dt.datetime(2024, 7, 1, 12)
    rows = [
        (1, "/p/a.jpg", day, 10.0, 20.0, 5, "p"),
        (1, "/p/b.JPG", day + dt.timedelta(hours=1), 0.0, 0.0, 5, "q"),
        (1, "/p/notes.txt", day + dt.timedelta(hours=1), 10.0, 20.0, 5, "q"),
        (1, "/q/a.jpg", day + dt.timedelta(hours=2), 10.0, 20.0, 5, "p"),
        (1, "/p/c.mp4", day + dt.timedelta(days=5), 10.5, 20.0, 5, "r"),
        (1, "/p/d.mp4", day + dt.timedelta(days=9), 10.5, 20.0, 5, "r"),
        (2, "/z/e.heic", day, None, None, 5, "r"),
    ]
    places = [(1, "Ham / let", 10.01, 20.01, "P", "PPL"), (2, "  ", 10.5, 20.0, "P", "PPL")]
    return spark.createDataFrame(rows, MEDIA), spark.createDataFrame(places, PLACES)


def test_run_with_places(spark):
    media, places = small(spark)
    cfg = AlbumConfig(library_cols=("library",), append_format="MMM yyyy", album_prefix="<yyyy>/")
    run = build_albums(media, cfg, places)
    names = {r.file_name: (r.location_name, r.album_id, r.album_name, r.part) for r in run.items.collect()}
    hamlet, unknown = "2024/Ham let (Jul 2024)", "2024/Unknown Location (Jul 2024)"
    assert names == {
        "/p/a.jpg": ("Ham / let", 1, hamlet, 1),
        "/p/b.JPG": ("Ham / let", 1, hamlet, 1),
        "/q/a.jpg": ("Ham / let", 1, hamlet, 1),
        "/p/c.mp4": ("  ", 2, unknown, 1),
        "/p/d.mp4": ("  ", 3, f"{unknown} (part 2)", 2),
        "/z/e.heic": (None, 1, "2024/01 Jul 2024", 1),
    }
    assert (run.places_total, run.places_kept) == (2, 2)
    reasons = [r.reason for r in run.breaks.orderBy("file_name").collect()]
    assert reasons == ["time (118.00 hrs) and distance (55.60 km)", "time (96.00 hrs)"]
    assert [r.files for r in run_totals(run.albums, cfg).collect()] == [6]
    assert file_preview(run.items, cfg).count() == 6
    assert [r.files_text for r in album_preview(run.albums, cfg).collect()] == ["3 files", "1 file", "1 file", "1 file"]


def test_append_needs_places(spark):
    with pytest.raises(ValueError):
        build_albums(small(spark)[0], AlbumConfig(append_format="yyyy", library_cols=("library",)))


def test_outputs_and_mark(spark, tmp_path):
    media, _ = small(spark)
    folder, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    simulated = AlbumConfig(library_cols=("library",))
    write_run(build_albums(media, simulated), simulated, folder, state_path=marks)
    assert read_marks(spark, marks, ("library",)) is None and not (tmp_path / "out").exists()

    cfg = AlbumConfig(library_cols=("library",), mode="copy")
    write_run(build_albums(media, cfg), cfg, folder, state_path=marks, destination="/albums/")
    manifest = spark.read.parquet(f"{folder}/manifest").where("library = 1")
    assert {(r.file_name, r.target_path, r.action) for r in manifest.collect()} == {
        ("/p/a.jpg", "1/01 Jul 2024/a.jpg", "PLACE"),
        ("/p/b.JPG", "1/01 Jul 2024/b.JPG", "PLACE"),
        ("/q/a.jpg", "1/01 Jul 2024/a.jpg", "SKIP_IDENTICAL"),
        ("/p/c.mp4", "1/06 Jul 2024/c.mp4", "PLACE"),
        ("/p/d.mp4", "1/10 Jul 2024/d.mp4", "PLACE"),
    }
    catalog = {r.album_path: (r.files, r.album_date) for r in spark.read.parquet(f"{folder}/catalog").where("library = 1").collect()}
    assert catalog["/albums/1/01 Jul 2024"] == (3, dt.datetime(2024, 7, 1, 12))
    saved = {r.library: r.last_processed for r in read_marks(spark, marks, ("library",)).collect()}
    assert saved == {1: dt.datetime(2024, 7, 10, 12), 2: dt.datetime(2024, 7, 1, 12)}

    # resumed: the last item of each library comes back, nothing older does
    again = AlbumConfig(library_cols=("library",), mode="copy", date_from="last")
    resumed = build_albums(media, again, state=read_marks(spark, marks, ("library",)))
    assert sorted(r.file_name for r in resumed.items.collect()) == ["/p/d.mp4", "/z/e.heic"]


def test_files_end_to_end(spark, tmp_path):
    """Files on disk, tags beside them, a destination that holds one of them already."""
    for name, data in {"in/a.jpg": b"one", "in/sub/a.jpg": b"two", "in/sub/b.jpg": b"tri", "out/05 May 2024/a.jpg": b"two"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    files = scan_media(spark, [f"{tmp_path}/in"], recursive=True)
    tags = files.select(
        "file_name", F.lit(1).alias("dir_ord"), F.lit("ExifSubIFD").alias("directory"), F.lit(1).alias("tag_ord"),
        F.lit("DateTimeOriginal").alias("tag"), F.lit("2024:05:05 10:00:00").alias("value"),
    )
    cfg = AlbumConfig(mode="copy")
    media = media_from_tags(tags, files.withColumn("modified_at", F.lit("2024-06-01").cast("timestamp_ntz")), cfg)
    run = build_albums(media, cfg)
    existing = with_file_digest(existing_files(spark, f"file:{tmp_path}/out"), "crc")
    write_run(run, cfg, f"{tmp_path}/result", existing, f"{tmp_path}/marks", "/out", lambda files: with_file_digest(files, "crc"))
    manifest = spark.read.parquet(f"{tmp_path}/result/manifest").collect()
    short = {r.file_name.split("/in/")[1]: (r.target_path, r.action) for r in manifest}
    assert short == {
        "a.jpg": ("05 May 2024/a (1).jpg", "PLACE"),
        "sub/a.jpg": ("05 May 2024/a.jpg", "SKIP_IDENTICAL"),
        "sub/b.jpg": ("05 May 2024/b.jpg", "PLACE"),
    }
    assert read_marks(spark, f"{tmp_path}/marks").first().last_processed == dt.datetime(2024, 5, 5, 10)


def test_published_at_once(spark, tmp_path, monkeypatch):
    """A run that is stopped anywhere leaves no trace in what is read."""
    media, _ = small(spark)
    cfg, folder, marks = AlbumConfig(library_cols=("library",), mode="copy"), f"{tmp_path}/out", f"{tmp_path}/marks"
    run = build_albums(media.withColumns({"length": F.lit(1), "digest": F.lit("d")}), cfg)
    assert read_published(spark, folder) is None
    fail = F.raise_error(F.lit("a task that dies")).cast("string")
    broken = dataclasses.replace(run, items=run.items.withColumn("digest", F.when(F.col("file_name") == "/q/a.jpg", fail).otherwise("d")))
    with pytest.raises(Exception):
        publish_run(broken, cfg, folder, None, marks)
    assert read_published(spark, folder) is None and read_marks(spark, marks, ("library",)) is None
    publish_run(run, cfg, folder, None, marks)
    first = read_published(spark, folder)
    assert first.number == 1 and first.manifest.count() == run.items.count() and first.catalog.count() == album_catalog(run.albums, cfg).count()
    assert read_marks(spark, marks, ("library",)).count() == 2
    with pytest.raises(Exception):
        publish_run(broken, cfg, folder, None, marks)
    assert read_published(spark, folder).number == 1
    publish_run(run, cfg, folder, None, marks)
    assert read_published(spark, folder).number == 2


def test_options(spark):
    media, _ = small(spark)
    base = {"library_cols": ("library",)}
    only = lambda **kw: sorted(r.file_name for r in build_albums(media, AlbumConfig(**base, **kw)).items.collect())
    assert only(no_videos=True) == ["/p/a.jpg", "/p/b.JPG", "/q/a.jpg", "/z/e.heic"]
    assert only(no_photos=True) == ["/p/c.mp4", "/p/d.mp4"]
    assert only(date_from="2024-07-01 13:00", date_to="2024-07-06 12:00") == ["/p/b.JPG", "/q/a.jpg"]
    assert only(exclude_recent=True, now=dt.datetime(2024, 7, 8)) == ["/p/a.jpg", "/p/b.JPG", "/q/a.jpg", "/z/e.heic"]
    wide = build_albums(media, AlbumConfig(time_hours=24 * 30, distance_km=1000, date_format="yyyy-MM-dd", **base))
    assert {r.album_name for r in wide.albums.collect()} == {"2024-07-01 - 2024-07-10", "2024-07-01"}
    plain = build_albums(media, AlbumConfig(time_hours=24 * 30, distance_km=1000, use_date_range=False, **base))
    assert {r.album_name for r in plain.albums.collect()} == {"01 Jul 2024"}
    catalog = album_catalog(plain.albums, AlbumConfig(**base))
    assert catalog.count() == 2
