import datetime as dt
import os
import random

import pytest

from geoalbums import AlbumConfig, build_albums
from geoalbums.streaming.albums import AlbumStream
from geoalbums.streaming.sessions import session_albums

START = dt.datetime(2024, 3, 9)


def test_sessions_break_at_the_exact_gap(spark):
    cfg = AlbumConfig(time_hours=2, library_cols=("library",))
    micro = dt.timedelta(microseconds=1)
    times = [START, START + dt.timedelta(hours=2), START + dt.timedelta(hours=4) - micro, START + dt.timedelta(hours=30)]
    media = spark.createDataFrame([(1, t) for t in times], "library int, date_created timestamp_ntz")
    rows = session_albums(media, cfg).orderBy("first_date").collect()
    assert [(r.first_date, r.last_date, r.files) for r in rows] == [
        (times[0], times[0], 1), (times[1], times[2], 2), (times[3], times[3], 1),
    ]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for library in (1, 2):
        at = START
        for number in range(90):
            at += dt.timedelta(minutes=rng.choice([5, 20, 50, 60, 61, 200]))
            placed = rng.random() < 0.5
            rows.append((library, f"/l{library}/{number:03d}.jpg", at, rng.choice([10.0, 10.3]) if placed else 0.0, 20.0 if placed else 0.0))
    schema = "library int, file_name string, date_created timestamp_ntz, latitude double, longitude double"
    media = spark.createDataFrame(rows, schema)
    cfg = AlbumConfig(time_hours=1, library_cols=("library",))
    incoming = str(tmp_path / "in")
    job = AlbumStream(cfg, str(tmp_path / "out"))
    cuts = [START + dt.timedelta(hours=h) for h in (0, 20, 21, 70, 10_000)]
    for start, end in zip(cuts, cuts[1:]):
        part = [r for r in rows if start <= r[2] < end]
        spark.createDataFrame(part, schema).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(media.schema).parquet(incoming)
        job.start(stream, str(tmp_path / "check")).awaitTermination()
    columns = ["library", "file_name", "latitude", "longitude", "album_id", "album_name", "part"]
    streamed = [tuple(r) for r in job.closed_items(spark).select(*columns).collect()]
    batch = [tuple(r) for r in build_albums(media, cfg).items.select(*columns).collect()]
    newest = max(r[2] for r in rows)
    when = {r[1]: r[2] for r in rows}
    ends = {}
    for item in batch:
        key = (item[0], item[4])
        ends[key] = max(ends.get(key, START), when[item[1]])
    closed = [i for i in batch if newest - ends[i[0], i[4]] > dt.timedelta(hours=1)]
    assert len(closed) > 100 and len(streamed) == len(closed)
    assert set(streamed) == set(closed)
    job.close_all(spark)
    job.close_all(spark)  # again: the same rows
    streamed = [tuple(r) for r in job.closed_items(spark).select(*columns).collect()]
    assert len(streamed) == len(batch) and set(streamed) == set(batch)
    assert job.late_items(spark).count() == 0
    # a tail is kept for the batch to come and the one before it
    assert len([f for f in os.listdir(tmp_path / "out" / "tail") if f.startswith("batch=")]) == 2


SCHEMA = "library int, file_name string, date_created timestamp_ntz, latitude double, longitude double"


def portions(spark, tmp_path, job, *parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        job.start(stream, str(tmp_path / "check")).awaitTermination()


def item(library, name, hours):
    return (library, f"{name}.jpg", START + dt.timedelta(hours=hours), 0.0, 0.0)


def test_idle_libraries_close_and_late_items_are_kept(spark, tmp_path):
    job = AlbumStream(AlbumConfig(time_hours=1, library_cols=("library",)), str(tmp_path / "out"))
    portions(
        spark, tmp_path, job,
        [item(1, "a", 0), item(2, "b", 0), item(2, "c", 5)],
        [item(2, "d", 50)],
        [item(1, "too late", -1), item(1, "next", 60), item(2, "e", 60)],
    )
    found = {(r.library, r.file_name[:-4]): r.album_id for r in job.closed_items(spark).collect()}
    assert found == {(1, "a"): 1, (2, "b"): 1, (2, "c"): 2, (2, "d"): 3}
    assert [(r.library, r.file_name[:-4]) for r in job.late_items(spark).collect()] == [(1, "too late")]
    job.close_all(spark)
    found = {(r.library, r.file_name[:-4]): r.album_id for r in job.closed_items(spark).collect()}
    assert found == {(1, "a"): 1, (1, "next"): 2, (2, "b"): 1, (2, "c"): 2, (2, "d"): 3, (2, "e"): 4}


def test_lost_tail_and_foreign_checkpoint(spark, tmp_path):
    cfg = AlbumConfig(time_hours=1, library_cols=("library",))
    job = AlbumStream(cfg, str(tmp_path / "out"))
    portions(spark, tmp_path, job, [item(1, "a", 0)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        job.start(stream, str(tmp_path / "another"))
    with pytest.raises(RuntimeError):
        job.run_batch(spark.createDataFrame([item(1, "z", 9)], SCHEMA), 7)
    with pytest.raises(ValueError):
        AlbumStream(AlbumConfig(avoid_existing=True), "x")
