"""The walk against a direct loop over the items, on random libraries cut into many buckets."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from geoalbums import AlbumConfig
from geoalbums.operators.scan import WHOLE, bucketed, dealt, ranked
from geoalbums.operators.walk import ORDER, walk, with_album_ids

START = dt.datetime(2024, 3, 9)
SCHEMA = (
    "library int, file_name string, date_created timestamp_ntz, latitude double, longitude double, "
    "location_name string"
)


def random_items(rng, libraries=4, size=60):
    rows = []
    for library in range(libraries):
        at, count = 0, size * (6 if library == 0 else 1)
        for number in range(count):
            at += rng.choice([0, 0, 1, 1, 2, 3, 4, 7])
            kind = rng.random()
            lat, lon = (0.0, 0.0) if kind < 0.6 else (0.0, 5.0) if kind < 0.65 else (rng.choice([10.0, 10.001, 10.2]), 20.0)
            name = rng.choice([None, "A", "B"]) if lat or lon else None
            rows.append((library, f"/l{library}/f{number:04d}.jpg", START + dt.timedelta(hours=at), lat, lon, name))
    rng.shuffle(rows)
    return rows


def km(a, b):
    (lat1, lon1), (lat2, lon2) = [tuple(math.radians(x) for x in p) for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def loop(rows, hours, distance):
    """file -> (lat, lon, name, source, rejected, album id), item by item."""
    out, limit = {}, dt.timedelta(hours=hours)
    for library in {r[0] for r in rows}:
        items = [list(r) for r in sorted((r for r in rows if r[0] == library), key=lambda r: (r[2], r[1]))]
        notes = {}
        for i, item in enumerate(items if distance else []):
            if item[3] or item[4]:
                continue
            close = lambda other: (other[3] or other[4]) and abs(other[2] - item[2]) <= limit
            before = next((o for o in reversed(items[:i]) if close(o)), None)
            after = next((o for o in items[i + 1:] if close(o)), None)
            if not before and not after:
                continue
            if before and (not after or item[2] - before[2] <= after[2] - item[2]):
                source, rejected = before, after
            else:
                source, rejected = after, before
            item[3:6] = source[3:6]
            notes[item[1]] = (source[1], rejected[1] if rejected else None)
        album = 1
        for i, item in enumerate(items):
            if i:
                prev = items[i - 1]
                far = distance and all((prev[3], prev[4], item[3], item[4])) and km(prev[3:5], item[3:5]) >= distance
                if far or (hours and item[2] - prev[2] >= limit):
                    album += 1
            out[item[1]] = (item[3], item[4], item[5], *notes.get(item[1], (None, None)), album)
    return out


@pytest.mark.parametrize(
    "seed,hours,distance,buckets", [(1, 3, 10, 9), (2, 1, 10, 40), (3, 4, 0, 7), (4, 0, 10, 25), (5, 2, 10, 150), (6, 7, 1, None)]
)
def test_against_loop(spark, seed, hours, distance, buckets):
    rows = random_items(random.Random(seed))
    cfg = AlbumConfig(time_hours=hours, distance_km=distance, library_cols=("library",), scan_buckets=buckets)
    items = bucketed(spark.createDataFrame(rows, SCHEMA), cfg.library_cols, ORDER, buckets)
    found = {
        r.file_name: (r.latitude, r.longitude, r.location_name, r.source_file, r.rejected_file, r.album_id)
        for r in with_album_ids(walk(items, cfg), cfg).collect()
    }
    assert found == loop(rows, hours, distance)


def test_thresholds_exact(spark):
    """A gap of exactly the threshold breaks, a microsecond less does not; across a clock change."""
    times = [START, START + dt.timedelta(hours=48), START + dt.timedelta(hours=96) - dt.timedelta(microseconds=1)]
    rows = [(0, f"{i}.jpg", t, 0.0, 0.0, None) for i, t in enumerate(times)]
    cfg = AlbumConfig(distance_km=0, library_cols=("library",))
    steps = with_album_ids(walk(bucketed(spark.createDataFrame(rows, SCHEMA), ("library",), ORDER, 3), cfg), cfg)
    assert [r.album_id for r in steps.orderBy("file_name").collect()] == [1, 2, 2]


def test_one_instant_is_split(spark):
    """A library whose items all share one instant still fills many buckets."""
    rows = [(0, f"{i:05d}.jpg", START, 0.0, 0.0, None) for i in range(3000)]
    items = bucketed(spark.createDataFrame(rows, SCHEMA), ("library",), ORDER, 10)
    sizes = [r["count"] for r in items.groupBy("_bucket").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1000


def test_long_ranges_are_cut(spark):
    """However few ranges, buckets and the windows' tasks hold a bounded number of rows; results stay."""
    rows = spark.range(200_000).select(
        F.format_string("%06d.jpg", "id").alias("file_name"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("date_created"),
        F.when(F.col("id") % 50_000 == 0, 10.0).otherwise(0.0).alias("latitude"), F.lit(0.0).alias("longitude"),
        F.lit(None).cast("string").alias("location_name"),
    )
    items = bucketed(rows, (), ORDER, 1)
    sizes = items.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("file_name").alias("a"), F.max("file_name").alias("b"))
    sizes = sizes.orderBy("_bucket").collect()
    assert max(r.n for r in sizes) <= 8192 and all(x.b < y.a for x, y in zip(sizes, sizes[1:]))
    assert dealt(items, [WHOLE]).rdd.getNumPartitions() >= 3
    steps = with_album_ids(walk(items, AlbumConfig(time_hours=1)), AlbumConfig(time_hours=1))
    # every item takes the place of the last positioned one, through all buckets
    assert steps.agg(F.min("latitude"), F.max("latitude"), F.max("album_id"), F.count("source_file")).first()[:] == (10.0, 10.0, 1, 199_996)


def test_null_library_stops(spark):
    rows = [(None, "a.jpg", START, 0.0, 0.0, None)]
    with pytest.raises(Exception, match="library column library is null"):
        bucketed(spark.createDataFrame(rows, SCHEMA), ("library",), ORDER)


def test_empty_and_single(spark):
    cfg = AlbumConfig()
    empty = spark.createDataFrame([], SCHEMA).drop("library")
    assert with_album_ids(walk(bucketed(empty, (), ORDER), cfg), cfg).count() == 0
    one = spark.createDataFrame([(0, "a.jpg", START, 0.0, 0.0, None)], SCHEMA).drop("library")
    assert [r.album_id for r in with_album_ids(walk(bucketed(one, (), ORDER), cfg), cfg).collect()] == [1]


def test_rank_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(500)] + [(f"g{i}", 0) for i in range(20)]
    random.Random(0).shuffle(rows)
    got = ranked(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], 12).collect()
    assert all(r["rank"] == r.v + 1 for r in got) and len(got) == 520


def test_no_single_task_over_items(spark):
    rows = random_items(random.Random(8))
    frame = spark.createDataFrame(rows, SCHEMA).drop("library")
    for cfg in (AlbumConfig(time_hours=3), AlbumConfig(time_hours=3, distance_km=0)):
        walked = walk(bucketed(frame, (), ORDER, 6), cfg)
        plan = walked._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan
