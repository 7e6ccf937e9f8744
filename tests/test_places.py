"""Place lookups against brute force, on every physical path."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoalbums import AlbumConfig
from geoalbums.operators import places as ops

TIERS = [("S", 0.001), ("L", 0.01), ("P", 0.1), ("H", 1.0), ("A", 1.0), ("P", 1.0)]
CODES = {"S": "CSTL", "L": "PRK", "P": "PPL", "H": "SEA", "A": "ADM3"}
SCHEMA = (
    "geonameid bigint, name string, latitude double, longitude double, feature_class string, feature_code string"
)


def world(seed, places=400, points=300):
    rng = random.Random(seed)
    spot = lambda: (round(10 + rng.choice([0, 0.5, 2]) + rng.gauss(0, 0.05), 4), round(-20 + rng.gauss(0, 0.05), 4))
    gazetteer = []
    for number in range(places):
        kind = rng.choice("SLPHA")
        lat, lon = spot() if kind in "SLP" else (10 + rng.uniform(-2, 4), -20 + rng.uniform(-2, 2))
        gazetteer.append((number, f"{kind}{number}", lat, lon, kind, CODES[kind]))
    where = []
    for _ in range(points):
        near = rng.choice(gazetteer)
        size = rng.choice([0.0005, 0.005, 0.05, 0.9])
        where.append((near[2] + rng.uniform(-size, size), near[3] + rng.uniform(-size, size)))
    where += [(gazetteer[0][2] + 0.001, gazetteer[0][3]), (50.0, 50.0)]
    return gazetteer, sorted(set(where))


def km(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    h = math.sin(a) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(b) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def brute(gazetteer, lat, lon, precision):
    for number, (kind, r) in enumerate(TIERS, start=1):
        if kind == "S" and precision < 3:
            continue
        hits = [
            (round(km(lat, lon, p[2], p[3]), 9), p[0]) for p in gazetteer
            if p[4] == kind and lat - r <= p[2] <= lat + r and lon - r <= p[3] <= lon + r
        ]
        if hits:
            return number, min(hits)[1]
    return None, None


@pytest.mark.parametrize(
    "broadcast_rows,hot_rows,array_places", [(500_000, 1_000_000, 1024), (0, 10, 1024), (500_000, 10, 5), (0, 7, 6)]
)
def test_nearest(spark, monkeypatch, broadcast_rows, hot_rows, array_places):
    monkeypatch.setattr(ops, "CELL_ARRAY_PLACES", array_places)
    gazetteer, where = world(broadcast_rows + hot_rows + array_places)
    cfg = AlbumConfig(broadcast_rows=broadcast_rows, hot_rows=hot_rows)
    found = ops.nearest_places(
        spark.createDataFrame(where, "latitude double, longitude double"),
        spark.createDataFrame(gazetteer, SCHEMA), cfg,
    ).collect()
    assert len(found) == len(where)
    for row in found:
        assert (row.tier, row.geonameid) == brute(gazetteer, row.latitude, row.longitude, 3)


def test_box_join(spark):
    gazetteer, where = world(11, places=200, points=100)
    points = spark.createDataFrame(where, "latitude double, longitude double")
    places = spark.createDataFrame(gazetteer, SCHEMA)
    expected = {
        (lat, lon, p[0]) for lat, lon in where for p in gazetteer
        if lat - 0.1 <= p[2] <= lat + 0.1 and lon - 0.1 <= p[3] <= lon + 0.1
    }
    for cfg in (AlbumConfig(), AlbumConfig(broadcast_rows=0, hot_rows=5)):
        rows = ops.box_join(points, places, 0.1, cfg).collect()
        assert len(rows) == len(expected)
        assert {(r.latitude, r.longitude, r.place_geonameid) for r in rows} == expected


def test_crowded_cell_is_tiled(spark):
    """Points at one spot and places at another of the same cell: no tile beyond its bound."""
    points = spark.createDataFrame([(10.001, 20.001, i % 2) for i in range(300)], "latitude double, longitude double, n int")
    places = spark.createDataFrame([(i, str(i), 10.002, 20.002 + (i % 3) * 0.2, "P", "PPL") for i in range(300)], SCHEMA)
    seen = places.select(*[F.col(c).alias(f"place_{c}") for c in places.columns]).withColumns({"_cx": F.lit(1), "_cy": F.lit(2)})
    cfg = AlbumConfig(broadcast_rows=0, hot_rows=40)
    tiles = ops._tiled_cell_join(points.withColumns({"_cx": F.lit(1), "_cy": F.lit(2)}), seen, cfg)
    assert tiles.count() == 300 * 300
    keys = tiles.groupBy("_row", "_column").count().collect()
    assert len(keys) == 64 and max(k["count"] for k in keys) < 4 * 40 * 40
    assert len(ops.box_join(points, places, 0.1, cfg).collect()) == 300 * 100


def test_many_latitudes_of_one_city(spark):
    """The ends of boxes run through a city of many latitudes."""
    rng = random.Random(9)
    items = [(10 + rng.random() / 50, 20 + rng.random() / 50) for _ in range(3000)]
    items += [(-10 - rng.random() / 50, -20 - rng.random() / 50) for _ in range(50)]
    gazetteer = []
    for i in range(1500):
        a, o = rng.choice(items)
        edge = lambda: rng.choice([-1, 1]) + rng.gauss(0, 0.003)
        gazetteer.append((i, "x", a + rng.choice([edge(), rng.uniform(-1, 1)]), o + edge(), "P", "PPL"))
    expected = {p[0] for p in gazetteer if any(p[2] - 1 <= a <= p[2] + 1 and p[3] - 1 <= o <= p[3] + 1 for a, o in items)}
    found = ops.places_near(
        spark.createDataFrame(gazetteer, SCHEMA), spark.createDataFrame(items, "latitude double, longitude double")
    ).collect()
    assert len(found) == len(expected) and {r.geonameid for r in found} == expected
    assert 300 < len(expected) < 1400
    low, high = F.col("low"), F.col("high")
    bounds = [(a, a + rng.choice([2.0, 0.3, 0.0])) for a, _ in items[:200]] + [(-1.5, 0.5), (0.0, 2.0)]
    for r in spark.createDataFrame(bounds, "low double, high double").select(
        "*", ops._whole_nodes(low, high).alias("nodes"), ops._leaf(low).alias("a"), ops._leaf(high).alias("b")
    ).collect():
        leaves = sorted((n.node << n.height, (n.node + 1) << n.height) for n in r.nodes)
        assert len(leaves) <= 43 and all(x[1] == y[0] for x, y in zip(leaves, leaves[1:]))
        assert (leaves[0][0], leaves[-1][1]) == (r.a + 1, r.b) if leaves else r.b - r.a <= 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_places_near(spark, seed):
    rng = random.Random(seed)
    gazetteer = [(i, str(i), rng.uniform(-6, 6), rng.uniform(-6, 6), "P", "PPL") for i in range(400)]
    items = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(6)] + [(0.0, 0.0), (0.0, 3.0)]
    expected = {
        p[0] for p in gazetteer
        if any((a or b) and p[2] - 1 <= a <= p[2] + 1 and p[3] - 1 <= b <= p[3] + 1 for a, b in items)
    }
    rows = ops.places_near(
        spark.createDataFrame(gazetteer, SCHEMA), spark.createDataFrame(items, "latitude double, longitude double")
    ).collect()
    assert len(rows) == len(expected) and {r.geonameid for r in rows} == expected


def test_relevance(spark):
    rows = spark.createDataFrame(
        [("P", "pplc"), ("P", "PPLX"), ("A", "adm2"), ("A", "ADM4"), ("A", "PCLI"), ("H", "SEA"), ("H", "sea"),
         ("S", "CSTL"), ("S", "cstl"), ("s", "CSTL"), ("L", None), ("T", "MT"), ("A", None)],
        "feature_class string, feature_code string",
    )
    keep = lambda p: [(r.feature_class, r.feature_code) for r in ops.relevant_places(rows, p).collect()]
    assert keep(1) == [("P", "pplc"), ("A", "adm2"), ("A", "PCLI"), ("H", "SEA"), ("L", None)]
    assert keep(2) == [("P", "pplc"), ("P", "PPLX"), ("A", "ADM4"), ("A", "PCLI"), ("H", "SEA"), ("L", None)]
    assert keep(3) == [*keep(2)[:5], ("S", "CSTL"), ("L", None)]


def test_enrich_paths_and_hot_coordinate(spark):
    gazetteer, _ = world(5, places=50)
    hot = (gazetteer[0][2], gazetteer[0][3])
    media = [(f"{i}.jpg", *hot) for i in range(60)] + [("zero.jpg", 0.0, 7.0), ("far.jpg", 60.0, 60.0)]
    frame = spark.createDataFrame(media, "file_name string, latitude double, longitude double")
    frame = frame.withColumn("location_name", F.lit(None).cast("string"))
    expected = dict(zip([m[0] for m in media], [None] * len(media)))
    name = {p[0]: p[1] for p in gazetteer}
    for file, lat, lon in media[:60]:
        expected[file] = name[brute(gazetteer, lat, lon, 3)[1]]
    for cfg in (AlbumConfig(), AlbumConfig(broadcast_rows=0, hot_rows=10)):
        rows = ops.enrich(frame, spark.createDataFrame(gazetteer, SCHEMA), cfg).collect()
        assert {r.file_name: r.location_name for r in rows} == expected and len(rows) == len(media)


def test_no_places_is_an_error(spark):
    gazetteer = spark.createDataFrame([(1, "x", 50.0, 50.0, "P", "PPL")], SCHEMA)
    media = spark.createDataFrame([(1.0, 1.0)], "latitude double, longitude double")
    with pytest.raises(ops.NoPlacesError):
        ops.load_gazetteer(gazetteer, media, AlbumConfig())
    assert ops.load_gazetteer(gazetteer, media, AlbumConfig(require_places=False))[1:] == (1, 0)


def test_no_pairwise_join(spark):
    gazetteer, where = world(3, places=60, points=40)
    for cfg in (AlbumConfig(), AlbumConfig(broadcast_rows=0)):
        found = ops.nearest_places(
            spark.createDataFrame(where, "latitude double, longitude double"), spark.createDataFrame(gazetteer, SCHEMA), cfg
        )
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_prefilter_takes_positions_as_they_are(spark):
    """An item off the usual range keeps the place it stands on, as it does in the nearest-place join."""
    media = spark.createDataFrame([("a", 10.0, 200.0), ("b", 10.0, 20.0)], "file_name string, latitude double, longitude double")
    places = spark.createDataFrame([(1, 10.0, 200.0), (2, 10.2, 20.1), (3, 10.0, 100.0)], "geonameid long, latitude double, longitude double")
    assert sorted(r.geonameid for r in ops.places_near(places, media).collect()) == [1, 2]
