"""Place names for positions: relevance filter, gazetteer prefilter, tiered nearest place.

Positions are looked up once per distinct coordinate. A tier of radius r puts its places on a
grid of r-sized cells, each place into all cells it can be seen from, and gathers a cell's places
into small arrays; a position then meets its candidates with one equi join on its own cell and
picks the nearest inside the exact box. Nothing is compared pair by pair across a region.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.functions.geo import (
    cell,
    cells_in_reach,
    has_geo_any,
    has_geo_both,
    haversine_km,
    within_box,
)
from geoalbums.operators.joins import left_join_by_weight
from geoalbums.sources.shared import materialize

# --- fixed values: feature codes that may name an album, and the search tiers in order --------
PLACE_CODES_1 = ("PPLC", "PPLA", "PPLA2", "PPL")
ADMIN_CODES_1 = ("ADM2", "ADM3", "PCLI")
ADMIN_CODES_2 = ("ADM3", "ADM4", "PCLI")
SPOT_CODES = (
    "CSTL", "MNMT", "PAL", "TMPL", "MSQE", "CH", "THTR", "OPRA", "HSTS", "ANS", "RUIN", "TMB",
    "PYRS", "LTHSE", "TOWR", "ARCH", "CAVE", "PIER", "QUAY", "GDN", "SQR", "MUS", "ZOO", "UNIV",
    "LIBR", "STDM", "RECG", "MAR", "RSRT", "SPA", "MSSN", "SHRN",
)
WATER_CODES = ("SEA", "GULF", "STRAIT")
TIERS = (("S", 0.001), ("L", 0.01), ("P", 0.1), ("H", 1.0), ("A", 1.0), ("P", 1.0))
PREFILTER_DEGREES = 1.0
# ----------------------------------------------------------------------------------------------

# A cell with more places than this is split over several arrays.
CELL_ARRAY_PLACES = 1024


def is_relevant(feature_class: Column, feature_code: Column, precision: int) -> Column:
    """May this place name an album at the given precision?"""
    code = F.upper(feature_code)
    places = code.isin(*PLACE_CODES_1) if precision == 1 else F.lit(True)
    admin = code.isin(*(ADMIN_CODES_1 if precision == 1 else ADMIN_CODES_2))
    relevant = (
        (feature_class == "L")
        | ((feature_class == "P") & places)
        | ((feature_class == "A") & admin)
        | ((feature_class == "H") & feature_code.isin(*WATER_CODES))
    )
    if precision == 3:
        relevant = relevant | ((feature_class == "S") & feature_code.isin(*SPOT_CODES))
    return F.coalesce(relevant, F.lit(False))


def relevant_places(places: DataFrame, precision: int) -> DataFrame:
    return places.where(is_relevant(F.col("feature_class"), F.col("feature_code"), precision))


# Heights of the dyadic tree of latitudes: leaves of 2**-20 degrees (some 10 cm), nodes up to one degree.
_HEIGHTS = 20


def places_near(places: DataFrame, media: DataFrame) -> DataFrame:
    """Places with at least one positioned item in their ±1° box.

    Per one-degree column of longitude, items shrink to the lowest and highest longitude of each
    dyadic interval of latitudes: in any column that touches a box, one side of the longitude test
    always holds, so the two extremes decide. Extremes of degree squares (at most one row each)
    settle nearly all places. For the rest, the latitudes of the box fall into at most some forty
    whole intervals, each an equi join of one row per column, and two leaves that are cut, where
    the latitudes themselves are looked at: the items of a metropolis never meet in one task.
    """
    r = PREFILTER_DEGREES
    lat, lon = F.col("latitude"), F.col("longitude")
    located = media.where(has_geo_any(lat, lon))
    rows = located.groupBy(cell(lat, r).alias("cx"), cell(lon, r).alias("cy"), lat.alias("at_lat")).agg(
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon")
    )
    rows = materialize(rows, "latitude-rows")
    squares = rows.groupBy("cx", "cy").agg(
        F.min("at_lat").alias("min_lat"),
        F.max("at_lat").alias("max_lat"),
        F.min("min_lon").alias("min_lon"),
        F.max("max_lon").alias("max_lon"),
    )
    around = materialize(_to_neighbours(squares), "squares")  # small where positions are on earth, but not by force
    homed = places.withColumn("px", cell(lat, r)).withColumn("py", cell(lon, r))
    home = (F.col("px") == F.col("nx")) & (F.col("py") == F.col("ny"))
    lat_low, lat_high, lon_low, lon_high = lat - r, lat + r, lon - r, lon + r
    lat_inside = (F.col("min_lat") >= lat_low) & (F.col("max_lat") <= lat_high)
    lon_inside = (F.col("min_lon") >= lon_low) & (F.col("max_lon") <= lon_high)
    lat_meets = F.col("min_lat").between(lat_low, lat_high) | F.col("max_lat").between(lat_low, lat_high)
    lon_meets = F.col("min_lon").between(lon_low, lon_high) | F.col("max_lon").between(lon_low, lon_high)
    settled = (lat_inside & lon_meets) | (lon_inside & lat_meets)
    sure = homed.join(around, home & settled, "left_semi").select(*places.columns)
    unsure = homed.join(around, home & settled, "left_anti").join(
        around, home & lat_meets & lon_meets, "left_semi"
    )
    unsure = materialize(unsure.withColumn("_place", F.monotonically_increasing_id()), "unsure-places")
    if unsure.isEmpty():
        return sure
    sides = F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.col("py") + d))
    probes = unsure.select("_place", "latitude", "longitude", sides.alias("cy"))
    nodes = _latitude_nodes(rows)
    whole = probes.select("*", F.explode(_whole_nodes(lat_low, lat_high)).alias("_node")).select("*", "_node.*")
    by_node = whole.join(nodes, ["cy", "height", "node"]).where(lon_meets).select("_place")
    cut = probes.withColumn("leaf", F.explode(F.array_distinct(F.array(_leaf(lat_low), _leaf(lat_high)))))
    by_row = cut.join(rows.withColumn("leaf", _leaf(F.col("at_lat"))), ["cy", "leaf"]).where(
        F.col("at_lat").between(lat_low, lat_high) & lon_meets
    ).select("_place")
    found = by_node.unionByName(by_row).distinct()
    return sure.unionByName(unsure.join(found, "_place", "left_semi").select(*places.columns))


def _leaf(lat: Column) -> Column:
    return F.floor(lat * (1 << _HEIGHTS))


def _latitude_nodes(rows: DataFrame) -> DataFrame:
    """cy, height, node: lowest and highest longitude of every dyadic interval that holds an item."""
    extremes = [F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon")]
    leaves = rows.groupBy("cy", _leaf(F.col("at_lat")).alias("leaf")).agg(*extremes)
    heights = F.explode(F.sequence(F.lit(0), F.lit(_HEIGHTS)))
    up = leaves.withColumn("height", heights).withColumn("node", F.expr("shiftright(leaf, height)"))
    return up.groupBy("cy", "height", "node").agg(*extremes)


def _whole_nodes(low: Column, high: Column) -> Column:
    """The fewest dyadic intervals that make up all leaves wholly between the two leaves of the bounds."""
    first, end = _leaf(low) + 1, _leaf(high)  # leaves first .. end - 1
    power = lambda h: F.lit(1 << h).cast("bigint")
    node_of = lambda h: lambda x: F.struct(F.lit(h).alias("height"), x.alias("node"))
    pieces = []
    for h in range(_HEIGHTS + 1):
        left, right = F.ceil(first / power(h)).cast("bigint"), F.floor(end / power(h)).cast("bigint")
        if h == _HEIGHTS:
            ids = F.when(left < right, F.sequence(left, F.greatest(right - 1, left)))
        else:
            ids = F.when(
                left < right,
                F.array_compact(F.array(F.when(left % 2 != 0, left), F.when(right % 2 != 0, right - 1))),
            )
        pieces.append(F.transform(F.coalesce(ids, F.array().cast("array<bigint>")), node_of(h)))
    return F.flatten(F.array(*pieces))


def _to_neighbours(cells: DataFrame) -> DataFrame:
    """Every cell row once for itself and once for each of its eight neighbours (nx, ny)."""
    offsets = F.sequence(F.lit(-1), F.lit(1))
    return cells.withColumn("nx", F.explode(F.transform(offsets, lambda d: F.col("cx") + d))).withColumn(
        "ny", F.explode(F.transform(offsets, lambda d: F.col("cy") + d))
    )


class NoPlacesError(ValueError):
    """The gazetteer has no place near any item: most likely it covers another region."""


def load_gazetteer(places: DataFrame, media: DataFrame, cfg: AlbumConfig) -> tuple[DataFrame, int, int]:
    """Relevant places near the media, with the counts (relevant entries, places kept).

    Both are counted by the passes that write the places, so nothing is read for the counts alone.
    """
    total, count = Observation(), Observation()
    every = F.count(F.lit(1)).alias("n")
    relevant = materialize(relevant_places(places, cfg.precision).observe(total, every), "relevant-places")
    kept = materialize(places_near(relevant, media).observe(count, every), "places")
    if count.get["n"] == 0 and cfg.require_places:
        raise NoPlacesError("no matching places were found near any item")
    return kept, total.get["n"], count.get["n"]


def box_join(points: DataFrame, places: DataFrame, radius: float, cfg: AlbumConfig) -> DataFrame:
    """All (point, place) pairs inside the ±radius box; points keep their columns.

    Place columns are prefixed with `place_`. Places are repeated into the cells they can be
    seen from; few of them are broadcast, many are joined by cell. A crowded cell is cut into
    tiles of at most `hot_rows` points and as many places, each a task's work at most.
    """
    renamed = places.select(*[F.col(name).alias(f"place_{name}") for name in places.columns])
    seen = renamed.withColumn("_cx", F.explode(cells_in_reach(F.col("place_latitude"), radius))).withColumn(
        "_cy", F.explode(cells_in_reach(F.col("place_longitude"), radius))
    )
    seen = materialize(seen, "box-places")
    lat, lon = F.col("latitude"), F.col("longitude")
    celled = points.withColumn("_cx", cell(lat, radius)).withColumn("_cy", cell(lon, radius))
    if seen.count() <= cfg.broadcast_rows:
        joined = celled.join(F.broadcast(seen), ["_cx", "_cy"])
    else:
        joined = _tiled_cell_join(materialize(celled, "box-points"), seen, cfg)
    return joined.where(
        within_box(F.col("place_latitude"), F.col("place_longitude"), lat, lon, radius)
    ).select(*points.columns, *renamed.columns)


def _tiled_cell_join(points: DataFrame, seen: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Join on the cell, both sides of a crowded cell dealt out: a row has a stripe of its own side and
    is repeated over the stripes of the other, `_row` and `_column` of its tiles. Of crowded cells there
    are at most rows / hot_rows."""
    cells = ["_cx", "_cy"]

    def stripes(name: str) -> Column:
        return F.ceil(F.coalesce(name, F.lit(0)) / max(cfg.hot_rows, 1)).cast("int")

    load = points.groupBy(*cells).agg(F.count("*").alias("points")).join(
        seen.groupBy(*cells).agg(F.count("*").alias("places")), cells
    )
    crowded = load.where(F.greatest("points", "places") > cfg.hot_rows).select(
        *cells, stripes("points").alias("_rows"), stripes("places").alias("_columns")
    )
    crowded = F.broadcast(materialize(crowded, "crowded-cells"))

    def dealt(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        return (  # equal rows are told apart by where they are written
            side.withColumn("_at", F.monotonically_increasing_id()).join(crowded, cells, "left")
            .withColumn(mine, F.pmod(F.xxhash64("_at"), F.coalesce(own, F.lit(1))).cast("int"))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
            .drop("_at", "_rows", "_columns")
        )

    left = dealt(points, "_rows", "_columns", "_row", "_column")
    right = dealt(seen, "_columns", "_rows", "_column", "_row")
    return left.join(right, [*cells, "_row", "_column"])


@dataclass(frozen=True)
class _TierCells:
    cells: DataFrame  # tier, cx, cy, part, candidates
    rows: dict[int, int]  # candidate places per tier, counted once per cell they are in
    most_parts: dict[int, int]  # arrays of the fullest cell per tier


def _tier_cells(places: DataFrame, tiers: list[tuple[int, str, float]], cfg: AlbumConfig) -> _TierCells:
    """All tiers' places on their grids, one row per cell and at most ~1,024 places."""
    own_tiers = None
    for feature_class in dict.fromkeys(feature_class for _, feature_class, _ in tiers):
        mine = F.array(
            *[
                F.struct(F.lit(number).alias("tier"), F.lit(radius).alias("radius"))
                for number, kind, radius in tiers
                if kind == feature_class
            ]
        )
        here = F.col("feature_class") == feature_class
        own_tiers = F.when(here, mine) if own_tiers is None else own_tiers.when(here, mine)
    # of places of a class on one spot the lowest id wins
    spots = places.groupBy("feature_class", "latitude", "longitude").agg(
        F.min(F.struct("geonameid", "name")).alias("place")
    )
    spread = (
        spots.select(F.explode(own_tiers).alias("_tier"), "latitude", "longitude", "place")
        .withColumn("cx", F.explode(cells_in_reach(F.col("latitude"), F.col("_tier.radius"))))
        .withColumn("cy", F.explode(cells_in_reach(F.col("longitude"), F.col("_tier.radius"))))
        .select(F.col("_tier.tier").alias("tier"), "cx", "cy", "latitude", "longitude", "place")
    )
    spread = materialize(spread, "tier-places")
    fill = spread.groupBy("tier", "cx", "cy").agg(F.count("*").alias("n"))
    figures = fill.groupBy("tier").agg(F.sum("n").alias("rows"), F.max("n").alias("fullest")).collect()  # 6 rows
    rows = {row.tier: row.rows for row in figures}
    most_parts = {row.tier: -(-row.fullest // CELL_ARRAY_PLACES) for row in figures}
    parted = spread.withColumn("part", F.lit(0))
    if max(most_parts.values(), default=1) > 1:
        crowded = fill.where(F.col("n") > CELL_ARRAY_PLACES).select(
            "tier", "cx", "cy", F.ceil(F.col("n") / CELL_ARRAY_PLACES).alias("parts")
        )
        # at most one crowded cell per 1,024 rows
        if sum(rows.values()) <= CELL_ARRAY_PLACES * cfg.broadcast_rows:
            crowded = F.broadcast(crowded)
        parted = spread.join(crowded, ["tier", "cx", "cy"], "left").withColumn(
            "part", F.pmod(F.xxhash64("latitude", "longitude"), F.coalesce("parts", F.lit(1))).cast("int")
        ).drop("parts")
    cells = parted.groupBy("tier", "cx", "cy", "part").agg(
        F.collect_list(F.struct("latitude", "longitude", "place")).alias("candidates")
    )
    return _TierCells(cells, rows, most_parts)


def _nearest(candidates: Column, lat: Column, lon: Column, radius: float) -> Column:
    """struct(distance, geonameid, name, …) of the nearest candidate in the box; null if none."""
    inside = F.filter(candidates, lambda c: within_box(c["latitude"], c["longitude"], lat, lon, radius))
    return F.array_min(
        F.transform(
            inside,
            lambda c: F.struct(
                haversine_km(lat, lon, c["latitude"], c["longitude"]).alias("distance_km"),
                c["place"]["geonameid"].alias("geonameid"),
                c["place"]["name"].alias("name"),
            ),
        )
    )


def nearest_places(points: DataFrame, places: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """For each distinct (latitude, longitude) of `points` the place that names it.

    Adds `tier` (1..6), `distance_km`, `geonameid`, `name`; all null where no tier has a place.
    The first tier with a place in its box decides, the nearest there wins, then the lowest id.
    A tier whose cells are few is broadcast and all such tiers share one pass over the points; a
    larger tier is joined by cell, for the points still open only, with crowded cells salted.
    """
    usable = relevant_places(places, cfg.precision)
    tiers = [
        (number, feature_class, radius)
        for number, (feature_class, radius) in enumerate(TIERS, start=1)
        if feature_class != "S" or cfg.precision == 3
    ]
    grid = _tier_cells(usable, tiers, cfg)
    lat, lon = F.col("latitude"), F.col("longitude")
    none = "struct<tier:int,distance_km:double,geonameid:bigint,name:string>"
    pending = points.withColumn("hit", F.lit(None).cast(none))
    done: list[DataFrame] = []
    for number, _, radius in tiers:
        if number not in grid.rows:
            continue
        cells = grid.cells.where(F.col("tier") == number).select(
            F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "candidates"
        )
        small = grid.rows[number] <= cfg.broadcast_rows
        if not small:
            pending = materialize(pending, "open-points")
            done.append(pending.where(F.col("hit").isNotNull()))
            pending = pending.where(F.col("hit").isNull())
        columns = pending.columns
        pending = pending.withColumn("_cx", cell(lat, radius)).withColumn("_cy", cell(lon, radius))
        if small:
            joined = pending.join(F.broadcast(cells), ["_cx", "_cy"], "left")
        else:
            joined = _salted_cell_join(pending, cells, cfg)
        best = _nearest(F.col("candidates"), lat, lon, radius)
        hit = F.coalesce(
            F.col("hit"),
            F.when(
                best.isNotNull(),
                F.struct(F.lit(number).alias("tier"), best["distance_km"], best["geonameid"], best["name"]),
            ).cast(none),
        )
        pending = joined.withColumn("hit", hit).select(*columns)
        if grid.most_parts[number] > 1:
            # a crowded cell came in several arrays: keep the best of them per point
            rest = [name for name in columns if name not in ("latitude", "longitude", "hit")]
            pending = pending.groupBy("latitude", "longitude").agg(
                F.min("hit").alias("hit"), *[F.first(name).alias(name) for name in rest]
            ).select(*columns)
    for frame in done:
        pending = pending.unionByName(frame)
    return pending.select(
        *[name for name in pending.columns if name != "hit"],
        F.col("hit.tier").alias("tier"),
        F.col("hit.distance_km").alias("distance_km"),
        F.col("hit.geonameid").alias("geonameid"),
        F.col("hit.name").alias("name"),
    )


def _salted_cell_join(
    points: DataFrame, cells: DataFrame, cfg: AlbumConfig, how: str = "left"
) -> DataFrame:
    """Join on the cell; points of a crowded cell are dealt over several tasks.

    There are at most points / hot_rows crowded cells, so that list is safe to broadcast.
    """
    hot = (
        points.groupBy("_cx", "_cy")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > cfg.hot_rows)
        .select("_cx", "_cy", F.ceil(F.col("n") / cfg.hot_rows).cast("int").alias("_salts"))
    )
    hot = F.broadcast(materialize(hot, "hot-cells"))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = points.join(hot, ["_cx", "_cy"], "left").withColumn(
        "_salt", F.pmod(F.xxhash64("latitude", "longitude"), salts).cast("int")
    ).drop("_salts")
    copied = cells.join(hot, ["_cx", "_cy"], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).drop("_salts")
    return dealt.join(copied, ["_cx", "_cy", "_salt"], how)


def enrich(media: DataFrame, places: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """`location_name` onto the items, where both axes are known and a place was found."""
    lat, lon = F.col("latitude"), F.col("longitude")
    points = materialize(
        media.where(has_geo_both(lat, lon)).groupBy("latitude", "longitude").agg(F.count("*").alias("items")),
        "points",
    )
    named = nearest_places(points, places, cfg).select(
        "latitude", "longitude", "items", F.col("name").alias("location_name")
    )
    rest = media.drop("location_name")
    joined = left_join_by_weight(
        rest, named, ["latitude", "longitude"], "items", points.count(), cfg.broadcast_rows, cfg.hot_rows
    )
    return joined.select(*rest.columns, "location_name")
