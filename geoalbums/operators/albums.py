"""Albums and their names, from items that have their album id.

Items arrive bucketed (see `scan`). An album may span many buckets, so album figures are first
gathered per (bucket, album) and names travel back on that key: no task gets a whole album.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.functions.dates import expand_template, net_format
from geoalbums.functions.text import format_list, trim_all
from geoalbums.operators.joins import left_join_by_weight
from geoalbums.operators.scan import (
    BUCKET,
    POSITION,
    earlier_buckets,
    in_bucket,
    join_carry,
    library_keys,
    up_to_here,
)
from geoalbums.sources.shared import materialize

# --- fixed values ---
UNKNOWN_LOCATION = "Unknown Location"
PLACES_PER_NAME = 4
# --------------------

def album_pieces(steps: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Album figures per bucket; the windows before have already put these rows together."""
    return steps.groupBy(BUCKET, *library_keys(cfg.library_cols), "album_id").agg(
        F.min("date_created").alias("first_date"),
        F.max("date_created").alias("last_date"),
        F.count("*").alias("files"),
        F.max(F.length("location_name") > 0).alias("has_place"),
    )


def album_figures(pieces: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """One row per album, with the bucket it begins in."""
    return pieces.groupBy(*library_keys(cfg.library_cols), "album_id").agg(
        F.min(BUCKET).alias(BUCKET),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("files").alias("files"),
        F.max("has_place").alias("has_place"),
    )


def top_places(steps: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Up to four most frequent place names per album, in order of first appearance.

    Counted before anything is ranked, and ranked with a limit Spark applies before the shuffle,
    so neither a long album nor one with very many places gathers in one task.
    """
    album = [*library_keys(cfg.library_cols), "album_id"]
    counts = (
        steps.select(*album, POSITION, trim_all(F.col("location_name")).alias("place"))
        .where(F.col("place") != "")
        .groupBy(*album, "place")
        .agg(F.count("*").alias("n"), F.min(POSITION).alias("first_no"))
    )
    ranking = Window.partitionBy(*album).orderBy(F.col("n").desc(), F.col("first_no"))
    best = counts.withColumn("rank", F.row_number().over(ranking)).where(
        F.col("rank") <= PLACES_PER_NAME
    )
    return best.groupBy(*album).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first_no", "place"))), lambda seen: seen["place"]
        ).alias("places")
    )


def date_name(cfg: AlbumConfig) -> Column:
    """`first` or `first - last` by calendar day."""
    first, last = F.to_date("first_date"), F.to_date("last_date")
    name = net_format(first, cfg.date_format)
    if not cfg.use_date_range:
        return name
    return F.when(first == last, name).otherwise(
        F.concat(name, F.lit(" - "), net_format(last, cfg.date_format))
    )


def place_name(cfg: AlbumConfig) -> Column:
    places = F.coalesce(F.col("places"), F.array(F.lit(UNKNOWN_LOCATION)))
    name = format_list(places, cfg.invalid_chars)
    if not cfg.append_format:
        return name
    return F.concat(name, F.lit(" ("), net_format(F.col("first_date"), cfg.append_format), F.lit(")"))


def base_names(figures: DataFrame, places: DataFrame | None, cfg: AlbumConfig) -> DataFrame:
    """Name from places or dates, then the prefix template. `places` is None without gazetteer."""
    if places is None:
        named = figures.withColumn("album_name", date_name(cfg))
    else:
        album = [*library_keys(cfg.library_cols), "album_id"]
        named = figures.join(places, album, "left").withColumn(
            "album_name",
            F.when(F.col("has_place"), place_name(cfg)).otherwise(date_name(cfg)),
        ).drop("places")
    if cfg.album_prefix:
        day = F.to_date("first_date")
        named = named.withColumn(
            "album_name", expand_template(cfg.album_prefix, day, F.col("album_name"))
        )
    return named


def avoid_existing(named: DataFrame, existing_folders: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Names taken on disk get the smallest free ` (n)`; only what is on disk counts.

    The smallest free number is the smallest successor that is missing, found with an anti join
    on (name, number): no list of numbers per name is ever gathered.
    """
    shared = [name for name in cfg.library_cols if name in existing_folders.columns]
    folder = F.col("folder")
    numbered = existing_folders.select(
        *shared,
        F.regexp_extract(folder, r"(?s)\A(.*) \([1-9]\d{0,17}\)\z", 1).alias("album_name"),
        F.regexp_extract(folder, r" \(([1-9]\d{0,17})\)\z", 1).try_cast("bigint").alias("number"),
    ).where(F.col("number").isNotNull())
    plain = existing_folders.select(*shared, folder.alias("album_name"), F.lit(0).cast("bigint").alias("number"))
    key = [*shared, "album_name"]
    wanted = named.groupBy(*key).agg(F.count("*").alias("albums"))
    taken = plain.unionByName(numbered).distinct().join(wanted, key, "left_semi")
    clashing = plain.join(wanted, key, "left_semi").select(*key).distinct()
    successors = taken.join(clashing, key, "left_semi").withColumn("number", F.col("number") + 1)
    free = materialize(
        successors.join(taken, [*key, "number"], "left_anti")
        .groupBy(*key)
        .agg(F.min("number").alias("suffix"))
        .join(wanted, key),
        "free-names",
    )
    joined = left_join_by_weight(
        named, free, key, "albums", free.count(), cfg.broadcast_rows, cfg.hot_rows
    )
    return joined.withColumn(
        "album_name",
        F.when(F.col("suffix").isNull(), F.col("album_name")).otherwise(
            F.concat("album_name", F.lit(" ("), F.col("suffix").cast("string"), F.lit(")"))
        ),
    ).select(*named.columns)


def part_numbers(named: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Adds `part`: 1, 2, 3 … through neighbouring albums of one name; 1 again when it changes.

    Album ids count up by one, so a part is the distance to the last album whose name differs
    from the one before it: a last-value scan, over the buckets the albums begin in.
    """
    if not cfg.use_part_numbers:
        return named.withColumn("part", F.lit(0))
    keys = library_keys(cfg.library_cols)
    albums = materialize(named, "named-albums")
    ordered, here = in_bucket(keys, "album_id"), up_to_here(keys, "album_id")
    inner_change = F.when(F.lag("album_name").over(ordered) != F.col("album_name"), F.col("album_id"))
    before = earlier_buckets(keys)
    summary = albums.withColumn("change", inner_change).groupBy(BUCKET, *keys).agg(
        F.min_by("album_name", "album_id").alias("first_name"),
        F.max_by("album_name", "album_id").alias("last_name"),
        F.min("album_id").alias("first_id"),
        F.max("change").alias("inner_change"),
    )
    summary = summary.withColumn("carry_name", F.last("last_name", True).over(before))
    edge_change = F.when(
        F.col("carry_name").isNull() | (F.col("carry_name") != F.col("first_name")), F.col("first_id")
    )
    carry = summary.withColumn("change", F.coalesce("inner_change", edge_change)).select(
        BUCKET, *keys, "carry_name", F.max("change").over(before).alias("carry_change")
    )
    df = join_carry(albums, carry, keys).withColumn(
        "prev_name", F.coalesce(F.lag("album_name").over(ordered), F.col("carry_name"))
    )
    change = F.when(
        F.col("prev_name").isNull() | (F.col("prev_name") != F.col("album_name")), F.col("album_id")
    )
    start = F.coalesce(F.max(change).over(here), F.col("carry_change"))
    return df.withColumn("part", (F.col("album_id") - start + 1).cast("int")).select(
        *named.columns, "part"
    )


def with_part_suffix(albums: DataFrame) -> DataFrame:
    return albums.withColumn("base_name", F.col("album_name")).withColumn(
        "album_name",
        F.when(
            F.col("part") >= 2,
            F.concat("album_name", F.lit(" (part "), F.col("part").cast("string"), F.lit(")")),
        ).otherwise(F.col("album_name")),
    )


def name_items(
    steps: DataFrame,
    pieces: DataFrame,
    albums: DataFrame,
    cfg: AlbumConfig,
    columns: tuple[str, ...] = ("album_name", "part"),
) -> DataFrame:
    """Album columns onto the items, through (bucket, album) pieces of bounded size."""
    keys = library_keys(cfg.library_cols)
    names = pieces.select(BUCKET, *keys, "album_id").join(
        albums.select(*keys, "album_id", *columns), [*keys, "album_id"]
    )
    return steps.join(names, [BUCKET, *keys, "album_id"])
