"""Time and distance albums on a stream, one micro-batch after the other.

What is still open stays in a tail table per batch: the items since the last closed album, that
album's last item, and each library's last album id, name and part. A batch reads the tail its
predecessor left, so a batch that is run again after a failure gives the same rows. Nothing is
lost without a word: items too late for their album are a table of their own, a tail that ought
to be there and isn't is an error, and `close_all` ends a stream with every item in an album.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.functions.dates import micros
from geoalbums.operators.albums import (
    album_figures,
    album_pieces,
    base_names,
    name_items,
    part_numbers,
    top_places,
    with_part_suffix,
)
from geoalbums.operators.places import enrich
from geoalbums.operators.scan import bucketed, library_keys
from geoalbums.operators.walk import ORDER, walk, with_album_ids
from geoalbums.plans.grouping import prepare
from geoalbums.sources.shared import materialize, path_exists, remove_path, scratch

_TAIL = ["file_name", "date_created", "latitude", "longitude", "location_name"]


@dataclass(frozen=True)
class AlbumStream:
    """Closed albums' items go to `folder`/items, late ones to `folder`/late, the tail to `folder`/tail.

    An album closes when its last item is more than `max(T, hold_hours)` before the newest item
    of all libraries so far, so a library that falls idle closes too. With no time threshold an
    album closes at the next break only, and `hold_hours` bounds how late an item may still be.
    A folder belongs to one checkpoint.
    """

    cfg: AlbumConfig
    folder: str
    places: DataFrame | None = None
    hold_hours: float = 0.0

    def __post_init__(self) -> None:
        if self.cfg.avoid_existing:
            raise ValueError("avoid_existing needs all folders at once: a stream cannot look them up")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        self._claim(stream.sparkSession, checkpoint)
        writer = stream.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def _claim(self, spark: SparkSession, checkpoint: str) -> None:
        """The folder is this checkpoint's from now on, or is so already."""
        path = f"{self.folder}/checkpoint-in-use"
        if path_exists(spark, path):
            owner = spark.read.parquet(path).first()["checkpoint"]
            if owner != checkpoint:
                raise ValueError(f"{self.folder} belongs to the stream with checkpoint {owner}")
        else:
            spark.range(1).select(F.lit(checkpoint).alias("checkpoint")).write.parquet(path)

    def _tail(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """What the batch before left; the first batch has nothing before it."""
        if batch_id == 0:
            return None
        path = f"{self.folder}/tail/batch={batch_id - 1}"
        if not path_exists(spark, path):
            raise RuntimeError(f"batch {batch_id} needs the tail of its predecessor, and {path} is missing")
        return spark.read.parquet(path)

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark, cfg = batch.sparkSession, self.cfg
        with scratch(spark):
            keys = library_keys(cfg.library_cols)
            fresh = prepare(batch, cfg).select(*cfg.library_cols, *_TAIL)
            if self.places is not None:
                fresh = enrich(materialize(fresh, "stream-media"), self.places, cfg)
            fresh = materialize(self._with_roles(fresh), "stream-fresh")
            tail = self._tail(spark, batch_id)
            late = fresh.where("false")
            items = fresh
            if tail is not None:
                closed = tail.where(F.col("role") == "closed").select(
                    *cfg.library_cols, *[F.col(name).alias(f"closed_{name}") for name in ORDER]
                )
                judged = materialize(self._judged(fresh, closed), "stream-judged")
                late = judged.where("late").drop("late")
                items = judged.where(~F.col("late")).drop("late").unionByName(tail)
            late.select(*cfg.library_cols, *_TAIL).write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
            self._close(items, str(batch_id), spark, keys)
        # a batch that is run again reads its predecessor's tail; older ones are never asked for
        if batch_id > 1:
            remove_path(spark, f"{self.folder}/tail/batch={batch_id - 2}")

    def close_all(self, spark: SparkSession) -> None:
        """Ends the stream: whatever is open becomes closed albums. Run again, it gives the same rows."""
        tails = spark.read.parquet(f"{self.folder}/tail")
        last = tails.agg(F.max(F.col("batch").cast("long"))).first()[0]
        if last is None:
            return
        tail = tails.where(F.col("batch").cast("long") == last).drop("batch")
        with scratch(spark):
            self._close(materialize(tail, "stream-last-tail"), "end", spark, library_keys(self.cfg.library_cols), flush=True)

    def _with_roles(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "role": F.lit("open"),
                "album_id": F.lit(None).cast("bigint"),
                "album_name": F.lit(None).cast("string"),
                "part": F.lit(None).cast("int"),
                "newest": F.col("date_created"),
            }
        )

    def _judged(self, fresh: DataFrame, closed: DataFrame) -> DataFrame:
        """`late`: whether an item belongs before what is closed already. One row per library of
        `closed` is all that is joined, so a large library is split by adaptive execution."""
        columns = fresh.columns
        key = list(self.cfg.library_cols)
        if key:
            joined = fresh.join(closed, key, "left")
        else:
            last = closed.agg(F.max(F.struct(*[f"closed_{name}" for name in ORDER])).alias("last"))
            joined = fresh.withColumn("last", last.scalar()).select("*", "last.*")
        late = F.struct(*ORDER) <= F.struct(*[F.col(f"closed_{name}").alias(name) for name in ORDER])
        return joined.select(*columns, F.coalesce(late, F.lit(False)).alias("late"))

    def _close(
        self, items: DataFrame, label: str, spark: SparkSession, keys: list[str], flush: bool = False
    ) -> None:
        cfg = self.cfg
        ranges = bucketed(items, cfg.library_cols, ORDER, cfg.scan_buckets)
        # The tail keeps positions as they came; the closed item keeps the one it ended up with.
        original = ranges.select(
            *ranges.columns, F.col("latitude").alias("own_lat"), F.col("longitude").alias("own_lon"),
            F.col("location_name").alias("own_name"),
        )
        walked = materialize(
            walk(original.drop("album_id", "album_name", "part"), cfg), "stream-walked"
        )
        steps = with_album_ids(walked, cfg)
        base = ranges.where(F.col("role") == "closed").select(
            *keys, F.col("album_id").alias("base_id"), F.col("album_name").alias("base_last_name"),
            F.col("part").alias("base_part"),
        )
        # A library's first album in the tail is the closed one, if there is one.
        newest = steps.agg(F.max("newest").alias("latest")).scalar()
        offsets = steps.select(*keys).distinct().join(base, keys, "left").withColumn("latest", newest)
        offsets = materialize(
            offsets.withColumn("offset", F.coalesce(F.col("base_id") - 1, F.lit(0))), "stream-offsets"
        )
        pieces = materialize(album_pieces(steps, cfg), "stream-pieces")
        figures = album_figures(pieces, cfg)
        named = base_names(figures, top_places(steps, cfg) if self.places is not None else None, cfg)
        # The closed album goes by the name it was given: its other items are gone.
        named = named.join(offsets.select(*keys, "base_id", "base_last_name"), keys, "left").withColumn(
            "album_name",
            F.when(F.col("base_id").isNotNull() & (F.col("album_id") == 1), F.col("base_last_name")).otherwise(
                F.col("album_name")
            ),
        ).drop("base_id", "base_last_name")
        albums = part_numbers(named, cfg)
        albums = albums.join(offsets, keys)
        if cfg.use_part_numbers:
            # parts of albums that carry on the closed album's name count on from its part
            first_run = F.col("part") == F.col("album_id")
            albums = albums.withColumn(
                "part",
                F.when(first_run & F.col("base_part").isNotNull(), F.col("part") + F.col("base_part") - 1)
                .otherwise(F.col("part")).cast("int"),
            )
        hold = max(cfg.time_micros, int(self.hold_hours * 3_600_000_000))
        idle = micros(F.col("latest")) - micros(F.col("last_date"))
        closes = F.lit(True) if flush else idle > hold
        albums = materialize(
            with_part_suffix(albums.withColumn("closes", closes)), "stream-albums"
        )
        # Albums close in order: an album stays open while an earlier one does.
        first_open = albums.where(~F.col("closes")).groupBy(*keys).agg(F.min("album_id").alias("first_open"))
        albums = materialize(
            albums.join(first_open, keys, "left").withColumn(
                "closes", F.col("first_open").isNull() | (F.col("album_id") < F.col("first_open"))
            ),
            "stream-closing",
        )
        last_closed = albums.where("closes").groupBy(*keys).agg(F.max("album_id").alias("last_closed"))
        status = albums.join(last_closed, keys, "left")
        shown = ("album_name", "part", "base_name", "closes", "last_closed", "offset", "latest")
        rows = name_items(steps, pieces, status, cfg, shown)
        rows = materialize(rows, "stream-rows")
        self._write_closed(rows, label)
        if not flush:
            self._write_tail(rows, label, keys)

    def _write_closed(self, rows: DataFrame, label: str) -> None:
        done = rows.where(F.col("closes") & (F.col("role") == "open"))
        done.select(
            *self.cfg.library_cols, *_TAIL,
            (F.col("album_id") + F.col("offset")).alias("album_id"), "album_name", "part",
        ).write.mode("overwrite").parquet(f"{self.folder}/items/batch={label}")

    def _write_tail(self, rows: DataFrame, label: str, keys: list[str]) -> None:
        open_items = rows.where(~F.col("closes")).select(
            *self.cfg.library_cols,
            "file_name", "date_created",
            F.col("own_lat").alias("latitude"), F.col("own_lon").alias("longitude"),
            F.col("own_name").alias("location_name"),
            "role",
            F.lit(None).cast("bigint").alias("album_id"),
            F.lit(None).cast("string").alias("album_name"),
            F.lit(None).cast("int").alias("part"),
            F.col("latest").alias("newest"),
        )
        ends = rows.where(F.col("closes") & (F.col("album_id") == F.col("last_closed")))
        row = F.struct(
            "file_name", "date_created", "latitude", "longitude", "location_name",
            (F.col("album_id") + F.col("offset")).alias("album_id"),
            F.col("base_name").alias("album_name"), "part", F.col("latest").alias("newest"),
        )
        closed_items = (
            ends.groupBy(*keys)
            .agg(F.max_by(row, F.struct(*ORDER)).alias("last"))
            .select(*self.cfg.library_cols, "last.*", F.lit("closed").alias("role"))
        )
        open_items.unionByName(closed_items).write.mode("overwrite").parquet(
            f"{self.folder}/tail/batch={label}"
        )

    def closed_items(self, spark: SparkSession) -> DataFrame:
        """Items of all closed albums so far."""
        return spark.read.parquet(f"{self.folder}/items").drop("batch")

    def late_items(self, spark: SparkSession) -> DataFrame:
        """Items that came after their place in the order was closed."""
        return spark.read.parquet(f"{self.folder}/late").drop("batch")
