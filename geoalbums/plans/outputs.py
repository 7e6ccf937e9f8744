"""Writing a run: catalog, manifest, then the mark, so that a failed write never moves it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.operators.placement import placement_manifest
from geoalbums.plans.grouping import AlbumRun
from geoalbums.plans.report import album_catalog
from geoalbums.sources.shared import path_exists
from geoalbums.sources.state import save_marks


def write_run(
    run: AlbumRun,
    cfg: AlbumConfig,
    folder: str,
    existing: DataFrame | None = None,
    state_path: str | None = None,
    destination: str = "",
    add_digest: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """`folder`/catalog and `folder`/manifest as parquet, one directory per library.

    A simulation writes neither files nor mark; its report comes from `plans.report`. Items
    without a `digest` column need `add_digest`, see `placement_manifest`.
    """
    if cfg.mode == "simulate":
        return
    album_catalog(run.albums, cfg, destination).write.mode("overwrite").parquet(f"{folder}/catalog")
    manifest = placement_manifest(run.items, cfg, existing, add_digest)
    if cfg.library_cols:
        # a library's rows end up in few files, and a large library in more than one
        manifest = manifest.hint("rebalance", *cfg.library_cols)
    manifest.write.mode("overwrite").partitionBy(*cfg.library_cols).parquet(f"{folder}/manifest")
    if state_path:
        save_marks(run.items, state_path, cfg)


@dataclass(frozen=True)
class PublishedRun:
    number: int
    catalog: DataFrame
    manifest: DataFrame


def publish_run(
    run: AlbumRun,
    cfg: AlbumConfig,
    folder: str,
    existing: DataFrame | None = None,
    state_path: str | None = None,
    destination: str = "",
    add_digest: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """As `write_run`, but all of it becomes visible at once, or nothing does.

    Catalog and manifest go to a folder of their own, `folder`/runs/…; a single row in
    `folder`/published then says that they are whole, and the marks are saved last. A run that
    fails before that row leaves what was published before; one that fails after it is done again
    over the same items, which then count as identical. One run at a time writes to a folder.
    """
    if cfg.mode == "simulate":
        return
    spark = run.items.sparkSession
    before = last_published(spark, folder)
    name = uuid.uuid4().hex
    write_run(run, cfg, f"{folder}/runs/{name}", existing, None, destination, add_digest)
    number = 1 if before is None else before[0] + 1
    row = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(name).alias("run"))
    row.write.mode("append").parquet(f"{folder}/published")
    if state_path:
        save_marks(run.items, state_path, cfg)


def last_published(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """(number, name) of the last run that was published."""
    path = f"{folder}/published"
    if not path_exists(spark, path):
        return None
    rows = spark.read.schema("number long, run string").parquet(path)
    last = rows.agg(F.max(F.struct("number", "run")).alias("last")).first()["last"]
    return None if last is None else (last["number"], last["run"])


def read_published(spark: SparkSession, folder: str) -> PublishedRun | None:
    last = last_published(spark, folder)
    if last is None:
        return None
    path = f"{folder}/runs/{last[1]}"
    return PublishedRun(last[0], spark.read.parquet(f"{path}/catalog"), spark.read.parquet(f"{path}/manifest"))
