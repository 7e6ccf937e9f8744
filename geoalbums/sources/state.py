"""The high-water mark: the latest capture date processed, per library.

Runs only ever append rows and a mark only ever rises, so the state is the maximum per library. A
failed write leaves the old marks in place; `compact_marks` keeps the table short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.sources.shared import remove_files


def merge_marks(items: DataFrame, state: DataFrame | None, library_cols: Sequence[str]) -> DataFrame:
    """New state: the later of the saved mark and the latest item of this run."""
    latest = items.groupBy(*library_cols).agg(F.max("date_created").alias("last_processed"))
    if state is not None:
        latest = latest.unionByName(state.select(*library_cols, "last_processed"))
    merged = latest.groupBy(*library_cols).agg(F.max("last_processed").alias("last_processed"))
    return merged.where(F.col("last_processed").isNotNull())


def read_marks(spark: SparkSession, path: str, library_cols: Sequence[str] = ()) -> DataFrame | None:
    """Saved marks; None when nothing was saved yet."""
    try:
        saved = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return saved.groupBy(*library_cols).agg(F.max("last_processed").alias("last_processed"))


def compact_marks(spark: SparkSession, path: str, library_cols: Sequence[str] = ()) -> None:
    """One row per library again, in as few files as that takes, whatever the number of runs.

    The maxima are appended first; the files they were read from go after that. A crash in between
    leaves both, which is the same state, as a mark is a maximum; what a run appends meanwhile stays.
    A reader that listed the old files just before has to read again.
    """
    try:
        saved = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return
        raise
    files = list(saved.inputFiles())  # a few per run since the last time
    fixed = spark.read.schema(saved.schema).parquet(*files)
    merged = fixed.groupBy(*library_cols).agg(F.max("last_processed").alias("last_processed"))
    merged.where(F.col("last_processed").isNotNull()).write.mode("append").parquet(path)
    remove_files(spark, files)


def save_marks(items: DataFrame, path: str, cfg: AlbumConfig) -> None:
    """Append this run's marks, those that rise above the saved ones; a simulation saves none."""
    if cfg.mode == "simulate":
        return
    spark = items.sparkSession
    saved = read_marks(spark, path, cfg.library_cols)
    merged = merge_marks(items, None, cfg.library_cols)
    if saved is not None:
        if cfg.library_cols:
            old = saved.withColumnRenamed("last_processed", "saved")
            merged = merged.join(old, list(cfg.library_cols), "left")
        else:
            merged = merged.withColumn("saved", saved.agg(F.max("last_processed")).scalar())
        merged = merged.where(F.col("saved").isNull() | (F.col("last_processed") > F.col("saved"))).drop("saved")
    merged.write.mode("append").parquet(path)
