"""Intermediate tables in the folder every executor can read.

Lineage is cut by writing a table there and reading it back: the rows are then fixed, survive
the loss of executors, and later steps read only the columns they need.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a folder in the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below one folder per application, which may go once the application has ended."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/geoalbums/{application}/{label}-{uuid.uuid4().hex}"


_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())  # a list per open `scratch`


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def hadoop_path(spark: SparkSession, path: str) -> str:
    """A path in full, with its store: one spelling for one place."""
    filesystem, found = _hadoop(spark, path)
    return filesystem.makeQualified(found).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    """False only if there is nothing; a store that can't be asked raises its error."""
    filesystem, found = _hadoop(spark, path)
    return filesystem.exists(found)


def remove_path(spark: SparkSession, path: str) -> None:
    filesystem, found = _hadoop(spark, path)
    filesystem.delete(found, True)


def remove_files(spark: SparkSession, uris: list[str]) -> None:
    """Files by the URIs that `DataFrame.inputFiles` gives."""
    for uri in uris:
        found = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, False)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are gone afterwards, but for those that `outlives`."""
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            remove_path(spark, path)


def materialize(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """Write once, read back. With `outlives` the table stays when the innermost `scratch` ends, and goes
    with the one around it, if any."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    lists = _written.get()
    if outlives:
        lists = lists[:-1]
    if lists:
        lists[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
