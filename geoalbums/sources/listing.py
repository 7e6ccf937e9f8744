"""Listings made by the executors: one round per level of folders, one table of folders per round.

The driver knows the roots and how many rounds there were, never a list of files. A folder is read by
one task, which passes its names on in pages; what must be asked file by file (length and time, where
the store does not say them with the name) is asked by whichever task gets the page.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoalbums.sources.shared import hadoop_path, materialize
from geoalbums.sources.stores import located, reason_of, store_of, tried

PAGE = 1000  # names of one folder that travel together
LISTED = "path string, folder boolean, modified_at timestamp, length long, error string"

_ENTRY = pa.struct(
    [("name", pa.string()), ("folder", pa.bool_()), ("modified_at", pa.timestamp("us", "UTC")), ("length", pa.int64())]
)
_PAGES = (
    "parent string, error string,"
    " entries array<struct<name:string,folder:boolean,modified_at:timestamp,length:bigint>>"
)


def _names(folder: str) -> Iterator[dict]:
    """What a folder holds: local entries by name and kind alone, those of other stores in full."""
    store, inner = store_of(folder)
    if not store:
        with os.scandir(inner) as entries:
            for entry in entries:
                # links to folders are not followed: they may lead back here
                if not (entry.is_symlink() and entry.is_dir()):
                    yield {"name": entry.name, "folder": entry.is_dir(follow_symlinks=False)}
        return
    filesystem, root = located(folder)
    for info in filesystem.get_file_info(fs.FileSelector(root)):
        yield {
            "name": info.base_name, "folder": info.type == fs.FileType.Directory, "modified_at": info.mtime,
            "length": info.size,
        }


def _pages(folder: str, page: int) -> Iterator[tuple[list[dict], str | None]]:
    entries = []
    names, error = tried(lambda: _names(folder))
    while error is None:
        try:
            entry = next(names, None)
        except Exception as stopped:  # pages that were passed on stand; the rest of the folder is reported
            error = reason_of(stopped)
            break
        if entry is None:
            break
        try:
            entry["name"].encode()
        except UnicodeEncodeError:
            yield [], f"a name is not UTF-8: {entry['name'].encode('utf-8', 'replace').decode()}"
            continue
        entries.append(entry)
        if len(entries) == page:
            yield entries, None
            entries = []
    if entries or error is not None:
        yield entries, error


def _facts(path: str) -> tuple[datetime, int]:
    """Time and length of a local file."""
    found = os.stat(store_of(path)[1])
    return datetime.fromtimestamp(found.st_mtime, timezone.utc), found.st_size


def _split(page: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for entries, error in _pages(folder, page):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([folder]), pa.array([error], pa.string()), pa.array([entries], pa.list_(_ENTRY))],
                        names=["parent", "error", "entries"],
                    )

    return split


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # a page at a time: a batch may hold thousands of them
            parent, error, entries = (batch.column(i)[at].as_py() for i in range(3))
            rows = [] if error is None else [(parent, None, None, None, error)]
            for entry in entries:
                path = f"{parent.rstrip('/')}/{entry['name']}"
                modified_at, length, reason = entry["modified_at"], entry["length"], None
                if not entry["folder"] and length is None:
                    facts, reason = tried(lambda: _facts(path))
                    modified_at, length = facts or (None, None)
                rows.append((path, entry["folder"], modified_at, length, reason))
            paths, folders, times, lengths, reasons = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array(times, pa.timestamp("us", "UTC")),
                    pa.array(lengths, pa.int64()), pa.array(reasons, pa.string()),
                ],
                names=["path", "folder", "modified_at", "length", "error"],
            )


def list_tree(spark: SparkSession, roots: Sequence[str], recursive: bool = False, page: int = PAGE) -> DataFrame:
    """path, modified_at, length, error: every file under the roots, hidden ones too, and once per root
    that leads to it; roots and folders that cannot be listed, and files that cannot be asked for
    their length, have an `error` and no length.
    """
    found, refused = [], []
    for root in roots:
        qualified, error = tried(lambda: hadoop_path(spark, root))
        (found if error is None else refused).append(qualified if error is None else (root, error))
    tasks = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(path,) for path in found], "path string")
    rounds = [
        spark.createDataFrame(refused, "path string, error string").select(
            "path", F.lit(None).cast("timestamp").alias("modified_at"), F.lit(None).cast("long").alias("length"), "error"
        )
    ]
    while True:
        pages = frontier.repartition(tasks).mapInArrow(_split(page), _PAGES)
        entries = materialize(pages.repartition(tasks).mapInArrow(_complete, LISTED), "listed-folders")
        rounds.append(entries.where("NOT coalesce(folder, false)").select("path", "modified_at", "length", "error"))
        frontier = entries.where("folder").select("path")
        if not recursive or frontier.isEmpty():
            break
    listed = rounds[0]
    for rows in rounds[1:]:
        listed = listed.unionByName(rows)
    return listed


def failed_files(*frames: DataFrame) -> DataFrame:
    """path, reason: rows of listings or digests that have an `error`, each reason once per path."""
    failed = None
    for frame in frames:
        path = "path" if "path" in frame.columns else "file_name"
        rows = frame.where(F.col("error").isNotNull()).select(F.col(path).alias("path"), F.col("error").alias("reason"))
        failed = rows if failed is None else failed.unionByName(rows)
    return failed.distinct()
