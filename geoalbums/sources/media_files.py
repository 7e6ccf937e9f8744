"""File listings: media under one or more roots, and what a destination already holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoalbums.functions.hashing import Crc64Part, chunked_digest, crc64_of_parts
from geoalbums.operators.filters import is_media
from geoalbums.sources.listing import failed_files, list_tree  # noqa: F401
from geoalbums.sources.shared import hadoop_path, path_exists
from geoalbums.sources.stores import located, open_file, tried, write_file  # noqa: F401


def list_files(spark: SparkSession, roots: Sequence[str], recursive: bool = False) -> DataFrame:
    """path, modified_at, length of the files under the roots, listed by the executors.

    A root that isn't there is left out, see `skipped_roots`, as is what cannot be listed: `list_tree`
    has these with the reason, and `failed_files` collects them.
    """
    return list_tree(spark, roots, recursive).where("error IS NULL").drop("error")


def _why_skipped(spark: SparkSession, root: str) -> str | None:
    try:
        return None if path_exists(spark, root) else "not found"
    except Exception as error:  # whatever a file system raises: the reason goes into the report
        return f"cannot be read: {str(error).splitlines()[0]}"


def skipped_roots(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """root, reason: the roots that a scan leaves out."""
    found = [(root, _why_skipped(spark, root)) for root in roots]
    return spark.createDataFrame([r for r in found if r[1] is not None], "root string, reason string")


def distinct_paths(files: DataFrame, path_col: str = "path") -> DataFrame:
    """One row per path (case counts); roots may overlap."""
    return files.dropDuplicates([path_col])


def scan_media(
    spark: SparkSession,
    roots: Sequence[str],
    recursive: bool = False,
    no_photos: bool = False,
    no_videos: bool = False,
) -> DataFrame:
    """Media files under the roots: file_name, modified_at, length.

    The listing alone is read; the type filter works on the path.
    """
    listed = list_files(spark, roots, recursive).select("path", "modified_at", "length")
    media = distinct_paths(listed.where(is_media(F.col("path"), no_photos, no_videos)))
    return media.withColumnRenamed("path", "file_name")


def scan_counts(files: DataFrame, path_col: str = "path") -> DataFrame:
    """files, duplicates removed, total bytes of the distinct paths, in two aggregation steps."""
    per_path = files.groupBy(path_col).agg(F.count("*").alias("seen"), F.max("length").alias("length"))
    return per_path.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.col("seen") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
    )


def existing_files(spark: SparkSession, destination: str) -> DataFrame:
    """Files already there: file_name, folder (relative to the destination), name, length."""
    root = hadoop_path(spark, destination).rstrip("/")
    listed = list_files(spark, [destination], recursive=True)
    relative = F.regexp_extract(F.col("path"), rf"\Q{root}\E/(.*)\z", 1)
    return listed.select(
        F.col("path").alias("file_name"),
        F.regexp_extract(relative, r"\A(?:(.*)/)?[^/]*\z", 1).alias("folder"),
        F.substring_index(relative, "/", -1).alias("name"),
        "length",
    )


def existing_folders(files: DataFrame) -> DataFrame:
    """Every folder that holds a file, and the folders above it, relative to the destination."""
    steps = F.split("folder", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda depth: F.array_join(F.slice(steps, 1, depth), "/")
    )
    return files.select("folder").distinct().select(F.explode(ancestors).alias("folder")).where(
        F.col("folder") != ""
    ).distinct()


_PREFIX = 64 * 1024
_CHUNK = 4 << 20  # bytes of a file that are held at a time


def _file_digest(path: str, mode: str, most: int | None) -> str:
    """Digest of a file, or of its first `most` bytes."""
    digest = chunked_digest(mode)
    left = most
    with open_file(path) as stream:
        while left is None or left > 0:
            chunk = stream.read(_CHUNK if left is None else min(_CHUNK, left))
            if not chunk:
                break
            digest.update(chunk)
            left = left if left is None else left - len(chunk)
    return digest.hexdigest()


RANGE_BYTES = 64 << 20  # longer files may be read by several tasks


def with_file_digest(
    files: DataFrame, mode: str, path_col: str = "file_name", prefix: bool = False, quarantine: bool = False,
    length_col: str | None = None, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Adds `digest` of each file's whole content, read in chunks where the row is.

    With `prefix` only the first 64 KiB are read: different digests then tell files apart, equal
    ones tell nothing. A file that is gone has no digest; one that cannot be read is an error, so
    that it does not pass for one without twins. With `quarantine` both have the reason in `error`
    instead, and the rest goes on; what a store refuses for a moment is tried again first.

    CRC digests of parts can be put together: given `length_col`, files of more than `range_bytes`
    are read in ranges, by as many tasks. The others' digests need a file's bytes one after the other.
    """
    if mode == "crc" and not prefix and length_col is not None:
        long = F.coalesce(F.col(length_col) > range_bytes, F.lit(False))
        short = with_file_digest(files.where(~long), mode, path_col, quarantine=quarantine)
        ranged = _with_ranged_crc(files.where(long), path_col, length_col, range_bytes)
        if not quarantine:
            stop = F.raise_error(F.concat(F.col(path_col), F.lit(": "), F.col("error"))).cast("string")
            fine = F.col("error").isNull() | (F.col("error") == "not found")
            ranged = ranged.withColumn("digest", F.when(fine, F.col("digest")).otherwise(stop)).drop("error")
        return short.unionByName(ranged.select(*short.columns))
    most = _PREFIX if prefix else None

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tried(lambda: _file_digest(path, mode, most)) for path in batch[path_col]]
            for path, (_, error) in zip(batch[path_col], found):
                if error not in (None, "not found") and not quarantine:
                    raise OSError(f"{path}: {error}")
            out = batch.assign(digest=pd.Series([value for value, _ in found], index=batch.index, dtype=object))
            if quarantine:
                out = out.assign(error=pd.Series([error for _, error in found], index=batch.index, dtype=object))
            yield out

    added = ["digest", "error"] if quarantine else ["digest"]
    kept = [field for field in files.schema.fields if field.name not in added]
    schema = T.StructType([*kept, *[T.StructField(name, T.StringType()) for name in added]])
    return files.select(*[F.col(f"`{f.name}`") for f in kept]).mapInPandas(digest, schema)


def _range_state(path: str, start: int, size: int, whole: int) -> int:
    part, left = Crc64Part(), size
    filesystem, inner = located(path)
    with filesystem.open_input_file(inner) as source:
        if source.size() != whole:
            raise OSError("not of the length it was listed with")
        source.seek(start)
        while left > 0:
            chunk = source.read(min(_CHUNK, left))
            if not chunk:
                raise OSError("ends before its length")
            part.update(chunk)
            left -= len(chunk)
    return part.state


def _with_ranged_crc(files: DataFrame, path_col: str, length_col: str, range_bytes: int) -> DataFrame:
    """Adds `digest` and `error`; a file's ranges are read wherever there is room."""
    whole = F.col("_length")
    paths = files.select(F.col(path_col).alias("_path"), F.col(length_col).alias("_length")).distinct()
    starts = F.sequence(F.lit(0).cast("bigint"), whole - 1, F.lit(range_bytes).cast("bigint"))
    ranges = paths.select("_path", "_length", F.explode(starts).alias("_start"))
    tasks = files.sparkSession.sparkContext.defaultParallelism

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, length, start in batch[["_path", "_length", "_start"]].itertuples(index=False):
                size = min(range_bytes, length - start)
                state, error = tried(lambda: _range_state(path, start, size, length))
                out.append((path, start, size, None if state is None else state.to_bytes(8, "big"), error))
            yield pd.DataFrame(out, columns=["_path", "_start", "_size", "_state", "error"])

    schema = "_path string, _start bigint, _size bigint, _state binary, error string"
    # most expensive first would need their order; dealt out evenly is enough for ranges of one size
    states = ranges.repartition(tasks).mapInPandas(read, schema)
    parts = F.array_sort(F.collect_list(F.struct("_start", "_size", "_state")))  # length / range_bytes of a file
    joined = states.groupBy("_path").agg(parts.alias("_parts"), F.max("error").alias("error"))
    digests = joined.select(
        F.col("_path").alias(path_col), F.when(F.col("error").isNull(), _crc_of_ranges("_parts")).alias("digest"), "error"
    )
    return files.drop("digest", "error").join(digests, path_col)


@F.pandas_udf(T.StringType())
def _crc_of_ranges(parts: pd.Series) -> pd.Series:
    def whole(own) -> str:
        return crc64_of_parts([(part["_size"], int.from_bytes(part["_state"] or b"", "big")) for part in own])

    return parts.map(whole)


def with_content(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds `content`, whole; for files known to be small."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                one = batch.iloc[at : at + 1]
                with open_file(one[path_col].iloc[0]) as stream:
                    yield one.assign(content=[stream.read()])

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    return files.mapInPandas(read, schema)
