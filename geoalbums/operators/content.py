"""Identical content: same length and same digest of the whole content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoalbums.config import AlbumConfig
from geoalbums.functions.hashing import content_digest
from geoalbums.operators.joins import left_join_by_weight
from geoalbums.sources.media_files import with_file_digest
from geoalbums.sources.shared import materialize


def _shared(files: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys other rows have too; very frequent keys are split at the join."""
    counted = files.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*keys)
    return files.join(materialize(counted, "shared-keys"), keys, "left_semi")


def digest_candidates(files: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """path, length, digest of all files that have another of their length.

    `files` is a listing (path, length): lengths are compared first, the first 64 KiB of files of
    one length next, and only files that are equal so far are read as a whole, in chunks. A file
    that is gone has no digest, one that cannot be read is an error. Where `files` has a column
    `content`, lengths are compared by the listing alone and digests are computed at the scan, of
    contents that share their length; contents are never shuffled. Every file that can have a twin
    is in the result.
    """
    if "content" in files.columns:
        return _content_digests(files, cfg)
    candidates = _shared(files.select("path", "length"), ["length"])
    screened = with_file_digest(candidates, cfg.hash_mode, "path", prefix=True).withColumnRenamed("digest", "prefix")
    screened = materialize(screened, "prefix-digests")
    alone = screened.groupBy("length", "prefix").agg(F.count("*").alias("n"))
    alone = materialize(alone.where("n = 1 AND prefix IS NOT NULL").select("length", "prefix"), "lone-prefixes")
    rest = screened.where("prefix IS NOT NULL").join(alone, ["length", "prefix"], "left_anti").select("path", "length")
    # what its beginning tells apart already goes by that, marked so that it equals no whole digest
    known = screened.where("prefix IS NULL").select("path", "length", F.lit(None).cast("string").alias("digest"))
    known = known.unionByName(
        screened.join(alone, ["length", "prefix"], "left_semi").select(
            "path", "length", F.concat(F.lit("prefix:"), "prefix").alias("digest")
        )
    )
    return known.unionByName(with_file_digest(rest, cfg.hash_mode, "path", length_col="length"))


def _content_digests(files: DataFrame, cfg: AlbumConfig) -> DataFrame:
    digest = content_digest(F.col("content"), cfg.hash_mode).alias("digest")
    lengths = files.groupBy("length").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("length")
    lengths = materialize(lengths, "shared-lengths")
    if lengths.count() <= cfg.broadcast_rows:
        shared = files.join(F.broadcast(lengths), "length", "left_semi")
        return materialize(shared.select("path", "length", digest), "content-digests")
    digests = materialize(files.select("path", "length", digest), "content-digests")
    return digests.join(lengths, "length", "left_semi")


def duplicate_groups(digests: DataFrame) -> DataFrame:
    """Groups of two or more: length, digest, files, first path.

    Counted first, which combines before the shuffle; paths are looked at in such groups only.
    """
    known = digests.where(F.col("digest").isNotNull())
    counted = known.groupBy("length", "digest").agg(F.count("*").alias("files")).where(F.col("files") > 1)
    counted = materialize(counted, "digest-counts")
    paths = known.join(counted, ["length", "digest"])
    return paths.groupBy("length", "digest", "files").agg(F.min("path").alias("first_path"))


def duplicate_files(digests: DataFrame, cfg: AlbumConfig) -> DataFrame:
    """Every file that has a twin, with the first path of its group; hot groups are split."""
    digests = materialize(digests, "digests")
    groups = materialize(
        duplicate_groups(digests).withColumn("weight", F.col("files")), "duplicate-groups"
    )
    joined = left_join_by_weight(
        digests, groups, ["length", "digest"], "weight", groups.count(), cfg.broadcast_rows, cfg.hot_rows
    )
    return joined.where(F.col("first_path").isNotNull())
