"""The queries: every operator over the given tables, or over what Spark derives from them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoalbums import AlbumConfig, build_albums
from geoalbums.functions import dates, geo, text
from geoalbums.operators import filters, places as place_ops
from geoalbums.operators.albums import album_figures, album_pieces, top_places
from geoalbums.operators.content import digest_candidates, duplicate_files, duplicate_groups
from geoalbums.operators.placement import manifest_counts, placement_manifest
from geoalbums.operators.scan import bucketed
from geoalbums.operators.walk import ORDER, walk, with_album_ids
from geoalbums.plans import report
from geoalbums.plans.outputs import publish_run, read_published
from geoalbums.plans.grouping import prepare, public
from geoalbums.sources import tags as tag_source
from geoalbums.sources.gazetteer import read_geonames
from geoalbums.sources.media_files import (
    distinct_paths, existing_files, failed_files, list_files, list_tree, scan_counts, scan_media, with_file_digest, write_file,
)
from geoalbums.sources.shared import fresh_path, materialize
from geoalbums.sources.state import compact_marks, merge_marks, read_marks, save_marks
from geoalbums.sources.stores import remove_file
from geoalbums.streaming.albums import AlbumStream
from geoalbums.streaming.sessions import session_albums
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

# Settings of the single-library and of the per-owner runs.
ONE = AlbumConfig(time_hours=0.25)
ONE_TIME = AlbumConfig(time_hours=0.25, distance_km=0)
ONE_DISTANCE = AlbumConfig(time_hours=0)
OWNERS = AlbumConfig(library_cols=("owner",))


def media(spark, sf_dir):
    return fx.derived(spark, sf_dir, fx.MEDIA, "events")


def media_owner(spark, sf_dir):
    return fx.derived(spark, sf_dir, fx.MEDIA_OWNER, "events")


def places(spark, sf_dir):
    return fx.derived(spark, sf_dir, fx.PLACES, "customer")


def media_tags(spark, sf_dir):
    """Written first: tags are a table, and a plan over its twelve unions would repeat every step."""
    return materialize(fx.derived(spark, sf_dir, fx.MEDIA_TAGS, "events"), "media-tags")


def media_files(spark, sf_dir):
    return fx.derived(spark, sf_dir, fx.MEDIA_FILES, "events")


def album_state(spark, sf_dir):
    return fx.derived(spark, sf_dir, fx.ALBUM_STATE, "events")


def existing_folders(spark, sf_dir):
    return fx.derived(spark, sf_dir, fx.EXISTING_FOLDERS, "events")


def content_files(spark, sf_dir):
    """Documents as files: path, length in bytes, content."""
    content = F.col("text").cast("binary")
    return fx.derived(spark, sf_dir, fx.CONTENT, "documents").select(
        "path", F.octet_length("text").cast("bigint").alias("length"), content.alias("content")
    )


def located(spark, sf_dir):
    """Distinct positions of all media with both axes."""
    rows = media(spark, sf_dir).where(geo.has_geo_both(F.col("latitude"), F.col("longitude")))
    return rows.select("latitude", "longitude").distinct()


def steps(media_rows, cfg):
    return with_album_ids(walk(bucketed(prepare(media_rows, cfg), cfg.library_cols, ORDER), cfg), cfg)


# --- sources, filters ---------------------------------------------------------------------------


def media_type_filter(spark, sf_dir, no_photos=False, no_videos=False):
    rows = media(spark, sf_dir)
    return rows.where(filters.is_media(F.col("file_name"), no_photos, no_videos)).select("event_id", "file_name")


def scan_dedup_paths(spark, sf_dir):
    """Two overlapping roots: everything, and the videos again."""
    rows = media(spark, sf_dir).select("file_name", "length")
    again = rows.where(filters.is_media(F.col("file_name"), no_photos=True))
    both = rows.where(filters.is_media(F.col("file_name"))).unionByName(again)
    return distinct_paths(both, "file_name").select("file_name")


def scan_report(spark, sf_dir):
    rows = media(spark, sf_dir).where(filters.is_media(F.col("file_name")))
    return scan_counts(rows, "file_name")


def total_bytes(spark, sf_dir):
    return report.total_bytes(media(spark, sf_dir).where(filters.is_media(F.col("file_name"))))


def missing_gps_count(spark, sf_dir):
    return report.missing_positions(media(spark, sf_dir).where(filters.is_media(F.col("file_name"))))


def tag_dates(spark, sf_dir):
    dated = tag_source.tag_dates(media_tags(spark, sf_dir), media_files(spark, sf_dir))
    return dated.select("file_name", "date_created")


def tag_locations(spark, sf_dir):
    found = tag_source.tag_locations(media_tags(spark, sf_dir), media_files(spark, sf_dir))
    return found.select(
        "file_name", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude")
    )


def media_from_tags(spark, sf_dir):
    cfg = AlbumConfig(date_from="2024-01-10", date_to="2024-01-20 12:00")
    found = tag_source.media_from_tags(media_tags(spark, sf_dir), media_files(spark, sf_dir), cfg)
    return found.select(
        "file_name", "date_created",
        F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"),
    )


def date_range(spark, sf_dir):
    cfg = AlbumConfig(date_from="2024-01-05", date_to="2024-01-12T06:30")
    return filters.date_window(media(spark, sf_dir), cfg).select("event_id", "date_created")


def resume_from_mark(spark, sf_dir):
    cfg = AlbumConfig(library_cols=("owner",), date_from="last")
    rows = filters.date_window(media_owner(spark, sf_dir), cfg, album_state(spark, sf_dir))
    return rows.select("event_id", "owner", "date_created")


def exclude_recent(spark, sf_dir):
    cfg = AlbumConfig(exclude_recent=True, now=dt.datetime(2024, 1, 25, 9, 30))
    return filters.date_window(media(spark, sf_dir), cfg).select("event_id", "date_created")


def late_dropped(spark, sf_dir):
    late = filters.late_items(media_owner(spark, sf_dir), OWNERS, album_state(spark, sf_dir))
    return late.groupBy("owner").agg(F.count("*").alias("late"))


def save_mark(spark, sf_dir):
    """Marks saved, run over the rest, saved again, read back."""
    path = fresh_path(spark, "marks")
    cfg = AlbumConfig(library_cols=("owner",), mode="copy")
    rows = media_owner(spark, sf_dir)
    save_marks(filters.date_window(rows, AlbumConfig(date_to="2024-01-16")), path, cfg)
    save_marks(filters.date_window(rows, AlbumConfig(date_to="2024-01-10")), path, cfg)
    resumed = AlbumConfig(library_cols=("owner",), date_from="last", date_to="2024-01-28")
    save_marks(filters.date_window(rows, resumed, read_marks(spark, path, ("owner",))), path, cfg)
    return read_marks(spark, path, ("owner",))


def marks_compacted(spark, sf_dir):
    """A run every third day, marks saved each time, and the table made short twice."""
    path = fresh_path(spark, "marks")
    cfg = AlbumConfig(library_cols=("owner",), mode="copy")
    rows = media_owner(spark, sf_dir)
    for day in range(1, 29, 3):
        save_marks(filters.date_window(rows, AlbumConfig(date_from=f"2024-01-{day:02}", date_to=f"2024-01-{day + 3:02}")), path, cfg)
        if day in (13, 28):
            compact_marks(spark, path, ("owner",))
    return read_marks(spark, path, ("owner",))


def merged_marks(spark, sf_dir):
    rows = filters.date_window(media_owner(spark, sf_dir), AlbumConfig(date_to="2024-01-12"))
    return merge_marks(rows, album_state(spark, sf_dir), ("owner",))


# --- scalar functions ---------------------------------------------------------------------------


def haversine_steps(spark, sf_dir):
    walked = walk(bucketed(prepare(media(spark, sf_dir), ONE_DISTANCE), (), ORDER), ONE_TIME)
    return walked.where(F.col("distance_km").isNotNull()).select(
        "event_id", F.round("distance_km", 6).alias("distance_km")
    )


def sanitize_names(spark, sf_dir):
    name = F.concat(F.lit("  "), F.col("name"), F.lit(": \t*  x  "))
    return places(spark, sf_dir).select(
        "geonameid",
        text.sanitize_name(name).alias("posix"),
        text.sanitize_name(name, AlbumConfig(portable_names=True).invalid_chars).alias("portable"),
    )


def format_place_list(spark, sf_dir):
    """Kinds of event per owner and day, at most a handful, as a list in words."""
    events = fx.table(spark, sf_dir, "events")
    kinds = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_set("event_type")).alias("kinds")
    )
    return kinds.select("user_id", F.col("day").cast("string").alias("day"), text.format_list(F.col("kinds")).alias("words"))


def pluralise_counts(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    per = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).unionByName(
        events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("user_id", F.lit(-1).cast("bigint"))
    )
    return per.select("user_id", "event_type", text.pluralise(F.col("n"), "file", "files").alias("label"))


def iso_texts(spark, sf_dir):
    ts, kind = F.col("ts"), F.col("event_id") % 7
    pattern = {0: "yyyy-MM-dd", 1: "yyyy-MM-dd HH:mm", 2: "yyyy-MM-dd HH:mm:ss",
               3: "yyyy-MM-dd'T'HH:mm", 4: "yyyy-MM-dd'T'HH:mm:ss", 5: "yyyy/MM/dd"}
    column = F.when(kind == 6, F.lit("2024-13-40"))
    for number, layout in pattern.items():
        column = column.when(kind == number, F.date_format(ts, layout))
    return fx.table(spark, sf_dir, "events").select("event_id", column.alias("iso"))


def parse_iso_dates(spark, sf_dir):
    return iso_texts(spark, sf_dir).select(
        "event_id", dates.parse_iso8601_col(F.col("iso")).alias("parsed")
    )


def date_names(spark, sf_dir):
    ts = F.col("ts")
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        dates.net_format(ts, "dd MMM yyyy").alias("usual"),
        dates.net_format(ts, "dddd d MMMM yy, HH:mm:ss").alias("long_form"),
        dates.net_format(ts, "MM/dd/yyyy 'at' h tt").alias("slashes"),
        dates.net_format(ts, "YYYY-MM").alias("unknown_letters"),
    )


def template_paths(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        *[
            dates.expand_template(template, F.col("ts"), F.col("event_type")).alias(name)
            for name, template in (
                ("plain", "Trip to "), ("year", "<yyyy>/"), ("month", "<yyyy>/<MM>_"),
                ("words", "Year <yyyy>/<MMMM>/"), ("rooted", "/abs"), ("open", "<yyyy"),
            )
        ],
    )


def violation_paths(spark, sf_dir):
    kind = F.col("c_custkey") % 6
    path = (
        F.when(kind == 0, F.lit("con")).when(kind == 1, F.concat(F.lit("2024/"), F.col("c_name")))
        .when(kind == 2, F.lit("  ")).when(kind == 3, F.lit("a/LPT1/b: c"))
        .when(kind == 4, F.lit("COM1.txt")).otherwise(F.concat(F.col("c_mktsegment"), F.lit("?")))
    )
    return fx.table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))


def name_violations(spark, sf_dir):
    portable = AlbumConfig(portable_names=True).invalid_chars
    return violation_paths(spark, sf_dir).select(
        "c_custkey",
        F.array_join(text.name_violations(F.col("path")), "; ").alias("posix"),
        F.array_join(text.name_violations(F.col("path"), portable), "; ").alias("portable"),
    )


# --- places -------------------------------------------------------------------------------------


def places_relevant(precision):
    def query(spark, sf_dir):
        return place_ops.relevant_places(places(spark, sf_dir), precision)

    return query


def geonames_text_reader(spark, sf_dir):
    """Places written as a dump, with malformed lines between, and read back."""
    rows = places(spark, sf_dir)
    blank = F.lit("")
    fields = [
        F.col("geonameid").cast("string"), F.col("name"), blank, blank,
        F.col("latitude").cast("string"), F.col("longitude").cast("string"),
        F.col("feature_class"), F.col("feature_code"), F.col("country"), blank, F.col("admin1"),
        blank, blank, blank, F.col("population").cast("string"), blank, blank, blank, blank,
    ]
    line = F.concat_ws("\t", *fields)
    bad = [
        blank,
        F.concat(F.lit("# "), line),
        F.concat_ws("\t", *fields[:10]),
        F.concat_ws("\t", *fields[:4], F.lit("abc"), *fields[5:]),
    ]
    path = fresh_path(spark, "dump")
    rows.select(F.explode(F.array(line, *bad)).alias("value")).write.text(path)
    return place_ops.relevant_places(read_geonames(spark, path), 3).select(
        "geonameid", "name", "latitude", "longitude", "feature_class", "feature_code", "country",
        "admin1", F.col("population").cast("bigint").alias("population"),
    )


def places_near_media(spark, sf_dir):
    return place_ops.places_near(places(spark, sf_dir), media(spark, sf_dir)).select("geonameid", "name")


def places_load_counts(spark, sf_dir):
    """Relevant places and those kept, as the load counted them."""
    _, total, kept = place_ops.load_gazetteer(places(spark, sf_dir), media(spark, sf_dir), AlbumConfig())
    return spark.range(1).select(F.lit(total).cast("long").alias("total"), F.lit(kept).cast("long").alias("kept"))


def box_join(spark, sf_dir):
    pairs = place_ops.box_join(located(spark, sf_dir), places(spark, sf_dir), 0.01, AlbumConfig())
    return pairs.select("latitude", "longitude", "place_geonameid")


def nearest_place(precision):
    def query(spark, sf_dir):
        cfg = AlbumConfig(precision=precision)
        found = place_ops.nearest_places(located(spark, sf_dir), places(spark, sf_dir), cfg)
        return found.select(
            "latitude", "longitude", F.coalesce("tier", F.lit(0)).alias("tier"),
            F.coalesce("geonameid", F.lit(-1)).alias("geonameid"), "name",
            F.round("distance_km", 6).alias("distance_km"),
        )

    return query


def enrich_media(spark, sf_dir):
    rows = prepare(media(spark, sf_dir), ONE)
    return place_ops.enrich(rows, places(spark, sf_dir), ONE).select("event_id", "location_name")


# --- the walk -----------------------------------------------------------------------------------


def walked(spark, sf_dir, cfg=ONE, rows=media):
    return walk(bucketed(prepare(rows(spark, sf_dir), cfg), cfg.library_cols, ORDER), cfg)


def impute_locations(spark, sf_dir):
    return walked(spark, sf_dir).select("event_id", "latitude", "longitude")


def impute_audit(spark, sf_dir):
    return walked(spark, sf_dir).where(F.col("source_file").isNotNull()).select(
        "event_id", "source_file", "source_gap", "rejected_file",
        F.coalesce("rejected_gap", F.lit(-1)).alias("rejected_gap"),
    )


def album_ids(cfg, rows=media):
    def query(spark, sf_dir):
        return steps(rows(spark, sf_dir), cfg).select("event_id", *cfg.library_cols, "album_id")

    return query


def album_breaks(spark, sf_dir):
    breaks = build_albums(media(spark, sf_dir), ONE).breaks
    return breaks.select(
        "event_id", "prev_file", F.round("gap_hours", 6).alias("gap_hours"),
        F.round("distance_km", 6).alias("distance_km"), "time_break", "distance_break",
        "prev_name", "curr_name",
    )


def album_break_texts(spark, sf_dir):
    return build_albums(media(spark, sf_dir), ONE).breaks.select("event_id", "prev_name", "curr_name", "reason")


def imputation_texts(spark, sf_dir):
    found = build_albums(media(spark, sf_dir), ONE).imputations
    return found.select("event_id", "source_name", "source_gap_text", F.coalesce("rejected_gap_text", F.lit("none")).alias("rejected_gap_text"))


def album_dates(spark, sf_dir):
    figures = album_figures(album_pieces(steps(media_owner(spark, sf_dir), OWNERS), OWNERS), OWNERS)
    return figures.select("owner", "album_id", "first_date", "last_date", "files")


def album_top_places(spark, sf_dir):
    rows = place_ops.enrich(prepare(media(spark, sf_dir), ONE), places(spark, sf_dir), ONE)
    found = top_places(steps(rows, ONE), ONE)
    return found.select("album_id", F.array_join("places", "|").alias("places"))


def album_names(cfg, with_places, rows=media):
    def query(spark, sf_dir):
        run = build_albums(rows(spark, sf_dir), cfg, places(spark, sf_dir) if with_places else None)
        return run.albums.select(*cfg.library_cols, "album_id", "album_name", "part")

    return query


def album_unique_names(spark, sf_dir):
    cfg = AlbumConfig(time_hours=0.25, distance_km=0, avoid_existing=True)
    run = build_albums(media(spark, sf_dir), cfg, existing_folders=existing_folders(spark, sf_dir))
    return run.albums.select("album_id", "album_name")


def album_catalog(spark, sf_dir):
    run = build_albums(media_owner(spark, sf_dir), OWNERS)
    catalog = report.album_catalog(run.albums, OWNERS, "/albums")
    return catalog.select("owner", "album_name", "album_path", "album_date", "files")


def album_preview(spark, sf_dir):
    run = build_albums(media(spark, sf_dir), ONE)
    return report.album_preview(run.albums, ONE)


def file_preview(spark, sf_dir):
    run = build_albums(media(spark, sf_dir), ONE)
    return report.file_preview(run.items, ONE)


def run_totals(spark, sf_dir):
    run = build_albums(media(spark, sf_dir), ONE)
    return report.run_totals(run.albums, ONE)


# --- content and placement ----------------------------------------------------------------------


def content_duplicates(mode):
    """Groups of identical content, named by their first path; digests differ between engines."""

    def query(spark, sf_dir):
        digests = digest_candidates(content_files(spark, sf_dir), AlbumConfig(hash_mode=mode))
        return duplicate_groups(digests).select("length", "files", "first_path")

    return query


def content_twins(spark, sf_dir):
    cfg = AlbumConfig(hash_mode="md5")
    digests = digest_candidates(content_files(spark, sf_dir), cfg)
    return duplicate_files(digests, cfg).select("path", "digest", "first_path")


def long_contents(spark, sf_dir):
    """Documents as files of over 64 KiB that differ in their last bytes only, or not at all."""
    head = F.rpad(F.lit("head of a long file "), 70_000, ".")
    tail = F.lpad((F.col("doc_id") % 100).cast("string"), 8, "0")
    return fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/long/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("path"),
        F.lit(70_008).cast("bigint").alias("length"),
        F.concat(head, tail).cast("binary").alias("content"),
    )


def content_same_prefix(spark, sf_dir):
    """One length and one beginning, different ends: no twins."""
    digests = digest_candidates(long_contents(spark, sf_dir), AlbumConfig(hash_mode="crc"))
    return duplicate_groups(digests).select("length", "files", "first_path")


def written_tree(spark, sf_dir):
    """Documents written as files below one new folder, by the executors; odd folders hold text files."""
    root = fresh_path(spark, "tree")

    def write(batches):
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                write_file(f"{root}/{name}", bytes(content))
            yield batch[["name"]]

    source, number = F.col("source"), F.col("doc_id").cast("string")
    ending = F.when(F.col("doc_id") % 5 == 0, ".txt").when(F.col("doc_id") % 5 == 1, ".MP4").otherwise(".jpg")
    rows = fx.table(spark, sf_dir, "documents").select(
        F.concat(source, F.lit("/d"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), number, ending).alias("name"),
        F.col("text").cast("binary").alias("content"),
    )
    materialize(rows.mapInPandas(write, "name string"), "written-names")
    return root


def _below(root):
    return F.regexp_extract("path", r"/(tree-[^/]*/.*)\z", 1).substr(F.lit(len("tree-") + 34), F.lit(1000))


def scan_files(spark, sf_dir):
    """Media found below a root that holds other files too."""
    root = written_tree(spark, sf_dir)
    found = scan_media(spark, [root], recursive=True).withColumnRenamed("file_name", "path")
    return found.select(_below(root).alias("name"), "length")


def existing_listing(spark, sf_dir):
    """Folders of a destination with their files and bytes."""
    root = written_tree(spark, sf_dir)
    files = existing_files(spark, root)
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("total_bytes"))


def content_files_twins(spark, sf_dir):
    """Twins among files: only those of one length and beginning are read as a whole."""
    root = written_tree(spark, sf_dir)
    listed = list_files(spark, [root], recursive=True).select("path", "length")
    cfg = AlbumConfig(hash_mode="sha")
    twins = duplicate_files(digest_candidates(listed, cfg), cfg)
    return twins.select(_below(root).alias("name"), "length")


def content_crc_ranges(spark, sf_dir):
    """Twins by CRC, files of over 512 bytes read in ranges of that size by any task."""
    root = written_tree(spark, sf_dir)
    listed = list_files(spark, [root], recursive=True).select("path", "length")
    digests = materialize(with_file_digest(listed, "crc", "path", length_col="length", range_bytes=512), "ranged-digests")
    twins = duplicate_files(digests, AlbumConfig(hash_mode="crc"))
    return twins.select(_below(root).alias("name"), "length")


def _doc():
    return F.regexp_extract("path", r"/(\d+)\.[^/.]*\z", 1).cast("bigint")


def digests_of_a_shrinking_tree(spark, sf_dir):
    """Root, listing and digests, where every seventh file goes between the two, and one root is not there."""
    root = written_tree(spark, sf_dir)
    listed = materialize(list_tree(spark, [root, f"{root}/nowhere"], recursive=True), "listing")
    good = listed.where("error IS NULL")

    def remove(batches):
        for batch in batches:
            for path in batch["path"]:
                remove_file(path)
            yield batch

    materialize(good.where(_doc() % 7 == 3).select("path").mapInPandas(remove, "path string"), "removed")
    digests = with_file_digest(good, "md5", "path", quarantine=True)
    return root, listed, materialize(digests, "quarantined-digests")


def failed_files_query(spark, sf_dir):
    root, listed, digests = digests_of_a_shrinking_tree(spark, sf_dir)
    return failed_files(listed, digests).select(_below(root).alias("name"), "reason")


def placement_failures(spark, sf_dir):
    """What became of the files of each source, the lost ones too; names are the documents' last digit."""
    _, _, digests = digests_of_a_shrinking_tree(spark, sf_dir)
    source = F.regexp_extract("path", r"([^/]*)/[^/]*/[^/]*\z", 1)
    name = F.concat(F.lit("/"), F.regexp_extract("path", r"(\d)\.[^/.]*\z", 1), F.lit(".jpg"))
    items = digests.select(
        F.concat("path", name).alias("file_name"), source.alias("album_name"), _doc().alias("item_no"), "length", "digest", "error"
    )
    manifest = placement_manifest(items, ONE)
    return manifest.groupBy("album_name", "action").agg(F.count("*").alias("files"))


def content_long_twins(spark, sf_dir):
    """Files of some hundred kilobytes: 200 documents each, written twice, and once more with another end.

    One length and one beginning: the first 64 KiB tell nothing, and all are read as a whole.
    """
    root = fresh_path(spark, "blocks")
    docs = fx.table(spark, sf_dir, "documents")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    blocks = docs.groupBy(F.floor(F.col("doc_id") / 200).alias("block")).agg(F.array_join(texts, "\n").cast("binary").alias("content"))

    def write(batches):
        for batch in batches:
            for block, content in zip(batch["block"], batch["content"]):
                for name, end in (("a", b"."), ("b", b"."), ("c", b"!")):
                    write_file(f"{root}/{block}/{name}.mp4", bytes(content) + end)
            yield batch[["block"]]

    materialize(blocks.mapInPandas(write, "block long"), "written-blocks")
    cfg = AlbumConfig(hash_mode="crc")
    listed = list_files(spark, [root], recursive=True).select("path", "length")
    twins = duplicate_files(digest_candidates(listed, cfg), cfg)
    name = F.regexp_extract("path", r"([^/]*/[^/]*)\z", 1)
    return twins.select(name.alias("name"), "length", F.regexp_extract("first_path", r"([^/]*/[^/]*)\z", 1).alias("first_name"))


def placement_items(spark, sf_dir, cfg):
    return build_albums(media(spark, sf_dir), cfg).items.withColumnRenamed("content_md5", "digest")


def placement_manifest_query(spark, sf_dir):
    manifest = placement_manifest(placement_items(spark, sf_dir, ONE_DISTANCE), ONE_DISTANCE)
    return manifest.select("file_name", "album_name", "target_name", "target_path", "action")


def existing_media(spark, sf_dir, items):
    """The first content of every third file name, already in its folder."""
    name = text.base_name(F.col("file_name"))
    return (
        items.where(F.regexp_extract("file_name", r"IMG_(\d+)", 1).cast("int") % 3 == 0)
        .groupBy(F.col("album_name").alias("folder"), name.alias("name"))
        .agg(F.min_by(F.struct("length", "digest"), "item_no").alias("content"))
        .select("folder", "name", "content.*")
    )


def placement_onto_existing(spark, sf_dir):
    items = placement_items(spark, sf_dir, ONE_DISTANCE)
    existing = materialize(existing_media(spark, sf_dir, items), "existing")
    manifest = placement_manifest(items, ONE_DISTANCE, existing)
    return manifest.select("file_name", "album_name", "target_name", "action")


def placement_tangled(spark, sf_dir):
    """Names that are numbers of each other, onto folders that hold numbers with gaps."""
    items = fx.derived(spark, sf_dir, fx.TANGLED, "events").withColumnRenamed("folder", "album_name")
    existing = fx.derived(spark, sf_dir, fx.TANGLED_EXISTING, "events")
    return placement_manifest(items, ONE, existing).select("file_name", "album_name", "target_name", "action")


def placement_counts(spark, sf_dir):
    return manifest_counts(placement_manifest(placement_items(spark, sf_dir, ONE_DISTANCE), ONE_DISTANCE))


def written_run(spark, sf_dir):
    """A run published twice over, and what is read back: per album, files and what became of them."""
    cfg = AlbumConfig(time_hours=0, mode="copy")
    run = build_albums(media(spark, sf_dir).withColumnRenamed("content_md5", "digest"), cfg)
    folder = fresh_path(spark, "published")
    for _ in range(2):
        publish_run(run, cfg, folder, state_path=f"{folder}/marks")
    found = read_published(spark, folder)
    acts = found.manifest.groupBy("album_name").agg(
        F.count_if(F.col("action") == "PLACE").alias("placed"), F.count_if(F.col("action") != "PLACE").alias("skipped")
    )
    saved = read_marks(spark, f"{folder}/marks")
    return found.catalog.select("album_name", "album_path", "album_date", "files").join(acts, "album_name").withColumn(
        "run", F.lit(found.number)
    ).withColumn("mark", saved.select("last_processed").scalar())


# --- streams ------------------------------------------------------------------------------------

SESSIONS = AlbumConfig(time_hours=24, distance_km=0, library_cols=("user_id",))


def stream_sessions(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        .select("user_id", F.col("ts").alias("date_created"))
    )
    out = fresh_path(spark, "sessions")
    run = (
        session_albums(stream, SESSIONS).writeStream.outputMode("append").format("parquet")
        .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


_PORTIONS = (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01"))


def _streamed(spark, rows, cfg, *, before=None):
    """The stream's job after media came in three portions of ten days, `before` ahead of the last."""
    out = fresh_path(spark, "stream")
    job = AlbumStream(cfg, f"{out}/result")
    for number, (start, end) in enumerate(_PORTIONS):
        portion = filters.date_window(rows, AlbumConfig(date_from=start, date_to=end))
        if before is not None and number == len(_PORTIONS) - 1:
            portion = portion.unionByName(before)
        portion.write.mode("append").parquet(f"{out}/incoming")
        stream = spark.readStream.schema(rows.schema).parquet(f"{out}/incoming")
        job.start(stream, f"{out}/checkpoint").awaitTermination()
    return job


def stream_albums(spark, sf_dir):
    """Media arriving in three portions of ten days."""
    closed = _streamed(spark, media(spark, sf_dir), ONE).closed_items(spark)
    return closed.select("file_name", "date_created", "latitude", "longitude", "album_id", "album_name", "part")


def stream_albums_by_owner(spark, sf_dir):
    """Owners of whom many fall idle: their albums close by the newest item of all."""
    closed = _streamed(spark, media_owner(spark, sf_dir), OWNERS).closed_items(spark)
    return closed.select("owner", "file_name", "album_id", "part")


def stream_flush(spark, sf_dir):
    """The same, ended: every item is in an album."""
    job = _streamed(spark, media_owner(spark, sf_dir), OWNERS)
    job.close_all(spark)
    return job.closed_items(spark).select("owner", "file_name", "album_id", "part")


def stream_late(spark, sf_dir):
    """Items that come after what they belong to was closed: a copy of one day, three weeks late."""
    rows = media(spark, sf_dir)
    day = filters.date_window(rows, AlbumConfig(date_from="2024-01-03", date_to="2024-01-04"))
    late = _streamed(spark, rows, ONE, before=day).late_items(spark)
    return late.select("file_name", "date_created")


# --- everything together ------------------------------------------------------------------------


def grouping_run(spark, sf_dir):
    cfg = AlbumConfig(time_hours=0.25, append_format="MMM yyyy", album_prefix="<yyyy>/", precision=3)
    run = build_albums(media(spark, sf_dir), cfg, places(spark, sf_dir))
    return run.items.select("event_id", "location_name", "album_id", "album_name", "part")


def queries() -> dict[str, Query]:
    append = AlbumConfig(time_hours=0.25, append_format="MMMM yyyy")
    prefix = AlbumConfig(album_prefix="<yyyy>/<MM>_", library_cols=("owner",))
    return {
        "media_type_filter": media_type_filter,
        "photos_only": lambda s, d: media_type_filter(s, d, no_videos=True),
        "videos_only": lambda s, d: media_type_filter(s, d, no_photos=True),
        "scan_dedup_paths": scan_dedup_paths,
        "scan_report": scan_report,
        "total_bytes": total_bytes,
        "missing_gps_count": missing_gps_count,
        "tag_dates": tag_dates,
        "tag_locations": tag_locations,
        "media_from_tags": media_from_tags,
        "date_range": date_range,
        "resume_from_mark": resume_from_mark,
        "exclude_recent": exclude_recent,
        "late_dropped": late_dropped,
        "save_mark": save_mark,
        "marks_compacted": marks_compacted,
        "merged_marks": merged_marks,
        "haversine_steps": haversine_steps,
        "sanitize_names": sanitize_names,
        "format_place_list": format_place_list,
        "pluralise_counts": pluralise_counts,
        "parse_iso_dates": parse_iso_dates,
        "date_names": date_names,
        "template_paths": template_paths,
        "name_violations": name_violations,
        "places_relevant_p1": places_relevant(1),
        "places_relevant_p2": places_relevant(2),
        "places_relevant_p3": places_relevant(3),
        "geonames_text_reader": geonames_text_reader,
        "places_near_media": places_near_media,
        "places_load_counts": places_load_counts,
        "box_join": box_join,
        "nearest_place_p1": nearest_place(1),
        "nearest_place_p2": nearest_place(2),
        "nearest_place_p3": nearest_place(3),
        "enrich_media": enrich_media,
        "impute_locations": impute_locations,
        "impute_audit": impute_audit,
        "album_ids": album_ids(ONE),
        "album_ids_time_only": album_ids(ONE_TIME),
        "album_ids_distance_only": album_ids(ONE_DISTANCE),
        "album_ids_by_owner": album_ids(OWNERS, media_owner),
        "album_breaks": album_breaks,
        "album_break_texts": album_break_texts,
        "imputation_texts": imputation_texts,
        "album_dates": album_dates,
        "album_top_places": album_top_places,
        "album_names_dates": album_names(ONE, False),
        "album_names_places": album_names(ONE, True),
        "album_names_append": album_names(append, True),
        "album_names_prefix": album_names(prefix, False, media_owner),
        "album_unique_names": album_unique_names,
        "album_parts": album_names(ONE_TIME, False),
        "album_no_parts": album_names(AlbumConfig(time_hours=0.25, use_part_numbers=False), False),
        "album_catalog": album_catalog,
        "album_preview": album_preview,
        "file_preview": file_preview,
        "run_totals": run_totals,
        "content_duplicates_md5": content_duplicates("md5"),
        "content_duplicates_sha": content_duplicates("sha"),
        "content_duplicates_prefix": content_duplicates("crc"),
        "content_twins": content_twins,
        "content_same_prefix": content_same_prefix,
        "content_files_twins": content_files_twins,
        "content_crc_ranges": content_crc_ranges,
        "content_long_twins": content_long_twins,
        "scan_files": scan_files,
        "failed_files": failed_files_query,
        "existing_listing": existing_listing,
        "placement_manifest": placement_manifest_query,
        "placement_onto_existing": placement_onto_existing,
        "placement_tangled": placement_tangled,
        "placement_failures": placement_failures,
        "written_run": written_run,
        "placement_counts": placement_counts,
        "stream_sessions": stream_sessions,
        "stream_albums": stream_albums,
        "stream_albums_by_owner": stream_albums_by_owner,
        "stream_flush": stream_flush,
        "stream_late": stream_late,
        "grouping_run": grouping_run,
    }
