"""Where every file goes: its album folder, under its own or a numbered name.

Files of one folder arrive in item order. A file whose name is taken is skipped if the file
there has the same length and digest; otherwise `name (1)`, `name (2)` … are tried in turn.

Three cases, told apart before any content is compared:

* quiet: nobody else can want the name. The bulk; a column expression.
* plain: copies and variants of one name, the folder holding none or a gapless run of its
  numbers. Only the first file of each content counts, and the k-th such content gets the k-th
  free number: a rank over ranges, whatever the size of the group.
* tangled: a new file's natural name is a number of another (`a.jpg` and `a (1).jpg`), or the
  folder holds numbers with gaps. Copies are folded into one row per content, and the slots of
  each name are a chain of their own; chains of one depth are walked side by side.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoalbums.config import AlbumConfig
from geoalbums.functions.text import base_name, extension, numbered_name, stem
from geoalbums.operators.joins import left_join_by_weight
from geoalbums.operators.scan import WHOLE, library_keys, ranked
from geoalbums.sources.shared import materialize

PLACE, SKIP, FAILED = "PLACE", "SKIP_IDENTICAL", "FAILED"

_EXISTING = -1  # arrival number of files that were there before

# fixed value: a numbered copy's suffix, as it is written
_NUMBER = r" \(([1-9]\d{0,17})\)"


def _root(name: Column) -> Column:
    """The stem without any trailing ` (n)`."""
    return F.regexp_replace(stem(name), rf"(?:{_NUMBER})+\z", "")


def _parent(name: Column) -> Column:
    """`a (2).jpg` -> `a.jpg`; null for a name without number."""
    bare = stem(name)
    return F.when(
        bare.rlike(rf"{_NUMBER}\z"),
        F.concat(F.regexp_replace(bare, rf"{_NUMBER}\z", ""), extension(name)),
    )


def _number_of(name: Column) -> Column:
    return F.regexp_extract(stem(name), rf"{_NUMBER}\z", 1).try_cast("bigint")


def _ancestors(name: Column) -> Column:
    """All names that could number their way to this one: `a (1) (2).jpg` has two."""
    suffix = stem(name).substr(F.length(_root(name)) + 1, F.length(name))
    groups = F.split(suffix, r"(?<=\))(?= \()")
    return F.transform(
        F.sequence(F.lit(0), F.size(groups) - 1),
        lambda keep: F.concat(
            _root(name), F.array_join(F.slice(groups, F.lit(1), keep), ""), extension(name)
        ),
    )


def placement_manifest(
    items: DataFrame,
    cfg: AlbumConfig,
    existing: DataFrame | None = None,
    add_digest: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per item: library, file_name, album_name, target_name, target_path, action, mode.

    `items` has file_name, album_name, item_no (arrival order within a library) and length, and
    `digest` unless `add_digest` supplies it: that is called with the files whose name somebody
    else wants, and only with those. `existing` has folder, name, length, digest.
    """
    keys = library_keys(cfg.library_cols)
    spot = [*keys, "folder", "name"]
    carried = ["length"] + (["digest"] if "digest" in items.columns else [])
    if keys == [WHOLE] and WHOLE not in items.columns:
        items = items.withColumn(WHOLE, F.lit(0))
    failed = None
    if "error" in items.columns:
        failed = _failed(items.withColumn("folder", F.col("album_name")), keys)
        items = items.where(F.col("error").isNull())
    files = materialize(
        items.select(
            *keys,
            F.col("album_name").alias("folder"),
            base_name(F.col("file_name")).alias("name"),
            "file_name", "item_no", *carried,
        ),
        "placement-files",
    )
    present = None if existing is None else _by_library(existing, keys)
    names = _wanted_names(files, present, spot)
    busy = materialize(_busy_names(names, keys, spot, cfg), "busy-names")

    flagged = left_join_by_weight(
        files, busy, spot, "files", busy.count(), cfg.broadcast_rows, cfg.hot_rows
    )
    quiet = flagged.where(F.col("tangled").isNull()).select(
        *spot, "file_name", F.col("name").alias("target_name"), F.lit(PLACE).alias("action")
    )
    contested = flagged.where(F.col("tangled").isNotNull())
    if add_digest is not None:
        contested = add_digest(contested)
    contested = materialize(contested, "contested-files")
    if "error" in contested.columns:
        unread = _failed(contested, keys)
        failed = unread if failed is None else failed.unionByName(unread)
        contested = contested.where(F.col("error").isNull()).drop("error")
    content = [*spot, "length", "digest"]
    contents = contested.groupBy(*content).agg(
        F.min("item_no").alias("first_no"),
        F.count("*").alias("copies"),
        F.max("tangled").alias("tangled"),
    )
    if present is not None:
        contents = materialize(contents, "distinct-contents")
    contents = materialize(_with_taken_numbers(contents, present, spot, cfg), "contents")
    placed = _place_plain(contents.where(~F.col("tangled")), present, spot, cfg)
    tangled = contents.where("tangled")
    if not tangled.isEmpty():  # seldom
        placed = placed.unionByName(_place_tangled(tangled, present, keys, spot))
    placed = materialize(placed, "placed")
    settled = left_join_by_weight(
        contested, placed, content, "copies", placed.count(), cfg.broadcast_rows, cfg.hot_rows
    ).select(
        *spot, "file_name", "target_name",
        F.when(F.col("item_no") == F.col("first_no"), F.col("action")).otherwise(F.lit(SKIP)).alias("action"),
    )
    placed_or_not = quiet.unionByName(settled).drop("name")
    if failed is not None:
        placed_or_not = placed_or_not.unionByName(failed)
    # libraries have folders of their own, so that no two files are given one target
    target = [*[F.col(c).cast("string") for c in cfg.library_cols], F.col("folder"), F.col("target_name")]
    return placed_or_not.select(
        *cfg.library_cols,
        "file_name",
        F.col("folder").alias("album_name"),
        "target_name",
        F.when(F.col("target_name").isNotNull(), F.concat_ws("/", *target)).alias("target_path"),
        "action",
        F.lit(cfg.mode).alias("mode"),
    )


def _failed(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.where(F.col("error").isNotNull()).select(
        *keys, "folder", "file_name", F.lit(None).cast("string").alias("target_name"), F.lit(FAILED).alias("action")
    )


def _by_library(existing: DataFrame, keys: list[str]) -> DataFrame:
    if keys == [WHOLE] and WHOLE not in existing.columns:
        existing = existing.withColumn(WHOLE, F.lit(0))
    return existing.select(*keys, "folder", "name", "length", "digest")


def _wanted_names(files: DataFrame, present: DataFrame | None, spot: list[str]) -> DataFrame:
    names = files.groupBy(*spot).agg(F.count("*").alias("files"))
    if present is None:
        return names.withColumn("taken", F.lit(False))
    taken = present.select(*spot).distinct().withColumn("taken", F.lit(True))
    return names.join(taken, spot, "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def _busy_names(names: DataFrame, keys: list[str], spot: list[str], cfg: AlbumConfig) -> DataFrame:
    """Names somebody else wants, with `tangled`; quiet names are not listed."""
    family = [*keys, "folder", "_root", "_ext"]
    names = materialize(
        names.withColumn("_stem", stem(F.col("name")))
        .withColumn("_root", _root(F.col("name")))
        .withColumn("_ext", extension(F.col("name"))),
        "wanted-names",
    )
    wanted_twice = (F.col("files") > 1) | F.col("taken")
    # A name with very many numbers is one row here before it is joined.
    reachable = (
        names.where(F.col("_stem") != F.col("_root"))
        .select(*family, F.explode(_ancestors(F.col("name"))).alias("name"))
        .distinct()
    )
    knots = (
        reachable.join(names.where(wanted_twice).select(*spot), spot, "left_semi")
        .select(*family)
        .distinct()
        .withColumn("knot", F.lit(True))
    )
    members = names.groupBy(*family).agg(F.count("*").alias("members"))
    knots = materialize(knots.join(members, family), "knots")
    return (
        left_join_by_weight(
            names, knots, family, "members", knots.count(), cfg.broadcast_rows, cfg.hot_rows
        )
        .where(wanted_twice | F.col("knot").isNotNull())
        .select(*spot, "files", F.coalesce("knot", F.lit(False)).alias("tangled"))
    )


def _taken_numbers(present: DataFrame, spot: list[str]) -> DataFrame:
    """Existing files as numbers of a name: the name itself is 0, `name (n)` is n."""
    name = F.col("name")
    rest = [key for key in spot if key != "name"]
    own = present.withColumn("number", F.lit(0).cast("bigint"))
    numbered = present.where(_parent(name).isNotNull()).select(
        *rest, _parent(name).alias("name"), "length", "digest", _number_of(name).alias("number")
    )
    return own.unionByName(numbered)


def _with_taken_numbers(
    contents: DataFrame, present: DataFrame | None, spot: list[str], cfg: AlbumConfig
) -> DataFrame:
    """Adds `first_free`, and marks as tangled the names whose taken numbers have gaps."""
    if present is None:
        return contents.withColumn("first_free", F.lit(0).cast("bigint"))
    runs = _taken_numbers(present, spot).groupBy(*spot).agg(
        F.count("*").alias("taken"), F.max("number").alias("highest")
    )
    variants = contents.groupBy(*spot).agg(F.count("*").alias("variants"))
    runs = materialize(runs.join(variants, spot), "taken-numbers")
    gapless = F.col("highest") == F.col("taken") - 1
    return left_join_by_weight(
        contents, runs, spot, "variants", runs.count(), cfg.broadcast_rows, cfg.hot_rows
    ).select(
        *[name for name in contents.columns if name != "tangled"],
        (F.col("tangled") | ~F.coalesce(gapless, F.lit(True))).alias("tangled"),
        F.coalesce("taken", F.lit(0)).alias("first_free"),
    )


def _place_plain(contents: DataFrame, present: DataFrame | None, spot: list[str], cfg: AlbumConfig) -> DataFrame:
    content = [*spot, "length", "digest"]
    result = [*content, "first_no", "copies", "target_name", "action"]
    if present is None:
        known, fresh = None, contents
    else:
        there = _taken_numbers(present, spot).groupBy(*content).agg(F.min("number").alias("number"))
        matched = materialize(contents.join(there, content, "left"), "matched-contents")
        known = matched.where(F.col("number").isNotNull()).withColumn("action", F.lit(SKIP))
        fresh = matched.where(F.col("number").isNull()).drop("number")
    numbered = ranked(fresh, spot, ["first_no"], cfg.scan_buckets).withColumn(
        "number", F.col("first_free") + F.col("rank") - 1
    ).withColumn("action", F.lit(PLACE))
    columns = [*content, "first_no", "copies", "number", "action"]
    both = numbered.select(*columns)
    if known is not None:
        both = both.unionByName(known.select(*columns))
    return both.withColumn("target_name", numbered_name(F.col("name"), F.col("number"))).select(*result)


def _depth(name: Column) -> Column:
    """How many ` (n)` a name ends in."""
    return F.when(_parent(name).isNull(), F.lit(0)).otherwise(F.size(_ancestors(name)))


def _place_tangled(contents: DataFrame, present: DataFrame | None, keys: list[str], spot: list[str]) -> DataFrame:
    """Names that get in each other's way, one chain of slots per name instead of one group per family.

    A name's contents try `name`, `name (1)`, `name (2)` … in turn: its chain. Slot n of a chain is
    barred from the moment somebody else is there: from the start where the folder holds it, and
    from the first arrival of a file whose own name it is; both are known beforehand. The name
    itself may be taken by a number of its parent's chain. So chains depend on the chains of
    shorter names only, and all chains of one depth are walked side by side.
    """
    content = [*spot, "length", "digest"]
    columns = [*content, "first_no", "copies", "target_name", "action"]
    contents = materialize(contents.select(*content, "first_no", "copies").withColumn("depth", _depth(F.col("name"))), "tangled")
    depths = sorted(row.depth for row in contents.select("depth").distinct().collect())  # as many as names have numbers
    bars = _bars(contents, present, keys, spot)
    placed: list[DataFrame] = []
    spilled = None  # slots that the chains of the depth before took
    for depth in depths:
        arrivals = contents.where(F.col("depth") == depth).drop("depth")
        barred = bars.where(F.col("depth") == depth).drop("depth")
        if spilled is not None:
            barred = barred.unionByName(spilled)
        walked = _walk_chains(arrivals, barred, spot)
        named = walked.withColumn("target_name", numbered_name(F.col("name"), F.col("number")))
        named = materialize(named, "walked-chains")
        placed.append(named.select(*columns))
        spilled = named.where((F.col("action") == PLACE) & (F.col("number") > 0)).select(
            *[key for key in spot if key != "name"], F.col("target_name").alias("name"),
            F.lit(0).cast("bigint").alias("number"), F.col("first_no").alias("since"), "length", "digest",
        )
    out = placed[0]
    for frame in placed[1:]:
        out = out.unionByName(frame)
    return out


def _bars(contents: DataFrame, present: DataFrame | None, keys: list[str], spot: list[str]) -> DataFrame:
    """Slots of the chains of `contents` that others hold, since when, and the content there."""
    rest = [key for key in spot if key != "name"]
    there = F.struct(F.col("first_no").alias("since"), "length", "digest")
    firsts = contents.groupBy(*spot).agg(F.min(there).alias("there"))
    claims = firsts.where(_parent(F.col("name")).isNotNull()).select(
        *rest, _parent(F.col("name")).alias("name"), _number_of(F.col("name")).alias("number"), "there"
    )
    if present is not None:
        held = _taken_numbers(present, spot).select(
            *spot, "number", F.struct(F.lit(_EXISTING).cast("bigint").alias("since"), "length", "digest").alias("there")
        )
        claims = claims.unionByName(held)
    chains = contents.select(*spot, "depth").distinct()
    held_first = claims.groupBy(*spot, "number").agg(F.min("there").alias("there"))
    return materialize(held_first.join(chains, spot).select(*spot, "depth", "number", "there.*"), "barred-slots")


def _walk_chains(arrivals: DataFrame, barred: DataFrame, spot: list[str]) -> DataFrame:
    """Adds `number` and `action` to the arrivals, which come in order of `first_no` within a chain.

    A chain's barred slots come first, as two numbers each and, where one holds a content of the
    chain itself, the number of that arrival: nothing else of a chain is held.
    """
    content = [*spot, "length", "digest"]
    own = arrivals.select(*content, F.col("first_no").alias("owner"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in content]
    matched = barred.alias("b").join(own.alias("a"), same, "left").select("b.*", "a.owner")
    none = F.lit(None).cast("bigint")
    rows = matched.where("number >= 0").select(
        *spot, F.lit(0).alias("kind"), F.col("number").alias("place"), "since", "owner",
        none.alias("length"), F.lit(None).cast("string").alias("digest"), none.alias("copies"),
    ).unionByName(
        arrivals.select(
            *spot, F.lit(1).alias("kind"), F.col("first_no").alias("place"), none.alias("since"), none.alias("owner"),
            F.col("length").cast("bigint").alias("length"), "digest", "copies",
        )
    )
    kept = [(name, "place" if name == "first_no" else name) for name in arrivals.columns]
    schema = T.StructType([T.StructField(name, rows.schema[source].dataType) for name, source in kept])
    schema = schema.add("number", "long").add("action", "string")
    ordered = rows.repartition(*spot).sortWithinPartitions(*spot, "kind", "place")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: _Chain | None = None
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            taken, numbers, actions = [], [], []
            for row, key in enumerate(zip(*[columns[name] for name in spot])):
                if chain is None or chain.key != key:
                    chain = _Chain(key)
                if columns["kind"][row] == 0:
                    chain.bar(columns["place"][row], columns["since"][row], columns["owner"][row])
                    continue
                number, action = chain.settle(columns["place"][row])
                taken.append(row)
                numbers.append(number)
                actions.append(action)
            if taken:
                settled = batch.take(pa.array(taken))
                values = [settled.column(source) for _, source in kept]
                yield pa.RecordBatch.from_arrays(
                    [*values, pa.array(numbers, pa.int64()), pa.array(actions, pa.string())], names=schema.names
                )

    return ordered.mapInArrow(walk, schema)


class _Chain:
    """The slots of one name while its contents arrive."""

    def __init__(self, key: tuple) -> None:
        self.key = key
        self.numbers, self.since = array("q"), array("q")  # barred slots, in order
        self.owners: dict[int, int] = {}  # where that is an arrival of this chain: by place in the above
        self.next, self.at = 0, 0  # the slot to try next, and the first barred one not below it
        self.met: dict[int, int] = {}  # arrivals whose content was met on the way, and the slot it is in

    def bar(self, number: int, since: int, owner: int | None) -> None:
        if owner is not None:
            self.owners[len(self.numbers)] = owner
        self.numbers.append(number)
        self.since.append(since)

    def settle(self, arrival: int) -> tuple[int, str]:
        while arrival not in self.met:
            slot, self.next = self.next, self.next + 1
            barred = self.at < len(self.numbers) and self.numbers[self.at] == slot
            at, self.at = self.at, self.at + barred
            if not barred or self.since[at] > arrival:
                return slot, PLACE
            if at in self.owners:
                self.met.setdefault(self.owners[at], slot)
        return self.met[arrival], SKIP


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("action").agg(F.count("*").alias("files"))
