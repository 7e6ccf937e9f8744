"""Placement against the rule run over a dictionary, with natural numbers and existing files."""

import random

import pytest

from geoalbums import AlbumConfig
from geoalbums.operators import placement
from geoalbums.operators.placement import _ancestors, manifest_counts, placement_manifest
from pyspark.sql import functions as F

ITEMS = "library int, file_name string, album_name string, item_no bigint, length bigint, digest string"
PRESENT = "library int, folder string, name string, length bigint, digest string"


def split(name):
    dot = name.rfind(".")
    return (name[:dot], name[dot:]) if dot >= 0 else (name, "")


def loop(items, present):
    taken = {(lib, folder, name): (length, digest) for lib, folder, name, length, digest in present}
    out = {}
    for lib, path, folder, number, length, digest in sorted(items, key=lambda i: (i[0], i[3])):
        name = path.rsplit("/", 1)[1]
        stem, ext = split(name)
        candidate, count, action = name, 1, "PLACE"
        while (lib, folder, candidate) in taken:
            if taken[lib, folder, candidate] == (length, digest):
                action = "SKIP_IDENTICAL"
                break
            candidate, count = f"{stem} ({count}){ext}", count + 1
        if action == "PLACE":
            taken[lib, folder, candidate] = (length, digest)
        out[path] = (candidate, action)
    return out


def case(seed):
    rng = random.Random(seed)
    names = ["a.jpg", "a (1).jpg", "a (2).jpg", "a (1) (1).jpg", "b.jpg", "c.jpg", "d (3).jpg", "e", "f (01).jpg"]
    items, number = [], 0
    for library in range(3):
        for folder in ("x", "y", "z/w"):
            for _ in range(rng.choice([3, 12, 30])):
                number += rng.randint(1, 3)
                items.append((library, f"/src{number}/{rng.choice(names)}", folder, number, rng.choice([1, 2]), rng.choice("pqr")))
    present = []
    for library, folder, name in ((0, "x", "a.jpg"), (0, "x", "b (2).jpg"), (1, "x", "c.jpg"), (1, "x", "c (1).jpg"),
                                  (1, "y", "b.jpg"), (1, "y", "b (3).jpg"), (2, "z/w", "a (1).jpg"), (2, "q", "a.jpg")):
        present.append((library, folder, name, rng.choice([1, 2]), rng.choice("pqr")))
    rng.shuffle(items)
    return items, present


@pytest.mark.parametrize("seed,broadcast_rows,hot_rows", [(1, 500_000, 1_000_000), (2, 0, 3), (3, 500_000, 1_000_000)])
def test_against_loop(spark, seed, broadcast_rows, hot_rows):
    items, present = case(seed)
    cfg = AlbumConfig(library_cols=("library",), mode="copy", scan_buckets=5, broadcast_rows=broadcast_rows, hot_rows=hot_rows)
    frame = spark.createDataFrame(items, ITEMS)
    for existing in ([], present):
        there = spark.createDataFrame(existing, PRESENT) if existing else None
        rows = placement_manifest(frame, cfg, there).collect()
        assert {r.file_name: (r.target_name, r.action) for r in rows} == loop(items, existing)
        assert len(rows) == len(items)
        assert all(r.target_path == f"{r.library}/{r.album_name}/{r.target_name}" and r.mode == "copy" for r in rows)
        placed = [r.target_path for r in rows if r.action == "PLACE"]
        assert len(placed) == len(set(placed))  # no target twice, over all libraries


def tangles(seed, names, arrivals, held):
    """One folder full of names that are numbers of each other, some held already, with gaps."""
    rng = random.Random(seed)

    def name():
        numbers = "".join(f" ({rng.randint(1, 6)})" for _ in range(rng.choice([0, 0, 1, 1, 2, 3])))
        return f"{rng.choice(names)}{numbers}.jpg"

    items = [(0, f"/s{i}/{name()}", "x", i, rng.choice([1, 2]), rng.choice("pqrst")) for i in range(arrivals)]
    present = {name(): (rng.choice([1, 2]), rng.choice("pqrst")) for _ in range(held)}
    return items, [(0, "x", key, *content) for key, content in present.items()]


@pytest.mark.parametrize("seed", range(3))
def test_tangled_families_against_loop(spark, seed):
    items, present = [], []
    for library in range(12):  # a case per library
        some, there = tangles(100 * seed + library, "ab", 60 + 20 * library, 3 * library)
        items += [(library, *rest) for _, *rest in some]
        present += [(library, *rest) for _, *rest in there]
    cfg = AlbumConfig(library_cols=("library",), scan_buckets=3)
    rows = placement_manifest(spark.createDataFrame(items, ITEMS), cfg, spark.createDataFrame(present, PRESENT)).collect()
    found = {(r.library, r.file_name): (r.target_name, r.action) for r in rows}
    for library in range(12):
        own = loop([i for i in items if i[0] == library], [x for x in present if x[0] == library])
        assert {k[1]: v for k, v in found.items() if k[0] == library} == own


def test_tangled_family_is_spread(spark):
    """One family of thousands of names: every name is a chain of its own, and tasks share them."""
    present = [(0, "x", f"a ({n}).jpg", 1, str(n % 50)) for n in range(1, 3000) if n % 7]
    items = [(0, f"/s{n}/a ({n % 4000 + 1}).jpg", "x", n, 1, str(n % 91)) for n in range(9000)]
    items += [(0, f"/t{n}/a.jpg", "x", 9000 + n, 1, str(n)) for n in range(500)]
    walk, seen = placement._walk_chains, []

    def watched(arrivals, barred, spot):
        out = walk(arrivals, barred, spot)
        seen.append(out.groupBy(F.spark_partition_id().alias("task")).count().collect())
        return out

    cfg = AlbumConfig(library_cols=("library",), scan_buckets=3)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(placement, "_walk_chains", watched)
        spark.conf.set(merging, "false")  # it would put so little data into one task
        rows = placement_manifest(spark.createDataFrame(items, ITEMS), cfg, spark.createDataFrame(present, PRESENT)).collect()
        spark.conf.unset(merging)
    assert {r.file_name: (r.target_name, r.action) for r in rows} == loop(items, present)
    most = max(seen, key=lambda tasks: sum(t["count"] for t in tasks))
    assert len(most) > 2 and max(t["count"] for t in most) < 0.6 * sum(t["count"] for t in most)


def test_digest_only_where_names_collide(spark):
    items, _ = case(4)
    frame = spark.createDataFrame(items, ITEMS)
    asked = []

    def add_digest(files):
        asked.append({(r.library, r.folder, r.name) for r in files.collect()})
        return files.join(frame.select("library", "file_name", "digest"), ["library", "file_name"])

    lonely = (9, "/src/only.jpg", "x", 10**6, 1, "p")
    cfg = AlbumConfig(library_cols=("library",))
    every = spark.createDataFrame([*items, lonely], ITEMS)
    rows = placement_manifest(every.drop("digest"), cfg, None, add_digest).collect()
    assert {r.file_name: (r.target_name, r.action) for r in rows} == loop([*items, lonely], [])
    assert (9, "x", "only.jpg") not in asked[0]


def test_failed_files_take_no_name(spark):
    """Files that failed before, or whose digest cannot be had, are listed without a target."""
    items, present = case(5)
    bad = {i[1] for i in items if i[3] % 5 == 0}
    frame = spark.createDataFrame([(*i, "gone" if i[1] in bad else None) for i in items], f"{ITEMS}, error string")
    cfg = AlbumConfig(library_cols=("library",), scan_buckets=3)
    there = spark.createDataFrame(present, PRESENT)
    rows = placement_manifest(frame, cfg, there).collect()
    expected = loop([i for i in items if i[1] not in bad], present) | {path: (None, "FAILED") for path in bad}
    assert {r.file_name: (r.target_name, r.action) for r in rows} == expected
    assert all((r.target_path is None) == (r.action == "FAILED") for r in rows)

    def add_digest(files):
        return files.join(frame.select("library", "file_name", "digest", "error"), ["library", "file_name"])

    rows = placement_manifest(frame.drop("digest", "error"), cfg, there, add_digest).collect()
    unread = {r.file_name for r in rows if r.action == "FAILED"}
    assert unread and unread <= bad  # those whose name nobody else wants are not read
    assert len(rows) == len(items)


def test_hot_name_needs_no_group(spark):
    """Many variants and copies of one name, onto a gapless run, are ranked and not grouped."""
    items = [(0, f"/s{i}/a.jpg", "x", i, 1, str(i // 2)) for i in range(400)]
    present = [(0, "x", "a.jpg", 1, "0"), (0, "x", "a (1).jpg", 1, "7")]
    cfg = AlbumConfig(library_cols=("library",), scan_buckets=8, broadcast_rows=0, hot_rows=50)
    manifest = placement_manifest(spark.createDataFrame(items, ITEMS), cfg, spark.createDataFrame(present, PRESENT))
    assert {r.file_name: (r.target_name, r.action) for r in manifest.collect()} == loop(items, present)
    assert {r.action: r.files for r in manifest_counts(manifest).collect()} == {"PLACE": 198, "SKIP_IDENTICAL": 202}


def test_ancestors(spark):
    rows = spark.createDataFrame([("a (1) (2).jpg",), ("a (3)",)], "name string")
    assert [r.a for r in rows.select(_ancestors(F.col("name")).alias("a")).collect()] == [
        ["a.jpg", "a (1).jpg"], ["a"],
    ]
