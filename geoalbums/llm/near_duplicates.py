"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A document's set is its distinct word shingles. Equal sets are one class with one representative.
Each representative has 64 minwise tokens; two sets of Jaccard similarity J agree in each with
probability J. Every tree branches the representatives by tokens it chooses, one after the other,
until a node is small; small nodes are compared exhaustively over the low bytes of all tokens,
with a margin of four standard deviations. What meets there, in any of the independent trees, is
a coarse group that holds every true link. The full sets of a coarse group are then brought
together (groups beyond `group_shingles` are branched again, in all trees) and every link is
decided exactly.

Cost follows the documents: inside a node or group, a search starts at one member and compares
with what is not reached yet, so that thousands of near copies cost a few passes, not all pairs.
Nothing is capped. Recall of the trees falls with their depth, so whatever is branched again is
also compared with its hubs: the members that hold most of the tokens frequent in their group, as
the original of many edited copies does. A node that no token divides is dealt out around its hubs.

What the trees and the limits of nodes and groups leave out is found exactly after that. Two sets
of the threshold's similarity differ in k shingles at most, by their sizes; of more than k parts of
the shingles' space that either has shingles in, one at least is the same in both. Representatives
that are not linked yet and have such a part in common, other than the parts that may be left aside
as linked sets share several, make up a family, whose members are all compared on full sets: in one
task, or, if they are more than it holds, in pieces, each with each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoalbums.llm.bits import bit_table, may_have
from geoalbums.llm.components import components
from geoalbums.llm.groups import group_bounds, whole_groups
from geoalbums.llm.words import LOWER, SPACED, U64, mix, row_sums, shingles, slices, sorted_sets, words
from geoalbums.sources.shared import materialize

TOKENS = 64
TREES = 8
DEPTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
HUB_DEPTHS = (4, 8, 16, 32)  # nodes that are heavy after so many tokens are compared with hubs of their own
HUBS = 4
_MULTIPLIERS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | U64(1)


@dataclass(frozen=True)
class NearDuplicateConfig:
    """shingle: words of a shingle. Links have 100 * intersection >= percent * union.

    node_rows and group_shingles bound what a task holds for one node and one group; a group of
    at most group_least documents is never branched, however long they are.
    """

    shingle: int = 5
    percent: int = 80
    node_rows: int = 512
    group_shingles: int = 200_000
    group_least: int = 4

    @property
    def least_equal(self) -> int:
        """Tokens that must agree: the expectation at the threshold less four deviations."""
        j = self.percent / 100
        return max(1, math.floor(TOKENS * j - 4 * math.sqrt(TOKENS * j * (1 - j))))


def _sketch_arrays(part, shingle: int):
    w = words(part, SPACED, LOWER)
    keys, first = shingles(w, shingle)
    short = np.repeat(w.counts < shingle, np.diff(first))
    keys = np.where(short, mix(keys ^ U64(0x5851F42D4C957F2D)), keys)
    return keys, first


def _tokens(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of minwise tokens per text that has shingles."""
    has = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(has), TOKENS), dtype=np.int32)
    for t in range(TOKENS if len(has) else 0):
        low = np.minimum.reduceat(mix_cheap(keys, t), first[has])
        out[:, t] = (mix(low) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def mix_cheap(keys: np.ndarray, t: int) -> np.ndarray:
    """The t-th order of shingles: keys are scrambled already, so a rotation and a product do."""
    turn = U64(t)
    turned = (keys << turn) | (keys >> U64((64 - t) % 64)) if t else keys
    return turned * _MULTIPLIERS[t]


SKETCH = "doc_id long, n_shingles long, high long, low long, tokens array<int>, bytes binary"


def sketches(docs: DataFrame, cfg: NearDuplicateConfig) -> DataFrame:
    """Per row: doc_id, size and 128-bit fingerprint of its set, minwise tokens and their low bytes."""
    shingle = cfg.shingle

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                ids = batch.column(0).slice(part.row, part.texts)
                keys, first = _sketch_arrays(part, shingle)
                distinct, bounds = sorted_sets(keys, first)
                tokens = _tokens(keys, first)
                per_text = (np.diff(bounds) > 0).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
                low_bytes = tokens.view(np.uint32).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(row_sums(mix(distinct ^ U64(0xA0761D6478BD642F)), bounds).view(np.int64)),
                        pa.array(row_sums(mix(distinct ^ U64(0xE7037ED1A0B428DB)), bounds).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends * TOKENS), pa.array(tokens.ravel())),
                        pa.Array.from_buffers(
                            pa.binary(), part.texts, [None, pa.py_buffer(ends * np.int32(TOKENS)), pa.py_buffer(low_bytes.tobytes())]
                        ),
                    ],
                    names=["doc_id", "n_shingles", "high", "low", "tokens", "bytes"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, SKETCH)


def _path(depth: int, base: Column) -> Column:
    """The node a row is in after so many branchings of its tree; trees begin at different tokens."""
    chosen = [F.element_at("tokens", ((F.col("tree") * (TOKENS // TREES) + d) % TOKENS + 1).cast("int")) for d in range(depth)]
    return F.xxhash64(base, "tree", *chosen)


def branch(
    rows: DataFrame, base: Column, weight: Column, limit: int, least: int = 1
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Branch (rep, tree, tokens, ...) until a node weighs at most `limit` or has `least` members at most.

    Returns the rows with their `node`, the rows of nodes that still weigh more after the last
    token, whose members agree in all tokens, and the rows of the heavy nodes of each hub depth.
    """
    columns, small, passed = rows.columns, None, []
    for depth in DEPTHS:
        rows = rows.withColumn("node", _path(depth, base))
        heavy = rows.groupBy("node").agg(F.sum(weight).alias("weight"), F.count("*").alias("members"))
        heavy = heavy.where((F.col("weight") > limit) & (F.col("members") > least)).select("node")
        heavy = materialize(heavy, "heavy-nodes")
        done = rows.join(heavy, "node", "left_anti")
        small = done if small is None else small.unionByName(done)
        if heavy.isEmpty():
            return small, rows.limit(0), passed
        rows = materialize(rows.join(heavy, "node", "left_semi"), "branching")
        if depth in HUB_DEPTHS:
            passed.append(rows)
        rows = rows.select(*columns)
    return small, rows.withColumn("node", _path(DEPTHS[-1], base)), passed


def _reach(n: int, linked) -> np.ndarray:
    """For each of n members the first member it is connected with; linked(i, rest) tells which of rest."""
    root = np.arange(n)
    rest = np.arange(1, n)
    head, queue = 0, [0]
    while True:
        while queue and len(rest):
            near = linked(queue.pop(), rest)
            if near.any():
                root[rest[near]] = head
                queue.extend(rest[near].tolist())
                rest = rest[~near]
        if not len(rest):
            return root
        head, rest = int(rest[0]), rest[1:]
        queue = [head]


def _coarse_links(rows: DataFrame, cfg: NearDuplicateConfig) -> DataFrame:
    """Links between members of a node that agree in enough low bytes, one per member at most."""
    least, percent = cfg.least_equal, cfg.percent

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            reps, sizes = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy()
            raw = table.column("bytes").combine_chunks().cast(pa.large_binary())
            offset = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset]
            sigs = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offset : offset + len(raw) * TOKENS].reshape(-1, TOKENS)
            at = group_bounds(table.column("node").to_numpy())
            length = np.diff(at)
            a, b = [], []

            def alike(i, j):
                same = (sigs[i] == sigs[j]).sum(axis=-1) >= least
                return same & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))

            pairs = at[:-1][length == 2]
            met = pairs[alike(pairs, pairs + 1)]
            a.append(reps[met])
            b.append(reps[met + 1])
            for low, n in zip(at[:-1][length > 2].tolist(), length[length > 2].tolist()):
                root = _reach(n, lambda i, rest: alike(low + i, low + rest))
                own = np.flatnonzero(root != np.arange(n))
                a.append(reps[low + root[own]])
                b.append(reps[low + own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    rows = rows.select("node", "rep", "n_shingles", "bytes").repartition("node").sortWithinPartitions("node", "rep")
    return rows.mapInArrow(compare, "a long, b long")


def _exact_links(groups: DataFrame, docs: DataFrame, cfg: NearDuplicateConfig) -> DataFrame:
    """Links confirmed on full sets inside each group (node, rep): one per member at most."""
    shingle, percent = cfg.shingle, cfg.percent

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node: list[int] = []
        reps: list[int] = []
        sets: list[np.ndarray] = []
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            sizes = np.array([len(s) for s in sets])

            def linked(i, rest):
                out = np.zeros(len(rest), dtype=bool)
                low, high = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
                for k in np.flatnonzero(100 * low >= percent * high).tolist():
                    j = int(rest[k])
                    both = _common(sets[i], sets[j])
                    out[k] = 100 * both >= percent * (sizes[i] + sizes[j] - both)
                return out

            if len(sets) > 1:
                for own, root in enumerate(_reach(len(sets), linked).tolist()):
                    if own != root:
                        a.append(reps[root])
                        b.append(reps[own])
            node.clear(), reps.clear(), sets.clear()

        for batch in batches:
            nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(batch.column(2)):
                values, at = sorted_sets(*_sketch_arrays(part, shingle))
                for r in range(part.texts):
                    if node and node[0] != nodes[part.row + r]:
                        close()
                    node[:] = [nodes[part.row + r]]
                    reps.append(ids[part.row + r])
                    sets.append(values[at[r] : at[r + 1]].copy())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a.clear(), b.clear()
        if sets:
            close()
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    rows = groups.join(texts, "rep").select("node", "rep", "text")
    return rows.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(confirm, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1 if len(y) else 0
    return int((y[at] == x).sum()) if len(y) else 0


def _trees(rows: DataFrame, trees: range) -> DataFrame:
    return rows.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in trees])))


def _hubs(rows: DataFrame) -> DataFrame:
    """node, rep: members that hold the most frequent token of their node in most places.

    They are the best of each of HUBS parts of a node, the best of all among them. Counts are
    combined before the shuffle.
    """
    each = rows.select("node", F.posexplode("tokens").alias("place", "token"))
    counted = each.groupBy("node", "place", "token").agg(F.count("*").alias("n"))
    usual = counted.groupBy("node", "place").agg(F.max(F.struct("n", "token")).alias("best"))
    usual = usual.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", F.col("best.token").alias("token")))).alias("usual"))
    usual = materialize(usual, "usual-tokens")
    held = F.size(F.filter(F.zip_with("tokens", F.col("usual.token"), lambda x, y: x == y), lambda same: same))
    scored = rows.join(usual, "node").select(
        "node", "rep", F.pmod(F.xxhash64("rep"), F.lit(HUBS)).alias("part"), F.struct(held, -F.col("rep")).alias("score")
    )
    hubs = scored.groupBy("node", "part").agg(F.max_by("rep", "score").alias("rep")).select("node", "rep")
    return materialize(hubs, "hubs")


def _around_hubs(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Nodes dealt into pieces, with all hubs of the node in every piece."""
    nodes = rows.groupBy("node").agg(F.sum(weight).alias("weight"))
    nodes = nodes.select("node", F.ceil(F.col("weight") / F.lit(limit)).cast("long").alias("pieces"))
    nodes = materialize(nodes, "pieces")
    dealt = rows.join(nodes, "node").select(
        F.xxhash64("node", F.pmod(F.xxhash64("node", "rep"), "pieces")).alias("node"), "rep"
    )
    hubs = _hubs(rows).join(nodes, "node").select(
        F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"), "node", "rep"
    ).select(F.xxhash64("node", "piece").alias("node"), "rep")
    return dealt.unionByName(hubs).distinct()


def _size_classes(largest: int, percent: int) -> list[int]:
    """The smallest size of each class: sets that may be linked are of one class or of neighbours."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(100 * lows[-1] // percent + 1)
    return lows


def _counted_parts(distinct: np.ndarray, bounds: np.ndarray, cfg: NearDuplicateConfig) -> tuple[np.ndarray, ...]:
    """(text, signature, class, least) of the parts of each set, in its own size class and the one below.

    A part without shingles has a signature only in sets that have too few parts with shingles.
    `least` is the number of signatures that a linked set has in common with this one in that class.
    """
    sizes = np.diff(bounds)
    lows = np.array(_size_classes(int(sizes.max(initial=0)), cfg.percent), dtype=np.int64)
    own = np.searchsorted(lows, sizes, "right") - 1
    high32, mixed = distinct >> U64(32), mix(distinct ^ U64(0x2545F4914F6CDD1D))
    found = []
    for step in (0, 1):
        cls = own - step
        smaller = lows[np.minimum(np.maximum(cls, 0) + 1, len(lows) - 1)] - 1  # the most the smaller set has
        differ = (100 - cfg.percent) * (smaller + 100 * smaller // cfg.percent) // (100 + cfg.percent)
        differ[(cls < 0) | (sizes == 0)] = 0
        total = np.where(differ > 0, differ + 4 + differ // 16, 0)
        text = np.repeat(np.arange(len(sizes)), sizes)
        wanted = total[text] > 0
        text = text[wanted]
        part = (high32[wanted] * total[text].astype(U64)) >> U64(32)  # rises with the sorted shingles
        starts = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(part.astype(np.int64), prepend=-1))
        sums = np.add.reduceat(mixed[wanted], starts) if len(starts) else mixed[:0]
        text, part = text[starts], part[starts]
        filled = np.bincount(text, minlength=len(sizes))
        for r in np.flatnonzero((total > 0) & (filled <= differ)).tolist():
            empty = np.setdiff1d(np.arange(total[r], dtype=U64), part[text == r])
            text, part = np.append(text, np.full(len(empty), r)), np.append(part, empty)
            sums = np.append(sums, np.zeros(len(empty), dtype=U64))
        place = (cls[text].astype(U64) << U64(40)) + part
        # of the parts with shingles as many are touched at most as shingles differ
        found.append((text, mix(sums + mix(place ^ U64(0x9E6C63D0876A9A47))), cls[text], np.maximum(1, filled - differ)[text]))
    return tuple(np.concatenate(column) for column in zip(*found))


def _parts(distinct: np.ndarray, bounds: np.ndarray, cfg: NearDuplicateConfig) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of `_counted_parts`."""
    return _counted_parts(distinct, bounds, cfg)[:2]


def _part_rows(docs: DataFrame, cfg: NearDuplicateConfig, only: np.ndarray | None = None) -> DataFrame:
    """signature, high: parts of the sets of all texts, a set by its fingerprint; with `only` those in a table
    of bits, and cls and least beside them."""
    shingle = cfg.shingle

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                distinct, bounds = sorted_sets(*_sketch_arrays(part, shingle))
                high = row_sums(mix(distinct ^ U64(0xA0761D6478BD642F)), bounds).view(np.int64)
                text, signature, cls, least = _counted_parts(distinct, bounds, cfg)
                if only is None:
                    yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(high[text])], names=["signature", "high"])
                    continue
                kept = may_have(only, signature)
                columns = (signature.view(np.int64)[kept], high[text[kept]], cls[kept], least[kept])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["signature", "high", "cls", "least"])

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("text")
    return texts.mapInArrow(draw, "signature long, high long" + ("" if only is None else ", cls long, least long"))


def _open_parts(rows: DataFrame) -> DataFrame:
    """Of (signature, rep, label, ...) those whose signature members of several labels have, with the lowest rep and their number."""
    parts = rows.groupBy("signature").agg(
        F.min("rep").alias("a"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("up")
    )
    return rows.join(parts.where("low <> up").select("signature", "a", "n"), "signature")


def _families(docs: DataFrame, classes: DataFrame, exact: DataFrame, cfg: NearDuplicateConfig) -> DataFrame:
    """node, rep: representatives that may be linked, by the parts they share, with ones they are not linked with yet.

    Linked sets share `least` parts at least, so they share one that is not among the `least` - 1 most
    frequent open ones of either: a part that many texts have, as a phrase of a site, brings nobody together.
    """
    shared = _part_rows(docs, cfg).groupBy("signature").agg(F.min("high").alias("a"), F.max("high").alias("b"))
    shared = materialize(shared.where("a <> b").select("signature"), "shared-parts")
    table = bit_table(shared.select(F.col("signature").alias("key")))
    rows = _part_rows(docs, cfg, table).distinct().join(shared, "signature", "left_semi")
    labels = classes.select("rep", "high").join(exact.select(F.col("node").alias("rep"), "label"), "rep", "left")
    labels = labels.select("high", "rep", F.coalesce("label", "rep").alias("label"))
    rows = materialize(rows.join(labels, "high"), "parts")
    of_set = Window.partitionBy("high", "cls")
    ranked = _open_parts(rows).withColumns(
        {"place": F.row_number().over(of_set.orderBy("n", "signature")), "parts": F.count("*").over(of_set)}
    )
    rare = ranked.where(F.col("place") <= F.col("parts") - F.col("least") + 1).select(*rows.columns)
    members = _open_parts(materialize(rare, "rare-parts"))
    return components(members.select("a", F.col("rep").alias("b"))).select(F.col("label").alias("node"), F.col("node").alias("rep"))


def _in_pieces(groups: DataFrame, classes: DataFrame, limit: int, least: int) -> DataFrame:
    """node, rep: groups as they are; those beyond `limit` shingles and `least` members cut into pieces, any two of which meet in a node."""
    each = classes.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles"))
    rows = materialize(groups.join(each, "rep"), "families")
    sizes = rows.groupBy("node").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("members"))
    pieces = F.least(F.ceil(2 * F.col("weight") / F.lit(limit)), F.ceil(F.col("members") / F.lit(max(1, least // 2)))).cast("long")
    sizes = sizes.where((F.col("weight") > limit) & (F.col("members") > least)).select("node", pieces.alias("pieces"))
    sizes = materialize(sizes, "pieces")
    dealt = rows.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("node", "rep"), "pieces"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    dealt = dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep")
    return rows.join(sizes, "node", "left_anti").select("node", "rep").unionByName(dealt)


def near_duplicates(docs: DataFrame, cfg: NearDuplicateConfig = NearDuplicateConfig()) -> DataFrame:
    """Per row of `docs` (doc_id, text, other columns are ignored): doc_id, n_shingles,
    component_id, kept.

    A-Z are lower-cased, words are what stands between white space, a text of fewer words than a
    shingle is one shingle. component_id is the smallest doc_id reachable over links, the
    document's own included; kept says that it is the document's own. Null and empty texts have
    no shingles, are linked with nothing and are kept. Rows with one doc_id are one document, of
    which every row is returned; a row without doc_id is linked with nothing: its component_id is
    null and it is kept. Ties don't arise: components don't depend on any order.
    """
    drawn = materialize(sketches(docs, cfg), "sketches")
    classes = (
        drawn.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("high", "low", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.min("tokens").alias("tokens"), F.min("bytes").alias("bytes"))
    )
    classes = materialize(classes, "classes")

    plain, stuck, _ = branch(_trees(classes, range(TREES)), F.lit(0), F.lit(1), cfg.node_rows)
    pivots = stuck.join(stuck.groupBy("node").agg(F.min("rep").alias("a")), "node").select("a", F.col("rep").alias("b"))
    coarse = components(_coarse_links(plain, cfg).unionByName(pivots))

    members = coarse.withColumnsRenamed({"node": "rep", "label": "coarse"}).join(classes, "rep")
    members = materialize(members.select("rep", "coarse", "n_shingles", "tokens"), "coarse-groups")
    large = (
        members.groupBy("coarse").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("members"))
        .where((F.col("weight") > cfg.group_shingles) & (F.col("members") > cfg.group_least)).select("coarse")
    )
    large = materialize(large, "large-groups")
    groups = members.join(large, "coarse", "left_anti").select(F.xxhash64("coarse").alias("node"), "rep")
    if not large.isEmpty():
        whole = materialize(members.join(large, "coarse", "left_semi"), "large-members")
        weight = F.col("n_shingles")
        small, stuck, passed = branch(_trees(whole, range(TREES)), F.col("coarse"), weight, cfg.group_shingles, cfg.group_least)
        groups = groups.unionByName(small.select("node", "rep"))
        for rows in [whole.withColumn("node", F.xxhash64("coarse", F.lit("whole"))), *passed, stuck]:
            groups = groups.unionByName(_around_hubs(rows.select("node", "rep", "tokens", "n_shingles"), weight, cfg.group_shingles))
    exact = materialize(components(_exact_links(groups, docs, cfg)), "linked")
    families = _in_pieces(_families(docs, classes, exact, cfg), classes, cfg.group_shingles, cfg.group_least)
    more = _exact_links(families, docs, cfg)
    exact = components(more.unionByName(exact.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    same = drawn.select("doc_id", "n_shingles", "high", "low").join(
        classes.select("high", "low", "n_shingles", "rep"), ["high", "low", "n_shingles"], "left"
    )
    # rows of one doc_id with different sets belong to several classes
    labels = exact.select(F.col("node").alias("rep"), "label")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    out = same.join(labels, "rep", "left").select("doc_id", "n_shingles", found.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
