"""The prefix trie of conversations, by digests of fixed-length blocks of turns.

A turn is an MD5 digest and a number of words; texts are read once and never shuffled. Blocks of
four turns, blocks of four blocks and so on are digested level by level, and the digest of a prefix
is put together from the levels above: however long a conversation is, its prefixes follow from as
many steps as its length has digits. Conversations that enter a block with one prefix are a group.
A group all of whose members have the same block is not looked into: one of them stands for all
turn boundaries inside. Only where siblings diverge are the turns of a block grouped one by one.

Sums over subtrees need no walk over depths. A node is owned by its smallest member; along a
conversation the nodes it owns are the last ones, a chain. What a node's subtree holds is the rest
of its owner's chain and the whole chains of its other members, so one sum over members is enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoalbums.operators.joins import left_join_by_weight
from geoalbums.operators.scan import BUCKET, bucketed, carried_sum, join_carry, ranked, up_to_here
from geoalbums.sources.shared import materialize

_ROOT = ""
_WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class TrieConfig:
    block: int = 4  # turns of a block, blocks of a block of blocks, and so on
    bounded_ends: int = 4096  # conversations that end at one node and are listed in one row
    broadcast_rows: int = 100_000
    hot_rows: int = 100_000

    def __post_init__(self) -> None:
        if self.block < 2 or self.bounded_ends < 1:
            raise ValueError("block must be at least 2 and bounded_ends at least 1")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1, 2, …), digest, n_words: turns in order, null turns first, then by digest.

    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out.
    A conversation of any length is numbered over ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))).cast("long").alias("n_words"),
    )
    placed = ranked(turns, ["conv_id"], ["turn", "digest"])
    return placed.select("conv_id", F.col("rank").cast("long").alias("pos"), F.unhex("digest").alias("digest"), "n_words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are rebuilt: (conv_id, pos, digest, n_words) and (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % 20, h = crc32(c) % 4, and
    goes on with its own turns after its first h.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    turn = F.struct("pos", "digest", "n_words")
    heads = turns.where((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(turn)).alias("head")  # three at most
    )
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base", "left")
    first = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,n_words:bigint>>")), F.lit(1), F.col("h").cast("int"))
    convs = convs.select("conv_id", "own", "h", first.alias("first"))
    convs = materialize(
        convs.withColumn("length", F.size("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-conversations"
    )
    shift = convs.where(F.size("first") < F.col("h")).select("conv_id", (F.col("h") - F.size("first")).alias("missing"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    rest = turns.where(F.col("pos") > h).join(shift, "conv_id", "left")
    rest = rest.withColumn("pos", F.col("pos") - F.coalesce("missing", F.lit(0))).drop("missing")
    borrowed = convs.select("conv_id", F.explode("first").alias("turn")).select("conv_id", "turn.*")
    return rest.unionByName(borrowed), convs.select("conv_id", "length")


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _below(before: Column, after: Column, digests: Column, r: Column, block: int) -> tuple[Column, Column]:
    """Prefix digests before and after child r of a block, from those of the block itself."""

    def upto(n: Column) -> Column:
        return F.unhex(F.md5(F.concat(before, _joined(F.slice(digests, F.lit(1), n)))))

    return (
        F.when(r == 0, before).otherwise(upto(r)),
        F.when(r == block - 1, after).otherwise(upto(r + 1)),
    )


def prefixed_blocks(turns: DataFrame, longest: int, block: int) -> DataFrame:
    """conv_id, k, before, after, digest, turns: blocks of turns with the digests of the prefixes that
    end where the block begins and ends."""
    place = F.col("pos") - 1
    units = turns.groupBy("conv_id", F.floor(place / block).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "n_words"))).alias("turns")  # `block` at most
    )
    units = units.withColumn("digest", F.unhex(F.md5(_joined(F.col("turns.digest")))))
    bottom = materialize(units, "trie-blocks")
    levels, size, top = [], block, bottom.select("conv_id", "k", "digest")
    while size <= longest:  # until one unit holds any conversation and is never full
        top = materialize(
            top.groupBy("conv_id", F.floor(F.col("k") / block).alias("k")).agg(
                F.array_sort(F.collect_list(F.struct("k", "digest"))).alias("parts")
            ).withColumn("digest", F.unhex(F.md5(_joined(F.col("parts.digest"))))),
            "trie-level",
        )
        levels.append(top)
        size *= block
    start = F.lit(_ROOT).cast("binary")
    prefixes = None  # conv_id, k, before, after of the level below
    for level in reversed(levels):
        if prefixes is None:
            known = level.withColumn("before", start).withColumn("after", start)
        else:
            known = level.join(prefixes, ["conv_id", "k"])
        parts = known.select("conv_id", "before", "after", F.col("parts.digest").alias("digests"), F.posexplode("parts").alias("r", "part"))
        below = _below(F.col("before"), F.col("after"), F.col("digests"), F.col("r"), block)
        prefixes = parts.select("conv_id", F.col("part.k").alias("k"), below[0].alias("before"), below[1].alias("after"))
        prefixes = materialize(prefixes, "trie-prefixes")
    if prefixes is None:
        return bottom.withColumn("before", start).withColumn("after", start)
    return bottom.join(prefixes, ["conv_id", "k"])


def _turns_of(blocks: DataFrame, block: int, *carried: str) -> DataFrame:
    """Turns of blocks one by one: key (digest of the prefix that ends with the turn), parent, depth, n_words."""
    rows = blocks.select("conv_id", "before", "after", *carried, F.col("turns.digest").alias("_digests"), F.posexplode("turns").alias("_r", "_turn"))
    parent, key = _below(F.col("before"), F.col("after"), F.col("_digests"), F.col("_r"), block)
    return rows.select(
        "conv_id", "before", *carried, key.alias("key"), parent.alias("parent"),
        F.col("_turn.pos").alias("depth"), F.col("_turn.n_words").alias("n_words"),
    )


def _ends(convs: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """conv_id, key of the node where it ends."""
    last = blocks.join(convs, "conv_id").where(F.col("k") == F.floor((F.col("length") - 1) / block))
    size = F.size("turns")
    whole = F.unhex(F.md5(F.concat("before", _joined(F.col("turns.digest")))))
    ended = last.select("conv_id", F.when(size == block, F.col("after")).otherwise(whole).alias("key"))
    return ended.unionByName(convs.where("length = 0").select("conv_id", F.lit(_ROOT).cast("binary").alias("key")))


def _id_digests(ends: DataFrame, cfg: TrieConfig) -> DataFrame:
    """key, ends_sha256: digest of the ids that end at a node, in rising order.

    Nodes with few are listed in one row. The ids of a node with many are ordered over ranges and
    joined to texts there; one task then runs the digest over these texts, a piece at a time.
    """
    counts = ends.groupBy("key").agg(F.count("*").alias("n"))
    many = materialize(counts.where(F.col("n") > cfg.bounded_ends).select("key"), "trie-many-ends")
    n_many = many.count()
    text = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    few = ends
    if n_many:
        few = ends.join(F.broadcast(many) if n_many <= cfg.broadcast_rows else many, "key", "left_anti")
    out = few.groupBy("key").agg(F.sha2(text.cast("binary"), 256).alias("ends_sha256"))
    if not n_many:
        return out

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            low = 0
            while low < len(ids):
                high = low + 1
                while high < len(ids) and keys[high] == keys[low]:
                    high += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[low]], pa.binary()), pa.array([ids[low]]), pa.array([",".join(map(str, ids[low:high]))])],
                    names=["key", "first", "ids"],
                )
                low = high

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"]
            )

        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != key:
                    if running is not None:
                        yield done()
                    key, running = own, hashlib.sha256()
                    running.update(ids.encode())
                else:
                    running.update(b"," + ids.encode())
        if running is not None:
            yield done()

    listed = ends.join(F.broadcast(many) if n_many <= cfg.broadcast_rows else many, "key", "left_semi")
    listed = listed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id")
    texts = listed.mapInArrow(pieces, "key binary, first long, ids string")
    texts = texts.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return out.unionByName(texts.mapInArrow(digests, "key binary, ends_sha256 string"))


def conversation_trie(conversations: DataFrame, cfg: TrieConfig = TrieConfig()) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    `conversations` has conv_id, turn, role, text; other columns are ignored. Null turns come first,
    null roles and texts are empty; turns of one number are ordered by the MD5 of role and text, and
    a repeated row is a turn of its own. Rows without conv_id belong to no conversation. A node is
    named by its smallest member and its depth. Without any conversation there is no node, not even a root.
    """
    turns, convs = rebuilt_turns(materialize(numbered_turns(conversations), "trie-turns"))
    longest = convs.agg(F.max("length")).first()[0]
    schema = (
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
        " saved_tokens long, ends_sha256 string"
    )
    if longest is None:
        return conversations.sparkSession.createDataFrame([], schema)
    blocks = prefixed_blocks(turns, longest, cfg.block)
    groups = blocks.groupBy("before").agg(
        F.count("*").alias("members"), F.min("conv_id").alias("owner"),
        (F.min("digest") != F.max("digest")).alias("diverges"),
    )
    blocks = materialize(blocks, "trie-prefixed")
    shared = materialize(groups.where("members > 1"), "trie-groups")
    grouped = left_join_by_weight(blocks, shared, ["before"], "members", shared.count(), cfg.broadcast_rows, cfg.hot_rows)
    alone = F.col("owner").isNull()
    grouped = materialize(
        grouped.select(
            *blocks.columns, F.coalesce("diverges", F.lit(False)).alias("diverges"),
            F.coalesce("owner", "conv_id").alias("owner"), alone.alias("alone"),
        ),
        "trie-grouped",
    )

    # nodes: one by one where siblings diverge, by their owner elsewhere
    refined = _turns_of(grouped.where("diverges"), cfg.block).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"),
        F.min("depth").alias("depth"), F.min("n_words").alias("n_words"),
    )
    straight = _turns_of(grouped.where(~F.col("diverges") & (F.col("owner") == F.col("conv_id"))), cfg.block, "alone")
    straight = left_join_by_weight(
        straight.where(~F.col("alone")), shared.select("before", "members", F.col("members").alias("n_convs")), ["before"],
        "members", shared.count(), cfg.broadcast_rows, cfg.hot_rows,
    ).select("*", F.lit(False).alias("refined")).unionByName(
        straight.where("alone").withColumn("n_convs", F.lit(1).cast("long")).withColumn("refined", F.lit(False))
    )
    root = convs.agg(
        F.lit(_ROOT).cast("binary").alias("key"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("binary").alias("before"),
    )
    columns = ["key", "conv_id", "n_convs", "parent", "depth", "n_words", "before"]
    nodes = (
        refined.withColumn("before", F.lit(None).cast("binary")).select(*columns)
        .unionByName(straight.select(*columns)).unionByName(root.select(*columns))
    )
    nodes = nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("n_words"))
    nodes = materialize(nodes, "trie-nodes")

    # parents: how many children, and whose they are
    inner = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")).where("key IS NOT NULL")
    parents = nodes.join(inner, "key").select(
        F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    parents = materialize(parents, "trie-parents")
    leaves = nodes.join(parents.select(F.col("parent").alias("key")), "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))

    # chains: what an owner's nodes weigh, and whether they end in a leaf
    weights = nodes.where("weight > 0").groupBy("conv_id").agg(F.sum("weight").alias("chain"))
    chains = materialize(
        leaves.join(weights, "conv_id", "full").select(
            "conv_id", F.coalesce("chain", F.lit(0)).alias("chain"), F.coalesce("leaf", F.lit(0)).alias("leaf")
        ),
        "trie-chains",
    )
    with_chains = materialize(
        grouped.where(~F.col("alone")).join(chains, "conv_id").select("conv_id", "before", "after", "turns", "diverges", "chain", "leaf"),
        "trie-members",
    )
    sums = [F.sum("chain").alias("chains"), F.sum("leaf").alias("n_leaves")]
    of_groups = with_chains.where(~F.col("diverges")).groupBy("before").agg(*sums)
    of_turns = _turns_of(with_chains.where("diverges"), cfg.block, "chain", "leaf").groupBy("key").agg(*sums)
    of_root = chains.agg(*sums).select(F.lit(_ROOT).cast("binary").alias("key"), "chains", "n_leaves")
    several = nodes.where("n_convs > 1")
    summed = several.where("before IS NULL").join(of_turns.unionByName(of_root), "key").select("key", "chains", "n_leaves")
    summed = summed.unionByName(
        several.where("before IS NOT NULL").join(of_groups, "before").select("key", "chains", "n_leaves")
    )
    summed = summed.join(_rest_of_chain(several), "key")
    own_chain = chains.select("conv_id", F.col("chain").alias("own_chain"))
    below = several.select("key", "conv_id").join(summed, "key").join(own_chain, "conv_id", "left").select(
        "key", "n_leaves", (F.col("chains") - F.coalesce("own_chain", F.lit(0)) + F.col("rest")).alias("saved")
    )

    ended = _id_digests(materialize(_ends(convs, blocks, cfg.block), "trie-ends"), cfg)
    children = parents.select(F.col("parent").alias("key"), "n_children")
    out = nodes.join(children, "key", "left").join(below, "key", "left").join(ended, "key", "left")
    out = out.join(parents.select("parent", "parent_conv_id"), "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def _rest_of_chain(nodes: DataFrame) -> DataFrame:
    """key, rest: weight of the node and those below it of the same owner. A chain of any length is summed
    over ranges."""
    ranges = bucketed(nodes.select("conv_id", "depth", "key", "weight"), ["conv_id"], ["depth"])
    summary = ranges.groupBy(BUCKET, "conv_id").agg(F.sum("weight").alias("weight"))
    after = Window.partitionBy("conv_id").orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = summary.select(BUCKET, "conv_id", F.sum("weight").over(after).alias("from_here"))
    passed = F.sum("weight").over(up_to_here(["conv_id"]))
    return join_carry(ranges, carry, ["conv_id"]).select(
        "key", (F.col("from_here") - passed + F.col("weight")).alias("rest")
    )
