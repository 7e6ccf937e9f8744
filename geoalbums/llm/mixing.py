"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A source with target / size = c + p takes every document c times and once more with probability
p. Independent draws would leave a source off its target by chance; here they depend on each
other. Two documents with open probabilities meet and, by one draw, words move from one to the
other until one of them is decided (0 or 1); the sum of words over both stays as it was, and so
does each one's expectation. A block of some 64 documents is one chain of such meetings and leaves
one open document; the open ones of 64 blocks are a block of the next level, up to one per source.
That last one is rounded to the nearer side. It may be a long one, so what a source is then off its
target is made good by a reserve of its documents (some 128, drawn by a hash): from the longest
down, each whose decision turned over brings the source nearer is turned over. Words above and
below the target are as likely, so the odds of a document stay what they were.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoalbums.sources.shared import materialize

_ITEM = "struct<h:bigint,doc_id:bigint,copy:bigint,size:bigint,p:double>"
_DONE = "array<struct<h:bigint,doc_id:bigint,copy:bigint,size:bigint,p:double,extra:int>>"


@dataclass(frozen=True)
class MixConfig:
    """weights are dealt to the sources in code point order, null last, again and again.

    factor: words of the mix over words of the input; ceiling: most words of a source over its
    own; block: documents of a block, on average; reserve: documents of a source, on average, that may
    make good what it is off its target; seed: another one gives another draw.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    factor: float = 1.5
    ceiling: float = 2.0
    block: int = 64
    reserve: int = 128
    seed: int = 17
    broadcast_rows: int = 100_000


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """source, documents, source_size, target: shares by weight, cut at the ceiling, the rest reshared.

    Resharing until nothing is above its ceiling ends at target = min(ceiling, level * weight); with
    sources in order of ceiling / weight the level is the largest of (words left) / (weights left).
    One row per source: the only window without a key is over that table.
    """
    sources = sizes.groupBy("source").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(w)) for w in cfg.weights])
    sources = sources.withColumn("weight", F.get(weights, (rank - 1) % len(cfg.weights)))
    sources = sources.withColumn("most", F.lit(cfg.ceiling) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = F.lit(cfg.factor) * F.sum("source_size").over(everything)
    full = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sources = sources.withColumn("reach", (words - full) / left)
    level = F.max("reach").over(everything)
    return sources.select(
        "source", "documents", "source_size", F.least("most", level * F.col("weight")).alias("target")
    )


def _uniform(*columns: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _meet(state: Column, item: Column, seed: int) -> Column:
    """The chain's open document meets the next one."""
    cur = state["cur"]
    room = F.least(cur["size"] * (1 - cur["p"]), item["size"] * item["p"])  # words cur can gain
    give = F.least(cur["size"] * cur["p"], item["size"] * (1 - item["p"]))  # words cur can lose
    gains = _uniform(F.lit(seed), cur["h"], item["h"]) * (room + give) < give
    cur_full = cur["size"] * (1 - cur["p"]) <= item["size"] * item["p"]
    cur_void = cur["size"] * cur["p"] <= item["size"] * (1 - item["p"])
    cur_done = F.when(gains, cur_full).otherwise(cur_void)

    def done(x: Column, extra: Column) -> Column:
        return F.struct(
            x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"), x["size"].alias("size"),
            F.lit(None).cast("double").alias("p"), extra.cast("int").alias("extra"),
        )

    def left(x: Column, p: Column) -> Column:
        return F.struct(
            x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"), x["size"].alias("size"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"),
        )

    item_left = item["p"] + F.when(gains, -room).otherwise(give) / item["size"]
    cur_left = cur["p"] + F.when(gains, room).otherwise(-give) / cur["size"]
    decided = F.when(cur_done, done(cur, gains)).otherwise(done(item, ~gains))
    remaining = F.when(cur_done, left(item, item_left)).otherwise(left(cur, cur_left))
    met = F.struct(F.concat(state["done"], F.array(decided)).cast(_DONE).alias("done"), remaining.cast(_ITEM).alias("cur"))
    begun = F.struct(state["done"].alias("done"), item.cast(_ITEM).alias("cur"))
    return F.when(cur.isNull(), begun).otherwise(met)


def _round_blocks(items: DataFrame, seed: int, last: bool) -> DataFrame:
    """One chain per (source, block): every document but the last is decided; extra is null for that."""
    listed = items.groupBy("source", "block").agg(
        F.array_sort(F.collect_list(F.struct("h", "doc_id", "copy", "size", "p").cast(_ITEM))).alias("items")
    )
    start = F.struct(F.array().cast(_DONE).alias("done"), F.lit(None).cast(_ITEM).alias("cur"))
    chained = listed.select("source", "block", F.aggregate("items", start, lambda s, x: _meet(s, x, seed)).alias("s"))
    open_extra = (F.col("s.cur.p") >= 0.5).cast("int") if last else F.lit(None).cast("int")
    cur = F.struct(*[F.col(f"s.cur.{c}").alias(c) for c in ("h", "doc_id", "copy", "size", "p")], open_extra.alias("extra"))
    return chained.select("source", "block", F.explode(F.concat("s.done", F.array(cur).cast(_DONE))).alias("x")).select(
        "source", "block", "x.*"
    )


def _turned_over(decided: DataFrame, sources: DataFrame, cfg: MixConfig) -> DataFrame:
    """source, h, doc_id, copy of the documents whose decision is turned over."""
    off = decided.groupBy("source").agg(F.sum("taken").alias("words")).select(F.col("source").alias("name"), "words")
    off = off.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "name", (F.col("words") - F.col("target")).alias("off"),
        F.greatest(F.lit(1), F.floor(F.col("documents") / F.lit(cfg.reserve))).alias("one_in"),
    )
    drawn = decided.where("free").join(off, F.col("source").eqNullSafe(F.col("name")))
    drawn = drawn.where(F.pmod(F.xxhash64(F.lit(cfg.seed - 1), "h", "copy"), "one_in") == 0)
    reserve = drawn.groupBy("source", "off").agg(
        F.sort_array(F.collect_list(F.struct("size", "h", "doc_id", "copy", "extra")), asc=False).alias("items")
    )
    none = F.array().cast("array<struct<h:bigint,doc_id:bigint,copy:bigint>>")
    start = F.struct(F.col("off").cast("double").alias("off"), none.alias("turned"))

    def step(state: Column, x: Column) -> Column:
        over = state["off"] > 0
        helps = (x["extra"] == over.cast("int")) & (x["size"] <= F.abs(state["off"]))
        row = F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"))
        return F.struct(
            F.when(helps, state["off"] + F.when(over, -x["size"]).otherwise(x["size"])).otherwise(state["off"]).alias("off"),
            F.when(helps, F.concat(state["turned"], F.array(row))).otherwise(state["turned"]).alias("turned"),
        )

    turned = reserve.select("source", F.aggregate("items", start, step, lambda state: state["turned"]).alias("turned"))
    return turned.select("source", F.explode("turned").alias("x")).select("source", "x.*")


def mix_sources(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """Per row of `docs` (doc_id, source, text; other columns are ignored): doc_id, source, size,
    source_size, target, copies, taken.

    size counts words; target is the source's; copies says how often the mix takes the document,
    taken = copies * size. Documents without words are taken as often as their source's documents
    are at least. A null source is a source. Repeated rows are rounded one by one. The draws are
    hashes of seed, doc_id and size: reruns agree, whatever the partitions.
    """
    sizes = materialize(word_counts(docs), "sizes")
    sources = materialize(source_targets(sizes, cfg), "targets")
    per_word = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = sources.withColumn("base", F.floor(per_word).cast("long")).withColumn("p", per_word - F.floor(per_word))
    rates = rates.withColumn("blocks", F.ceil(F.col("documents") / F.lit(cfg.block)).cast("long"))

    # equal rows are counted before they are dealt out, so that no key holds many rows
    rows = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).drop("n")
    h = F.xxhash64(F.lit(cfg.seed), "doc_id", "size", "copy")
    rates_of = rates.select(F.col("source").alias("name"), "p", "blocks")
    rows = rows.join(rates_of, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("h", h).withColumn("block", F.pmod(F.xxhash64(F.lit(cfg.seed + 1), "h"), "blocks"))
    fraction = (F.col("p") > 0) & (F.col("size") > 0)

    columns = ["source", "h", "doc_id", "copy", "size", "extra"]
    whole = rows.where(~fraction).withColumn("extra", F.lit(0)).select(*columns, F.lit(False).alias("free"))
    open_items = rows.where(fraction)
    largest = sources.agg(F.max("documents")).first()[0] or 0
    levels = 1
    while math.ceil(math.ceil(largest / cfg.block) / 64 ** (levels - 1)) > 1:
        levels += 1
    decided = whole
    for level in range(levels):
        rounded = materialize(_round_blocks(open_items, cfg.seed + level, level == levels - 1), "rounded")
        decided = decided.unionByName(rounded.where("extra IS NOT NULL").select(*columns, F.lit(True).alias("free")))
        open_items = rounded.where("extra IS NULL").withColumn("block", F.floor(F.col("block") / 64))

    named = rates.select(F.col("source").alias("name"), "source_size", "target", "base")
    taken = (F.col("base") + F.col("extra")) * F.col("size")
    decided = decided.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("taken", taken)
    decided = materialize(decided, "decided")
    turned = materialize(_turned_over(decided, sources, cfg), "turned-over")
    key = ["source", "h", "doc_id", "copy"]
    small = turned.count() <= cfg.broadcast_rows
    turned = turned.select(*[F.col(c).alias(f"turned_{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"turned_{c}")) for c in key]
    out = decided.join(F.broadcast(turned) if small else turned, same, "left")
    other_way = F.when(F.col("turned_h").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra"))
    copies = F.col("base") + other_way
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
