"""Line dedup: an exact set-similarity join of lines, of which later matches are removed.

A line is the set of its words. Lines of equal sets are one class, of which all but the first
occurrence are removed. Classes are joined with classes: words are ordered by rarity, and a pair
of Jaccard similarity t or more must share a word among the rarest (1 - t) * size + 1 of both. A
pair that meets must pass the length, positional and bitmap filters (all exact), and is verified on
the full sets. Only whether some earlier class matches is asked: of each word's list a class first
gives just its earliest two partners that pass the filters; of these the likeliest is verified, the
others only if it turns out not to match, and all that lists still hold only if none did. Thousands
of variants of a line cost a few verifications each, not all pairs.

Rarity is a table of 2**18 counts, filled from all lines. Any order gives the same result; a good
one gives short lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoalbums.llm.bits import bit_table, may_have
from geoalbums.llm.groups import group_bounds, whole_groups
from geoalbums.llm.words import LOWER, SPACED, U64, Slice, mix, row_sums, runs, slices, words
from geoalbums.sources.shared import materialize, scratch

_BUCKETS = 1 << 18


@dataclass(frozen=True)
class LineDedupConfig:
    """percent: least Jaccard similarity of a match, in hundredths."""

    percent: int = 80


@dataclass
class _Lines:
    """Lines with words: text, number, and the distinct words tokens[first[i]:first[i + 1]]."""

    text: np.ndarray
    number: np.ndarray
    tokens: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def line(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text)), self.sizes)

    def keys(self) -> np.ndarray:
        """A key per set of words."""
        return mix(row_sums(mix(self.tokens ^ U64(0xA0761D6478BD642F)), self.first) + self.sizes.astype(U64))


def _lines(part: Slice) -> _Lines:
    w = words(part, SPACED, LOWER)
    start, end, first = runs(part.data != 0x0A, part.at)
    low, high = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    text = np.repeat(np.arange(part.texts), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(part.data == 0x0A)])
    number = breaks[start] - breaks[part.at[text]]
    worded = high > low
    text, number, low, high = text[worded], number[worded], low[worded], high[worded]
    line = np.repeat(np.arange(len(low)), high - low)
    order = np.lexsort((w.key, line))
    key = w.key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    bounds = np.concatenate([[0], np.cumsum(new)])[np.append(low, len(key))]
    return _Lines(text, number, key[new], bounds)


def _spots(lines: _Lines, key: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """A key per occurrence of a line: of its set, document and number."""
    return mix(mix(key + doc_id[lines.text]) + lines.number.astype(U64))


def _doc_ids(column: pa.Array, part: Slice) -> np.ndarray:
    ids = column.slice(part.row, part.texts).fill_null(0)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)


def _rarity(docs: DataFrame) -> np.ndarray:
    """How often words of each bucket occur in lines, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                w = words(part, SPACED, LOWER)
                total += np.bincount((w.key % U64(_BUCKETS)).astype(np.int64), minlength=_BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most 2**18 rows
    out = np.zeros(_BUCKETS, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _uid() -> Column:
    """Rows of equal doc_id and text are one document."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def _lists(docs: DataFrame) -> DataFrame:
    """Per document: uid, doc_id, the numbers and classes of its lines."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                lines = _lines(part)
                structs = pa.StructArray.from_arrays(
                    [pa.array(lines.number.astype(np.int32)), pa.array(lines.keys().view(np.int64))], names=["number", "cls"]
                )
                first = np.searchsorted(lines.text, np.arange(part.texts + 1)).astype(np.int32)
                arrays = [batch.column(c).slice(part.row, part.texts) for c in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.ListArray.from_arrays(pa.array(first), structs)], names=["uid", "doc_id", "lines"]
                )

    rows = docs.select(_uid().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(draw, "uid long, doc_id long, lines array<struct<number:int,cls:long>>")


# An entry of a word's list is a few numbers, as entries are most of what is shuffled: word (32 bits
# of its key) with the line's size (16) and the word's place (16), class, doc_id, line number, and
# a bitmap of 64 parities, in which two sets differ in as many bits at most as in words. Unlike sets
# of many words differ in half of the bits, which would pass: lines of over _SHORT words have 256
# parities. These are four bitmaps, of which `parity` is the sum and three are kept beside it.
_MOST = (1 << 16) - 1  # sizes and places from here on pass all filters
_SHORT = 40


_FINER = ("finer1", "finer2", "finer3")  # null in lines of up to _SHORT words
_ENTRY = ("word", "cls", "doc_id", "number", "parity", *_FINER)


def _token() -> Column:
    return F.shiftright("word", 32)


def _parities(lines: _Lines) -> tuple[np.ndarray, list[np.ndarray]]:
    """A line's 64 parities, and of four such bitmaps, each of a quarter of the words, all but the first."""
    mixed = mix(lines.tokens)
    bits, quarter = U64(1) << (mixed >> U64(58)), (mixed >> U64(56)) & U64(3)

    def per_line(values: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduceat(values, lines.first[:-1]) if len(lines.text) else values

    return per_line(bits), [per_line(np.where(quarter == U64(q), bits, U64(0))) for q in (1, 2, 3)]


def _entries(
    docs: DataFrame, rarity: np.ndarray, percent: int, of_words: np.ndarray | None = None, of_lines: np.ndarray | None = None
) -> DataFrame:
    """_ENTRY: the prefix words of all lines (a slice's first of each class), or of
    those words or lines that may be in a bit table."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                lines = _lines(part)
                key, sizes, line = lines.keys(), lines.sizes, lines.line
                ids = _doc_ids(batch.column(0), part)
                none = batch.column(0).slice(part.row, part.texts).is_null().to_numpy(zero_copy_only=False)[lines.text]
                wanted = np.ones(len(key), dtype=bool)
                if of_lines is not None:
                    wanted = may_have(of_lines, _spots(lines, key, ids))
                else:
                    rank = np.lexsort((lines.number, ids[lines.text].view(np.int64), none, key))
                    wanted[rank[1:]] = key[rank[1:]] != key[rank[:-1]]
                order = np.lexsort((lines.tokens, rarity[(lines.tokens % U64(_BUCKETS)).astype(np.int64)], line))
                place = np.arange(len(order)) - lines.first[line]
                prefix = sizes - -(-percent * sizes // 100) + 1
                parity, finer = _parities(lines)
                chosen = np.flatnonzero((place < prefix[line]) & wanted[line])
                token = lines.tokens[order][chosen] >> U64(32)
                if of_words is not None:
                    some = may_have(of_words, mix(token))
                    chosen, token = chosen[some], token[some]
                own = line[chosen]
                packed = (np.minimum(sizes[own], _MOST) << 16) | np.minimum(place[chosen], _MOST)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(((token << U64(32)) | packed.astype(U64)).view(np.int64)), pa.array(key[own].view(np.int64)),
                        pa.array(ids.view(np.int64)[lines.text[own]], mask=none[own]),
                        pa.array(lines.number[own].astype(np.int32)), pa.array(parity[own].view(np.int64)),
                        *(pa.array(f[own].view(np.int64), mask=sizes[own] <= _SHORT) for f in finer),
                    ],
                    names=list(_ENTRY),
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    finer = "".join(f", {name} long" for name in _FINER)
    return rows.mapInArrow(draw, f"word long, cls long, doc_id long, number int, parity long{finer}")


def _sets(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """spot, cls, tokens of the lines whose spot may be in the table."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                lines = _lines(part)
                key = lines.keys()
                spot = _spots(lines, key, _doc_ids(batch.column(0), part))
                found = np.flatnonzero(may_have(table, spot))
                found = found[np.unique(spot[found], return_index=True)[1]]
                own = np.zeros(len(key), dtype=bool)
                own[found] = True
                found = np.flatnonzero(own)
                ends = np.concatenate([[0], np.cumsum(lines.sizes[found])]).astype(np.int32)
                tokens = lines.tokens[own[lines.line]] if len(found) else lines.tokens[:0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spot[found].view(np.int64)), pa.array(key[found].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.view(np.int64))),
                    ],
                    names=["spot", "cls", "tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(draw, "spot long, cls long, tokens array<long>")


def _unpacked(word: np.ndarray, parity: np.ndarray, finer: list[np.ndarray]) -> dict[str, np.ndarray]:
    bitmaps = np.stack([parity, *finer], axis=1).view(U64)
    return {"size": (word >> 16) & _MOST, "pos": word & _MOST, "parity": bitmaps[:, 0].copy(), "finer": bitmaps, "token": word >> 32}


def _allowed(y: np.ndarray, x: np.ndarray, columns: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Whether entries y and x, which share a word, may be of matching lines: by size, place and bitmaps."""
    ny, nx = columns["size"][y], columns["size"][x]
    n = ny + nx
    rest = np.minimum(ny - columns["pos"][y], nx - columns["pos"][x])
    differ = np.bitwise_count(columns["parity"][y] ^ columns["parity"][x]).astype(np.int64)
    may = (
        (100 * np.minimum(ny, nx) >= percent * np.maximum(ny, nx))
        & ((100 + percent) * rest >= percent * n)
        & ((100 + percent) * differ <= (100 - percent) * n)
    )
    some = np.nonzero(may & (np.minimum(ny, nx) > _SHORT))
    if len(some[0]):
        bitmaps = columns["finer"][np.broadcast_to(y, may.shape)[some]] ^ columns["finer"][np.broadcast_to(x, may.shape)[some]]
        bitmaps[:, 0] ^= bitmaps[:, 1] ^ bitmaps[:, 2] ^ bitmaps[:, 3]
        differ = np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        may[some] = (100 + percent) * differ <= (100 - percent) * n[some]
    return may | (np.maximum(ny, nx) >= _MOST)


_NARROW = 24  # lists up to this length are looked at side by side, all lists of a batch at once
_BLOCK = 256


_TAKEN = 2  # partners a list gives of each entry at once


def _first_partners(at: np.ndarray, columns: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the two earliest ones before it in its list that may match (-1: none), and how
    many there are (beyond two the count may fall short, but stays above two)."""
    length = np.diff(at)
    out = np.full((_TAKEN, at[-1]), -1)
    count = np.zeros(at[-1], dtype=np.int64)
    place = np.arange(at[-1]) - np.repeat(at[:-1], length)
    narrow = np.repeat(length <= _NARROW, length)
    for lag in range(1, int(min(_NARROW, length.max(initial=0)))):
        y = np.flatnonzero(narrow & (place >= lag))
        may = y[_allowed(y, y - lag, columns, percent)]
        out[1, may], out[0, may] = out[0, may], may - lag  # a longer lag is an earlier partner
        count[may] += 1
    for low, high in zip(at[:-1][length > _NARROW].tolist(), at[1:][length > _NARROW].tolist()):
        for block in range(low, high, _BLOCK):
            y = np.arange(block, min(block + _BLOCK, high))
            for before in range(low, y[-1], 8 * _BLOCK):
                left = y[count[y] <= _TAKEN]
                x = np.arange(before, min(before + 8 * _BLOCK, y[-1]))
                if not len(left) or not len(x):
                    continue
                may = _allowed(left[:, None], x[None, :], columns, percent) & (x[None, :] < left[:, None])
                seen = may.cumsum(axis=1)
                for nth in range(1, _TAKEN + 1):
                    for have in range(nth):  # so many came from earlier blocks
                        some = (count[left] == have) & (seen[:, -1] >= nth - have)
                        out[nth - 1, left[some]] = x[(seen[some] == nth - have).argmax(axis=1)]
                count[left] += seen[:, -1]
    return out, count


def _grouped(entries: DataFrame) -> DataFrame:
    """Whole lists in tasks, each in the order of the lines."""
    return entries.repartition(_token()).sortWithinPartitions(
        _token(), F.col("doc_id").asc_nulls_last(), "number", "cls"
    )


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """cls, spot, x_cls, x_spot, more: of each list, every class and its earliest possible partners,
    and whether it has still others there."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "token"):
            word, cls, number, parity = (table.column(c).to_numpy() for c in ("word", "cls", "number", "parity"))
            finer = [table.column(c).fill_null(0).to_numpy() for c in _FINER]
            token = word >> 32
            order = np.lexsort((np.arange(len(cls)), cls, token))
            first = np.ones(len(cls), dtype=bool)
            first[order[1:]] = (cls[order[1:]] != cls[order[:-1]]) | (token[order[1:]] != token[order[:-1]])
            word, cls, number, parity = word[first], cls[first], number[first], parity[first]
            doc = table.column("doc_id").fill_null(0).to_numpy()[first].view(U64)
            columns = _unpacked(word, parity, [f[first] for f in finer])
            partners, count = _first_partners(group_bounds(columns["token"]), columns, percent)
            spot = mix(mix(cls.view(U64) + doc) + number.astype(U64)).view(np.int64)
            found = []
            for partner in partners:
                y = np.flatnonzero(partner >= 0)
                found.append(np.stack([cls[y], spot[y], cls[partner[y]], spot[partner[y]], count[y] > _TAKEN], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, i]) for i in range(5)], names=["cls", "spot", "x_cls", "x_spot", "more"]
            )

    rows = _grouped(entries).select(_token().alias("token"), *_ENTRY)
    return rows.mapInArrow(look, "cls long, spot long, x_cls long, x_spot long, more long")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """cls of the pairs whose full sets match."""
    x = pairs.select(F.col("x_cls").alias("cls"), F.col("x_spot").alias("spot"))
    spots = materialize(pairs.select("cls", "spot").unionByName(x).select("spot").distinct(), "spots")
    sets = _sets(docs, bit_table(spots.select(F.col("spot").alias("key")))).join(spots, "spot")
    sets = materialize(sets.select("spot", "cls", "tokens").distinct(), "line-sets").select("spot", "tokens")
    other = sets.select(F.col("spot").alias("x_spot"), F.col("tokens").alias("x_tokens"))
    met = pairs.select("cls", "spot", "x_spot").join(sets, "spot").join(other, "x_spot")
    n = F.size(F.array_intersect("tokens", "x_tokens"))
    same = 100 * n >= percent * (F.size("tokens") + F.size("x_tokens") - n)
    return materialize(met.where(same).select("cls").distinct(), "matches")


def _all_candidates(y: DataFrame, docs: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """cls, spot, x_cls, x_spot: the classes y (cls, spot) with all their possible partners."""
    own = _entries(docs, rarity, percent, of_lines=bit_table(y.select(F.col("spot").alias("key"))))
    own = materialize(own.join(y, "cls").select(*_ENTRY, "spot").distinct(), "open-entries")
    table = bit_table(_mixed_words(own))
    all_of_them = _entries(docs, rarity, percent, of_words=table)
    other = materialize(all_of_them.distinct(), "entries-of-open-words")
    x = other.select(*[F.col(c).alias(f"x_{c}") for c in _ENTRY])
    own, x = own.withColumn("token", _token()), x.withColumn("token", F.shiftright("x_word", 32))

    def part(name: str, shift: int) -> Column:
        return F.shiftright(name, shift).bitwiseAND(_MOST)

    ny, nx = part("word", 16), part("x_word", 16)
    rest = F.least(ny - part("word", 0), nx - part("x_word", 0))
    differ = F.bit_count(F.col("parity").bitwiseXOR(F.col("x_parity")))
    bitmaps = [F.col(c).bitwiseXOR(F.col(f"x_{c}")) for c in ("parity", *_FINER)]
    bitmaps[0] = reduce(Column.bitwiseXOR, bitmaps)
    differ = F.coalesce(reduce(Column.__add__, [F.bit_count(b) for b in bitmaps]), differ)
    place, x_place = (
        F.struct(F.col(f"{p}doc_id").isNull(), F.coalesce(f"{p}doc_id", F.lit(0)), f"{p}number", f"{p}cls") for p in ("", "x_")
    )
    may = (x_place < place) & (F.col("cls") != F.col("x_cls")) & (
        (F.greatest(ny, nx) >= _MOST)
        | (100 * F.least(ny, nx) >= percent * F.greatest(ny, nx))
        & ((100 + percent) * rest >= percent * (ny + nx))
        & ((100 + percent) * differ <= (100 - percent) * (ny + nx))
    )
    pairs = own.join(x, "token").where(may).select("cls", "spot", "x_cls", "x_doc_id", F.col("x_number").cast("long").alias("n"))
    return _with_spots(pairs.distinct())


def _arrow_map(df: DataFrame, make, schema: str) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch)

    return df.mapInArrow(apply, schema)


def _mixed_words(entries: DataFrame) -> DataFrame:
    def make(batch):
        return pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(U64)).view(np.int64))], names=["key"])

    return _arrow_map(entries.select(F.shiftrightunsigned("word", 32).alias("token")).distinct(), make, "key long")


def _with_spots(pairs: DataFrame) -> DataFrame:
    def make(batch):
        cls, doc, number = (batch.column(c).fill_null(0).to_numpy().view(U64) for c in ("x_cls", "x_doc_id", "n"))
        spot = pa.array(mix(mix(cls + doc) + number).view(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], spot], names=["cls", "spot", "x_cls", "x_spot"])

    return _arrow_map(pairs, make, "cls long, spot long, x_cls long, x_spot long")


def later_matches(docs: DataFrame, rarity: np.ndarray, cfg: LineDedupConfig) -> DataFrame:
    """cls of all classes of lines that match an earlier class."""
    pairs = _candidates(_entries(docs, rarity, cfg.percent), cfg.percent)
    pairs = pairs.groupBy("cls", "spot", "x_cls", "x_spot").agg(F.count("*").alias("n"), F.max("more").alias("more"))
    pairs = materialize(pairs, "candidates")
    # of a class's partners the one that shares most of its words is tried first
    best = pairs.groupBy("cls", "spot").agg(F.max(F.struct("n", "x_cls", "x_spot")).alias("x"), F.max("more").alias("more"))
    best = materialize(best.select("cls", "spot", "x.x_cls", "x.x_spot", "more"), "best-candidates")
    found = _verified(best, docs, cfg.percent)
    others = pairs.join(found, "cls", "left_anti").join(best.select("cls", "x_cls"), ["cls", "x_cls"], "left_anti")
    others = materialize(others, "other-candidates")
    if not others.isEmpty():
        found = found.unionByName(_verified(others, docs, cfg.percent))
    left = materialize(best.where("more = 1").select("cls", "spot").join(found, "cls", "left_anti"), "unmatched")
    if left.isEmpty():
        return found
    again = _all_candidates(left, docs, rarity, cfg.percent).join(pairs, ["cls", "x_cls"], "left_anti")
    return found.unionByName(_verified(materialize(again, "more-candidates"), docs, cfg.percent))


def removed_lines(docs: DataFrame, cfg: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """uid, n_lines, removed_lines: one row per document (rows of one doc_id and text are one)."""
    lists = materialize(_lists(docs).distinct(), "lines")
    lines = lists.select("uid", "doc_id", F.explode("lines").alias("x")).select("uid", "doc_id", "x.*")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number", "uid")
    firsts = materialize(lines.groupBy("cls").agg(F.min(place).alias("x")).select("cls", "x.uid", "x.number"), "first-lines")
    stay = firsts.join(later_matches(docs, _rarity(docs), cfg), "cls", "left_anti")
    stay = stay.groupBy("uid").agg(F.collect_set("number").alias("staying"))
    numbers = lists.select("uid", F.transform("lines", lambda x: x["number"]).alias("numbers"))
    staying = F.coalesce("staying", F.array().cast("array<int>"))
    return numbers.join(stay, "uid", "left").select(
        "uid", F.size("numbers").cast("long").alias("n_lines"), F.array_except("numbers", staying).alias("removed_lines")
    )


def dedup_lines(docs: DataFrame, cfg: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_lines (that have a
    word), n_removed, removed_lines (numbers, from 0).

    Lines are ended by \\n; words are what stands between white space, A-Z lower-cased. Lines are
    in order of doc_id (null last) and number; where different texts have one doc_id, the order of
    their hashes decides. A line is removed if any earlier one matches, removed itself or not.
    Lines without a word stay. Null and empty texts have no lines. Rows that repeat doc_id and text
    are one document and all get its result.
    """
    with scratch(docs.sparkSession):
        found = materialize(removed_lines(docs, cfg), "removed-lines", outlives=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _uid().alias("uid"))
    return rows.join(found, "uid").select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def cut_lines(docs: DataFrame, cfg: LineDedupConfig = LineDedupConfig()) -> DataFrame:
    """`docs` with later matches cut out of `text`, without the documents that lose all of their
    lines. Other columns stay as they are. See `dedup_lines` for what is a match."""
    with scratch(docs.sparkSession):
        found = removed_lines(docs, cfg).where(F.size("removed_lines") > 0)
        found = materialize(found, "removed-lines", outlives=True)
    found = found.select(F.col("uid").alias("__uid"), F.struct("n_lines", "removed_lines").alias("__cut"))
    out = docs.withColumn("__uid", _uid()).join(found, "__uid", "left")
    out = out.where("__cut IS NULL OR size(__cut.removed_lines) < __cut.n_lines")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("__cut.removed_lines", i)), "\n")
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(left)
    return out.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
