"""Words of whole texts as numpy arrays: positions and 64-bit keys, computed over bytes.

A column of texts is one byte array with offsets. A table of 256 entries says which bytes belong
to words; the words' bounds are where that changes, and their keys come from one running
polynomial sum over the bytes, so no Python object is made per word. Texts are taken in slices of
about a megabyte, cut between texts: memory follows the slice, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text; every byte of a character beyond ASCII counts
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True
#: A-Z to a-z, all else as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
AS_IS = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Slice:
    """Some consecutive texts: text i has bytes data[at[i]:at[i + 1]]."""

    row: int
    data: np.ndarray
    at: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.at) - 1


@dataclass
class Words:
    """Word j has bytes data[start[j]:end[j]]; words of text i are first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    key: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow column (null: empty) in slices; `row` is the first one's index."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    # the column's own buffers: nothing of a batch is copied
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + slice_bytes, "right")) - 1)
        high = min(high, len(column))
        at = offsets[low : high + 1]
        yield Slice(low, data[at[0] : at[-1]], at - at[0])
        low = high
    # workers live on: what Arrow keeps for later is memory the next stage may need
    pa.default_memory_pool().release_unused()


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true within each text: starts, ends, and each text's first run."""
    n = len(mask)
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], before[1:] = False, mask[:-1]
        after[-1], after[:-1] = False, mask[1:]
        inner = at[(at > 0) & (at < n)]
        before[inner] = False
        after[inner - 1] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return start, end, np.searchsorted(start, at)


def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """A 64-bit key for each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(start), dtype=U64)
    low = 0
    while low < len(start):
        base = start[low]
        high = max(low + 1, int(np.searchsorted(end, base + SLICE_BYTES, "right")))
        span = fold[data[base : end[high - 1]]].astype(U64)
        span += U64(1)
        up, down = powers(len(span) + 1)
        total = np.empty(len(span) + 1, dtype=U64)
        total[0] = 0
        np.cumsum(span * up[: len(span)], out=total[1:])
        s, e = start[low:high] - base, end[low:high] - base
        out[low:high] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        low = high
    return out


def words(part: Slice, letters: np.ndarray = SPACED, fold: np.ndarray = AS_IS, with_keys: bool = True) -> Words:
    start, end, first = runs(letters[part.data], part.at)
    key = keys(part.data, start, end, fold) if with_keys else np.zeros(0, dtype=U64)
    return Words(start, end, first, key)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the k-word windows inside texts, and each text's first window.

    A text of fewer than k words, but not none, has its whole sequence as its one window.
    """
    counts = w.counts
    per_text = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], per_text)
    length = np.repeat(np.minimum(counts, k), per_text)
    out = np.zeros(len(at), dtype=U64)
    for j in range(k):
        inside = length > j
        if inside.all():
            out = mix(out * U64(0xD6E8FEB86659FD93) + w.key[at + j])
        elif inside.any():
            out[inside] = mix(out[inside] * U64(0xD6E8FEB86659FD93) + w.key[at[inside] + j])
    return out, first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i, 0 where that is empty."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def sorted_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in order, one text after the other, and where each begins."""
    values = values.copy()
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        values[low:high].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[first[(first < len(values))]] = True
    kept = np.concatenate([[0], np.cumsum(new)])[first]
    return values[new], kept
