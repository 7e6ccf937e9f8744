"""Content digests of whole contents: md5 and sha are Spark's own, CRC-64 is an Arrow-batched UDF."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# --- fixed value: CRC-64, reflected ECMA-182 ----------------------------
CRC64_POLYNOMIAL = 0xC96C5795D7870F42
# ------------------------------------------------------------------------

_ALL_ONES = 0xFFFFFFFFFFFFFFFF
_LANE = 1024  # bytes checked side by side, one array step per byte position


_cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(effect of one byte, effect of a lane of zero bytes on each of the eight state bytes)."""
    if "crc64" not in _cache:
        byte = np.arange(256, dtype=np.uint64)
        for _ in range(8):
            odd = (byte & np.uint64(1)).astype(bool)
            byte = (byte >> np.uint64(1)) ^ np.where(odd, np.uint64(CRC64_POLYNOMIAL), np.uint64(0))
        shifts = np.uint64(8) * np.arange(8, dtype=np.uint64)
        state = (np.arange(256, dtype=np.uint64)[None, :] << shifts[:, None]).ravel()
        for _ in range(_LANE):
            state = byte[state & np.uint64(0xFF)] ^ (state >> np.uint64(8))
        _cache["crc64"] = byte, state.reshape(8, 256)
    return _cache["crc64"]


def crc64_hex(blobs: list[bytes]) -> list[str]:
    """CRC-64 of every blob, upper-case hex."""
    return [f"{state ^ _ALL_ONES:016X}" for state in _advance(blobs, [_ALL_ONES] * len(blobs))]


def _advance(blobs: list[bytes], states: list[int]) -> list[int]:
    """The states after every blob.

    A CRC is linear: whole lanes of all blobs are checked side by side from a zero state, then
    each blob's lanes are chained by moving its state over a lane. What is left is done bytewise.
    """
    byte, over_lane = _tables()
    whole = np.array([len(blob) // _LANE for blob in blobs], dtype=np.int64)
    joined = b"".join(blob[: count * _LANE] for blob, count in zip(blobs, whole.tolist()))
    lanes = np.ascontiguousarray(np.frombuffer(joined, dtype=np.uint8).reshape(-1, _LANE).T)
    checked = np.zeros(lanes.shape[1], dtype=np.uint64)
    for column in lanes if lanes.shape[1] else ():
        checked = byte[(checked ^ column) & np.uint64(0xFF)] ^ (checked >> np.uint64(8))

    state = np.array(states, dtype=np.uint64)
    first = np.cumsum(whole) - whole
    for lane in range(int(whole.max(initial=0))):
        reach = np.flatnonzero(whole > lane)
        moved = np.zeros(len(reach), dtype=np.uint64)
        for part in range(8):
            moved ^= over_lane[part][(state[reach] >> np.uint64(8 * part)) & np.uint64(0xFF)]
        state[reach] = moved ^ checked[first[reach] + lane]

    steps = byte.tolist()
    out = []
    for blob, count, value in zip(blobs, whole.tolist(), state.tolist()):
        for item in blob[count * _LANE :]:
            value = steps[(value ^ item) & 0xFF] ^ (value >> 8)
        out.append(value)
    return out


class Crc64:
    """CRC-64 of content that comes in chunks."""

    def __init__(self) -> None:
        self._state = _ALL_ONES

    def update(self, chunk: bytes) -> None:
        self._state = _advance([chunk], [self._state])[0]

    def hexdigest(self) -> str:
        return f"{self._state ^ _ALL_ONES:016X}"


class Crc64Part:
    """The state that bytes from somewhere inside a content lead to, beginning at zero."""

    def __init__(self) -> None:
        self.state = 0

    def update(self, chunk: bytes) -> None:
        self.state = _advance([chunk], [self.state])[0]


_moves: dict[int, list[int]] = {}  # per number of bytes: where as many zero bytes take each bit of a state


def _moved(bits: list[int], state: int) -> int:
    out = 0
    while state:
        low = state & -state
        out ^= bits[low.bit_length() - 1]
        state ^= low
    return out


def _over(length: int) -> list[int]:
    """Effect of `length` zero bytes: a matrix over two elements, by repeated squaring."""
    if length not in _moves:
        if length == 1:
            byte = _tables()[0].tolist()
            _moves[1] = [byte[bit & 0xFF] ^ (bit >> 8) for bit in (1 << i for i in range(64))]
        else:
            half = _over(length // 2)
            twice = [_moved(half, bit) for bit in half]
            _moves[length] = [_moved(_over(1), bit) for bit in twice] if length % 2 else twice
    return _moves[length]


def crc64_of_parts(parts: list[tuple[int, int]]) -> str:
    """CRC-64 of a content from (bytes, state of a `Crc64Part`) of its parts, in order."""
    state = _ALL_ONES
    for length, own in parts:
        if length:
            state = _moved(_over(length), state) ^ own
    return f"{state ^ _ALL_ONES:016X}"


_AT_ONCE = 16 << 20  # bytes of contents checked side by side


@pandas_udf(StringType())
def _crc64_udf(content: pd.Series) -> pd.Series:
    out: list[str | None] = []
    group: list[bytes] = []
    places: list[int] = []

    def close() -> None:
        for place, digest in zip(places, crc64_hex(group)):
            out[place] = digest
        group.clear(), places.clear()

    for blob in content:
        if blob is not None:
            places.append(len(out))
            group.append(bytes(blob))
        out.append(None)
        if sum(map(len, group)) > _AT_ONCE:
            close()
    close()
    return pd.Series(out, index=content.index, dtype=object)


def crc64(content: Column) -> Column:
    """Upper-case hex CRC-64 of the whole content."""
    return _crc64_udf(content)


def content_digest(content: Column, mode: str) -> Column:
    if mode == "crc":
        return crc64(content)
    return F.md5(content) if mode == "md5" else F.sha2(content, 512)


def chunked_digest(mode: str):
    """An object with update and hexdigest, for content read in chunks; equals `content_digest`."""
    return Crc64() if mode == "crc" else hashlib.md5() if mode == "md5" else hashlib.sha512()
