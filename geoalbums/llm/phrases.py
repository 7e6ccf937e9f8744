"""Phrases of prefix-free parsing, over bytes.

A trigger is a place whose rolling hash is the least of a window of places (the last one of equal
ones): every window has one, and which it is depends on the window's bytes alone. Triggers cut a
text into phrases; equal strings of sufficient length are cut alike wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from geoalbums.llm.words import U64, mix, powers

ROLL = 12  # bytes of the rolling hash
WINDOW = 128  # places of which one is a trigger


@dataclass
class Rolling:
    """Hashes of any stretch of one text."""

    total: np.ndarray
    down: np.ndarray

    @classmethod
    def over(cls, data: np.ndarray) -> Rolling:
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
        return cls(total, down)

    def keys(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def owners(data: np.ndarray, length: int, rolling: Rolling) -> np.ndarray:
    """For each start of a `length`-byte string the trigger that owns it: the one of the window
    that begins there."""
    places = len(data) - ROLL + 1
    at = np.arange(places)
    hashed = rolling.keys(at, at + ROLL)
    bits = U64(max(20, int(len(data)).bit_length()))
    least = (hashed >> bits << bits) | ((U64(1) << bits) - U64(1) - at.astype(U64))
    covered = 1
    while covered < WINDOW:
        step = min(covered, WINDOW - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    starts = len(data) - length + 1
    mask = (U64(1) << bits) - U64(1)
    return (mask - (least[:starts] & mask)).astype(np.int64)


def phrase_runs(data: np.ndarray, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first start, last start) of each run of strings with one owner."""
    own = owners(data, length, rolling)
    low = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    return own[low], low, np.append(low[1:], len(own)) - 1
