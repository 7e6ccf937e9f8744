"""Leading eigenpairs of a symmetric matrix by spectrum slicing, on the driver.

The number of eigenvalues above a shift is the number of positive pivots of an LDLᵀ factorisation of
the shifted matrix (Sylvester). Halving an interval by such counts isolates each leading eigenvalue;
Rayleigh quotient iteration then converges cubically inside its interval, and counts on both sides
certify its number. Eigenvalues that cannot be told apart are found together, as a subspace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ALPHA = (1 + 17**0.5) / 8  # of Bunch and Kaufman: bounds growth for 1x1 and 2x2 pivots alike
_EPS = float(np.finfo(float).eps)
_TOGETHER = 1e-9  # of the largest eigenvalue: closer ones are found as a subspace


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than `shift`, from the inertia of the pivoted LDLᵀ of matrix - shift * I."""
    a = matrix.astype(float)
    n, k, positive = len(a), 0, 0
    a[np.diag_indices(n)] -= shift
    while k < n:
        double, own = False, abs(a[k, k])
        if k < n - 1:
            column = np.abs(a[k + 1 :, k])
            r = int(column.argmax()) + k + 1
            most = column[r - k - 1]
            if own < _ALPHA * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                widest = row.max()
                if own * widest < _ALPHA * most * most:
                    if abs(a[r, r]) >= _ALPHA * widest:
                        _swap(a, k, r)
                    else:
                        _swap(a, k + 1, r)
                        double = True
        if double:
            positive += 1  # such a pair of pivots has one of each sign
            pair = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= pair @ np.linalg.solve(a[k : k + 2, k : k + 2], pair.T)
            k += 2
            continue
        pivot = a[k, k]
        positive += bool(pivot > 0)
        if pivot != 0:
            column = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(column, column / pivot)
        k += 1
    return positive


@dataclass(frozen=True)
class _Slice:
    low: float
    high: float
    above_low: int  # eigenvalues above `low`: the slice holds numbers above_high + 1 .. above_low
    above_high: int

    @property
    def held(self) -> int:
        return self.above_low - self.above_high

    @property
    def middle(self) -> float:
        return (self.low + self.high) / 2


def _halved(matrix: np.ndarray, s: _Slice) -> list[_Slice]:
    above = min(max(count_above(matrix, s.middle), s.above_high), s.above_low)
    halves = [_Slice(s.middle, s.high, above, s.above_high), _Slice(s.low, s.middle, s.above_low, above)]
    return [half for half in halves if half.held]


def _slices(matrix: np.ndarray, most: int, floor: float, scale: float) -> list[_Slice]:
    """Slices of the `most` largest eigenvalues above `floor`, from the top: of one eigenvalue each, or
    of several that are closer than `_TOGETHER`."""
    above = count_above(matrix, floor)
    todo = [_Slice(floor, scale * (1 + 1e-6), above, 0)] if above else []
    done = []
    while todo:
        s = todo.pop()
        if s.above_high >= most:
            continue
        if s.held > 1 and s.high - s.low > _TOGETHER * scale:
            todo += reversed(_halved(matrix, s))
        else:
            done.append(s)
    return done


def _solved(matrix: np.ndarray, shift: float, vectors: np.ndarray, scale: float) -> np.ndarray:
    """(matrix - shift * I)⁻¹ vectors; a shift that is an eigenvalue to the last bit is moved a little."""
    for step in (0.0, 2 * _EPS * scale, 64 * _EPS * scale):
        try:
            found = np.linalg.solve(matrix - (shift + step) * np.eye(len(matrix)), vectors)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    return vectors


def _rayleigh(matrix: np.ndarray, s: _Slice, scale: float) -> tuple[float, np.ndarray]:
    """The one eigenpair of a slice."""
    start = np.random.default_rng(s.above_low).standard_normal(len(matrix))
    for _ in range(60):  # each round that fails halves the slice
        vector, inside = start / np.linalg.norm(start), False
        for _ in range(8):
            # of all eigenvalues the slice's own is nearest to its middle
            vector = _solved(matrix, s.middle, vector, scale)
            vector /= np.linalg.norm(vector)
            value = float(vector @ matrix @ vector)
            off = float(np.linalg.norm(matrix @ vector - value * vector))
            if s.low < value - off and value + off < s.high:
                inside = True
                break
        noise = 16 * len(matrix) * _EPS * scale
        best = (off, value, vector)
        for _ in range(12 if inside else 0):
            vector = _solved(matrix, value, vector, scale)
            vector /= np.linalg.norm(vector)
            value = float(vector @ matrix @ vector)
            off = float(np.linalg.norm(matrix @ vector - value * vector))
            settled = best[0] <= noise and off >= best[0] / 2
            best = min(best, (off, value, vector), key=lambda x: x[0])
            if settled:
                break
        off, value, vector = best
        if inside and off <= noise and s.low <= value <= s.high:
            # the counts say that this is the eigenvalue of that number
            margin = 2 * off + noise
            if count_above(matrix, value - margin) >= s.above_low and count_above(matrix, value + margin) <= s.above_high:
                return value, vector
        if s.high - s.low <= noise:
            return value, vector
        s = _halved(matrix, s)[0]
    return value, vector


def _ritz(matrix: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors inside a small subspace, largest first, by Jacobi rotations."""
    basis = np.linalg.qr(basis)[0]
    small = basis.T @ matrix @ basis
    turn = np.eye(len(small))
    for _ in range(30):
        off = np.abs(small - np.diag(np.diag(small))).max()
        if off <= 1e-3 * _EPS * np.abs(small).max():
            break
        for p in range(len(small)):
            for q in range(p):
                if small[p, q] == 0:
                    continue
                theta = (small[q, q] - small[p, p]) / (2 * small[p, q])
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                rotation = np.eye(len(small))
                rotation[p, p] = rotation[q, q] = c
                rotation[p, q], rotation[q, p] = t * c, -t * c
                small = rotation.T @ small @ rotation
                turn = turn @ rotation
    order = np.argsort(-np.diag(small), kind="stable")
    return np.diag(small)[order], (basis @ turn)[:, order]


def _subspace(matrix: np.ndarray, s: _Slice, scale: float) -> tuple[np.ndarray, np.ndarray]:
    basis = np.random.default_rng(s.above_low).standard_normal((len(matrix), s.held))
    for _ in range(4):
        basis = np.linalg.qr(_solved(matrix, s.middle, np.linalg.qr(basis)[0], scale))[0]
    return _ritz(matrix, basis)


def leading_eigenpairs(matrix: np.ndarray, most: int, floor_share: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` eigenvalues, falling, and their unit vectors as columns.

    Eigenvalues of at most `floor_share` of the largest are noise and are left out.
    """
    scale = float(np.abs(matrix).sum(axis=1).max()) if len(matrix) else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for s in _slices(matrix, most, floor_share * scale, scale):
        if s.held == 1:
            value, vector = _rayleigh(matrix, s, scale)
            values.append(value)
            vectors.append(vector)
        else:
            found, basis = _subspace(matrix, s, scale)
            values += found.tolist()
            vectors += list(basis.T)
    # neighbours on both sides of a cut may be close as well: they share a subspace too
    low = 0
    while low < len(values):
        high = low + 1
        while high < len(values) and values[high - 1] - values[high] <= _TOGETHER * scale:
            high += 1
        if high - low > 1:
            found, basis = _ritz(matrix, np.array(vectors[low:high]).T)
            values[low:high], vectors[low:high] = found.tolist(), list(basis.T)
        low = high
    kept = [i for i, value in enumerate(values[:most]) if value > floor_share * values[0]]
    return np.array([values[i] for i in kept]), np.array([vectors[i] for i in kept]).reshape(len(kept), len(matrix)).T
