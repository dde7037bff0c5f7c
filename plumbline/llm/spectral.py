"""Leading eigenpairs of a symmetric matrix.

Householder tridiagonalisation, bisection on Sturm counts for the eigenvalues,
inverse iteration with reorthogonalisation inside clusters for the vectors.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
# Eigenvalues closer than this share of the norm form a cluster.
CLUSTER = 1e-3
SWEEPS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the Householder vectors (zero or unit) that led there."""
    a = np.array(matrix, np.float64)
    size = len(a)
    off, reflectors = np.zeros(max(size - 1, 0)), []
    for k in range(size - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x[1:]).max()
        if scale == 0:
            off[k] = x[0]
            reflectors.append(np.zeros(len(x)))
            continue
        length = np.hypot.reduce(x)
        alpha = -length if x[0] >= 0 else length
        x[0] -= alpha
        v = x / np.hypot.reduce(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        off[k] = alpha
        reflectors.append(v)
    if size > 1:
        off[size - 2] = a[size - 1, size - 2]
    return a.diagonal().copy(), off, reflectors


def _below(diagonal: np.ndarray, squares: np.ndarray, shifts: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative pivots of T - shift."""
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(np.int64)
    for d, square in zip(diagonal[1:], squares):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - shifts - square / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The `count` largest eigenvalues, falling, each bisected down to neighbouring doubles."""
    size = len(diagonal)
    radius = np.zeros(size)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    low = np.full(count, (diagonal - radius).min())
    high = np.full(count, (diagonal + radius).max())
    norm = max(abs(low[0]), abs(high[0]), np.finfo(np.float64).tiny)
    low, high = low - 2 * EPS * norm * size, high + 2 * EPS * norm * size
    squares, tiny = off * off, np.finfo(np.float64).tiny / EPS
    # The k-th largest has size - k eigenvalues below any shift just under it.
    rank = size - 1 - np.arange(count)
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = _below(diagonal, squares, middle, tiny) > rank
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solves (T - shift) x = b by elimination with row exchanges."""
    size = len(diagonal)
    d, u, u2 = diagonal - shift, np.append(off, 0.0), np.zeros(size)
    factors, swaps = np.zeros(size), np.zeros(size, bool)
    for i in range(size - 1):
        below, nxt, far = off[i], d[i + 1], u[i + 1] if i + 1 < size - 1 else 0.0
        if abs(below) > abs(d[i]):
            swaps[i] = True
            factors[i] = d[i] / below
            head = u[i]
            d[i], u[i], u2[i] = below, nxt, far
            d[i + 1] = head - factors[i] * nxt
            if i + 1 < size - 1:
                u[i + 1] = -factors[i] * far
        else:
            factors[i] = below / d[i] if d[i] else 0.0
            d[i + 1] = nxt - factors[i] * u[i]
    d = np.where(np.abs(d) < least, np.where(d < 0, -least, least), d)

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(size - 1):
            if swaps[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factors[i] * x[i + 1]
            else:
                x[i + 1] -= factors[i] * x[i]
        for i in range(size - 1, -1, -1):
            rest = u[i] * x[i + 1] if i + 1 < size else 0.0
            if i + 2 < size:
                rest += u2[i] * x[i + 2]
            x[i] = (x[i] - rest) / d[i]
            if abs(x[i]) > 1e150:
                x /= abs(x[i])
        return x

    return solve


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit vectors as rows.

    The sign of a vector is fixed by its entry of largest size, which is positive.
    """
    size = len(matrix)
    count = min(count, size)
    if not count:
        return np.zeros(0), np.zeros((0, size))
    scale = float(np.abs(matrix).max())
    if scale == 0:
        return np.zeros(count), np.eye(size)[:count]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, count)
    norm = max(np.abs(values).max(), np.abs(diagonal).max(), np.abs(off).max() if len(off) else 0.0)
    vectors, start, random = np.zeros((count, size)), 0, np.random.default_rng(0)
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            start = k
        # Equal eigenvalues get shifts of their own, a few roundings apart.
        shift = min(value, shift - 4 * EPS * norm) if k > start else value
        solve = _solver(diagonal, off, shift, EPS * norm)
        x = _unit(random.uniform(0.5, 1.0, size))
        for _ in range(SWEEPS):
            x = solve(x)
            x = _unit(x)
            for _ in range(2):
                for other in vectors[start:k]:
                    x = x - (other @ x) * other
                x = _unit(x)
        vectors[k] = x
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ v, v)
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    top = vectors[np.arange(count), np.abs(vectors).argmax(axis=1)]
    return values * scale, vectors * np.where(top < 0, -1.0, 1.0)[:, None]
