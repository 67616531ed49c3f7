"""Linear support-vector machines on hashed sparse features, in numpy."""

from __future__ import annotations

import zlib

import numpy as np

#: Hashed feature space.
DIMS = 1 << 17


def gram_ids(text: str, n: int, salt: int) -> np.ndarray:
    """Distinct hashed byte n-grams of a text (n <= 8); a text shorter than n has none."""
    a = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if len(a) < n:
        return np.zeros(0, dtype=np.int64)
    code = np.full(len(a) - n + 1, salt, dtype=np.uint64)
    for i in range(n):
        code = code * np.uint64(0x100000001B3) ^ a[i : len(a) - n + 1 + i]
    code = np.unique(code) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - 17)).astype(np.int64)


def word_ids(words) -> np.ndarray:
    """Hashed whole strings."""
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % DIMS for w in words), dtype=np.int64)


Row = tuple[np.ndarray, np.ndarray]
#: Weights (DIMS, outputs) and biases of several machines.
Model = tuple[np.ndarray, np.ndarray]


def merged(row: Row) -> Row:
    """The row with each feature once."""
    ids, at = np.unique(row[0], return_inverse=True)
    return ids, np.bincount(at, weights=row[1], minlength=len(ids))


def scores(model: Model, row: Row) -> np.ndarray:
    w, b = model
    return row[1] @ w[row[0]] + b


def scores_of(model: Model, rows: list[Row], at_once: int = 400) -> np.ndarray:
    """(rows, outputs) scores of many rows."""
    w, b = model
    out = np.zeros((len(rows), len(b)))
    for lo in range(0, len(rows), at_once):
        part = rows[lo : lo + at_once]
        size = np.array([len(i) for i, _ in part])
        if size.sum():
            x = np.concatenate([v for _, v in part])[:, None] * w[np.concatenate([i for i, _ in part])]
            full = np.flatnonzero(size)
            out[lo + full] = np.add.reduceat(x, (np.cumsum(size) - size)[full], axis=0)
    return out + b


def fit_svms(rows: list[Row], y: np.ndarray, cost: np.ndarray, epochs: int = 6, seed: int = 7) -> Model:
    """L2-regularised squared-hinge SVMs with targets y (rows, outputs) of +-1 and costs alike, by dual coordinate descent on all outputs at once.

    Rows have each feature once. The biases are regularised like weights. Results are fixed for given input. A row of cost 0 is left out
    of that output; an output without positive rows finds nothing.
    """
    k = y.shape[1]
    w, b = np.zeros((DIMS, k)), np.zeros(k)
    alpha = np.zeros(y.shape)
    half = np.where(cost > 0, 0.5 / np.where(cost > 0, cost, 1.0), 0.0)
    diag = 1.0 + np.array([float(v @ v) for _, v in rows])[:, None] + half if rows else half
    live = np.flatnonzero((cost > 0).any(axis=1))
    rnd = np.random.default_rng(seed)
    counts, active = cost > 0, np.ones(len(rows), dtype=bool)
    for n in range(epochs):
        # Rows that no margin holds are passed over until the last epoch.
        for i in rnd.permutation(live if n in (0, epochs - 1) else live[active[live]]):
            ids, v = rows[i]
            old = alpha[i]
            g = y[i] * (v @ w[ids] + b) - 1.0 + old * half[i]
            new = np.maximum(old - g / diag[i], 0.0) * counts[i]
            d = (new - old) * y[i]
            if d.any():
                alpha[i] = new
                w[ids] += v[:, None] * d
                b += d
            elif not new.any():
                active[i] = False
    b = np.where(((y > 0) & (cost > 0)).any(axis=0), b, -1.0)
    return w.astype(np.float32), b
