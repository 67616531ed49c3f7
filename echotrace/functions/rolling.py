"""Rolling hashes of windows of 64-bit codes, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Multiplier of the polynomial; any odd number with well-mixed bits does.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n at least; kept, as long files need long tables."""
    if len(_POWERS.get("up", ())) < n:
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, 4096), b, dtype=_U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def spans_hash(codes: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hash (as int64) of the codes[start : start + size] of each start; equal content, equal hash."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum(_mix(codes) * up[: len(codes)], out=sums[1:])
    return _mix((sums[start + size] - sums[start]) * down[start] + _mix(np.atleast_1d(np.asarray(size)).astype(_U))).view(np.int64)


def windows_hash(codes: np.ndarray, k: int, out_of_scope: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the k codes from each place on; 0 where they reach over the end or out of scope. `salt` keeps apart what must not meet."""
    n = len(codes)
    win = np.zeros(n, dtype=np.int64)
    if k < 1 or n < k:
        return win
    before = np.r_[0, np.cumsum(out_of_scope)]
    at = np.flatnonzero(before[k:] == before[: n - k + 1])
    h = _mix(spans_hash(codes, at, k).view(_U) ^ _mix(np.array([salt], dtype=np.int64).view(_U) + _U(1)))
    win[at] = np.where(h == 0, _U(1), h).view(np.int64)
    return win
