"""Polynomial hashes of all substrings of a byte array from one prefix sum."""

from __future__ import annotations

import hashlib

import numpy as np

#: Sums modulo 2**64 can be fooled by regular strings, the shortest of which have over a thousand bytes.
LONG_SPAN = 256
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept and grown as needed."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, factor in enumerate((BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`span_hash` takes the hash of any span of ``data`` (uint8)."""
    powers, _ = _table(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends]; equal spans of equal length have equal hashes.

    Spans of LONG_SPAN bytes and more have the first bytes of a digest of their bytes.
    """
    _, inverse = _table(len(sums))
    found = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        found[i] = int.from_bytes(digest, "little")
    return found


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all spans of one width."""
    _, inverse = _table(len(sums))
    n = max(0, len(sums) - width)
    return mixed((sums[width:] - sums[:n]) * inverse[:n] + np.uint64(width))


def span_hashes(sums: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the spans of one width that begin at the given places, as :func:`window_hash` has them."""
    _, inverse = _table(len(sums))
    return mixed((sums[places + width] - sums[places]) * inverse[places] + np.uint64(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values."""
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - size:width - size + n])
