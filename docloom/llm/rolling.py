"""Hashes of byte runs from prefix sums: the hash of any run is one difference and one product."""

from __future__ import annotations

import numpy as np

#: An odd number and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_tables = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: A fixed value for each byte, so that no byte stands for nothing.
BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(17))


#: The same for a second, independent hash.
OTHER_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))


def powers(n: int, which: str) -> np.ndarray:
    """The first n powers of the base ("up") or of its inverse ("down")."""
    table = _tables[which]
    if len(table) < n:
        factor = np.full(max(n, 1 << 16) * 2, BASE if which == "up" else INVERSE, np.uint64)
        factor[0] = 1
        table = _tables[which] = np.cumprod(factor)
    return table[:n]


def prefix(data: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """Prefix sums of a uint8 array; one longer than data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data), "up"), out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from each start to each end, wherever they stand."""
    return mixed((sums[end] - sums[start]) * powers(len(sums), "down")[start])


def blocks(sizes: list[int], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to most at most, or hold one item."""
    out, a, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > a and total + s > most:
            out.append((a, i))
            a, total = i, 0
        total += s
    return [*out, (a, len(sizes))] if len(sizes) > a else out
