"""SetSketch registers: exponentially spaced truncated minima of a set's hashes.

Each register draws an exponential waiting time of rate A for every element and keeps the level of the least one, where levels are
powers of BASE, cut off below level 0 and above LEVELS + 1. The registers of a union are the greater of both sets' registers, place by
place. Two sets have a register in common with about the probability of their Jaccard similarity, a little over it,
so runs of registers serve as keys. How many registers are greater in one set, greater in the other and equal gives a likelihood
of the similarity, together with both sizes, which are known.
"""

from __future__ import annotations

import math

import numpy as np

#: Of the published configuration with registers of two bytes (fixed values).
BASE, RATE, LEVELS = 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BAND_BYTES = 2 * ROWS
_STRIP = 1024  # hashes that meet all registers at once
_DRAWS = np.random.default_rng(12).integers(0, 1 << 64, (2, REGISTERS), np.uint64) | np.array([[0], [1]], np.uint64)
_SHRINK, _LOG = (BASE - 1) / BASE, math.log(BASE)


def registers(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS numbers of 16 bits of a set of 64-bit hashes; all 0 for an empty set."""
    least = np.full(REGISTERS, ~np.uint64(0))
    for at in range(0, len(hashes), _STRIP):
        least = np.minimum(least, ((hashes[at : at + _STRIP, None] ^ _DRAWS[0]) * _DRAWS[1]).min(axis=0))
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    # The least of uniform draws belongs to the least waiting time, since one rises with the other.
    with np.errstate(divide="ignore"):
        waits = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        levels = np.floor(1 - np.log(waits) / _LOG)
    return np.clip(levels, 0, LEVELS + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def _greater(x: np.ndarray) -> np.ndarray:
    """The probability that a register is greater in one of two sets; x: its share of the union's rate that is its own."""
    return -np.log1p(-x * _SHRINK) / _LOG


def _slope(x: np.ndarray) -> np.ndarray:
    return _SHRINK / _LOG / (1 - x * _SHRINK)


def similarity(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 30) -> np.ndarray:
    """The most likely Jaccard similarity of each pair of sets, from the number of registers that are greater and less in the
    first and from the sizes (1 or more). The likelihood is concave, so its slope is halved in on."""
    equal = REGISTERS - greater - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        j = (low + high) / 2
        a, b = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        slope = equal * (v * _slope(a) + u * _slope(b)) / np.maximum(1 - _greater(a) - _greater(b), 1e-12) - greater * v * _slope(a) / _greater(a) - less * u * _slope(b) / _greater(b)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2
