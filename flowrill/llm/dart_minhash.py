"""DartMinHash: weighted MinHash signatures from darts thrown at weight and rank.

For every element the plane of weight x rank carries a Poisson process of darts that depends on the
element alone. A set owns the darts below its elements' weights. Each dart is hashed to one
coordinate of the signature, and a coordinate keeps the owned dart of earliest rank. Two sets agree
in a coordinate with a probability of their weighted Jaccard similarity.

Darts are thrown region by region: weights [0, 1), [1, 2), [2, 4), ... and ranks [0, 1/8), [1/8, 1),
[1, 2), [2, 4), ... Bands of rank are opened until all coordinates are filled, so a sparse set costs
about its size plus k log k darts, and one of many elements few darts more than that. Many sets are
signed at once, which changes no signature.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_UNIT = 2.0**-53


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * _UNIT


@lru_cache(maxsize=128)
def _poisson(mean: float) -> np.ndarray:
    """Distribution function at 0, 1, 2, ... of a Poisson number."""
    last = math.ceil(mean + 12 * math.sqrt(mean) + 30)
    terms = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(last + 1)]
    return np.cumsum(terms)


def _doubling(number: int) -> tuple[float, float]:
    """Start and width of a region: [0, 1), [1, 2), [2, 4), [4, 8), ..."""
    return (0.0, 1.0) if number == 0 else (2.0 ** (number - 1), 2.0 ** (number - 1))


def _ranks(number: int) -> tuple[float, float]:
    """The first of these regions is cut at 1/8."""
    return ((0.0, 0.125), (0.125, 0.875))[number] if number < 2 else _doubling(number - 1)


class DartMinHash:
    def __init__(self, coordinates: int, seed: int = 9) -> None:
        self.k = coordinates
        self.seed = seed

    def _darts(self, elements, weights, owners, level: int, ranks: int):
        """Identity, rank and owner of the owned darts of one region of weight and rank."""
        low, width = _doubling(level)
        first, height = _ranks(ranks)
        if level:
            inside = weights > low
            elements, weights, owners = elements[inside], weights[inside], owners[inside]
        region = mix(elements + np.uint64(self.seed * 1_000_003 + level * 1009 + ranks + 1))
        n = np.searchsorted(_poisson(width * height), _uniform(region), side="right")
        starts = np.cumsum(n) - n
        index = np.arange(int(n.sum())) - np.repeat(starts, n)
        dart = mix(np.repeat(region, n) + (index.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        owner = np.repeat(owners, n)
        if width > 1 or (weights < low + width).any():
            owned = low + width * _uniform(mix(dart ^ np.uint64(1))) < np.repeat(weights, n)
            dart, owner = dart[owned], owner[owned]
        return dart, first + height * _uniform(mix(dart ^ np.uint64(2))), owner

    def signatures(self, elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of ``k`` dart identities for each of several weighted sets, given one after the
        other (distinct uint64 elements, weights above 0); zeros for an empty set."""
        found = np.zeros(len(sizes) * self.k, np.uint64)
        empty = np.repeat(np.asarray(sizes) > 0, self.k)
        owners = np.repeat(np.arange(len(sizes)), sizes)
        ranks = 0
        while empty.any():
            levels = 1 + max(0, math.ceil(math.log2(float(weights.max()))))
            parts = [self._darts(elements, weights, owners, level, ranks) for level in range(levels)]
            dart, rank, owner = (np.concatenate(p) for p in zip(*parts))
            place = owner * self.k + (mix(dart ^ np.uint64(3)) % np.uint64(self.k)).astype(np.int64)
            free = empty[place]
            dart, rank, place = dart[free], rank[free], place[free]
            latest_first = np.argsort(-rank, kind="stable")
            found[place[latest_first]] = dart[latest_first]
            empty[place] = False
            ranks += 1
            open_sets = empty.reshape(-1, self.k).any(axis=1)
            if not open_sets.all():
                left = open_sets[owners]
                elements, weights, owners = elements[left], weights[left], owners[left]
        return found.reshape(-1, self.k)

    def signature(self, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The signature of one set."""
        return self.signatures(elements, weights, np.array([len(elements)]))[0]
