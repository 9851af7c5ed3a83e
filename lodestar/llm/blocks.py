"""Meeting keys of binary codes: blocks of bits by their pivot coordinates, with the least sure bits turned over."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, log, log2, pi

import numpy as np

from lodestar.llm.simhash import Scheme, references

#: Chance with which a pair at the least correlation does not meet, at most, by the model of :func:`meeting`.
MISS = 0.001
#: Bits of a block that may be turned over.
FLIPS = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=64)
def meeting(width: int, flips: int, rho: float) -> float:
    """The chance that items of correlation ``rho`` meet in a block: all bits that differ are among the least sure ones, of either item.

    By sampling correlated normals, which sums of many votes tend to.
    """
    rng, n = np.random.default_rng(1), 20_000
    x = rng.standard_normal((n, width))
    y = rho * x + max(0.0, 1 - rho * rho) ** 0.5 * rng.standard_normal((n, width))
    low = [np.argsort(np.argsort(np.abs(v), axis=1), axis=1) < flips for v in (x, y)]
    return float((~(((x > 0) != (y > 0)) & ~low[0] & ~low[1]).any(axis=1)).mean())


class Blocks:
    """The blocks of the codes of so many items, of which those of correlation ``rho`` or more shall meet.

    A block has so many bits that few unrelated items share it (their number over
    2^width stays within 16 up to 2^44 items), and 14 at least; there are as many
    blocks as the chance to meet asks for, and as many words of 64 bits as hold
    them, 4 at least. ``scheme`` links codes within the distance that all but a
    few in a million of such pairs have.
    """

    def __init__(self, n_items: int, rho: float, ratio: Fraction | None = None):
        if not 0.5 <= rho <= 1:
            raise ValueError("items must be correlated by 0.5 to 1 to be found by their codes")
        self.width = max(14, min(40, ceil(log2(max(2, n_items))) - 4))
        chance = min(meeting(self.width, FLIPS, rho), 1 - MISS)
        self.number = ceil(log(MISS) / log(1 - chance))
        self.words = max(4, ceil(self.width * self.number / 64))
        differ, bits = acos(rho) / pi, 64 * self.words
        self.scheme = Scheme(self.words, round(bits * differ + 4.4 * (bits * differ * (1 - differ)) ** 0.5), (), (), pivots=2, ratio=ratio)
        self.places = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        bit = np.unpackbits(references(self.words).view(np.uint8), axis=1, bitorder="little")[:, : self.width * self.number]
        self.refs = bit.reshape(len(bit), self.number, self.width).astype(np.uint64) @ self.places  # (references, blocks)

    def keys(self, votes: np.ndarray, flips: int = FLIPS) -> np.ndarray:
        """Keys (rows by blocks and turned bits) of the pivot coordinates of each block; a bit is set by a positive vote."""
        v = votes[:, : self.number * self.width].reshape(len(votes), self.number, self.width)
        value = (v > 0).astype(np.uint64) @ self.places
        close = np.argsort(np.abs(v), axis=2, kind="stable")[:, :, :flips]
        flip = self.places[close]
        values = [value]
        for r in range(1, flips + 1):
            values += [value ^ flip[:, :, list(c)].sum(axis=2, dtype=np.uint64) for c in combinations(range(flips), r)]
        value = np.stack(values, axis=2)
        key = np.broadcast_to(np.arange(1, self.number + 1, dtype=np.uint64)[None, :, None], value.shape)
        for r in self.refs:
            key = (key ^ (key >> np.uint64(29))) * _MIX + np.bitwise_count(value ^ r[None, :, None])
        return (key ^ (key >> np.uint64(32))).reshape(len(votes), -1)

    def codes(self, votes: np.ndarray) -> list[bytes]:
        """The code of each row of votes, little-endian."""
        return [c.tobytes() for c in np.packbits(votes[:, : 64 * self.words] > 0, axis=1, bitorder="little")]
