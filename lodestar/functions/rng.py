"""Random numbers from hashes: the same for a seed and a row wherever it is computed."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 1 << 52


def uniform(seed: int, *keys: Column | str) -> Column:
    """In the open interval (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(_STEPS)) + 0.5) / float(_STEPS)


def gumbel(seed: int, *keys: Column | str) -> Column:
    return -F.log(-F.log(uniform(seed, *keys)))


def normal(seed: int, *keys: Column | str) -> Column:
    """Standard normal, by Box and Muller."""
    u, v = uniform(seed, *keys), uniform(seed + 0x5BD1E995, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def generator(seed: int, *keys: int) -> np.random.Generator:
    """A counter-based generator for a place in a stream or a row."""
    return np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, hash(keys) & (1 << 64) - 1]))
