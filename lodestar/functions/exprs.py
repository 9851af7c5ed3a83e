"""Column builders on arrays: distances, kernels, entropies and decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def kernel(name: str, gamma: float = 1.0, degree: int = 3, coef0: float = 1.0) -> Callable[[Column, Column], Column]:
    """A named kernel between two array columns."""
    kinds: dict[str, Callable[[Column, Column], Column]] = {
        "rbf": lambda a, b: F.exp(-gamma * sqdist(a, b)),
        "laplacian": lambda a, b: F.exp(-gamma * manhattan(a, b)),
        "linear": dot,
        "poly": lambda a, b: F.pow(gamma * dot(a, b) + coef0, F.lit(degree)),
        "sigmoid": lambda a, b: F.tanh(gamma * dot(a, b) + coef0),
        "cosine": lambda a, b: dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)),
    }
    return kinds[name]


def normalised(freq: Column, prior: float | list[float] = 0.0) -> Column:
    """Class probabilities from frequencies and a prior; uniform where there is no mass."""
    p = F.transform(freq, lambda v: v + prior) if isinstance(prior, int | float) else F.zip_with(freq, F.array(*map(F.lit, prior)), lambda a, b: a + b)
    s = total(p)
    return F.when(s > 0, F.transform(p, lambda v: v / s)).otherwise(F.transform(freq, lambda v: F.lit(1.0) / F.size(freq)))


def argmax(a: Column) -> Column:
    """Place (from 0) of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def expected_costs(p: Column, cost: list[list[float]]) -> Column:
    """Expected cost of each prediction; rows of ``cost`` are true classes, columns predictions."""
    return F.array(*(sum((p[t] * cost[t][c] for t in range(1, len(cost))), p[0] * cost[0][c]) for c in range(len(cost))))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.log(v)).otherwise(0.0))


def least_confident(p: Column, cost: list[list[float]] | None = None) -> Column:
    return 1 - F.array_max(p) if cost is None else F.array_min(expected_costs(p, cost))


def margin(p: Column, cost: list[list[float]] | None = None) -> Column:
    s = F.sort_array(p, False) if cost is None else F.sort_array(expected_costs(p, cost))
    gap = F.abs(s[0] - s[1])
    return 1 - gap if cost is None else -gap


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)))


def clipped(p: Column, eps: float) -> Column:
    """Probabilities of at least eps, normalised again."""
    q = F.transform(p, lambda v: F.least(F.greatest(v, F.lit(eps)), F.lit(1.0)))
    s = total(q)
    return F.transform(q, lambda v: v / s)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda v: F.exp(v - F.array_max(a)))
    s = total(e)
    return F.transform(e, lambda v: v / s)


def outer(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def one_hot(place: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == place, 1.0).otherwise(0.0))
