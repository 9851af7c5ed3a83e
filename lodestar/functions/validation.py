"""Checks of parameters and schemas, before any job runs."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MappingError(ValueError):
    """A strategy needs candidates that are rows of the pool."""


def check_scalar(x: Any, name: str, kinds: type | tuple[type, ...], low: float | None = None, high: float | None = None, low_open: bool = False, high_open: bool = False) -> None:
    if not isinstance(x, kinds) or isinstance(x, bool) and bool not in (kinds if isinstance(kinds, tuple) else (kinds,)):
        raise TypeError(f"{name} must be {kinds}")
    if low is not None and (x < low or low_open and x == low):
        raise ValueError(f"{name} is too small: {x}")
    if high is not None and (x > high or high_open and x == high):
        raise ValueError(f"{name} is too large: {x}")


def check_classes(classes: Sequence) -> list:
    if len({type(c) for c in classes}) > 1 and not all(isinstance(c, int | float) for c in classes):
        raise TypeError("classes must be of one type")
    if len(set(classes)) != len(classes):
        raise ValueError("classes repeat")
    return sorted(classes)


def check_class_prior(prior: float | Sequence[float], n: int) -> list[float]:
    out = [float(prior)] * n if isinstance(prior, int | float) else [float(p) for p in prior]
    if len(out) != n or any(p < 0 for p in out):
        raise ValueError("a prior needs one number of at least 0 for each class")
    return out


def check_cost_matrix(cost: Sequence[Sequence[float]] | None, n: int) -> list[list[float]]:
    """Rows are true classes, columns predictions; by default every mistake costs one."""
    if cost is None:
        return [[float(i != j) for j in range(n)] for i in range(n)]
    out = [[float(v) for v in row] for row in cost]
    if len(out) != n or any(len(r) != n for r in out):
        raise ValueError(f"a cost matrix of {n} x {n} numbers is needed")
    if any(v < 0 for r in out for v in r):
        warnings.warn("the cost matrix has negative costs", stacklevel=2)
    if any(out[i][i] != 0 for i in range(n)):
        warnings.warn("the cost matrix has costs of right predictions", stacklevel=2)
    return out


def check_batch_size(batch_size: int, available: int | None = None) -> int:
    check_scalar(batch_size, "batch_size", int, 1)
    if available is not None and batch_size > available:
        warnings.warn(f"only {available} candidates are there", stacklevel=2)
        return available
    return batch_size


def check_features(df: DataFrame, col: str = "x") -> int | None:
    """The one number of features of all rows; None for no rows."""
    low, high = df.agg(F.min(F.size(col)), F.max(F.size(col))).first()
    if low != high:
        raise ValueError("rows differ in their number of features")
    return low


def check_pool(df: DataFrame, classes: Sequence | None = None, features: int | None = None) -> int | None:
    """The number of features of a pool (id, x, y, w), whose rows need ids, finite features of one number, weights of at least 0 and known classes."""
    check_schema(df, {"id": "", "x": "array", "y": ""})
    n = check_features(df)
    if features is not None and n is not None and n != features:
        raise ValueError(f"{features} features are needed, not {n}")
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    faults = {"rows without an id": F.col("id").isNull(), "rows without features": F.col("x").isNull(), "features that are no finite numbers": odd}
    if "w" in df.columns:
        faults["negative weights"] = F.col("w") < 0
    if classes is not None:
        faults["labels of no known class"] = F.col("y").isNotNull() & ~F.col("y").isin(list(classes))
    counts = df.agg(*(F.count_if(c).alias(f"f{k}") for k, c in enumerate(faults.values()))).first()
    found = [what for what, c in zip(faults, counts, strict=True) if c]
    if found:
        raise ValueError("a pool has " + ", ".join(found))
    return n


def check_indices(ids: Sequence[int], pool: DataFrame, unique: bool = True, id_col: str = "id") -> list[int]:
    """The ids, which must be those of rows of the pool and, unless allowed, differ."""
    ids = [int(i) for i in ids]
    if unique and len(set(ids)) != len(ids):
        raise ValueError("indices repeat")
    asked = pool.sparkSession.createDataFrame([(i,) for i in set(ids)], "_i long")  # as many as were given
    if missing := [r[0] for r in asked.join(pool, F.col("_i") == F.col(id_col), "left_anti").limit(5).collect()]:
        raise ValueError(f"indices of no row, such as {sorted(missing)}")
    return ids


def check_bound(bound: Sequence[Sequence[float]]) -> None:
    if len(bound) != 2 or len(bound[0]) != len(bound[1]) or any(a > b for a, b in zip(*bound, strict=True)):
        raise ValueError("a bound is a pair of lower and upper corners")


def check_schema(df: DataFrame, needed: dict[str, str]) -> None:
    have = dict(df.dtypes)
    for col, kind in needed.items():
        if col not in have or kind and not have[col].startswith(kind):
            raise TypeError(f"a column {col} of type {kind or 'any'} is needed")


def derived_seed(seed: int, n_unlabelled: int) -> int:
    """A seed for each cycle: the seed times one more than the unlabelled rows."""
    return seed * (n_unlabelled + 1) % (1 << 31)


def call_with(f: Callable, **kwargs: Any) -> Any:
    """Call with those keywords that the function takes."""
    params = inspect.signature(f).parameters
    if any(p.kind is p.VAR_KEYWORD for p in params.values()):
        return f(**kwargs)
    return f(**{k: v for k, v in kwargs.items() if k in params})
