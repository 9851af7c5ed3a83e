"""Budget managers: what is wanted of an item, and what is learned from the decision.

A state is a plain dictionary that JSON can hold, so the same steps serve the
batch fold and the streaming processor. ``step`` decides and learns at once;
``query`` decides for a batch and leaves the state as it is; ``update`` learns
from decisions made elsewhere. A null utility is never queried. Random numbers
come from the seed and the item's position.
"""

from __future__ import annotations

import copy
import math
import warnings
from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

State = dict
_MASK = (1 << 64) - 1


def hashed(seed: int, position: int, salt: int = 0) -> float:
    """Uniform in (0, 1), by a mixer of seed, position and salt."""
    z = (seed * 0x9E3779B97F4A7C15 + position * 0xD1B54A32D192ED03 + (salt + 1) * 0x8CB92BA72F3D8DD7) & _MASK
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        z = (z ^ z >> 30) * m & _MASK
    return ((z ^ z >> 31) >> 11) / (1 << 53) + 2.0**-54


def hashed_normal(seed: int, position: int) -> float:
    return math.sqrt(-2 * math.log(hashed(seed, position, 1))) * math.cos(2 * math.pi * hashed(seed, position, 2))


@dataclass
class BudgetManager:
    """The budget is the share of items that may be queried."""

    budget: float = 0.1
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.budget <= 1:
            raise ValueError("a budget is more than 0 and at most 1")

    def initial(self) -> State:
        return {"n": 0}

    def wants(self, state: State, u: float | None) -> bool:
        """Whether the item, the n-th of the state, is queried; the state stays as it is."""
        raise NotImplementedError

    def learn(self, state: State, u: float | None, queried: bool) -> None:
        """Take in what was decided about the n-th item."""

    def step(self, state: State, utility: float | None) -> bool:
        u = _number(utility)
        state["n"] += 1
        queried = bool(self.wants(state, u))
        self.learn(state, u, queried)
        return queried

    def query(self, state: State, utilities: Sequence[float | None]) -> list[bool]:
        """Decisions for a batch of items in order; the state stays as it is."""
        trial = copy.deepcopy(state)
        return [self.step(trial, u) for u in utilities]

    def update(self, state: State, utilities: Sequence[float | None], queried: Sequence[bool]) -> State:
        """The state after the items of a batch and the decisions about them."""
        for u, q in zip(utilities, queried, strict=True):
            state["n"] += 1
            self.learn(state, _number(u), bool(q))
        return state


def _number(u: float | None) -> float | None:
    return None if u is None or math.isnan(u) else u


@dataclass
class EstimatedBudget(BudgetManager):
    """Spending is estimated over about the last w items."""

    w: int = 100

    def initial(self) -> State:
        return {"n": 0, "spent": 0.0}

    def room(self, state: State) -> bool:
        return state["spent"] / self.w < self.budget

    def wants(self, state: State, u: float | None) -> bool:
        return self.room(state) and self.likes(state, u)

    def likes(self, state: State, u: float | None) -> bool:
        raise NotImplementedError

    def learn(self, state: State, u: float | None, queried: bool) -> None:
        state["spent"] = state["spent"] * (self.w - 1) / self.w + queried


@dataclass
class FixedUncertaintyManager(EstimatedBudget):
    """Queries below a fixed confidence that the number of classes and the budget give."""

    n_classes: int = 2

    def likes(self, state: State, u: float | None) -> bool:
        return u is not None and 1 - u <= 1 / self.n_classes + self.budget * (1 - 1 / self.n_classes)


@dataclass
class VariableUncertaintyManager(EstimatedBudget):
    """The threshold falls with each query and rises otherwise, while there is budget."""

    theta: float = 1.0
    s: float = 0.01

    def initial(self) -> State:
        return {"n": 0, "spent": 0.0, "theta": self.theta}

    def noise(self, state: State) -> float:
        return 1.0

    def likes(self, state: State, u: float | None) -> bool:
        return u is not None and 1 - u < state["theta"] * self.noise(state)

    def moves(self, state: State) -> bool:
        """Whether the n-th item moves the threshold."""
        return self.room(state)

    def learn(self, state: State, u: float | None, queried: bool) -> None:
        if self.moves(state):
            state["theta"] *= 1 - self.s if queried else 1 + self.s
        super().learn(state, u, queried)


@dataclass
class RandomVariableUncertaintyManager(VariableUncertaintyManager):
    """The threshold is multiplied with a normal number around one for each item."""

    delta: float = 1.0

    def noise(self, state: State) -> float:
        return 1 + self.delta * hashed_normal(self.seed, state["n"])


@dataclass
class SplitManager(VariableUncertaintyManager):
    """A share v of the items is queried at random, the rest by the variable threshold."""

    v: float = 0.1

    def at_random(self, state: State) -> bool:
        return hashed(self.seed, state["n"], 3) < self.v

    def likes(self, state: State, u: float | None) -> bool:
        if self.at_random(state):
            return u is not None and hashed(self.seed, state["n"], 4) <= self.budget
        return super().likes(state, u)

    def moves(self, state: State) -> bool:
        return super().moves(state) and not self.at_random(state)


@dataclass
class RandomBudgetManager(EstimatedBudget):
    def likes(self, state: State, u: float | None) -> bool:
        return u is not None and hashed(self.seed, state["n"]) <= self.budget


@dataclass
class DensityBasedSplitManager(BudgetManager):
    """Counts what was queried exactly; a variable threshold with noise while there is budget."""

    theta: float = 1.0
    s: float = 0.01
    delta: float = 1.0

    def initial(self) -> State:
        return {"n": 0, "queried": 0, "theta": self.theta}

    def room(self, state: State) -> bool:
        return self.budget > state["queried"] / state["n"]

    def wants(self, state: State, u: float | None) -> bool:
        return self.room(state) and u is not None and 1 - u < state["theta"] * (1 + self.delta * hashed_normal(self.seed, state["n"]))

    def learn(self, state: State, u: float | None, queried: bool) -> None:
        if self.room(state):
            state["theta"] *= 1 - self.s if queried else 1 + self.s
        state["queried"] += queried


@dataclass
class BalancedQuantileManager(BudgetManager):
    """Queries utilities over a quantile of the last w, moved so that spending keeps to the budget.

    The last utilities are kept in their order and sorted, so an item costs a place found by bisection.
    """

    w: int = 100
    w_tol: int = 50

    def initial(self) -> State:
        return {"n": 0, "queried": 0, "history": [], "sorted": []}

    def with_item(self, state: State, u: float) -> list[float]:
        """The sorted last w utilities once u is among them."""
        h = list(state["sorted"])
        if len(h) >= self.w:
            del h[bisect_left(h, state["history"][0])]
        insort(h, u)
        return h

    def wants(self, state: State, u: float | None) -> bool:
        if u is None:
            return False
        h = self.with_item(state, u)
        place = (1 - self.budget) * (len(h) - 1)
        k = min(int(place), len(h) - 1)
        low, high, t = h[k], h[min(k + 1, len(h) - 1)], place - k
        theta = low + (high - low) * t if t < 0.5 else high - (high - low) * (1 - t)
        return u >= theta - (h[-1] - h[0]) * (self.budget * state["n"] - state["queried"]) / self.w_tol

    def learn(self, state: State, u: float | None, queried: bool) -> None:
        if u is not None:
            state["sorted"] = self.with_item(state, u)
            state["history"] = [*state["history"], u][-self.w :]
            state["queried"] += queried


@dataclass
class PeriodicManager(BudgetManager):
    """Queries as soon as a whole label's budget has come together."""

    def initial(self) -> State:
        return {"n": 0, "queried": 0}

    def wants(self, state: State, u: float | None) -> bool:
        return state["n"] * self.budget - state["queried"] >= 1 - 1e-9

    def learn(self, state: State, u: float | None, queried: bool) -> None:
        state["queried"] += queried


@dataclass
class RandomManager(BudgetManager):
    """Queries at random; within the budget counted exactly unless it may be exceeded."""

    allow_exceeding: bool = True

    def initial(self) -> State:
        return {"n": 0, "queried": 0}

    def wants(self, state: State, u: float | None) -> bool:
        room = self.allow_exceeding or state["n"] * self.budget - state["queried"] > 1
        return room and hashed(self.seed, state["n"]) >= 1 - self.budget

    def learn(self, state: State, u: float | None, queried: bool) -> None:
        state["queried"] += queried


class FeatureStrategy:
    """A strategy whose state takes in the items' features besides their utilities."""

    def query(self, state: State, utilities: Sequence[float | None], xs: Sequence[list[float]]) -> list[bool]:
        """Decisions for a batch of items in order; the state stays as it is."""
        trial = copy.deepcopy(state)
        return [self.step(trial, u, x) for u, x in zip(utilities, xs, strict=True)]


@dataclass
class DensityStrategy(FeatureStrategy):
    """Asks the manager only for items that are the new nearest neighbour of some recent one."""

    manager: BudgetManager = field(default_factory=DensityBasedSplitManager)
    window: int = 100

    def initial(self) -> State:
        return {"m": self.manager.initial(), "x": [], "d": []}

    def step(self, state: State, utility: float | None, x: list[float]) -> bool:
        density = 0
        if state["x"]:
            d = np.sqrt(((np.array(state["x"]) - np.array(x)) ** 2).sum(axis=1))
            least = np.array(state["d"])
            density = int((d < least).sum())
            state["d"] = np.minimum(d, least).tolist()
            nearest = float(d.min())
        else:
            nearest = 1e308  # no neighbour yet
        state["x"] = (state["x"] + [list(x)])[-self.window :]
        state["d"] = (state["d"] + [nearest])[-self.window :]
        return self.manager.step(state["m"], utility if density > 0 else None)


@dataclass
class CognitiveStrategy(FeatureStrategy):
    """As density, with a memory whose weakest item goes: strength decays, and less so for items found near often."""

    manager: BudgetManager = field(default_factory=RandomVariableUncertaintyManager)
    window: int = 50
    density_threshold: int = 1
    force_full_budget: bool = False

    def initial(self) -> State:
        return {"m": self.manager.initial(), "t": 0, "x": [], "d": [], "theta": [], "seen": []}

    def step(self, state: State, utility: float | None, x: list[float]) -> bool:
        t = state["t"]
        density, nearest = 0, 1e308
        if state["x"]:
            d = np.sqrt(((np.array(state["x"]) - np.array(x)) ** 2).sum(axis=1))
            hit = d < np.array(state["d"])
            density, nearest = int(hit.sum()), float(d.min())
            state["d"] = np.minimum(d, state["d"]).tolist()
            state["theta"] = (np.array(state["theta"]) + hit).tolist()
            state["seen"] = np.where(hit, t, state["seen"]).tolist()
        if len(state["x"]) > self.window:
            strength = np.exp(-(t - np.array(state["seen"])) / (np.array(state["theta"]) + 1.0))
            k = int(strength.argmin())
            for part in ("x", "d", "theta", "seen"):
                del state[part][k]
        for part, v in (("x", list(x)), ("d", nearest), ("theta", 0), ("seen", t)):
            state[part].append(v)
        state["t"] = t + 1
        if density >= self.density_threshold:
            return self.manager.step(state["m"], utility)
        return self.manager.step(state["m"], None) if self.force_full_budget else False


def cognitive(kind: str, **kwargs) -> CognitiveStrategy:
    """The named variants: Ran, FixUn, VarUn and RanVarUn."""
    managers = {"Ran": RandomBudgetManager, "FixUn": FixedUncertaintyManager, "VarUn": VariableUncertaintyManager, "RanVarUn": RandomVariableUncertaintyManager}
    return CognitiveStrategy(managers[kind](**kwargs))


def check_budget_manager(budget: float | None = None, manager: BudgetManager | None = None, default: type[BudgetManager] = FixedUncertaintyManager) -> BudgetManager:
    """The manager as given, else the default with the budget; a budget that differs from the manager's is warned about and not used."""
    if manager is None:
        return default() if budget is None else default(budget=budget)
    if budget is not None and budget != manager.budget:
        warnings.warn(f"the manager's budget of {manager.budget} holds, not {budget}", stacklevel=2)
    return manager
