"""Utilities of uncertainty, committee disagreement and expected error."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import exprs as E
from lodestar.functions.rng import uniform
from lodestar.operators.classifiers import ParzenWindow
from lodestar.operators.pairs import Block, Side, against, as_arrays

EPS = float(np.finfo(float).eps)
#: Makes a model, a function from features to class probabilities, of features, class codes and weights.
Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def random_sampling(cand: DataFrame, seed: int = 0) -> DataFrame:
    """A utility of one and a hashed key: the candidates of largest key are a random sample."""
    return cand.select("id", F.lit(1.0).alias("utility"), uniform(seed, "id").alias("key"))


def uncertainty(probas: DataFrame, method: str = "least_confident", cost: list[list[float]] | None = None, weight: str | None = None) -> DataFrame:
    """Rows (id, utility) from rows (id, p): least_confident, margin_sampling or entropy, times a weight."""
    if method == "entropy" and cost is not None:
        raise ValueError("entropy takes no cost matrix")
    u = {"least_confident": lambda: E.least_confident(F.col("p"), cost), "margin_sampling": lambda: E.margin(F.col("p"), cost), "entropy": lambda: E.entropy(F.col("p"))}[method]()
    return probas.select("id", (u * F.col(weight) if weight else u).alias("utility"))


def expected_precisions(p: np.ndarray, nodes: int = 32) -> np.ndarray:
    """For each of the probabilities, which descend: the expected average precision of the ranking of all others.

    The recursion over hits among the first n rows (which takes the first row for
    a hit) is the expectation of (1 + sum of hits so far / n at each hit) / hits.
    With 1 / t the integral of z^(t - 1) over 0..1 the hits are independent under
    the integral, of chance r = p z / (1 - p + p z); what lies before and behind a
    row are running sums, so leaving a row out costs nothing more. The integral
    goes over panels that halve towards z = 1, where the product has its mass.
    """
    n = len(p)
    if n < 2:
        return np.zeros(n)
    first, q, rank = p[0], p[1:], np.arange(2.0, n + 1)
    x, w = np.polynomial.legendre.leggauss(nodes)
    edges = [2.0**-k for k in range(int(math.log2(p.sum() + 2)) + 5)] + [0.0]
    out, of_first = np.zeros(n - 1), 0.0
    for high, low in zip(edges[:-1], edges[1:], strict=True):
        for gap, weight in zip((low + high) / 2 + (high - low) / 2 * x, (high - low) / 2 * w, strict=True):
            d = 1 - q * gap
            r, log_d = q * (1 - gap) / d, np.log(d)
            product = log_d.sum()
            if product - log_d.min() < -800:
                continue  # below the least number
            before = np.cumsum(r) - r  # hits among the rows above, but for the first
            ahead = r * (2 + before) / rank
            behind, each = r * (2 + before) / (rank - 1), r / (rank - 1)
            worth = 2 + np.cumsum(ahead) - ahead + behind.sum() - np.cumsum(behind) - r * (each.sum() - np.cumsum(each))
            out += weight * np.exp(product - log_d) * worth
            of_first += weight * math.exp(product - log_d[0]) * (2 + (r[1:] * (2 + before[1:] - r[0]) / (rank[1:] - 1)).sum())
    return np.concatenate([[of_first * q[0]], out * first])


def expected_average_precision(probas: DataFrame, n_classes: int) -> DataFrame:
    """Rows (id, utility): summed expected average precision of ranking all other rows by each class.

    A ranking is one sequence, so ids and probabilities, a few numbers a row, are
    gathered to one place; its cost is that of some hundred passes over them
    (:func:`expected_precisions`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        p = t.column("p").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, n_classes)
        u = np.zeros(len(p))
        for c in range(n_classes):
            order = np.argsort(-p[:, c], kind="stable")
            u[order] += expected_precisions(p[order, c])
        yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(u)], names=["id", "utility"])

    dealt = probas.select("id", "p").repartition(probas.sparkSession.sparkContext.defaultParallelism)  # what makes them stays in many tasks
    return dealt.coalesce(1).mapInArrow(run, "id long, utility double")


def epistemic_pwc(freq: DataFrame, steps: int = 40, table: int | None = None) -> DataFrame:
    """Rows (id, utility) from rows (id, freq) of two classes: min of the support of either class, by golden section over theta.

    With ``table`` the supports of whole frequencies up to that number are
    worked out once, and frequencies between them interpolated.
    """

    def support(n: float, p: float) -> float:
        if n == 0 and p == 0:
            return 1.0
        top = p / (n + p)
        best = (p * math.log(top) if p else 0.0) + (n * math.log(1 - top) if n else 0.0)

        def value(theta: float) -> float:
            ll = (p * math.log(theta) if p and theta > 0 else (-math.inf if p else 0.0)) + (n * math.log(1 - theta) if n and theta < 1 else (-math.inf if n else 0.0))
            return min(math.exp(ll - best), 2 * theta - 1)

        a, b, g = 0.5, 1.0, (math.sqrt(5) - 1) / 2
        for _ in range(steps):
            x, y = b - g * (b - a), a + g * (b - a)
            if value(x) < value(y):
                a = x
            else:
                b = y
        return max(0.0, value((a + b) / 2), value(1.0) if n == 0 else 0.0)

    grid = np.array([[min(support(n, p), support(p, n)) for p in range(table + 2)] for n in range(table + 2)]) if table else None

    def utility(n: float, p: float) -> float:
        if grid is None or max(n, p) > table:
            return min(support(n, p), support(p, n))
        i, j = int(n), int(p)
        a, b = n - i, p - j
        return float((1 - a) * ((1 - b) * grid[i, j] + b * grid[i, j + 1]) + a * ((1 - b) * grid[i + 1, j] + b * grid[i + 1, j + 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [utility(f[0], f[1]) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(u, pa.float64())], names=["id", "utility"])

    return freq.select(F.col("id").cast("long"), "freq").mapInArrow(run, "id long, utility double")


#: Labelled rows, and candidates, that :class:`LogisticPeaks` works on at once.
ROWS_AT_ONCE, CANDIDATES_AT_ONCE = 512, 256
#: What the likelihood may still gain where the steps end, and how close the bounds of a utility have to come.
GAIN, CLOSE = 1e-10, 1e-12


class LogisticPeaks:
    """The penalised likelihood of a logistic regression over all blocks of its labelled rows, and its maxima where a row has a given logit.

    Weights come as lines of a matrix, one for each candidate, so that a step for
    many candidates is two matrix products with the labelled rows.
    """

    def __init__(self, blocks: list[Block], ridge: float):
        self.blocks, self.ridge = blocks, ridge
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = self.data()[0][0].shape[1]
        self.free = self.inverse = np.zeros((width, width))  # of use only once the fit is there
        self.free = self.newton(None, 0.0, np.zeros(width))
        self.best = float(self.values(self.free[None])[0][0])
        self.inverse = np.linalg.inv(self.hessian(self.free))
        self.reach = math.sqrt(max(float(((x @ self.inverse) * x).sum(axis=1).max()) for x, _ in self.parts()))  # no labelled row's logit moves more for a step of length one in the metric of the fit

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": []}  # the rows are not shipped with the functions

    def data(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Features with a one, rows by number, and sums by labels, of each block; loaded once in each process."""
        if not self.held:
            for side in (b.load() for b in self.blocks):
                x = np.hstack([side["x"], np.ones((len(side["y"]), 1))])
                order = np.argsort(side["n"], kind="stable")  # equal numbers lie together
                self.held.append((x[order], side["n"][order].astype(np.float64), side["y"] @ x))
        return self.held

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, n, _ in self.data():
            for s in range(0, len(x), ROWS_AT_ONCE):
                yield x[s : s + ROWS_AT_ONCE], n[s : s + ROWS_AT_ONCE]

    def values(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likelihood and its gradient for each line of weights."""
        total = sum(xy for _, _, xy in self.data())
        value, slope = w @ total - 0.5 * self.ridge * (w * w).sum(axis=1), total - self.ridge * w
        many, across = len(w), np.ascontiguousarray(w.T)
        room = np.empty((2, ROWS_AT_ONCE * many))  # memory that is touched again and again
        for x, n in self.parts():
            z, more = (r[: len(x) * many].reshape(len(x), many) for r in room)
            np.matmul(x, across, out=z)
            if z.max(initial=0.0) > 700:
                value -= n @ np.maximum(z - 700, 0)
                np.minimum(z, 700, out=z)
            np.exp(z, out=z)
            np.add(z, 1, out=more)
            if n[0] == n[-1]:
                whole = len(x) // 32 * 32
                with np.errstate(over="ignore"):
                    logs = n[0] * (np.log(more[:whole].reshape(-1, 32, many).prod(axis=1)).sum(axis=0) + np.log(more[whole:]).sum(axis=0))  # a logarithm for 32 rows
                beyond = ~np.isfinite(logs)
                logs[beyond] = n @ np.log(more[:, beyond])
            else:
                logs = n @ np.log(more)
            value -= logs
            np.divide(z, more, out=z)
            if n[-1] > 1:
                z *= n[:, None]
            slope -= z.T @ x
        return value, slope

    def hessian(self, w: np.ndarray) -> np.ndarray:
        out = (self.ridge + 1e-9) * np.eye(len(w))
        for x, n in self.parts():
            p = 1 / (1 + np.exp(np.clip(-x @ w, -700, 700)))
            out += (x * (n * p * (1 - p))[:, None]).T @ x
        return out

    def newton(self, a: np.ndarray | None, logit: float, w: np.ndarray) -> np.ndarray:
        """The best weights, or those with ``a @ w`` at the logit, by Newton steps from w, halved until they rise."""
        if a is not None:
            w = w + a * ((logit - a @ w) / (a @ a))
        value, slope = (v[0] for v in self.values(w[None]))
        for _ in range(200):
            inverse = np.linalg.inv(self.hessian(w))
            move = inverse @ slope
            if a is not None:
                along = inverse @ a
                move = move - along * ((a @ move) / (a @ along))
            for _ in range(40):
                new, turned = (v[0] for v in self.values((w + move)[None]))
                if new >= value - 1e-10:
                    break
                move = move / 2
            w, value, slope = w + move, new, turned
            if not np.abs(move).max(initial=0.0) >= 1e-9:
                break
        return w

    def peaks(self, a: np.ndarray, logit: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the highest likelihood, less the fit's, with ``a @ w`` at its logit, and its weights.

        Quasi-Newton steps (L-BFGS) from w in the metric of the fit, within the
        constraint, until what is still to be gained is less than ``GAIN``; a row
        that needs too many has Newton steps of its own.
        """
        out, at = np.empty(len(a)), np.empty_like(a)
        along = a @ self.inverse
        width = (a * along).sum(axis=1)

        def level(w: np.ndarray) -> np.ndarray:
            return w + along * ((logit - (a * w).sum(axis=1)) / width)[:, None]

        live, w = np.arange(len(a)), level(w)
        value, slope = self.values(w)
        past: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(80):
            q, shares = slope.copy(), []
            for s, y, r in reversed(past):
                shares.append(r * (s * q).sum(axis=1))
                q -= shares[-1][:, None] * y
            move = q @ self.inverse
            move -= along * ((a * move).sum(axis=1) / width)[:, None]
            for (s, y, r), share in zip(past, reversed(shares), strict=True):
                move += s * (share - r * (y * move).sum(axis=1))[:, None]
            gain = (slope * move).sum(axis=1) / 2
            ended = gain < GAIN
            out[live[ended]], at[live[ended]] = value[ended] + gain[ended], w[ended]
            if ended.any():
                stay = ~ended
                live, a, along, width, logit, w, value, slope, move, gain = (v[stay] for v in (live, a, along, width, logit, w, value, slope, move, gain))
                past = [(s[stay], y[stay], r[stay]) for s, y, r in past]
            if not len(live):
                break
            new, turned = self.values(w + move)
            for _ in range(40):
                low = np.flatnonzero(~(new >= value + 1e-4 * gain - 1e-10))
                if not len(low):
                    break
                move[low] /= 2
                gain[low] /= 2
                new[low], turned[low] = self.values(w[low] + move[low])
            y = slope - turned
            bent = (move * y).sum(axis=1)
            past = [*past[-9:], (move, y, np.divide(1.0, bent, out=np.zeros(len(bent)), where=bent > 1e-300))]
            w, value, slope = w + move, new, turned
        for k, row in enumerate(live):
            at[row] = self.newton(a[k], logit[k], w[k])
            out[row] = self.values(at[row][None])[0][0]
        return np.minimum(0.0, out - self.best), at

    def supports(self, a: np.ndarray, alphas: np.ndarray) -> np.ndarray:
        """For each row the lesser support of either class over levels alpha of its probability.

        A support is the largest of min(likelihood ratio, line) over the levels of
        its side. The logistic loss is self-concordant: no labelled row's logit
        moves more than ``reach`` times the length of a step, so that the fit alone
        bounds the likelihood of every level from both sides. Only where these
        bounds leave a utility open, a level is solved, that of the highest upper
        bound; as the likelihood is concave in the logit, it bounds the others too.
        """
        logit, line = np.log(alphas / (1 - alphas)), np.abs(2 * alphas - 1)
        sides = [2 * alphas > 1, 2 * alphas < 1]
        own, rows = a @ self.free, np.arange(len(a))
        length = np.abs(logit - own[:, None]) / np.sqrt((a * (a @ self.inverse)).sum(axis=1))[:, None] * self.reach
        with np.errstate(over="ignore"):
            low, high = (-np.where(length < 1e-4, length**2 / 2 * (1 + sign * length / 3), np.expm1(sign * length) - sign * length) / self.reach**2 for sign in (1, -1))
        last, last_off = np.tile(self.free, (len(a), 1)), np.zeros(len(a))  # the weights of the level solved last, and its logit less the fit's
        while True:
            at_least, at_most = np.minimum(np.exp(low), line), np.minimum(np.exp(high), line)
            least = np.stack([np.where(side, at_least, 0.0).max(axis=1) for side in sides])
            most = np.stack([np.where(side, at_most, 0.0).max(axis=1) for side in sides])
            which = np.stack([np.where(side, at_most, 0.0).argmax(axis=1) for side in sides])
            open_ = np.flatnonzero(most.min(axis=0) - least.min(axis=0) > CLOSE)
            if not len(open_):
                return (least.min(axis=0) + most.min(axis=0)) / 2
            k = which[least.argmin(axis=0), rows][open_]
            off, before = logit[k] - own[open_], last_off[open_]
            start = self.free + (last[open_] - self.free) * np.divide(off, before, out=np.zeros(len(off)), where=before * off > 0)[:, None]
            peak, last[open_] = self.peaks(a[open_], logit[k], start)
            last_off[open_] = off
            ratio = (logit - own[open_, None]) / off[:, None]
            l, h = low[open_], high[open_]  # noqa: E741
            l = np.where((ratio > 0) & (ratio < 1), np.maximum(l, (peak[:, None] - 2 * GAIN) * ratio), l)  # noqa: E741
            h = np.where(ratio > 1, np.minimum(h, (peak[:, None] + 2 * GAIN) * ratio), h)
            l[np.arange(len(k)), k] = h[np.arange(len(k)), k] = peak
            low[open_], high[open_] = l, np.maximum(l, h)


def epistemic_logistic(rows: DataFrame, pool: DataFrame, levels: int = 50, ridge: float = 1e-3) -> DataFrame:
    """Epistemic uncertainty of a logistic regression on labels 0 and 1.

    For each level alpha of the predicted probability the likelihood is
    maximised under the one linear constraint that the row's logit is that of
    alpha (:class:`LogisticPeaks`); supports are as for kernels. Every step sums
    over all blocks of the labelled rows' distinct places; each worker, and the driver for
    the fit without a constraint, holds them all. Rows with numbers that are not finite have no utility.
    """
    from lodestar.operators.pairs import blocks_of

    labelled = pool.filter("y is not null").groupBy("x").agg(F.min("id").alias("id"), F.sum(F.col("y").cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))
    blocks = blocks_of(labelled.select("id", "x", "y", "n"))
    if not blocks:
        return rows.select("id", F.lit(1.0).alias("utility"))
    fit, alphas = LogisticPeaks(blocks, ridge), (np.arange(levels) + 0.5) / levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(s, CANDIDATES_AT_ONCE) for s in range(0, b.num_rows, CANDIDATES_AT_ONCE)):
                x = as_arrays(part)["x"]
                u = fit.supports(np.hstack([x, np.ones((len(x), 1))]), alphas)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(u, pa.float64(), mask=np.isnan(u))], names=["id", "utility"])

    return rows.select(F.col("id").cast("long"), "x").mapInArrow(run, "id long, utility double")


def label_counts(n_classes: int, m: int) -> Iterator[tuple[int, ...]]:
    """All ways in which m labels can fall on the classes."""
    for chosen in itertools.combinations_with_replacement(range(n_classes), m):
        yield tuple(chosen.count(c) for c in range(n_classes))


def reduction(freq: np.ndarray, m_max: int = 1, prior: float = 1.0, cost: np.ndarray | None = None) -> np.ndarray:
    """Expected reduction of the cost per label for up to m_max labels, in closed form, for each row of frequencies.

    The Beta ratios of the Dirichlet model are ratios of rising factorials, as
    labels come in whole numbers.
    """
    n = freq.shape[1]
    cost = 1 - np.eye(n) if cost is None else cost
    a = freq + prior
    mass = a.sum(axis=1)

    def rising(x: np.ndarray, k: int) -> np.ndarray:
        out = np.ones_like(x)
        for i in range(k):
            out = out * (x + i)
        return out

    def expected(m: int) -> np.ndarray:
        total = np.zeros(len(freq))
        for l in label_counts(n, m):  # noqa: E741
            ways = math.factorial(m) / math.prod(math.factorial(v) for v in l)
            pred = np.round((freq + l) @ cost, 9).argmin(axis=1)
            drawn = ways * math.prod(rising(a[:, c], v) for c, v in enumerate(l) if v) if any(l) else np.full(len(freq), float(ways))
            for t in range(n):
                total += drawn * (a[:, t] + l[t]) / rising(mass, m + 1) * cost[t, pred]
        return total

    none = expected(0)
    return np.max([(none - expected(m)) / m for m in range(1, m_max + 1)], axis=0)


def cost_reduction(freq: DataFrame, m_max: int = 1, prior: float = 1.0, cost: list[list[float]] | None = None, weight: str | None = None) -> DataFrame:
    """Rows (id, utility) from rows (id, freq): :func:`reduction`, times a weight."""
    c = None if cost is None else np.array(cost, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array(b.column(1).to_pylist(), dtype=float)
            u = reduction(f, m_max, prior, c) * b.column(2).to_numpy(zero_copy_only=False) if len(f) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(u)], names=["id", "utility"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return freq.select(F.col("id").cast("long"), "freq", w.alias("w")).mapInArrow(run, "id long, utility double")


def by_row(members: DataFrame, column: str = "p", out: str = "ps") -> DataFrame:
    """Rows (id, ps): what the members say about a row, in one array; rows of :func:`committee` are that already."""
    if out in members.columns:
        return members
    return members.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", column))), lambda s: s[column]).alias(out))  # one line a member


def _of_class(c: int) -> Callable[[Column], Column]:
    return lambda p: p[c]


def _log_term(c: int) -> Callable[[Column], Column]:
    return lambda p: p[c] * F.log(p[c])


def _member_mean(ps: Column, f: Callable[[Column], Column]) -> Column:
    return E.total(F.transform(ps, f)) / F.size(ps)


def committee_kl(members: DataFrame, n_classes: int, eps: float = 1e-7) -> DataFrame:
    """Rows (id, utility) from rows (member, id, p) or (id, ps): mean Kullback-Leibler divergence from the members' mean."""
    q = by_row(members).select("id", F.transform("ps", lambda p: E.clipped(p, eps)).alias("q"))
    q = q.withColumn("m", F.array(*(_member_mean(F.col("q"), _of_class(c)) for c in range(n_classes))))
    terms = [_member_mean(F.col("q"), _log_term(c)) - F.col("m")[c] * F.log(F.col("m")[c]) for c in range(n_classes)]
    return q.select("id", sum(terms[1:], terms[0]).alias("utility"))


def vote_counts(votes: DataFrame) -> DataFrame:
    """Rows (id, n, k): votes of each class that has any, and of all, from rows (member, id, vote)."""
    one = votes.groupBy("id", "vote").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("id").agg(F.collect_list("n").alias("n"), F.sum("n").alias("k"))  # one number a class


def vote_entropy(votes: DataFrame) -> DataFrame:
    share = F.transform("n", lambda v: v / F.col("k"))
    return vote_counts(votes).select("id", E.entropy(share).alias("utility"))


def variation_ratios(votes: DataFrame) -> DataFrame:
    return vote_counts(votes).select("id", (1 - F.array_max("n") / F.col("k")).alias("utility"))


def committee_std(members: DataFrame, value: str = "value") -> DataFrame:
    """Rows (id, utility): standard deviation of the members' predictions."""
    return members.groupBy("id").agg(F.stddev_pop(value).alias("utility"))


def bald(members: DataFrame, n_classes: int) -> DataFrame:
    """Mutual information of label and member, from rows (member, id, p) or (id, ps): entropy of the mean less mean entropy."""
    rows = by_row(members).select("id", "ps", _member_mean(F.col("ps"), E.entropy).alias("h"))
    rows = rows.withColumn("m", F.array(*(_member_mean(F.col("ps"), _of_class(c)) for c in range(n_classes))))
    return rows.select("id", (E.entropy(F.col("m")) - F.col("h")).alias("utility"))


def batch_bald(members: DataFrame, n_classes: int, k: int, n_samples: int | None = None, eps: float = 1e-7, seed: int = 0) -> DataFrame:
    """Greedy batches by joint mutual information: rows (step, id, utility), the pick of each step.

    The joint probabilities of the labels of the picks are held for each member:
    exactly while there are at most ``n_samples`` (by default as many as members)
    label combinations, as drawn combinations beyond.
    """
    wide = by_row(members).select("id", "ps").persist()
    spark = members.sparkSession
    try:
        first = wide.first()
        if first is None:
            return spark.createDataFrame([], "step int, id long, utility double")
        n_m = len(first.ps)
        limit = n_samples or n_m
        joint = np.ones((n_m, 1))  # member x combination
        weight = np.ones(1)  # of each combination: 1 for exact ones
        chosen: list[tuple[int, int, float]] = []
        conditional = 0.0
        for step in range(1, k + 1):
            taken = [c[1] for c in chosen]

            def run(batches, joint=joint, weight=weight, taken=taken, conditional=conditional):
                base = joint.mean(axis=0)
                for b in batches:
                    ids, ps = b.column(0).to_pylist(), b.column(1).to_pylist()
                    out = []
                    for i, p in zip(ids, ps, strict=True):
                        if i in taken:
                            continue
                        p = np.clip(np.array(p), eps, 1)
                        h = float(-(p * np.log(p)).sum(axis=1).mean())
                        q = joint.T @ p / len(p)
                        if weight[0] == 1:
                            u = float(-(q * np.log(q)).sum())
                        else:
                            u = float(-((q / base[:, None]) * np.log(q)).sum() * weight[0])
                        out.append((i, u - h - conditional))
                    cols = list(zip(*out, strict=True)) or [[], []]
                    yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int64()), pa.array(list(cols[1]), pa.float64())], names=["id", "utility"])

            best = wide.select(F.col("id").cast("long"), "ps").mapInArrow(run, "id long, utility double").orderBy(F.round("utility", 9).desc(), "id").limit(1).collect()
            if not best:
                break
            pick, u = best[0]
            chosen.append((step, pick, u))
            p = np.clip(np.array(wide.filter(F.col("id") == pick).first().ps), eps, 1)
            conditional += float(-(p * np.log(p)).sum(axis=1).mean())
            if weight[0] == 1 and joint.shape[1] * n_classes <= limit:
                joint = (joint[:, :, None] * p[:, None, :]).reshape(n_m, -1)
            else:
                rng = np.random.default_rng([seed, step])
                each = max(1, limit // n_m)
                if weight[0] == 1:  # draw combinations of all picks so far
                    old = np.vstack([joint[:, rng.choice(joint.shape[1], each, p=joint[m] / joint[m].sum())].T for m in range(n_m)])
                else:
                    old = joint.T
                owner = np.repeat(np.arange(n_m), len(old) // n_m)
                label = np.array([rng.choice(n_classes, p=p[m] / p[m].sum()) for m in owner])
                joint = (old * p[:, label].T).T
                weight = np.full(joint.shape[1], 1 / joint.shape[1])
        return spark.createDataFrame(chosen, "step int, id long, utility double")
    finally:
        wide.unpersist()


def expected_error(cand: DataFrame, lab: DataFrame, evaluation: DataFrame, clf: ParzenWindow, method: str = "misclassification_loss", cost: list[list[float]] | None = None, subtract_current: bool = True) -> DataFrame:
    """Rows (id, utility): how far labelling a candidate is expected to lower the error on the evaluation rows.

    For kernel frequencies a new label adds one kernel to each evaluation row's
    frequency, so nothing is fitted again. cand: (id, x, w); evaluation: (id, x, w).
    """
    n = len(clf.classes)
    cost_m = np.array(cost or [[float(i != j) for j in range(n)] for i in range(n)])
    prior = np.array([clf.class_prior] * n if isinstance(clf.class_prior, int | float) else clf.class_prior, dtype=float)
    if method == "log_loss" and cost is not None:
        raise ValueError("log loss takes no cost matrix")
    ready = clf.freq(evaluation.select("id", "x", "w"), lab, "f")

    def probas(f: np.ndarray) -> np.ndarray:
        f = f + prior
        s = f.sum(axis=-1, keepdims=True)
        return np.where(s > 0, f / np.where(s > 0, s, 1), 1.0 / n)

    def risk(p: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Summed over the evaluation rows (next to last axis)."""
        if method == "log_loss":
            return -(p * np.log(p + EPS)).sum(axis=(-1, -2))
        c = p @ cost_m
        return (c[..., :].min(axis=-1) * w).sum(axis=-1)

    def f(a: Side, b: Side) -> np.ndarray:
        k = clf.pair_kernel(a["x"], b["x"]) * a["w"][:, None]
        out = np.zeros((len(k), n + 1))
        out[:, n] = risk(probas(b["f"]), b["w"])
        for y in range(n):
            grown = np.repeat(b["f"][None], len(k), axis=0)
            grown[:, :, y] += k
            out[:, y] = risk(probas(grown), b["w"])
        return out

    rows = clf.probas(cand.select("id", "x", "w"), lab, "p")
    got = against(rows, ready, f, "sum", "r", [0.0] * (n + 1))
    future = sum((F.col("p")[c] * F.col("r")[c] for c in range(1, n)), F.col("p")[0] * F.col("r")[0])
    return got.select("id", (-(future - (F.col("r")[n] if subtract_current else F.lit(0.0)))).alias("utility"))


def value_of_information(cand: DataFrame, lab: DataFrame, clf: ParzenWindow, cost: list[list[float]] | None = None, consider_unlabeled: bool = True, consider_labeled: bool = True, candidate_to_labeled: bool = True, subtract_current: bool = True, normalize: bool = False) -> DataFrame:
    """Rows (id, utility): expected fall of the risk over labelled rows (with their label) and unlabelled ones (by their probabilities)."""
    n = len(clf.classes)
    cost_m = np.array(cost or [[float(i != j) for j in range(n)] for i in range(n)])
    code = F.array_position(F.array(*map(F.lit, clf.classes)), F.col("y")) - 1
    ev = lab.select("id", "x", "w", code.cast("double").alias("t")).unionByName(cand.select("id", "x", "w", F.lit(-1.0).alias("t")))
    ready = clf.freq(ev, lab, "f")
    prior = np.array([clf.class_prior] * n if isinstance(clf.class_prior, int | float) else clf.class_prior, dtype=float)

    def risks(f: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of each evaluation row; t: its true class, -1 if unlabelled."""
        f = f + prior
        s = f.sum(axis=-1, keepdims=True)
        p = np.where(s > 0, f / np.where(s > 0, s, 1), 1.0 / n)
        known = np.einsum("...c,...c->...", p, cost_m[np.maximum(t, 0).astype(int)])
        guess = np.einsum("...t,tc,...c->...", p, cost_m, p)
        return w * np.where(t >= 0, known * consider_labeled, guess * consider_unlabeled)

    def f(a: Side, b: Side) -> np.ndarray:
        k = clf.pair_kernel(a["x"], b["x"]) * a["w"][:, None]
        own = a["id"][:, None] == b["id"][None, :]
        out = np.zeros((len(k), n + 2))
        out[:, n] = risks(b["f"], b["t"], b["w"]).sum()
        out[:, n + 1] = ((b["t"] >= 0) & consider_labeled | (b["t"] < 0) & consider_unlabeled).sum()
        for y in range(n):
            grown = np.repeat(b["f"][None], len(k), axis=0)
            grown[:, :, y] += k
            t = np.where(own, y if candidate_to_labeled else b["t"], np.broadcast_to(b["t"], own.shape))
            out[:, y] = risks(grown, t, np.broadcast_to(b["w"], own.shape)).sum(axis=1)
        return out

    rows = clf.probas(cand.select("id", "x", "w"), lab, "p")
    got = against(rows, ready, f, "sum", "r", [0.0] * (n + 2))
    future = sum((F.col("p")[c] * F.col("r")[c] for c in range(1, n)), F.col("p")[0] * F.col("r")[0])
    u = -(future - (F.col("r")[n] if subtract_current else F.lit(0.0)))
    return got.select("id", (u / F.col("r")[n + 1] if normalize else u).alias("utility"))


def _refitted(cand: DataFrame, lab: DataFrame, evaluation: DataFrame, fit: Fit, classes: Sequence, risk: Callable, subtract_current: bool) -> DataFrame:
    """Rows (id, utility): the expected fall of ``risk`` when a candidate is labelled and the classifier fitted anew.

    ``risk(p, side, candidate, class)``: of the evaluation side's probabilities; candidate and class are None
    for the current one. Candidates are dealt over the tasks; each holds the
    labelled and the evaluation rows, which must be within SHIP_BYTES (a larger side is an error).
    """
    from lodestar.operators.retrain import IndexClassifier, sides

    n = len(classes)
    sent = cand.sparkSession.sparkContext.broadcast(sides(lab, evaluation, sorted(classes)))  # at most SHIP_BYTES each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, ev = sent.value
        for b in batches:
            a, out = as_arrays(b), []
            for k in range(b.num_rows):
                own = a["x"][k : k + 1]
                model = IndexClassifier(fit, np.vstack([train["x"], own]) if len(train["x"]) else own, np.append(train["c"], -1), np.append(train["w"], a["w"][k]), n)
                last = len(train["x"])
                model.fit(np.arange(last))
                p = model.predict_proba(own)[0]
                current = risk(model.predict_proba(ev["x"]), ev, None, None) if subtract_current else 0.0
                future = sum(p[c] * risk(model.partial_fit([last], [c]).predict_proba(ev["x"]), ev, a["id"][k], c) for c in range(n))
                out.append(float(current - future))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["id", "utility"])

    return cand.select(F.col("id").cast("long"), "x", F.coalesce("w", F.lit(1.0)).alias("w")).mapInArrow(run, "id long, utility double")


def expected_error_refit(cand: DataFrame, lab: DataFrame, evaluation: DataFrame, fit: Fit, classes: Sequence, method: str = "misclassification_loss", cost: list[list[float]] | None = None, subtract_current: bool = True) -> DataFrame:
    """Rows (id, utility): as :func:`expected_error`, with a classifier that is fitted anew for each candidate and class.

    ``fit`` makes a model of (x, y codes, weights), see :mod:`lodestar.operators.retrain`.
    """
    n = len(classes)
    cost_m = np.array(cost or [[float(i != j) for j in range(n)] for i in range(n)])
    if method == "log_loss" and cost is not None:
        raise ValueError("log loss takes no cost matrix")

    def risk(p: np.ndarray, side: Side, candidate, label) -> float:
        if method == "log_loss":
            return -(p * np.log(p + EPS)).sum()
        return ((p @ cost_m).min(axis=1) * side["w"]).sum()

    return _refitted(cand, lab, evaluation, fit, classes, risk, subtract_current)


def value_of_information_refit(cand: DataFrame, lab: DataFrame, fit: Fit, classes: Sequence, cost: list[list[float]] | None = None, consider_unlabeled: bool = True, consider_labeled: bool = True, candidate_to_labeled: bool = True, subtract_current: bool = True, normalize: bool = False) -> DataFrame:
    """Rows (id, utility): as :func:`value_of_information`, with a classifier that is fitted anew for each candidate and class."""
    n = len(classes)
    cost_m = np.array(cost or [[float(i != j) for j in range(n)] for i in range(n)])
    code = F.array_position(F.array(*map(F.lit, sorted(classes))), F.col("y")) - 1
    evaluation = lab.select("id", "x", "w", code.cast("double").alias("t")).unionByName(cand.select("id", "x", "w", F.lit(-1.0).alias("t")))

    def risk(p: np.ndarray, side: Side, candidate, label) -> float:
        t = side["t"]
        counted = (t >= 0) & consider_labeled | (t < 0) & consider_unlabeled
        if candidate is not None and candidate_to_labeled:
            t = np.where(side["id"] == candidate, label, t)
        known = (p * cost_m[np.maximum(t, 0).astype(int)]).sum(axis=1)
        guess = np.einsum("nt,tc,nc->n", p, cost_m, p)
        total = (side["w"] * np.where(t >= 0, known * consider_labeled, guess * consider_unlabeled)).sum()
        return total / max(1, counted.sum()) if normalize else total

    return _refitted(cand, lab, evaluation, fit, classes, risk, subtract_current)


def gaussian_weighted(utilities: DataFrame, pool: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Utilities times the density of a Gaussian mixture over the pool."""
    from lodestar.operators.classifiers import mixture_responsibilities

    d = mixture_responsibilities(pool.select("id", "x"), k, seed).select("id", F.exp("density").alias("d"))
    return utilities.join(d, "id").select("id", (F.col("utility") * F.col("d")).alias("utility"))


def dual(utilities: DataFrame, pool: DataFrame, delta: float, gain: float, seed: int = 0) -> DataFrame:
    """Density-weighted utilities, mixed with plain ones once the expected gain falls below delta."""
    weighted = gaussian_weighted(utilities, pool, seed=seed).withColumnRenamed("utility", "dense")
    eps = max(0.0, gain) if gain < delta else 1.0
    return utilities.join(weighted, "id").select("id", ((1 - eps) * F.col("utility") + eps * F.col("dense")).alias("utility"))


def committee(rows: DataFrame, pool: DataFrame, classifiers: Sequence[ParzenWindow]) -> DataFrame:
    """Rows (id, ps): the class probabilities of each classifier over the same pool, all in one pass over the rows."""
    if any(c.n_neighbors for c in classifiers) or len({tuple(c.classes) for c in classifiers}) > 1:
        return by_row(members_of(rows, pool, classifiers))
    n = len(classifiers[0].classes)

    def f(a: Side, b: Side) -> np.ndarray:
        return np.hstack([c.pair_kernel(a["x"], b["x"]) @ b["v"] for c in classifiers])

    got = against(rows.select("id", "x"), classifiers[0].votes(pool), f, "sum", "_f", [0.0] * (n * len(classifiers)))
    each = [E.normalised(F.slice("_f", k * n + 1, n), c.class_prior) for k, c in enumerate(classifiers)]
    return got.select("id", F.array(*each).alias("ps"))


def members_of(rows: DataFrame, pool: DataFrame, classifiers: Sequence) -> DataFrame:
    """Rows (member, id, p): a committee of any classifiers over the same pool."""
    out = None
    for m, clf in enumerate(classifiers):
        part = clf.probas(rows.select("id", "x"), pool).select(F.lit(m).alias("member"), "id", "p")
        out = part if out is None else out.unionAll(part)
    return out


def votes_of(members: DataFrame) -> DataFrame:
    """Rows (member, id, vote): the likeliest class of each member, from rows (id, ps)."""
    return by_row(members).select("id", F.posexplode(F.transform("ps", lambda p: E.argmax(F.transform(p, lambda v: F.round(v, 12))))).alias("member", "vote"))
