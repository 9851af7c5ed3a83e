"""One way to ask any pool strategy: resolve the candidates, score them, pick the batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.selection import proportional, simple_batch, top_k
from lodestar.functions.validation import MappingError, check_batch_size, check_indices, check_schema
from lodestar.operators import diverse as D
from lodestar.operators import informative as I
from lodestar.operators import regressors as R
from lodestar.operators.classifiers import ParzenWindow


def candidates_of(pool: DataFrame, candidates: None | Sequence[int] | DataFrame = None, in_pool: bool = False, only_unlabeled: bool = False) -> DataFrame:
    """The candidates: all unlabelled rows, those of some ids, or rows of another frame (id, x).

    A strategy that needs rows of the pool (``in_pool``) takes no other frame.
    """
    if isinstance(candidates, DataFrame):
        if in_pool:
            raise MappingError("this strategy needs candidates of the pool")
        check_schema(candidates, {"id": "", "x": "array"})
        return candidates if "w" in candidates.columns else candidates.withColumn("w", F.lit(1.0))
    if candidates is None:
        return pool.filter("y is null")
    ids = pool.sparkSession.createDataFrame([(i,) for i in check_indices(candidates, pool, unique=False)], "id long")
    got = pool.join(F.broadcast(ids), "id", "left_semi")  # as many ids as were given
    return got.filter("y is null") if only_unlabeled else got


def _probas(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda cand, lab, clf, k, seed, /, **kw: f(clf.probas(cand.select("id", "x"), lab), **kw)


def _members(cand: DataFrame, lab: DataFrame, clf) -> DataFrame:
    """Rows (id, ps) of a committee: a list of classifiers, of any kinds."""
    if not isinstance(clf, list | tuple):
        raise TypeError("a committee of classifiers is needed")
    return I.committee(cand, lab, clf) if all(isinstance(c, ParzenWindow) for c in clf) else I.by_row(I.members_of(cand, lab, clf))


def _spread(cand: DataFrame, lab: DataFrame, regs, **kw) -> DataFrame:
    """The spread of a committee's predictions, or of one regressor's distribution."""
    if not isinstance(regs, list | tuple):
        return regs.predict(cand.select("id", "x"), lab).select("id", F.col("std").alias("utility"))
    out = cand.select("id", "x")
    for k, reg in enumerate(regs):
        out = reg.predict(out, lab).withColumn(f"_p{k}", F.col("pred")).drop("pred", "std", "nu", "loc", "scale")
    values = F.array(*(F.col(f"_p{k}") for k in range(len(regs))))
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / len(regs)
    return out.select("id", F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / len(regs)).alias("utility"))


def _expected_error(cand, lab, clf, k, seed, /, **kw) -> DataFrame:
    evaluation = kw.pop("evaluation", cand)
    if isinstance(clf, ParzenWindow):
        return I.expected_error(cand, lab, evaluation, clf, **kw)
    return I.expected_error_refit(cand, lab, evaluation, clf.fit, clf.classes, **kw)


def _density(cand, lab, clf, k, seed, /, **kw) -> DataFrame:
    base = SCORED[kw.pop("base", "uncertainty")](cand, lab, clf, k, seed, **kw.pop("base_params", {}))
    return I.gaussian_weighted(base, lab.unionByName(cand), seed=seed, **kw)


def _dual(cand, lab, clf, k, seed, /, **kw) -> DataFrame:
    base = SCORED[kw.pop("base", "uncertainty")](cand, lab, clf, k, seed, **kw.pop("base_params", {}))
    return I.dual(base, lab.unionByName(cand), seed=seed, **kw)


def _sub_sampled(cand, lab, clf, k, seed, /, **kw) -> DataFrame:
    base, params = kw.pop("base", "uncertainty"), kw.pop("base_params", {})
    return D.sub_sampled(cand, kw.pop("max_candidates"), lambda c: SCORED[base](c, lab, clf, k, seed, **params), seed, **kw)


def _parallel(cand, lab, clf, k, seed, /, **kw) -> DataFrame:
    base, params = kw.pop("base", "uncertainty"), kw.pop("base_params", {})
    return D.parallel(cand, lambda c: SCORED[base](c, lab, clf, k, seed, **params), kw.pop("n_jobs", 8))


#: Strategies that give a utility for each candidate, by name. The estimator is a classifier, a regressor
#: (those with ``reg``) or a list of either (those with ``clfs``).
SCORED: dict[str, Callable[..., DataFrame]] = {
    "random": lambda cand, lab, clf, k, seed, /, **kw: I.random_sampling(cand, seed).select("id", F.col("key").alias("utility")),
    "uncertainty": _probas(I.uncertainty),
    "expected_average_precision": lambda cand, lab, clf, k, seed, /, **kw: I.expected_average_precision(clf.probas(cand.select("id", "x"), lab), len(clf.classes), **kw),
    "density_weighted": _density,
    "dual": _dual,
    "probabilistic": lambda cand, lab, clf, k, seed, /, **kw: I.cost_reduction(clf.freq(cand.select("id", "x"), lab), **kw),
    "epistemic": lambda cand, lab, clf, k, seed, /, **kw: I.epistemic_pwc(clf.freq(cand.select("id", "x"), lab), **kw),
    "epistemic_logistic": lambda cand, lab, clf, k, seed, /, **kw: I.epistemic_logistic(cand, lab, **kw),
    "committee_kl": lambda cand, lab, clfs, k, seed, /, **kw: I.committee_kl(_members(cand, lab, clfs), len(clfs[0].classes), **kw),
    "committee_votes": lambda cand, lab, clfs, k, seed, /, **kw: I.vote_entropy(I.votes_of(_members(cand, lab, clfs))),
    "committee_variation": lambda cand, lab, clfs, k, seed, /, **kw: I.variation_ratios(I.votes_of(_members(cand, lab, clfs))),
    "committee_std": lambda cand, lab, reg, k, seed, /, **kw: _spread(cand, lab, reg),
    "bald": lambda cand, lab, clfs, k, seed, /, **kw: I.bald(_members(cand, lab, clfs), len(clfs[0].classes)),
    "expected_error": _expected_error,
    "value_of_information": lambda cand, lab, clf, k, seed, /, **kw: I.value_of_information(cand, lab, clf, **kw) if isinstance(clf, ParzenWindow) else I.value_of_information_refit(cand, lab, clf.fit, clf.classes, **kw),
    "contrastive": lambda cand, lab, clf, k, seed, /, **kw: D.contrastive(clf.probas(cand.select("id", "x"), lab), clf.probas(lab.select("id", "x"), lab), len(clf.classes), **kw),
    "discriminative": lambda cand, lab, clf, k, seed, /, **kw: D.discriminative(cand, lab, **kw),
    "quire": lambda cand, lab, clf, k, seed, /, **kw: D.quire(lab.unionByName(cand), clf.classes, **kw).join(cand.select("id"), "id", "left_semi"),
    "cost_embedding": lambda cand, lab, clf, k, seed, /, **kw: R.cost_embedding(cand, lab, clf.classes, seed=seed, **kw),
    "model_change": lambda cand, lab, reg, k, seed, /, **kw: R.model_change(cand, lab, reg, seed=seed, **kw),
    "output_change": lambda cand, lab, reg, k, seed, /, **kw: R.model_output_change(cand, lab, kw.pop("evaluation", cand), reg, seed=seed, **kw),
    "variance_reduction": lambda cand, lab, reg, k, seed, /, **kw: R.variance_reduction(cand, lab, kw.pop("evaluation", cand), reg, seed=seed, **kw),
    "information_gain": lambda cand, lab, reg, k, seed, /, **kw: R.information_gain(cand, lab, kw.pop("evaluation", cand), reg, seed=seed, **kw),
    "sub_sampled": _sub_sampled,
    "parallel": _parallel,
}


def _target(method: str) -> Callable[..., DataFrame]:
    return lambda cand, lab, reg, k, seed, /, **kw: D.greedy_target(reg.predict(cand.select("id", "x"), lab), lab, "pred", method, k, **kw)


#: Strategies that pick their batch step by step.
STEPPED: dict[str, Callable[..., DataFrame]] = {
    "core_set": lambda cand, lab, clf, k, seed, /, **kw: D.core_set(cand, lab, k, **kw),
    "greedy_x": lambda cand, lab, clf, k, seed, /, **kw: D.greedy_x(cand, lab, k, **kw),
    "greedy_y": _target("GSy"),
    "greedy_xy": _target("GSi"),
    "prob_cover": lambda cand, lab, clf, k, seed, /, **kw: D.prob_cover(cand, lab, k=k, **kw),
    "typi_clust": lambda cand, lab, clf, k, seed, /, **kw: D.typi_clust(cand, lab, k, seed, **kw),
    "badge": lambda cand, lab, clf, k, seed, /, **kw: D.badge(clf.probas(cand.select("id", "x"), lab), len(clf.classes), k, seed, **kw),
    "clue": lambda cand, lab, clf, k, seed, /, **kw: D.clue(clf.probas(cand.select("id", "x"), lab), k, seed=seed, **kw),
    "drop_query": lambda cand, lab, clf, k, seed, /, **kw: D.drop_query(cand, lambda r: clf.predict(clf.probas(r, lab)), k, seed=seed, **kw),
    "falcun": lambda cand, lab, clf, k, seed, /, **kw: D.falcun(clf.probas(cand.select("id", "x"), lab), k, seed=seed, **kw),
    "four_ds": lambda cand, lab, clf, k, seed, /, **kw: D.four_ds(lab.unionByName(cand), clf.probas(cand.select("id", "x"), lab), k, seed=seed, **kw),
    "batch_bald": lambda cand, lab, clfs, k, seed, /, **kw: I.batch_bald(_members(cand, lab, clfs), len(clfs[0].classes), k, seed=seed, **kw),
    "discriminative_steps": lambda cand, lab, clf, k, seed, /, **kw: D.discriminative_steps(cand, lab, k, **kw),
    "tree_based": lambda cand, lab, clf, k, seed, /, **kw: R.tree_based(cand, lab, k, seed=seed, **kw),
}
_IN_POOL = {"quire", "typi_clust", "four_ds", "prob_cover", "density_weighted", "dual"}


@dataclass
class Strategy:
    """A named strategy with its parameters over pools (id, x, y, w).

    ``classifier`` is the estimator that the strategy asks: a classifier or
    regressor of rows of any kind (kernel, ``pyspark.ml``, a local ``fit``), or a list of them.
    """

    name: str
    classifier: object
    seed: int = 0
    draw: str = "max"
    params: dict = field(default_factory=dict)

    def utilities(self, pool: DataFrame, candidates: None | Sequence[int] | DataFrame = None) -> DataFrame:
        """Rows (id, utility) of all candidates."""
        if self.name not in SCORED:
            raise ValueError(f"{self.name} picks step by step and has no single utility")
        cand = candidates_of(pool, candidates, self.name in _IN_POOL)
        return SCORED[self.name](cand, pool.filter("y is not null"), self.classifier, 1, self.seed, **self.params)

    def query(self, pool: DataFrame, candidates: None | Sequence[int] | DataFrame = None, batch_size: int = 1, return_utilities: bool = False):
        """Rows (step, id, utility) of the picks; fewer if there are fewer candidates.

        With ``return_utilities`` also rows (step, id, utility, picked): for each
        step the utilities of all candidates, null for those picked before; for
        strategies that pick step by step those of the picks alone.
        """
        check_batch_size(batch_size)
        if self.name in STEPPED:
            cand = candidates_of(pool, candidates, self.name in _IN_POOL)
            picked = STEPPED[self.name](cand, pool.filter("y is not null"), self.classifier, batch_size, self.seed, **self.params)
            return (picked, picked.withColumn("picked", F.lit(True))) if return_utilities else picked
        scored = self.utilities(pool, candidates)
        if self.draw == "max":
            picked = top_k(scored, batch_size).select("step", "id", "utility")
            return (picked, simple_batch(scored, batch_size)) if return_utilities else picked
        picked = proportional(scored, batch_size, seed=self.seed).select("step", "id", "utility")
        return (picked, picked.withColumn("picked", F.lit(True))) if return_utilities else picked
