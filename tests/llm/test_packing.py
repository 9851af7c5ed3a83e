import itertools
import random

from lodestar.llm import packing as P


def least_cost(lengths, costs):
    """The cheapest packing by trying all partitions of a few documents."""
    best = None
    n = len(lengths)
    for labels in itertools.product(range(n), repeat=n):
        bins = {}
        for k, b in enumerate(labels):
            bins[b] = bins.get(b, 0) + lengths[k]
        if max(bins.values()) <= costs.sizes[-1]:
            cost = sum(costs.held(h) for h in bins.values())
            best = cost if best is None else min(best, cost)
    return best


def check_bins(lengths, bins, final, sizes):
    for b, size in zip(bins, final, strict=True):
        held = sum(p[0] for p in b)
        assert held <= size and size == min(s for s in sizes if s >= held)
    got = {}
    for n, doc, start in (p for b in bins for p in b):
        got.setdefault(doc, []).append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, m in sorted(got[k]):
            assert start == at
            at += m
        assert at == n


def test_small_blocks_are_exact():
    rng = random.Random(0)
    for overhead, attention in ((1, 10**9), (2, 16), (0, 8)):
        costs = P.Costs((4, 8, 16), overhead, attention)
        for _ in range(25):
            lengths = [rng.randint(0, 16) for _ in range(rng.randint(1, 6))]
            bins, final = P.pack_block(lengths, (4, 8, 16), overhead, attention)
            check_bins(lengths, bins, final, (4, 8, 16))
            assert abs(sum(costs.of[c] for c in final) - least_cost(lengths, costs)) < 1e-9


def test_best_fit_near_the_optimum(monkeypatch):
    """Without the exact way for small blocks: best fit over all subsets of sizes, with loose bins packed anew."""
    rng, exact = random.Random(4), P.EXACT
    worst = 1.0
    for _ in range(60):
        lengths = [rng.randint(1, 64) for _ in range(9)]
        monkeypatch.setattr(P, "EXACT", exact)
        costs = P.Costs((16, 32, 64), 4, 100)
        best = costs.total(P.packed_exactly([(n, k, 0) for k, n in enumerate(lengths)], costs))
        monkeypatch.setattr(P, "EXACT", 6)
        bins, final = P.pack_block(lengths, (16, 32, 64), 4, 100)
        check_bins(lengths, bins, final, (16, 32, 64))
        worst = max(worst, costs.total(bins) / best)
    assert worst <= 1.10, worst


def test_large_blocks_near_the_bound_and_of_mixed_sizes():
    rng, costs = random.Random(1), P.Costs(P.SIZES, P.OVERHEAD, P.ATTENTION)
    for make, mixed in ((lambda: int(rng.lognormvariate(5.5, 1.2)) + 1, True), (lambda: rng.randint(1, 400), False), (lambda: int(rng.lognormvariate(7, 1.5)) + 1, True)):
        lengths = [make() for _ in range(5000)]
        bins, final = P.pack_block(lengths)
        check_bins(lengths, bins, final, P.SIZES)
        assert costs.total(bins) <= 1.02 * costs.bound(lengths), costs.total(bins) / costs.bound(lengths)
        opened = {c for c in final if final.count(c) > 0.01 * len(final)}
        assert (len(opened) > 1) == mixed and 2048 in opened


def test_table(spark):
    rows = [(k, 3 * k) for k in range(300)] + [(300, 20_000), (301, None), (302, 0), (303, -5), (7, 21), (7, 21), (None, 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n_tokens long, bin_id string").repartition(5)
    out = P.pack(df).collect()
    total = sum(max(0, n or 0) for _, n in rows)
    assert sum(r.piece_tokens for r in out) == total
    assert len({r.doc_id for r in out}) == len({i for i, _ in rows})
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: (r.bin_offset, r.piece_tokens)):
            assert r.bin_offset == at
            at += r.piece_tokens
        assert at <= b[0].bin_size and len({r.bin_size for r in b}) == 1
    assert P.pack(df.limit(0)).collect() == []


def test_word_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a\x0bb\xa0c \n")], "doc_id long, text string")
    assert sorted(tuple(r) for r in P.word_lengths(df).collect()) == [(1, 1), (2, 1), (3, 3)]
