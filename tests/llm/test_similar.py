import numpy as np

import corpus_pipeline as P
from lodestar.llm import similar as S
from lodestar.llm.common import local_labels


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def planted():
    """Pairs of a similarity of 0.70 to 0.90, some hundred for 0.78 to 0.87, and a chain and a large group."""
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(400):
        w = list(rng.choice(vocab, int(rng.integers(60, 600))))
        j = rng.uniform(0.78, 0.87) if k % 4 else rng.uniform(0.7, 0.9)
        v, gone = list(w), (1 - j) / (1 + j) * len(w)  # shingles that differ: an edit takes five
        cut = int(gone % 5)
        for at in np.arange(int(gone // 5)) * 9 + 5:
            v[min(at, len(v) - 1)] = f"new{rng.integers(10**9)}"
        for c in range(cut):
            v[c] = f"new{rng.integers(10**9)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    base = list(rng.choice(vocab, 200))
    for k in range(700):
        v = list(base)
        for at in rng.choice(200, int(rng.integers(0, 6)), replace=False):
            v[at] = f"new{rng.integers(10**9)}"
        rows.append((1000 + k, " ".join(v)))
    return rows


def test_planted_pairs_against_brute_force(spark):
    rows = planted()
    sets = [shingles(t) for _, t in rows]
    i, j = np.array([(a, b) for a in range(800) for b in ([a + 1] if a % 2 == 0 else [])] + [(a, b) for a in range(800, len(rows)) for b in range(a + 1, len(rows))]).T
    both = np.array([len(sets[a] & sets[b]) for a, b in zip(i, j, strict=True)])
    all_ = np.array([len(sets[a] | sets[b]) for a, b in zip(i, j, strict=True)])
    sim = both[:400] / all_[:400]
    assert ((sim >= 0.78) & (sim < 0.8)).sum() >= 20 and ((sim >= 0.8) & (sim < 0.82)).sum() >= 20
    link = 5 * both >= 4 * all_
    label = local_labels(len(rows), i[link], j[link])
    want = {rows[k][0] for k in range(len(rows)) if label[k] == k}
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()} == want


def test_pairs_at_the_similarity_meet():
    """Sets at 0.8 exactly, of few and of many shingles: nearly all share a key and are within the radius."""
    rng = np.random.default_rng(0)
    for n_sets in (1000, 3_000_000):
        blocks, cases, met = S.Blocks(n_sets, 1.6 / 1.8), 0, 0
        for na, nb, both in ((4, 5, 4), (9, 9, 8), (16, 20, 16), (45, 45, 40), (450, 450, 400)):
            pools = rng.integers(0, 1 << 63, (400, na + nb - both), dtype=np.uint64)
            votes = [S.prints([x[:na] for x in pools], blocks.words), S.prints([x[len(x) - nb :] for x in pools], blocks.words)]
            flips = [next((f for most, f in S.FEW_FLIPS if n <= most), S.FLIPS) for n in (na, nb)]
            keys = [blocks.keys(v, f) for v, f in zip(votes, flips, strict=True)]
            close = ((votes[0] > 0) != (votes[1] > 0)).sum(axis=1) <= blocks.scheme.radius
            met += sum(bool(set(x.tolist()) & set(y.tolist())) and c for x, y, c in zip(*keys, close.tolist(), strict=True))
            cases += len(pools)
        assert met >= 0.995 * cases, (n_sets, met / cases)


def test_exact_labels_against_plain_sets():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        sets = [np.unique(np.append(rng.permutation(base)[: rng.integers(30, 61)], rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64))) for _ in range(40)]
        side = rng.integers(0, 2, 40)
        for one in (True, False):
            label = S.exact_labels(sets, one, side, S.Fraction(4, 5))
            link = [(i, j) for i in range(40) for j in range(i + 1, 40) if (one or side[i] != side[j]) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
            assert label.tolist() == local_labels(40, *np.array(link, dtype=int).reshape(-1, 2).T).tolist()


def test_edges(spark):
    df = spark.createDataFrame([(5, "a b"), (3, "A  b"), (7, None), (8, ""), (9, "a c")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.similar_components(df).collect()} == {5: 3, 3: 3, 7: 7, 8: 7, 9: 9}
    assert S.similar_components(df.limit(0)).collect() == []


def test_rows_that_stay(spark):
    """Null and repeated ids, repeated rows and clashing column names: one row of each group stays, as it stands."""
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text, "a", 1), (7, text, "a", 1), (None, text + " x", "b", 2), (9, text, "c", 3), (None, "alone", "d", 4), (None, "alone", "d", 4), (5, "five", "e", 5), (5, "cinq", "f", 6), (6, None, "g", 7), (8, "", "h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h1 string, row int").repartition(3)
    assert sorted(map(tuple, P.near_duplicates(spark, df, "").collect()), key=str) == sorted([rows[0], rows[4], rows[6], rows[7], rows[8]], key=str)
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "x " * 30)], "doc_id long, text string")
    assert {r.doc_id for r in P.near_duplicates(spark, df, "").collect()} == {1, 3}


def test_stage_on_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sets = [shingles(t or "") for _, t in rows]
    link = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = local_labels(len(rows), *np.array(link).T)
    assert {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()} == {rows[k][0] for k in range(len(rows)) if label[k] == k}
