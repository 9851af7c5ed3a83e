import numpy as np
import xxhash

from lodestar.llm import simhash as S


def brute(rows, radius=3):
    """(fingerprint, component) by id, by plain counting and all pairs."""
    fps = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if comp[j] < comp[i] and (fps[i] ^ fps[j]).bit_count() <= radius:
                    comp[i], changed = comp[j], True
    return {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def result(spark, rows, schema="doc_id long, text string", **kw):
    out = S.simhash_components(spark.createDataFrame(rows, schema), **kw).collect()
    return {r.doc_id: (r.fingerprint, r.component_id) for r in out}


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{k}" for k in range(300)] + ["É", "x y"]
    base = [" ".join(rng.choice(vocab, n)) for n in (1, 2, 3, 5, 40, 80, 200, 400)]
    rows = [(0, None), (1, ""), (2, " \t\n")]
    for t in base:
        for c in range(9):
            w = t.split(" ")
            for _ in range(c // 2):
                w[rng.integers(len(w))] = str(rng.choice(vocab))
            rows.append((len(rows), (" ".join(w)).upper() if c == 1 else "\n".join(w)))
    assert result(spark, rows) == brute(rows)


def test_dense_cluster_in_chunks(spark):
    rng = np.random.default_rng(1)
    fps = set()
    while len(fps) < 2500:
        f = 0x0123456789ABCDEF
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(f.tobytes(), i) for i, f in enumerate(fps)], "fp binary, rep long")
    from lodestar.llm.components import components

    got = {r.node: r.component for r in components(S.near_links(df, S.exact(3))).collect()}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    from lodestar.llm.common import local_labels

    want = local_labels(len(fps), i, j)
    assert [got.get(k, k) for k in range(len(fps))] == want.tolist()


def test_empty_and_extra_columns(spark):
    assert result(spark, []) == {}
    df = spark.createDataFrame([(5, "a b", "x", 1), (3, "A  b", None, 2)], "doc_id long, text string, fp string, key long")
    got = {r.doc_id: r.component_id for r in S.simhash_components(df).collect()}
    assert got == {5: 3, 3: 3}
