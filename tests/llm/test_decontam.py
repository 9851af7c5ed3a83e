import numpy as np

from lodestar.llm import decontam as D


def brute(docs, items, size=13):
    out = []
    for i, t in docs:
        w = D.words_of((t or "").encode())
        hit, met = [False] * len(w), set()
        for item, x in items:
            q = D.words_of((x or "").encode())
            n = min(size, len(q))
            if not q:
                continue
            for s in range(len(q) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit[p : p + n] = [True] * n
                        met.add(str(item))
        out.append((i, len(w), sum(hit), len(met), D.digest_of(met), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out)


def cases():
    rng = np.random.default_rng(3)
    vocab = ["a", "B", "c9", "é", "dd", "e-f"]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate([1, 3, 13, 14, 30, 20])] + [(10, None), (11, "--"), (12, "")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "B")]
    for k in range(40):
        w = list(rng.choice(vocab + [f"x{v}" for v in range(40)], rng.integers(1, 200)))
        if k % 2:
            at = rng.integers(len(w))
            w[at:at] = items[k % 6][1].upper().split()
        docs.append((len(docs), " ,".join(w)))
    docs.append((4, docs[4][1]))
    return docs, items


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    docs, items = cases()
    assert rows(D.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(D, "QUERY_BLOCK_BYTES", 40)
    monkeypatch.setattr(D.Windows, "AT_ONCE", 5)
    assert rows(D.contamination(*frames(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    assert rows(D.contamination(d.limit(0), b)) == []
    assert rows(D.contamination(d, b.limit(0))) == brute(docs, [])


def test_proximity(spark):
    docs = [(1, "a x b y c"), (2, "a q q q q b"), (3, "b a"), (4, None), (5, "b")]
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    got = sorted(tuple(r) for r in D.near_matches(index, ["A", "b"], 3).collect())
    assert got == [(1, 0, 3), (3, 0, 2)]


def test_clashing_columns_and_a_very_long_text(spark):
    docs, items = cases()
    docs = docs[:10] + [(99, "x1 " * 100_000 + items[4][1] + " x2" * 100_000)]
    d, b = frames(spark, docs, items)
    got = rows(D.contamination(d.selectExpr("*", "1 segment", "'x' items", "2 n_words"), b.selectExpr("*", "1 i", "'y' t")))
    assert [r for r in got if r[0] != 99] == brute(docs[:10], items)
    last = next(r for r in got if r[0] == 99)
    assert last[1] == 200_000 + len(D.words_of(items[4][1].encode())) and last[2] >= len(D.words_of(items[4][1].encode())) and not last[5]
