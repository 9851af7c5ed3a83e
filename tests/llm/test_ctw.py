import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ctw as C


def plain_model(train):
    """Context-tree weighting by recursion over dictionaries: log probability of a text and its end."""
    n = {}
    for t in train:
        a = b"\xff" * 5 + t + b"\xff"
        for i in range(5, len(a)):
            ctx = a[i - 5 : i][::-1]
            for d in range(6):
                q = 1
                for k in range(8):
                    bit = a[i] >> (7 - k) & 1
                    n.setdefault((ctx[:d], q), [0, 0])[bit] += 1
                    q = 2 * q + bit
    kids = {}
    for ctx, q in n:
        if ctx:
            kids.setdefault((ctx[:-1], q), []).append((ctx, q))
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - 2 * math.lgamma(0.5)
    memo = {}

    def pw(node):
        if node not in memo:
            own = kt(*n[node])
            memo[node] = own if len(node[0]) == 5 else math.log(0.5) + np.logaddexp(own, sum(pw(c) for c in kids.get(node, ())))
        return memo[node]

    def predict(ctx, q, bit, d=0):
        node = (ctx[:d], q)
        if node not in n:
            return 0.5
        own = (n[node][bit] + 0.5) / (sum(n[node]) + 1)
        if d == 5:
            return own
        w = math.exp(math.log(0.5) + kt(*n[node]) - pw(node))
        return w * own + (1 - w) * predict(ctx, q, bit, d + 1)

    def score(t):
        a, out = b"\xff" * 5 + t + b"\xff", 0.0
        for i in range(5, len(a)):
            ctx, q = a[i - 5 : i][::-1], 1
            for k in range(8):
                bit = a[i] >> (7 - k) & 1
                out += math.log10(predict(ctx, q, bit))
                q = 2 * q + bit
        return out

    return score


def plain_base(train, texts):
    split = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
    n = {}
    for t in train:
        for w in [*split(t), None]:
            n[w] = n.get(w, 0) + 1
    total, room = sum(n.values()), sum(n.values()) + 0.5 * (len(n) + 1)
    return [(len(split(t)) + 1, sum(w in n for w in [*split(t), None]), total, sum(math.log10((n.get(w, 0) + 0.5) / room) for w in [*split(t), None])) for t in texts]


def check(spark, rows, held):
    df = spark.createDataFrame([(*r, h) for r, h in zip(rows, held, strict=True)], "doc_id long, text string, h boolean").repartition(3)
    got = sorted(C.scores(df.withColumn("score", F.lit("x")), F.col("h")).collect(), key=lambda r: (r.doc_id, r.score))
    texts = [t or "" for _, t in rows]
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    model = plain_model([t.encode() for t in train])
    want = sorted(((i, h, *b, model(t.encode())) for (i, _), h, t, b in zip(rows, held, texts, plain_base(train, texts), strict=True)), key=lambda r: (r[0], r[-1]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g[:5]) == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9) and math.isclose(g.score, w[6], rel_tol=1e-6)


def test_against_recursion(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", 700)
    monkeypatch.setattr(C, "SCAN_BYTES", 200)
    rng = np.random.default_rng(2)
    rows = [(k, "".join(rng.choice(list("ab é\n\x0bC"), rng.integers(0, 120)))) for k in range(30)] + [(30, None), (31, ""), (5, "a b"), (5, "a b"), (32, "z" * 300)]
    check(spark, rows, [k % 4 == 1 for k in range(len(rows))])


def test_nothing_to_learn_from(spark):
    check(spark, [(1, "ab"), (2, None)], [True, True])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.scores(empty, F.lit(False)).collect() == []


def test_large_counts():
    n = np.array([0.0, 1, 4095, 4096, 1e6])
    want = [math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - 2 * math.lgamma(0.5) for z, o in zip(n, n[::-1], strict=True)]
    np.testing.assert_allclose(C.log_kt(n, n[::-1]), want, rtol=1e-9)


def test_values_of():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    ask = rng.integers(0, len(keys), 20000)
    assert (C.values_of(keys, np.arange(len(keys), dtype=np.float32), keys[ask]) == ask).all()
    with pytest.raises(KeyError):
        C.values_of(keys, np.zeros(len(keys)), np.array([1 << 60], dtype=np.uint64))


def test_groups_of_blocks(spark, monkeypatch):
    """Contexts that are gathered group by group first give the same scores."""
    monkeypatch.setattr(C, "BLOCK_BYTES", 300)
    monkeypatch.setattr(C, "GROUP_BLOCKS", 2)
    rng = np.random.default_rng(3)
    check(spark, [(k, "".join(rng.choice(list("ab é"), rng.integers(0, 150)))) for k in range(30)], [k % 5 == 1 for k in range(30)])


def test_very_long_text(spark):
    """A text of a megabyte beside short ones: one row each, and the score of the repetitive one is near zero a byte."""
    df = spark.createDataFrame([(1, "abc " * 250_000), (2, "abc"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in C.scores(df, F.lit(False)).collect()}
    assert got[1].n_tokens == 250_001 and got[1].bits_per_byte < 0.01 and got[3].n_tokens == 1


def test_blocks_are_worked_on_in_pieces():
    """A block's texts come batch by batch and are let go: the memory at the peak is far below that of its words and grams at once."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    vocabulary = np.array(["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)])
    texts = [" ".join(rng.choice(vocabulary, 30_000)) for _ in range(40)]  # 8 MB in one block

    def batches():
        for k, t in enumerate(texts):
            yield pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int32()), "text": [t], "held_out": [k % 5 == 1]})

    tracemalloc.start()
    got = [b for b in C.block_counts(batches())]
    peak_counts = tracemalloc.get_traced_memory()[1]
    rows = pa.Table.from_batches(got)
    grams, words = rows.filter(pa.compute.is_valid(rows["ctx"])), rows.filter(pa.compute.is_valid(rows["word"]))
    assert words.num_rows == 300 and sum(words["n"].to_pylist()) == 32 * 30_000

    def placed():
        for b in grams.to_batches(2000):
            n = b.num_rows
            values = [np.zeros(len(k) // 3, dtype="<f4").tobytes() for k in b.column("keys").to_pylist()]
            yield pa.RecordBatch.from_pydict({"block": b.column("block"), "kind": pa.array([0] * n, pa.int32()), "ctx": b.column("ctx"), "data": b.column("keys"), "values": pa.array(values), "n": pa.nulls(n, pa.int64()), "id": pa.nulls(n, pa.int64()), "held_out": pa.nulls(n, pa.bool_())})
        for b in words.to_batches():
            n = b.num_rows
            yield pa.RecordBatch.from_pydict({"block": b.column("block"), "kind": pa.array([1] * n, pa.int32()), "ctx": pa.nulls(n, pa.int32()), "data": b.column("word"), "values": pa.nulls(n, pa.binary()), "n": b.column("n"), "id": pa.nulls(n, pa.int64()), "held_out": pa.nulls(n, pa.bool_())})
        for k, t in enumerate(texts):
            yield pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int32()), "kind": pa.array([2], pa.int32()), "ctx": pa.nulls(1, pa.int32()), "data": pa.array([t.encode()]), "values": pa.nulls(1, pa.binary()), "n": pa.nulls(1, pa.int64()), "id": pa.array([k]), "held_out": [k % 5 == 1]})

    tracemalloc.reset_peak()
    base = tracemalloc.get_traced_memory()[0]
    out = [r for b in C.scored(placed(), 32 * 30_001, 301, 32) for r in b.to_pylist()]
    peak_scores = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert [r["id"] for r in out] == list(range(40)) and {r["n_known"] for r in out} == {30_001} and {r["score"] for r in out} == {0.0}
    assert peak_counts < 60 << 20 and peak_scores < 60 << 20
