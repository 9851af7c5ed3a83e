import math
import random

import numpy as np
import pytest

from lodestar.llm import lang_id as L
from lodestar.llm.common import id_bucket

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    held = id_bucket("doc_id", 3) == 1
    out = L.classify(docs.filter(held), L.fit(docs.filter(~held))).collect()
    assert len(out) > 250
    assert sum(r.lang_pred == r.lang for r in out) / len(out) >= 0.98
    assert sum(r.rejected for r in out) / len(out) <= 0.01


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "12 !", "de"), (6, "the dog", None), (6, "the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", id_bucket("doc_id", 2))
    out = L.classify(docs, L.fit(docs)).collect()
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in sorted(out, key=lambda r: r.doc_id)]
    assert got == [(1, "en", False), (2, "de", False), (3, "und", True), (4, "und", True), (5, "und", True), (6, "en", False), (6, "en", False)]
    assert all(0 <= r.score <= 1 for r in out)
    kept = L.classify(docs, L.fit(docs), only_known=True)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 6]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.rejected) for r in L.classify(docs, L.fit(docs)).collect()] == [("und", True)]
    assert L.classify(docs.limit(0), L.fit(docs.limit(0))).collect() == []


def brute(model, text):
    """The nearest centroid by plain loops over trigrams."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    a = [c if 97 <= c <= 122 or c > 127 else 32 for c in f" {text.lower()} ".encode()]
    tf = {}
    for x, y, z in zip(a, a[1:], a[2:], strict=False):
        if (x, y, z) != (32, 32, 32):
            h = ((x * 0x9E3779B1 & 0xFFFFFFFF) ^ (y * 0x85EBCA77 & 0xFFFFFFFF) ^ (z * 0xC2B2AE3D & 0xFFFFFFFF)) >> 19
            tf[h] = tf.get(h, 0) + 1
    v = {h: math.log1p(n) * float(model.idf[h]) for h, n in tf.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    cos = [sum(x * float(c[h]) for h, x in v.items()) / size for c in model.centroids]
    best = max(range(len(cos)), key=lambda k: cos[k])
    return model.langs[best], min(1.0, max(0.0, cos[best]))


def test_predictions_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    held = id_bucket("doc_id", 3) == 1
    model = L.fit(docs.filter(~held))
    long = docs.limit(1).selectExpr("cast(-1 as bigint) doc_id", "repeat(text || ' ', 3000) text", "lang")
    for r in L.classify(docs.unionAll(long), model).collect():
        lang, score = brute(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4


def test_every_language_is_learned(spark):
    """Hundreds of languages with few texts each, rare ones too; more than the texts to fit on are an error."""
    rng = random.Random(1)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 5)) for _ in range(400)]
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 6)))
    rows = [(1000 * k + i, " ".join(word(a) for _ in range(60)), f"l{k:03d}") for k, a in enumerate(alphabets) for i in range(1 if k % 3 == 0 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert set(model.langs) == {r[2] for r in rows} and len(model.langs) <= L.FIT_TEXTS
    assert np.mean([r.lang_pred == r.lang for r in L.classify(docs, model).collect()]) > 0.9
    with pytest.raises(ValueError, match="more languages"):
        L.fit(docs, fit_texts=300)
