import numpy as np

import corpus_pipeline as P
from lodestar.llm import decontam, lang_id, similar
from lodestar.llm.common import id_bucket, local_labels
from tests.llm.test_decontam import brute

SF = "/root/testdata/sf0.001"


def planted(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    first = max(d[0] for d in docs) + 1
    long = [d for d in docs if len(d[1].split()) > 300][:5]
    extra = [(long[0][1], "en"), (long[1][1] + " tail", "en"), (" ".join(long[2][1].split()[:5]) + " " + items[0][1], "en"), (None, "en"), ("123 ... 456", "de"), ("", None)]
    docs += [(first + k, t, lang, "x", len(t or "")) for k, (t, lang) in enumerate(extra)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages_against_plain_versions(spark):
    docs, items, df = planted(spark)
    kept = {d[0]: d for d in docs}

    out = P.language(spark, df, SF)
    assert out.columns == df.columns
    model = lang_id.fit(df.filter(id_bucket("doc_id", 3) != 1))
    rejected = model.predict([d[1] for d in docs])[2]
    kept = {d[0]: d for d, r in zip(docs, rejected, strict=True) if not r}
    assert sorted(map(tuple, out.collect())) == sorted(kept.values())
    assert len(docs) - len(kept) <= 3 + len(docs) // 100

    df = spark.createDataFrame(list(kept.values()), df.schema).repartition(3)
    out = P.near_duplicates(spark, df, SF)
    ids = sorted(kept)
    sets = [set(similar.shingle_set(kept[i][1].encode(), 5).tolist()) for i in ids]
    link = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = local_labels(len(ids), *np.array(link).T)
    got = sorted(map(tuple, out.collect()))
    assert {r[0] for r in got} == {i for k, i in enumerate(ids) if label[k] == k}
    kept = {r[0]: r for r in got}

    df = spark.createDataFrame(got, df.schema).repartition(3)
    out = P.decontaminated(spark, df, SF)
    bad = {r[0] for r in brute([(r[0], r[1]) for r in got if len(r[1]) < 3000], items) if r[5]}
    bad |= {r.doc_id for r in decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect() if r.contaminated and len(kept[r.doc_id][1]) >= 3000}
    assert bad
    assert {r.doc_id for r in out.collect()} == set(kept) - bad
    assert out.columns == df.columns

    rows = P.packed(spark, out, SF).collect()
    lengths = {r.doc_id: len(r.text.encode().split()) + 1 for r in out.collect()}
    held, bins = dict.fromkeys(lengths, 0), {}
    for r in rows:
        held[r.doc_id] += r.piece_tokens
        bins[r.bin_id, r.bin_size] = bins.get((r.bin_id, r.bin_size), 0) + r.piece_tokens
    assert held == lengths and all(n <= size for (_, size), n in bins.items())


def test_run_and_empty_table(spark):
    assert P.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:3]:
        assert stage(spark, empty, SF).collect() == []
    assert P.packed(spark, empty, SF).collect() == []


def test_rows_without_ids_of_their_own(spark):
    """Null and repeated ids and extra columns: stages judge rows, so that one row's fate is not another's."""
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    clean = [" ".join(f"the house number {k} stands in street {j}" for j in range(8 * k, 8 * k + 8)) for k in range(4)]
    rows = [(5, clean[0], "en"), (5, items[0], "en"), (None, clean[1], "en"), (None, items[1], "de"), (7, clean[2], None), (7, clean[2], None), (None, clean[3], "en")]
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, lang string, row int, mark string").repartition(3)
    out = P.decontaminated(spark, df, SF)
    assert out.columns == df.columns
    assert sorted((r.text for r in out.collect()), key=str) == sorted([clean[0], clean[1], clean[2], clean[2], clean[3]])
    assert sorted(r.text for r in P.near_duplicates(spark, out, SF).collect()) == sorted(clean)
    assert sum(r.piece_tokens for r in P.packed(spark, df, SF).collect()) == sum(len(t.split()) + 1 for _, t, _ in rows)
