"""Decontamination holds little at once and moves no documents."""

import pyarrow as pa

import corpus_pipeline
from lodestar.llm import decontam


def test_segments_are_small_and_hold_all_texts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 10)
    texts = ["a b", None, "", "c" * 30, "d e f", "g", "h" * 9]
    parts = list(decontam.slices(pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "t"])))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 10 for p in parts) and len(parts) == 4


def test_documents_stay_where_they_are(spark, monkeypatch):
    """A join whose sides Spark can't measure moves and sorts whole documents."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, kept = [], []
        for most in (1 << 20, -1):
            monkeypatch.setattr(corpus_pipeline, "SENT_MARKS", most)
            out = corpus_pipeline.decontaminated(spark, docs, sf)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            kept.append(sorted(r.doc_id for r in out.select("doc_id").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plans[0] and "BroadcastHashJoin" in plans[0]
    assert "SortMergeJoin" not in plans[1] and kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
