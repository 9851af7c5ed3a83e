"""The corpus pipeline: language ID, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontam, lang_id, packing, similar
from lodestar.llm.common import id_bucket, new_path, table, written

#: Marks of contaminated documents, eight bytes each, that are sent to all executors.
SENT_MARKS = 1 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those rejected go (no letter, or far from every language)."""
    model = lang_id.fit(docs.filter(id_bucket("doc_id", 3) != 1))
    return lang_id.classify(docs, model, only_known=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Found by SimHash pivot tables, decided by the Jaccard similarity of five-word
    shingles, 0.8 or more. Rows without an id come last in their group; of rows
    that share an id or are equal one stays.
    """
    return similar.without_near_duplicates(docs, shingle=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates, judged row by row: ids may be null or repeated."""
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), similar.row_marks(docs)[0].alias("mark"))
    texts = marked.select(F.col("mark").alias("doc_id"), F.col("row.text").alias("text"))
    bad = decontam.contamination(texts, table(spark, sf_dir, "benchmark"), window=13, share=20).filter("contaminated")
    bad = written(bad.select(F.col("doc_id").alias("mark")).distinct(), "contaminated")
    # Few marks go to the documents, which then stay where they are; many meet them by hash, without sorting whole documents.
    bad = F.broadcast(bad) if bad.count() <= SENT_MARKS else bad.hint("shuffle_hash")
    return marked.join(bad, "mark", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequences."""
    return packing.pack(packing.word_lengths(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]

#: SQL can express neither the classifier, the components nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


