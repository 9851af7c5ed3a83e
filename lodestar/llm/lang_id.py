"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter trigrams. The vectors of
each language are clustered into a few centroids (spherical k-means), and a text
gets the language of the centroid with the largest cosine. Texts farther from
every centroid than the training texts of its language allow are rejected; short
texts may be farther, as few trigrams can't come near any centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map

#: Dimensions that the trigrams are hashed to.
DIMS = 1 << 13
#: Labelled texts that the classifier is fitted on, about so many of all languages together.
FIT_TEXTS = 2000
CENTROIDS = 3
#: A text is rejected if its cosine is below this share of the least cosine of its language's training texts.
REJECT_SHARE = 0.5
#: Distinct trigrams from which on that holds; with fewer the bound falls with the square root of their number.
REJECT_TRIGRAMS = 200
UNKNOWN = "und"
#: ASCII letters and bytes above 127 stand for themselves, all else for a space.
_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_has_letter = regex.compile(r"\p{L}").search


def counts_of(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams that are not three spaces."""
    a = np.frombuffer(f" {text.lower()} ".encode().translate(_LETTERS), dtype=np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(DIMS, dtype=np.float32)
    x, y, z = a[:-2], a[1:-1], a[2:]
    h = ((x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA77) ^ z * np.uint32(0xC2B2AE3D)) >> np.uint32(19)).astype(np.int64)
    blank = (x == 32) & (y == 32) & (z == 32)
    return np.bincount(h[~blank] if blank.any() else h, minlength=DIMS).astype(np.float32)


@dataclass
class Model:
    """idf of each dimension, unit centroids with their language, and the least cosine that a language allows."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF vectors, in place of the counts."""
        v = np.log1p(counts, out=counts)
        v *= self.idf
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
        return v

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine clipped to 0..1 and whether the text is rejected, for each text."""
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        rows = [k for k, t in enumerate(texts) if t and _has_letter(t)] if self.langs else []
        for s in range(0, len(rows), 256):
            part = rows[s : s + 256]
            counts = np.stack([counts_of(texts[k]) for k in part])
            slack = np.sqrt(np.minimum(1.0, np.count_nonzero(counts, axis=1) / REJECT_TRIGRAMS))
            cos = self.vectors(counts) @ self.centroids.T
            best = cos.argmax(axis=1)
            for k, b, c, s_ in zip(part, best, cos[np.arange(len(part)), best], slack, strict=True):
                langs[k] = self.langs[b]
                scores[k] = min(1.0, max(0.0, float(c)))
                rejected[k] = c < self.least[b] * s_
        return langs, scores, rejected


def clustered(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids by spherical k-means, started at points far from each other."""
    start = [v.sum(axis=0)]
    start[0] = start[0] / max(np.linalg.norm(start[0]), 1e-12)
    while len(start) < min(k, len(v)):
        start.append(v[int((v @ np.stack(start).T).max(axis=1).argmin())])
    c = np.stack(start)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_texts: int = FIT_TEXTS, centroids: int = CENTROIDS) -> Model:
    """Fit on about ``fit_texts`` of the rows with a language and a letter, as many of each language where there are as many.

    Every language is learned, by one text at least; more languages than
    ``fit_texts`` are an error, as that bounds the centroids too. The sample is
    chosen by the hash of the id. Only its trigram counts come to the driver.
    """
    draw = F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1 << 30))
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    labelled = labelled.filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}")).withColumn("draw", draw)
    sizes = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("low")).limit(fit_texts + 1).collect()
    if not sizes:
        return Model(np.ones(DIMS, dtype=np.float32), np.zeros((0, DIMS), dtype=np.float32), [], np.zeros(0))
    if len(sizes) > fit_texts:
        raise ValueError(f"more languages than the {fit_texts} texts to fit on")
    each = fit_texts // len(sizes)
    tops = [(r.l, max(r.low + 1, int(min(1.0, each / r.n) * (1 << 30)))) for r in sizes]
    chosen = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(tops, "l string, top long")), "l").filter("draw < top")  # at most fit_texts rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if _has_letter(t.as_py()):
                    c = counts_of(t.as_py())
                    at = np.flatnonzero(c)
                    rows.append((lang, at.astype("<u2").tobytes(), c[at].astype("<f4").tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["l", "at", "c"])

    sample = arrow_map(chosen.select("t", "l"), run, "l string, at binary, c binary").collect()
    sample.sort(key=lambda r: (r.l, bytes(r["at"]), bytes(r.c)))
    if not sample:
        return Model(np.ones(DIMS, dtype=np.float32), np.zeros((0, DIMS), dtype=np.float32), [], np.zeros(0))
    counts = np.zeros((len(sample), DIMS), dtype=np.float32)
    for k, r in enumerate(sample):
        counts[k, np.frombuffer(r["at"], dtype="<u2")] = np.frombuffer(r.c, dtype="<f4")
    idf = np.log((1 + len(sample)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + np.float32(0.1)
    model = Model(idf, np.zeros((0, DIMS), dtype=np.float32), [], np.zeros(0))
    v, langs = model.vectors(counts), np.array([r.l for r in sample])
    cents, names, least = [], [], []
    for lang in sorted(r.l for r in sizes):
        own = v[langs == lang]
        if len(own):
            c = clustered(own, centroids)
            cents.append(c)
            names += [lang] * len(c)
            least += [REJECT_SHARE * float((own @ c.T).max(axis=1).min())] * len(c)
    return Model(idf, np.concatenate(cents).astype(np.float32), names, np.array(least))


def classify(docs: DataFrame, model: Model, text_col: str = "text", only_known: bool = False) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and rejected; with ``only_known`` the rows that are not rejected, unchanged.

    Columns of those three names that ``docs`` has already are replaced. Null
    texts and texts without a letter are ``und``, score 0 and rejected, and so
    is every text where the model was fitted on no rows. Repeated rows stay
    repeated; an empty table gives no rows; of equal cosines the first centroid
    in order of language counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers for each of at most about FIT_TEXTS centroids
    new = ["lang_pred", "score", "rejected"]
    src = docs if only_known else docs.drop(*new)
    at = src.columns.index(text_col)
    schema = src.schema if only_known else src.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            langs, scores, rejected = m.predict(b.column(at).cast(pa.string()).to_pylist())
            if only_known:
                yield b.filter(pa.array(~rejected))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=[*b.schema.names, *new])

    return arrow_map(src, run, schema)
