"""Quality by nearest-neighbour voting over latent-semantic vectors (operator 4).

Terms: byte 1- to 3-grams of the whole text as it stands (case, marks and lines count), hashed to BINS, and the share of
words that repeat the one before. Their square-rooted shares are weighted by inverse document frequency and
projected to DIMS latent-semantic dimensions (truncated SVD of the labelled sample). The labelled vectors, SAMPLE
at most, are broadcast with the projection: SAMPLE * DIMS + BINS * DIMS floats. Every document's cosine with all of them is computed in
blocks; the NEIGHBOURS nearest vote for their labels with weight max(similarity, 0)**SHARPNESS, the two labels with the
weight of their share in the labelled rows where the sample had to even them out. Similarities are compared after rounding, ties go to the lower doc_id, so
results don't depend on how rows are batched.

Null and empty texts have no direction and get the share of label 1 among labelled rows, as does everything without labels for both values (0.5
without any). Labels of rows that appear twice with different values count as 0. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import DOUBLE, annotate, struct, table
from quarryline.llm.features import bounded_sample, gram_counts, held_out, learning, unit

BINS, DIMS, SAMPLE, NEIGHBOURS, SEED, SHARPNESS = 4096, 48, 6000, 15, 4, 4
REPEAT_WEIGHT = 1.0


def terms(texts: list[str | None]) -> np.ndarray:
    counts = gram_counts(texts, BINS, fold=False, repeats=True)
    words = np.maximum(counts[:, BINS], 1)
    share = REPEAT_WEIGHT * np.sqrt(counts[:, BINS + 1] / words)
    return np.hstack([unit(counts[:, :BINS]), share[:, None].astype(np.float32)])


class QualityModel:
    def __init__(self, x: np.ndarray, labels: np.ndarray, prior: float):
        self.prior, self.labels = prior, labels.astype(np.float32)
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        self.idf[-1] = 1
        weighted = x * self.idf
        dims = min(DIMS, *weighted.shape)
        draw = np.random.default_rng(SEED).standard_normal((weighted.shape[1], dims + 10)).astype(np.float32)
        q = np.linalg.qr(weighted @ draw)[0]
        for _ in range(3):
            q = np.linalg.qr(weighted @ np.linalg.qr(weighted.T @ q)[0])[0]
        self.axes = np.ascontiguousarray(np.linalg.svd(q.T @ weighted, full_matrices=False)[2][:dims].T)
        self.vectors = np.ascontiguousarray(self._latent(x).T)
        part = float(self.labels.mean())
        one, zero = prior / part if part else 1.0, (1 - prior) / (1 - part) if part < 1 else 1.0
        self.votes = np.where(self.labels > 0, one, zero).astype(np.float64)

    def _latent(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        n, k = self.vectors.shape[1], min(NEIGHBOURS, self.vectors.shape[1])
        for at in range(0, len(texts), block):
            x = terms(texts[at : at + block])
            near = np.rint((self._latent(x) @ self.vectors).astype(np.float64) * 1e4).astype(np.int64)
            order = near * n + np.arange(n)[::-1]  # ties to the lower position
            top = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(x), 1))
            weight = (np.maximum(np.take_along_axis(near, top, 1), 0) / 1e4) ** SHARPNESS * self.votes[top]
            total = weight.sum(1)
            some = (total > 0) & (x.sum(1) > 0)
            out[at : at + block][some] = np.round((weight * self.labels[top]).sum(1)[some] / total[some], 9)
        return out


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, seed: int = SEED) -> QualityModel | float:
    """A model of labels.quality from the rows that may be learned from; the prior alone if one value is missing."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(learning()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if not (counts.get(0) and counts.get(1)):
        return prior

    def make():
        return lambda texts: [pa.array([r.tobytes() for r in terms(texts).astype(np.float16)])]

    picked = bounded_sample(marks.select(F.col("label_id").alias("doc_id"), F.lit("").alias("text"), "quality"), "quality", most, seed).select(F.col("doc_id").alias("label_id"), "quality")
    # a few thousand ids: SAMPLE bounds them; an id of several texts gives the least one
    rows = docs.where("text <> ''").select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = annotate(rows, make, struct(x=T.BinaryType()), carry=("doc_id", "quality")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    if len({r["quality"] for r in found}) < 2:
        return prior
    return QualityModel(np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32), np.array([r["quality"] for r in found]), prior)


def score(docs: DataFrame, model: QualityModel | float, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and score of every row."""

    def make():
        if isinstance(model, float):
            return lambda texts: [np.full(len(texts), model)]
        return lambda texts: [model.scores(texts)]

    return annotate(docs, make, struct(score=DOUBLE), text, carry)


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
