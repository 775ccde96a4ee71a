"""Quality: regularised quadratic discriminant over document statistics.

Sixteen statistics of the whole text are transformed (logs and logits) and
standardised; each class gets a mean and a covariance, shrunk first towards the
pooled covariance and then towards a multiple of the identity (Friedman, 1989).
The score is the posterior of label 1: the difference of Mahalanobis
log-densities plus the log prior ratio. Each class's Cholesky factor is made
once and sent with the task.

Moments are summed over all labelled training rows on the executors; only sums
of size 16 x 16 per class and partition reach the driver.

Defined cases: null and empty texts have the statistics of an empty text and get
a score; with labels of one class only, or none, the score is that class's prior
(0.5 without labels). Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import cut, documents_of, held_out

N_STATS = 16
_KIND = np.zeros(256, np.uint8)  # classes of bytes; 0: bytes over 127
_KIND[0:128] = 6
_KIND[[9, 11, 12, 13, 32]] = 1
_KIND[10] = 2
_KIND[48:58] = 3
_KIND[65:91] = 4
_KIND[97:123] = 5
_KIND[[44, 46, 33, 63, 59, 58, 39, 34, 45, 40, 41]] = 7


def _logit(x: float, n: float) -> float:
    return float(np.log((x + 0.5) / (max(n - x, 0.0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text."""
    raw = (text or "").encode()
    n = len(raw)
    k = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) if n else np.zeros(8, np.int64)
    words = raw.split()
    lines = raw.split(b"\n")
    kinds = set(words)
    odd = sum(map(len, kinds))
    lone = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,!?;:\"')-")
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(n / (len(words) + 1))),
        _logit(k[3], n), _logit(k[4], n), _logit(k[6], n), _logit(k[7], n), _logit(k[0], n), _logit(k[1], n),
        _logit(k[2], n), _logit(len(kinds), len(words)), _logit(len(set(lines)), len(lines)), float(np.log1p(odd / (len(kinds) + 1))),
        _logit(raw.count(b"|"), len(words) + 1), _logit(lone, len(words)), float(np.log1p(n / (raw.count(b". ") + 1))),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats``, an array of N_STATS doubles, per row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compute, "doc_id long, stats array<double>")


class Discriminant(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # 2 x d
    factors: np.ndarray  # 2 x d x d, inverse Cholesky factors
    offsets: np.ndarray  # log prior - half log determinant, per class
    prior: float | None  # the score where only one class, or none, is known

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        log = [self.offsets[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit_discriminant(stats: DataFrame, towards_pool: float = 0.1, towards_round: float = 0.05) -> Discriminant:
    """``stats``: (stats, label). Shrinkage weights are fixed parameters."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros((N_STATS + 1, N_STATS + 1)) for c in (0, 1)}
        for b in batches:
            x = np.array(b["stats"].to_pylist()).reshape(-1, N_STATS)
            y = b["label"].to_numpy(zero_copy_only=False)
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[c].ravel().tolist() for c in (0, 1)], pa.list_(pa.float64()))], ["label", "m"])

    parts = stats.select("stats", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1)).mapInArrow(moments, "label int, m array<double>")
    # summed entry by entry before anything reaches the driver
    entries = parts.select("label", F.posexplode("m").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, (N_STATS + 1) ** 2))
    for r in entries:
        total[r["label"], r["at"]] = r["v"]
    total = total.reshape(2, N_STATS + 1, N_STATS + 1)
    n = total[:, 0, 0]
    if n.min() < 2:
        return Discriminant(*[np.zeros(0)] * 5, prior=0.5 if n.sum() == 0 else float(n[1] / n.sum()))
    means = total[:, 0, 1:] / n[:, None]
    cov = total[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    centre = (means * n[:, None]).sum(axis=0) / n.sum()
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    means, cov, pooled = (means - centre) / scale, cov / np.outer(scale, scale), pooled / np.outer(scale, scale)
    factors, offsets = [], []
    for c in (0, 1):
        s = (1 - towards_pool) * cov[c] + towards_pool * pooled
        s = (1 - towards_round) * s + towards_round * np.trace(s) / N_STATS * np.eye(N_STATS)
        chol = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(chol))
        offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(chol)).sum())
    return Discriminant(centre, scale, means, np.array(factors), np.array(offsets), None)


def score_quality(stats: DataFrame, model: Discriminant) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b["stats"].to_pylist()).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(model.scores(x))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(score, "doc_id long, score double")


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(document_statistics(documents_of(spark, sf_dir)), "stats")
    labels = documents_of(spark, sf_dir, "labels").where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    train = stats.where(~held_out("doc_id", 5, 0)).join(labels, "doc_id")
    scored = score_quality(stats, fit_discriminant(train))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
