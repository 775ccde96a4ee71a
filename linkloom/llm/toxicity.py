"""Toxicity: cumulative-link ordinal regression over sparse text features.

Grades are ordered (0 none, 1 some, 2 strong). P(grade > k) = sigmoid(w.x - t_k)
with one weight vector for all thresholds t_0 <= t_1; the score is the expected
grade, the sum of these probabilities.

The labels hold toxic 0/1 and quality 0/1. A toxic document of low quality is
grade 2, another toxic one grade 1: the grade comes from the labels, not from the
features that predict it. Labels without any grade 2 leave the second threshold
where the prior of ``fit_ordinal`` holds it.

Features are words and word starts of five letters (lower case, runs of ``\\w``),
all of them, hashed to ``DIMENSION`` places, each with the value 1 + ln(count) times
the place's shrunk log-odds of toxic against other documents in the sample: places
that tell nothing have a value near zero. The whole text is read. The sample of
labelled documents is bounded by ``max_labelled`` and chosen by a hash of the id;
nothing else is.

Defined cases: a null or empty text has no feature and gets the base score;
repeated rows get equal scores; with no labelled toxic document nothing is
toxic; of repeated labels of an id the worst counts, null ids and labels are
ignored. Extra columns of the input are kept by ``drop_toxic`` and ignored by
``score_toxicity``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import bounded_sample, cut, discard, documents_of
from linkloom.llm.words import slices

_TOKEN = re.compile(r"\w+")
DIMENSION = 1 << 20
SCORE_SCHEMA = "expected_grade double, p_toxic double, grade int"


class OrdinalModel(NamedTuple):
    weights: np.ndarray  # of each place, with its log-odds multiplied in
    thresholds: np.ndarray

    def chances(self, texts: list[str | None], places: _Places) -> np.ndarray:
        """P(grade > k) of each text, for each k."""
        doc, place, n = features(texts, places)
        x = np.bincount(doc, self.weights[place].astype(float) * (1 + np.log(n)), len(texts))
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds[None, :], -50, 50)))


class _Places(dict):
    """Places of words, kept for the texts to come, up to a million of them: the
    word's place, its start's place, and whether it has one, in one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        start = (xxhash.xxh3_64_intdigest("^" + word[:5]) % DIMENSION + DIMENSION) * DIMENSION if len(word) > 5 else 0
        self[word] = i = xxhash.xxh3_64_intdigest(word) % DIMENSION + start
        return i


def features(texts: list[str | None], places: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place and count of every term of whole texts, by text
    and place."""
    words: list[str] = []
    ends = [0]
    for text in texts:
        if text:
            words += _TOKEN.findall(text.lower())
        ends.append(len(words))
    ids = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    base = np.repeat(np.arange(len(texts)), np.diff(ends)) * DIMENSION
    long = ids >= DIMENSION
    key = np.concatenate([base + ids % DIMENSION, base[long] + ids[long] // DIMENSION - DIMENSION])
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[at] // DIMENSION, key[at] % DIMENSION, np.diff(np.append(at, len(key)))


def log_odds(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, prior: float = 10.0) -> np.ndarray:
    """Log-odds of the documents that hold a feature, against the base rate;
    shrunk to zero by ``prior`` documents of the base rate."""
    share = n_bad / (n_bad + n_good)
    return np.log((bad + prior * share) / (good + prior * (1 - share))) - np.log(n_bad / n_good)


def fit_ordinal(who: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, n_terms: int, grades: int = 3, l2: float = 1.0, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient descent with Adam steps on the
    penalised likelihood of the cumulative-link model. ``l2`` is the precision of
    the weights' prior, and of the logs of the gaps between thresholds."""
    n = len(y)
    w, base, gap = np.zeros(n_terms), np.array([1.0]), np.zeros(grades - 2)
    params = np.concatenate([w, base, gap])
    m, v = np.zeros_like(params), np.zeros_like(params)

    def sig(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, steps + 1):
        w, t = params[:n_terms], np.concatenate([[params[n_terms]], params[n_terms] + np.cumsum(np.exp(params[n_terms + 1 :]))])
        eta = np.bincount(who, val * w[col], n) if len(col) else np.zeros(n)
        above = np.ones((n, grades + 1))  # P(grade > k - 1) for k = 0..grades
        above[:, 1:-1] = sig(eta[:, None] - t[None, :])
        above[:, -1] = 0
        p = np.maximum(above[np.arange(n), y] - above[np.arange(n), y + 1], 1e-12)
        slope = above * (1 - above)
        g_eta = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / p
        g_t = np.zeros(grades - 1)
        for k in range(grades - 1):
            g_t[k] = (slope[:, k + 1] / p * ((y == k + 1).astype(float) - (y == k).astype(float))).sum()
        grad = np.concatenate([np.bincount(col, val * g_eta[who], n_terms) if len(col) else np.zeros(n_terms), [g_t.sum()], [np.exp(params[n_terms + 1 + k]) * g_t[k + 1 :].sum() for k in range(grades - 2)]])
        grad[:n_terms] += l2 * w
        grad[n_terms + 1 :] += l2 * params[n_terms + 1 :]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_terms], np.concatenate([[params[n_terms]], params[n_terms] + np.cumsum(np.exp(params[n_terms + 1 :]))])


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 2 for toxic documents of low quality, 1 for other toxic
    ones, 0 for the rest; the worst of repeated labels."""
    quality = F.col("quality") if "quality" in labels.columns else F.lit(None)
    grade = F.when((F.col("toxic") == 1) & (quality == 0), 2).otherwise(F.col("toxic")).cast("int")
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(grade).alias("grade"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 6_000) -> OrdinalModel:
    """``docs``: (doc_id, text), ``labels``: (doc_id, toxic, quality). At most about
    ``max_labelled`` labelled rows are read, whose counts reach the driver."""
    marks = cut(grades_of(labels), "grades")
    n = marks.count()
    # the bound holds for the labels' side, which is broadcast; texts are not shuffled
    drawn = bounded_sample(marks, "doc_id", max_labelled, n)
    sample = bounded_sample(docs.select("doc_id", "text"), "doc_id", max_labelled, n).join(F.broadcast(drawn), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for b in batches:
            for lo, hi in slices(b["text"]):
                part = b.slice(lo, hi - lo)
                doc, place, n = features(part["text"].to_pylist(), places)
                ends = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32))
                i, x = (pa.ListArray.from_arrays(ends, pa.array(v)) for v in (place.astype(np.int32), (1 + np.log(n)).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["grade"], i, x], ["doc_id", "grade", "i", "x"])

    got = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "grade", "text").mapInArrow(count, "doc_id long, grade int, i array<int>, x array<float>").toArrow()
    discard(marks)
    rows = [tuple(got[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in ("doc_id", "grade", "i", "x")]
    order = sorted(range(got.num_rows), key=lambda r: (rows[0][r], rows[2][r].tobytes(), rows[3][r].tobytes()))
    grade = np.array([rows[1][r] for r in order], np.int64)
    if not (grade > 0).any() or not (grade == 0).any():
        return OrdinalModel(np.zeros(DIMENSION, np.float32), np.array([20.0, 40.0]))
    place = [rows[2][r] for r in order]
    who = np.repeat(np.arange(len(order)), [len(p) for p in place])
    place = np.concatenate(place)
    bad, good = (np.bincount(place[keep], minlength=DIMENSION) for keep in ((grade > 0)[who], (grade == 0)[who]))
    odds = log_odds(bad, good, int((grade > 0).sum()), int((grade == 0).sum()))
    seen, col = np.unique(place, return_inverse=True)
    value = np.concatenate([rows[3][r] for r in order]) * odds[place]
    w, thresholds = fit_ordinal(who, col, value, grade, len(seen))
    weights = np.zeros(DIMENSION, np.float32)
    weights[seen] = w * odds[seen]
    return OrdinalModel(weights, thresholds)


def score_toxicity(docs: DataFrame, model: OrdinalModel, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with expected_grade, p_toxic and grade."""
    fields = [f for f in docs.select(*keep).schema.fields]
    source = docs.select(*keep, F.col("text").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for b in batches:
            for lo, hi in slices(b["_text"]):
                part = b.slice(lo, hi - lo)
                p = model.chances(part["_text"].to_pylist(), places)
                out = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part[k] for k in keep] + out, [*keep, "expected_grade", "p_toxic", "grade"])

    return source.mapInArrow(score, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [SCORE_SCHEMA]))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose p_toxic is under ``limit``."""
    model = fit_toxicity(docs, labels)
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in named.items()], F.col("text").alias("text"))
    scored = score_toxicity(plain, model, list(named.values()))
    return scored.where(F.col("p_toxic") < limit).select(*[F.col(k).alias(c) for c, k in named.items()])


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    model = fit_toxicity(docs, documents_of(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, ["doc_id"]).withColumn("toxic", F.col("p_toxic") >= 0.5)
