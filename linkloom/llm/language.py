"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle,
1994).

A profile is the list of the most frequent character n-grams (one to three
letters, words padded by a space), most frequent first. A document's profile is
compared with each language's by the out-of-place distance: the sum over the
document's n-grams of the difference of ranks, or of the profile length where
the language lacks the n-gram. The nearest language wins; ties go to the
language name that sorts first.

An n-gram is one number, made of the code points of its letters, so that letters
of every script count. Profiles are kept sparse, as (n-gram, language, rank).

Profiles are learned from at most about ``max_docs`` documents of each of the
``max_languages`` languages with most labelled documents, chosen by a hash of the
id; both bounds are parameters. The whole of each text is counted.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing could be learned. A null id is never held out.
Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import documents_of, held_out

PROFILE = 400
#: Bits of a code point; a space stands for what is no letter.
_BITS, _SPACE = 21, 32


class Profiles(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # sorted, one entry for each language that has the n-gram
    language: np.ndarray
    rank: np.ndarray


_IS_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """True for code points that are letters."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def coded(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; one space for a run of other
    characters, and one at each end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[_SPACE], np.where(_letters()[c], c, _SPACE), [_SPACE]]).astype(np.int64)
    return c[np.concatenate([[True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)])]


def ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three characters, by number, and their counts.
    n-grams that are spaces only, or have a space inside, are not counted."""
    two = (codes[:-1] << _BITS) | codes[1:]
    three = ((two[:-1] << _BITS) | codes[2:])[codes[1:-1] != _SPACE]
    g = np.concatenate([codes[codes != _SPACE], two, three])
    g.sort()
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    keys, n = g[at], np.diff(np.append(at, len(g)))
    real = keys != (_SPACE << _BITS | _SPACE)
    return keys[real], n[real]


def profile(codes: np.ndarray) -> np.ndarray:
    """n-grams by falling count, ties by number; at most PROFILE."""
    keys, n = ngrams(codes)
    return keys[np.argsort(-n, kind="stable")[:PROFILE]]


def fit_profiles(docs: DataFrame, max_docs: int = 3_000, max_languages: int = 10_000) -> Profiles:
    """``docs``: (doc_id, text, lang), labelled rows only."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    scale = 1 << 30
    drawn = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(scale)) < F.least(F.lit(scale), F.lit(scale * max_docs) / F.col("n"))
    # max_languages bounds this broadcast
    sample = known.join(F.broadcast(counts), "lang").where(drawn).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b["lang"].to_pylist()
            by_lang: dict[str, list[np.ndarray]] = {}
            for t, lang in zip(b["text"].to_pylist(), langs, strict=True):
                by_lang.setdefault(lang, []).append(coded(t))
            for lang, codes in by_lang.items():
                keys, n = ngrams(np.concatenate(codes))  # texts end and begin with a space
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    totals = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    # at most max_languages times PROFILE rows, the whole model
    best = totals.withColumn("rank", rank).where(F.col("rank") < PROFILE).select("lang", "gram", "rank").collect()
    languages = sorted({r["lang"] for r in best}, key=str.encode)
    number = {name: i for i, name in enumerate(languages)}
    rows = np.array(sorted((r["gram"], number[r["lang"]], r["rank"]) for r in best), np.int64).reshape(-1, 3)
    return Profiles(languages, rows[:, 0].copy(), rows[:, 1].astype(np.int32), rows[:, 2].astype(np.int16))


def distances(mine: np.ndarray, model: Profiles) -> np.ndarray:
    """Out-of-place distance of a profile to each language's."""
    lo, hi = np.searchsorted(model.grams, mine), np.searchsorted(model.grams, mine, side="right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    nearer = PROFILE - np.abs(model.rank[at] - np.repeat(np.arange(len(mine)), n))
    return PROFILE * len(mine) - np.bincount(model.language[at], nearer, len(model.languages)).astype(np.int64)


def predict(text: str | None, model: Profiles) -> tuple[str, float]:
    if not text or not model.languages:
        return "und", 0.0
    mine = profile(coded(text))
    if not len(mine):
        return "und", 0.0
    apart = distances(mine, model)
    best = int(np.argmin(apart))
    return model.languages[best], float(1 - apart[best] / (PROFILE * len(mine)))


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, lang_pred, score per row of (doc_id, text)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [predict(t, model) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(label, "doc_id long, lang_pred string, score double")


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    model = fit_profiles(docs.where(~held_out("doc_id", 4, 2)).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
