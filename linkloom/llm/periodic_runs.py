"""Periodic runs of words by seeds and extended diagonals.

A run is a stretch of consecutive words of one document with smallest period q
(words q apart are identical) and length >= max(6, 4 q) that no neighbouring word
extends. On the diagonal of lag q such a run is a stretch of at least
max(6 - q, 3 q) words that equal the word q later, so it holds a k-gram that
recurs q words on for every k up to that guaranteed overlap. Lags are taken in
classes 2**j <= q < 2**(j + 1), each with the k-grams of the overlap that its
least lag guarantees (5 words for lag 1, 3 * 2**j for the others).

k is at least q in every class, and two places of a k-gram that are less than q
apart would give the run a smaller period (Fine and Wilf). So the pairs to seed a
diagonal with are those of one occurrence and the next: a position gives at most
one pair a class, and a phrase that recurs a thousand times gives no million
pairs. A position can only hold a recurring k-gram of a longer class if the
5-grams inside it recur, which leaves few positions of ordinary text to be looked
at beyond the first class.

Seeds are extended word by word to both ends of their diagonal; a table of the
furthest word covered on each lag suppresses the seeds inside a stretch that is
known already. Documents are independent, so nothing is shuffled; a task holds
the words of about a megabyte of texts, or of one longer text, at a time.

Defined cases: a null text has no words; a null id is kept (and its words are
never replaced by ``planted``); repeated rows are separate documents; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import documents_of
from linkloom.llm.words import Words, mix, powers, slices, words_of

#: Least length of a run in words and in periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4


def lag_class(j: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[int, int, int]:
    """First lag, first lag beyond, and k of class j."""
    low, high = 1 << j, 2 << j
    return low, high, min(max(least_words, least_periods * q) - q for q in (low, high - 1))


def _next_same(keys: np.ndarray) -> np.ndarray:
    """For each place the next one with the same key, else -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = order[1:][same]
    return out


def seeds(h: np.ndarray, doc: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """k, places and lags of each class of lags. ``h``: hashes of the words of some
    documents one after the other, ``doc``: the document of each, ``last``: the
    word after the last of its document."""
    place = np.arange(len(h))
    p, q = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)  # prefix sums: the hash of any k-gram in one step
    np.cumsum(h * p[: len(h)], out=total[1:])
    salt = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    recur = np.zeros(0, np.int64)  # how many places in a row, from here, hold a 5-gram that recurs
    j, base = 0, lag_class(0)[2]
    while len(place):
        low, high, k = lag_class(j)
        if j:
            place = place[recur[place] >= k - base + 1] if len(recur) else place[:0]
        place = place[place + k <= last[place]]
        if not len(place):
            return
        keys = mix((total[place + k] - total[place]) * q[place]) ^ salt[place]
        after = _next_same(keys)
        has = np.flatnonzero(after >= 0)
        at, lag = place[has], place[after[has]] - place[has]
        if not j:  # a place is marked if its 5-gram occurs before or after it too
            marked = np.zeros(len(h) + 1, bool)
            marked[at] = marked[place[after[has]]] = True
            ends = np.flatnonzero(~marked)
            recur = ends[np.searchsorted(ends, np.arange(len(h)))] - np.arange(len(h))
        fits = (lag >= low) & (lag < high)
        yield k, at[fits], lag[fits]
        j += 1


def _extended(h: np.ndarray, at: int, end: int, lag: int, first: int, last: int) -> tuple[int, int]:
    """The stretch of the diagonal of ``lag`` around [at, end)."""
    while at > first and h[at - 1] == h[at - 1 + lag]:
        at -= 1
    while end + lag < last and h[end] == h[end + lag]:
        end += 1
    return at, end


def runs_of(h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs of the documents whose words have the hashes ``h``: rows of (document,
    start within it, length, period), by document, start and period."""
    begin, last = first[:-1][doc], first[1:][doc]
    found: list[tuple[int, int, int, int]] = []
    for k, at, lag in seeds(h, doc, last):
        order = np.lexsort((at, lag, doc[at]))
        at, lag = at[order], lag[order]
        # a seed less than k words behind the one before on its lag lies in what that one covers
        new = np.ones(len(at), bool)
        new[1:] = (lag[1:] != lag[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (at[1:] - at[:-1] > k)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at))[: len(heads)] - 1
        covered: dict[tuple[int, int], int] = {}
        for i, t, q in zip(at[heads].tolist(), at[tails].tolist(), lag[heads].tolist(), strict=True):
            d = int(doc[i])
            if i < covered.get((d, q), 0):
                continue
            s, e = _extended(h, i, t + k, q, int(begin[i]), int(last[i]))
            covered[d, q] = e
            if e + q - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((d, s - int(begin[i]), e + q - s, q))
    found = sorted(found, key=lambda r: (r[0], r[1], r[3]))
    return np.array(found, np.int64).reshape(-1, 4)


def _kept(n: int, doc: np.ndarray, first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(step, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(step)[:n] == 0


def _joined(w: Words, keep: np.ndarray, source: np.ndarray) -> list[bytes]:
    """The kept words of each document joined by one space. ``source``: which word
    of the text stands at each place."""
    data = w.data.tobytes()
    out = []
    plain = source == np.arange(len(source))
    spans = np.zeros(len(w.data) + 1, np.int32)
    kept = np.flatnonzero(keep & plain)
    head = np.ones(len(kept), bool)
    head[1:] = w.doc[kept[1:]] != w.doc[kept[:-1]]
    lo = w.starts[kept] - ~head  # with the separator before it
    spans[lo] += 1
    spans[w.ends[kept]] -= 1
    inside = np.cumsum(spans)[:-1] > 0
    body = w.data.copy()
    body[lo[~head]] = 32
    body = body[inside].tobytes()
    sizes = np.bincount(w.doc[kept], weights=w.ends[kept] - lo, minlength=len(w.first) - 1).astype(np.int64)
    cuts = np.append(0, np.cumsum(sizes)).tolist()
    changed = np.zeros(len(w.first) - 1, bool)
    changed[w.doc[~plain]] = True
    for d in range(len(w.first) - 1):
        if changed[d]:
            a, b = int(w.first[d]), int(w.first[d + 1])
            at = source[a:b][keep[a:b]]
            out.append(b" ".join(data[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)))
        else:
            out.append(body[cuts[d] : cuts[d + 1]])
    return out


def _found(texts: pa.Array, g: pa.Array, parts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Words of each document, runs and collapsed texts, a slice of documents at a time."""
    for lo, hi in slices(texts):
        w = words_of(texts.slice(lo, hi - lo))
        source = np.arange(len(w.hash))
        for d, (shift, share) in enumerate(zip(g.slice(lo, hi - lo).to_pylist(), parts.slice(lo, hi - lo).to_pylist(), strict=True)):
            first, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
            if n and shift is not None and share:
                a = shift % n
                source[first + a : first + n] = first + a + np.arange(n - a) % (1 + (n - a) // share)
        h = w.hash[source]
        runs = runs_of(h, w.doc, w.first)
        yield np.diff(w.first), runs, _joined(w, _kept(len(h), w.doc, w.first, runs), source)


def periodic_runs(docs: DataFrame, planted: tuple[Column, Column] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and
    collapsed (the words of the text without those that a run repeats, joined by
    one space) of each document.

    ``planted``: two columns (g, parts). Where both are there, each word from
    number a = g % n on is first replaced so that the rest of the text repeats its
    first 1 + floor((n - a) / parts) words: repetition with known places, to
    measure or test with."""
    g, parts = planted or (F.lit(None), F.lit(None))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), g.cast("long").alias("g"), parts.cast("long").alias("parts"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = batch.column("text"), 0
            for n, runs, collapsed in _found(texts, batch.column("g"), batch.column("parts")):
                first = np.append(0, np.cumsum(np.bincount(runs[:, 0], minlength=len(n)))).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], fields=list(runs_type.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, len(n)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(first), structs, type=runs_type), pa.array(collapsed, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                done += len(n)

    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which a tenth (by crc32 of the id) first gets a
    planted repetition, as digests."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.when(h % 10 == 0, F.floor(h / 10))
    found = periodic_runs(documents_of(spark, sf_dir), (g, 3 + g % 8))
    # the greatest length first; among equals the smallest start, then the smallest period
    ordered = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("top", ordered).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
