"""Substring dedup by repeated-phrase automata.

A window is ``width`` consecutive words of one document; it is repeated if the
same words also start anywhere else. Every word that a repeated window covers is
removed. Three steps, each linear in the text:

1. Anchors. Winnowing (Schleimer et al., 2003) picks in every window the phrase
   of ``gram`` words with the least hash, so that equal windows hold equal
   anchors at equal places (the leftmost of equal phrases). Around each anchor
   lies a segment: the windows whose anchor it is, so that a window is in one. One row an anchor (about one for 14
   words) is shuffled.
2. Confirmation. An anchor seen once has no repeated window. A segment seen
   twice is repeated whole. Segments that share an anchor but differ are
   compared window by window: their windows' hashes are counted. Hashes of 64
   bits are compared under an anchor hash of 64 bits, 128 in all. Out come the
   distinct passages, each from one place where it is written: a segment, or a
   run of its windows, that recurs.
3. Automata. The passages are dealt into shards of about ``shard_words`` words,
   those of one document together, and a shard is compiled into an Aho-Corasick
   automaton over word numbers with pyahocorasick. Every document that holds an
   anchor of a shard's passages is streamed through the shard's automaton, which
   locates all occurrences; documents without one can hold none of them. What is
   removed comes from the automata alone.

Hot anchors: counts are combined before the shuffle and joins on the anchor can
be split by adaptive skew joins. A shard that many documents ask for is compiled
in several tasks, each for about ``part_bytes`` of their text. Nothing is
dropped, capped or sampled.

Defined cases: null and empty texts have no words and are returned with zeros
and the hash of the empty string; repeated rows (equal doc_id too, or null) are
separate documents and repeat each other: rows are numbered once, in a written
table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import cut, discard, documents_of
from linkloom.llm.words import Words, rolled, slices, spans_hash, words_of

WIDTH, GRAM = 35, 8
SHARD_WORDS, PART_BYTES = 400_000, 16_000_000


def _sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of a[i:i+width] for each i, by doubling."""
    f = np.minimum if least else np.maximum
    have = 1
    out = a
    while have * 2 <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(w: Words, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and row of each anchor.

    Window and word positions count through the slice."""
    n, span = len(w.hash), width - gram + 1
    empty = np.empty(0, np.int64)
    if n < width:
        return np.empty(0, np.uint64), empty, empty, empty
    grams = rolled(w.hash, gram)
    inside = w.doc[: n - width + 1] == w.doc[width - 1 :]  # windows that lie in one document
    low = _sliding(grams, span, True)
    low = np.where(inside, low, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    best = _sliding(np.concatenate([pad, low, pad]), span, False)  # over the windows that hold the phrase
    at = np.flatnonzero((best == grams) & (grams > 0))
    # the windows of which phrase p is the least one: from p - left to p + right - span + 1
    first = np.maximum(at - span + 1, w.first[w.doc[at]])
    last = np.minimum(at, w.first[w.doc[at] + 1] - width)
    left = _reach(grams, at, first, -1, span, np.greater)
    right = _reach(grams, at, last + span - 1, 1, span, np.greater_equal)
    first = np.maximum(first, at - left)
    last = np.minimum(last, at + right - span + 1)
    ok = last >= first
    return grams[at[ok]], first[ok], (last - first + 1)[ok], w.doc[at[ok]]


def _reach(grams: np.ndarray, at: np.ndarray, end: np.ndarray, way: int, span: int, holds: np.ufunc) -> np.ndarray:
    """How far from each anchor, at most to ``end``, every phrase is greater (to
    the left) or no phrase is smaller (to the right)."""
    far = np.zeros(len(at), np.int64)
    going = np.ones(len(at), bool)
    for step in range(1, span):
        to = at + way * step
        going &= (to <= end) if way > 0 else (to >= end)
        i = np.flatnonzero(going)
        if not len(i):
            break
        good = holds(grams[to[i]], grams[at[i]])
        far[i[good]] = step
        going[i[~good]] = False
    return far


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def anchor_table(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """a (anchor), s (segment), row, lo (first window in the document), n."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, rows = b["text"], b["row"]
            for i, j in slices(text):
                w = words_of(text.slice(i, j - i))
                a, lo, n, doc = anchors(w, width, gram)
                if len(a):
                    s = spans_hash(w.hash, lo, lo + n - 1 + width, 1)
                    yield pa.RecordBatch.from_arrays([_signed(a), _signed(s), rows.slice(i, j - i).take(pa.array(doc)), pa.array((lo - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], ["a", "s", "row", "lo", "n"])

    return docs.select("row", "text").mapInArrow(find, "a long, s long, row long, lo int, n int")


def window_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Windows of the segments listed in ``segs`` (a, s, lo, n, c) of each
    document: w (hash), c, a, s, at (number of the window in its segment)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b["text"]
            for i, j in slices(text):
                w = words_of(text.slice(i, j - i))
                rows = [(x["a"], x["s"], x["lo"] + w.first[d], x["n"], x["c"]) for d, segs in enumerate(b["segs"][i:j].to_pylist()) for x in segs]
                a, s, lo, n, c = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                of = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = lo[of] + at
                yield pa.RecordBatch.from_arrays([_signed(spans_hash(w.hash, start, start + width, 2)), pa.array(c[of]), pa.array(a[of]), pa.array(s[of]), pa.array(at.astype(np.int32))], ["w", "c", "a", "s", "at"])

    return docs.select("text", "segs").mapInArrow(find, "w long, c long, a long, s long, at int")


def confirmed_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Distinct passages: a, s (the segment), row, lo (where its text is taken
    from), starts (windows of it that recur); and the places of recurring anchors: a, s,
    row. ``docs``: (row, text), row unique."""
    found = cut(anchor_table(docs, width, gram), "anchors")
    many = cut(found.groupBy("a").agg(F.count("*").alias("k"), (F.min("s") != F.max("s")).alias("differ")).where("k > 1").select("a", "differ"), "many")
    # tables are cut before they are joined, so that hot anchors can be split
    seen = cut(found.join(many, "a"), "recurring")
    kinds = cut(seen.groupBy("a", "s", "differ").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo")).alias("r"), F.first("n").alias("n")), "kinds")
    whole = kinds.where("not differ").select("a", "s", "r.row", "r.lo", F.sequence(F.lit(0), F.col("n") - 1).alias("starts"))
    asked = kinds.where("differ").groupBy(F.col("r.row").alias("row")).agg(F.collect_list(F.struct("a", "s", F.col("r.lo").alias("lo"), "n", "c")).alias("segs"))
    # under one anchor, a window has one place in a segment, or more where the anchor is repeated in it
    shown = cut(window_table(docs.join(asked, "row"), width), "windows")
    double = shown.groupBy("a", "w").agg(F.sum("c").alias("k")).where("k > 1").select("a", "w")
    parts = cut(shown.join(double, ["a", "w"], "left_semi").groupBy("a", "s").agg(F.sort_array(F.collect_set("at")).alias("starts")), "parts")
    part = kinds.where("differ").join(parts, ["a", "s"]).select("a", "s", "r.row", "r.lo", "starts")
    passages = cut(whole.union(part), "passages")
    places = cut(seen.select("a", "s", "row"), "places")
    discard(found, many, seen, kinds, shown, parts)
    return passages, places


def passage_texts(docs: DataFrame, passages: DataFrame, width: int = WIDTH) -> DataFrame:
    """shard, passage: the words of every passage, joined by a space. A run of
    consecutive windows of one segment is one passage."""
    asked = passages.groupBy("row", "shard").agg(F.collect_list(F.struct("lo", "starts")).alias("segs"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, out = [], []
            for shard, text, segs in zip(b["shard"].to_pylist(), b["text"].to_pylist(), b["segs"].to_pylist(), strict=True):
                words = text.encode().split()  # bytes split at exactly the separators of words
                for seg in segs:
                    at = np.array(seg["starts"])
                    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        lo = seg["lo"] + int(run[0])
                        shards.append(shard)
                        out.append(b" ".join(words[lo : lo + len(run) - 1 + width]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(out, pa.string())], ["shard", "passage"])

    return docs.join(asked, "row").select("shard", "text", "segs").mapInArrow(write, "shard int, passage string")


def occurrences(passages: pa.Array, texts: pa.Array) -> list[list[tuple[int, int]]]:
    """Word ranges of each text that occurrences of the passages cover, by an
    Aho-Corasick automaton over numbers of words."""
    p = words_of(passages)
    known = np.unique(p.hash)
    numbers = (np.searchsorted(known, p.hash) + 1).tolist()
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for lo, hi in zip(p.first[:-1].tolist(), p.first[1:].tolist(), strict=True):
        if hi > lo:
            machine.add_word(tuple(numbers[lo:hi]), hi - lo)
    out: list[list[tuple[int, int]]] = []
    if not len(machine):
        return [[] for _ in range(len(texts))]
    machine.make_automaton()
    for i, j in slices(texts):
        w = words_of(texts.slice(i, j - i))
        at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
        number = np.where(known[at] == w.hash, at + 1, 0)  # 0: a word of no passage
        for d in range(j - i):
            runs: list[tuple[int, int]] = []
            for end, length in machine.iter(tuple(number[w.first[d] : w.first[d + 1]].tolist())):
                lo, hi = end + 1 - length, end + 1
                while runs and lo <= runs[-1][1]:
                    lo = min(lo, runs.pop()[0])
                runs.append((lo, hi))
            out.append(runs)
    return out


def covered(docs: DataFrame, passages: DataFrame, places: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """row, runs (lo, hi): the words of each document that passages cover."""
    words = passages.agg(F.sum(F.size("starts") + width - 1)).first()[0] or 0
    shard = F.pmod(F.xxhash64("row", F.floor(F.col("lo") / shard_words)), F.lit(ceil(words / shard_words) or 1)).cast("int")
    dealt = cut(passages.withColumn("shard", shard), "dealt")
    routes = cut(places.join(dealt.select("a", "s", "shard"), ["a", "s"]).select("row", "shard").distinct(), "routes")
    sent = cut(docs.join(routes, "row").select("shard", "row", "text"), "sent")
    parts = cut(sent.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("text")) / part_bytes).cast("int").alias("parts")), "shard_parts")
    texts = sent.join(parts, "shard").select("shard", F.pmod(F.xxhash64(F.lit(9), F.col("row")), F.col("parts")).cast("int").alias("part"), "row", "text")
    machines = cut(passage_texts(docs, dealt, width), "passage_texts").join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "passage")

    def locate(known: pa.Table, stream: pa.Table) -> pa.Table:
        runs = occurrences(_one(known["passage"]), _one(stream["text"])) if len(known) else [[] for _ in range(len(stream))]
        hit = [i for i, r in enumerate(runs) if r]
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.table({"row": stream["row"].take(pa.array(hit, pa.int64())), "runs": pa.array([[{"lo": a, "hi": b} for a, b in runs[i]] for i in hit], kind)})

    found = machines.groupBy("shard", "part").cogroup(texts.groupBy("shard", "part")).applyInArrow(locate, "row long, runs array<struct<lo:int,hi:int>>")
    out = cut(found.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs")), "covered")
    discard(dealt, routes, sent, parts)
    return out


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def cut_out(docs: DataFrame, cover: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs`` (row,
    doc_id, text) without the words that ``cover`` (row, runs) covers."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, runs in zip(b["text"], b["runs"].to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                if runs:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [r["lo"] for r in runs], 1)
                    np.add.at(change, [r["hi"] for r in runs], -1)
                    words = list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))
                gone.append(n[-1] - len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.join(cover, "row", "left").select("doc_id", "text", "runs").mapInArrow(write, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of (doc_id, text)."""
    # numbers are given while the table is written, so no row gets another one later
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")), "rows")
    passages, places = confirmed_passages(rows, width, gram)
    cover = covered(rows, passages, places, width, shard_words, part_bytes)
    discard(passages, places)
    return cut_out(rows, cover)


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents_of(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
n AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) h FROM n),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) p FROM r),
k AS (SELECT doc_id, list(p) ps FROM c GROUP BY doc_id),
a AS (SELECT doc_id, w, CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END kept FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM a"""
