"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a benchmark question
with other numbers or names has the same template. Windows of ``width``
consecutive template tokens are hashed and joined with the benchmark's windows;
the matched windows of a document and an item are then aligned by diagonal, over
all places of each window, and the slots of the best alignment are checked: a value that fills a slot of the item must be replaced by one and the
same value wherever it occurs, and no two values by one.

A pair (document, item) is reported when the matched windows cover at least
``cover`` of the item's template windows and at least ``consistent`` of the slot
fillings agree with the most frequent replacement.

Tokens are runs of ``\\w`` (or a decimal number) of the lower-cased text. A
number is a token of digits or one of NUMBER_WORDS; a unit is one of UNITS after
a number; a name is a capitalised word, or several in a row, that does not follow
the start of the text or of a line or one of ``.!?:;`` and is not in a line of
capitals only. In a document, a name that begins a window also counts with its
first word as it is, since an item's first word may stand in running text. A
window is ``width`` template tokens, or as many more as it takes to hold
``literals`` tokens that are no placeholder, so that a template of slots alone
matches nothing and one dense in numbers is still compared.

Beside them, every window of lower-cased tokens of an item is joined by hash. A
pair that the template windows don't report is reported if template and exact
windows together cover ``cover`` of all windows of the item, and slots agree. So a
verbatim copy is found whatever its case and however many names it holds; a copy
of an item in title case with other names is not.

An item of fewer than ``width`` tokens is one window of its own length; an item
of fewer than ``literals`` tokens matches documents that hold these tokens and no
others.

The benchmark's windows are broadcast up to ``max_broadcast`` bytes; beyond
that, the windows of the documents are joined with them by a shuffle.

Defined cases: null and empty texts match nothing; repeated documents are
reported alike; repeated items are reported each. Documents that share an id, or
have none, are compared each on its own and reported under that id. Extra columns
are kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import cut, documents_of
from linkloom.llm.words import mix, powers, rolled, slices, spans_hash

#: Units that follow a number.
UNITS = frozenset(
    "mg g kg gm mcg ml l cl mm cm m km in ft mi s sec min h hr hrs mph kmh v w kw hz b kb mb gb tb lb lbs oz yd pct usd eur gbp percent dollars dollar euros euro cents cent pounds pound"
    " seconds second minutes minute hours hour days day weeks week months month years year miles mile meters meter metres metre kilometers kilometer kilometres kilometre centimeters centimetres millimeters millimetres"
    " inches inch feet foot yards yard kilograms kilogram grams gram tons ton tonnes tonne ounces ounce liters liter litres litre gallons gallon degrees degree celsius fahrenheit watts volts joules".split()
)
#: Numbers in words.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|\w+|[.!?:;\n]")
_STOPS = frozenset(".!?:;\n")
WIDTH, LITERALS, COVER, CONSISTENT = 8, 5, 0.5, 0.8
PLAIN, NUMBER, UNIT, NAME = range(4)
MARKS = ("", "<number>", "<unit>", "<name>")
_MARK_HASHES = np.array([xxhash.xxh3_64_intdigest(m) for m in MARKS], np.uint64)
_STOP, _LINE, _NUMERIC, _CAPITAL, _UNIT, _UPPER, _LOWER = (1 << i for i in range(7))


class Tokens(dict):
    """Numbers of raw tokens, with what is known of each; emptied between texts
    where a million of them are held."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.hashes, self.flags = array("Q"), array("B")

    def __missing__(self, raw: str) -> int:
        word, flag = raw.lower(), 0
        if raw in _STOPS:
            flag = _STOP | (_LINE if raw == "\n" else 0)
        elif raw[0].isdecimal() or word in NUMBER_WORDS:
            flag = _NUMERIC
        elif raw[0].isupper():
            flag = _CAPITAL
        flag |= (_UNIT if word in UNITS else 0) | (_UPPER if raw.isupper() else _LOWER if word != raw.upper() else 0)
        self[raw] = i = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self.flags.append(flag)
        return i

    def trimmed(self) -> Tokens:
        return self if len(self.words) < 1_000_000 else Tokens()


class Template(NamedTuple):
    """Tokens and template tokens of one text after another."""

    known: Tokens
    ids: np.ndarray  # of every token
    word_hash: np.ndarray
    kind: np.ndarray  # of each template token
    at: np.ndarray  # first word of each template token; one more than tokens
    words: np.ndarray  # first word of each text; one more than texts
    tokens: np.ndarray  # first template token of each text

    def text(self, lo: int, hi: int) -> str:
        return " ".join([self.known.words[i] for i in self.ids[lo:hi].tolist()])

    def value(self, i: int) -> str:
        return self.text(self.at[i], self.at[i + 1])

    def marks(self) -> list[str]:
        """Template tokens as text."""
        return [MARKS[k] or self.text(i, i + 1) for k, i in zip(self.kind.tolist(), self.at.tolist())]


def templates(texts: list[str | None], known: Tokens) -> Template:
    raw: list[str] = []
    ends = [0]
    for text in texts:
        raw += _TOKEN.findall(text or "")
        raw.append("\n")  # a text begins as a line does
        ends.append(len(raw))
    ids = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
    flag = np.frombuffer(known.flags, np.uint8)[ids]
    stop = flag & _STOP > 0
    line = np.cumsum(flag & _LINE > 0)
    lines = int(line[-1]) + 1 if len(raw) else 1
    capitals = (np.bincount(line[flag & _UPPER > 0], minlength=lines) > 0) & (np.bincount(line[flag & _LOWER > 0], minlength=lines) == 0)
    start, after = np.ones(len(raw), bool), np.zeros(len(raw), bool)
    start[1:] = stop[:-1]
    after[1:] = flag[:-1] & _NUMERIC > 0
    kind = np.where((flag & _CAPITAL > 0) & ~start & ~capitals[line], NAME, PLAIN)
    kind[after & (flag & _UNIT > 0)] = UNIT
    kind[flag & _NUMERIC > 0] = NUMBER
    words = np.concatenate([[0], np.cumsum(~stop)])[ends]
    ids, kind = ids[~stop], kind[~stop]
    first = np.ones(len(ids), bool)  # names in a row are one
    first[1:] = (kind[1:] != NAME) | (kind[:-1] != NAME)
    first[words[words < len(ids)]] = True
    at = np.append(np.flatnonzero(first), len(ids))
    return Template(known, ids, np.frombuffer(known.hashes, np.uint64)[ids], kind[first], at, words, np.searchsorted(at, words))


def template(text: str | None) -> Template:
    """Tokens of a text, and its template."""
    return templates([text], Tokens())


class Windows(NamedTuple):
    lo: np.ndarray  # template tokens of the window
    hi: np.ndarray
    form: np.ndarray  # 0 as it is; 1, 2: the first name's first word as it is
    hash: np.ndarray  # signed


def windows(t: Template, width: int = WIDTH, literals: int = LITERALS, running: bool = False) -> Windows:
    """Template windows, each within one text; with ``running`` also those that
    begin within a name."""
    n = len(t.kind)
    limit = np.repeat(t.tokens[1:], np.diff(t.tokens))
    p, q = powers(n + 3)
    first = t.word_hash[t.at[:-1]]
    token = mix(np.where(t.kind == PLAIN, first, _MARK_HASHES[t.kind]))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(token * p[:n], out=total[1:])
    plain = t.kind == PLAIN
    at = np.append(np.flatnonzero(plain), [n] * (literals + 1))  # places of plain tokens; beyond the last, the end
    before = np.cumsum(plain) - plain
    out = []
    forms = [(0, np.arange(n))]
    if running:
        names = np.flatnonzero(t.kind == NAME)
        lone = np.diff(t.at)[names] == 1
        forms += [(1, names[lone]), (2, names[~lone])]
    for form, lo in forms:
        hi = np.maximum(lo + width - (form == 2), at[before[lo] + literals - 1 - (form > 0)] + 1)
        ok = hi <= limit[lo]
        lo, hi = lo[ok], hi[ok]
        size = (hi - lo + (form == 2)).astype(np.uint64)
        if form == 0:
            h = (total[hi] - total[lo]) * q[lo]
        else:
            tail = (total[hi] - total[lo + 1]) * q[lo + 1]
            h = mix(first[lo]) + (tail * p[1] if form == 1 else mix(_MARK_HASHES[NAME : NAME + 1]) * p[1] + tail * p[2])
        out.append((lo, hi, np.full(len(lo), form), mix(h + size, width).view(np.int64)))
    return Windows(*(np.concatenate(x) for x in zip(*out, strict=True)))


def filled(t: Template, lo: int, hi: int, form: int = 0) -> list[tuple[int, str]]:
    """Word number and value of the slots of a window."""
    rest = [(int(t.at[i]), t.value(i)) for i in range(lo + (form > 0), hi) if t.kind[i] != PLAIN]
    return [(int(t.at[lo]) + 1, t.text(t.at[lo] + 1, t.at[lo + 1])), *rest] if form == 2 else rest


def exact_windows(t: Template, width: int, literals: int = LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of ``width`` lower-cased tokens; a text
    of fewer than ``literals`` tokens is one window, for width 0."""
    if width:
        limit = np.repeat(t.words[1:], np.diff(t.words))
        lo = np.flatnonzero(np.arange(len(limit)) + width <= limit)
        return lo, mix(rolled(t.word_hash, width), 100 + width)[lo].view(np.int64)
    size = np.diff(t.words)
    short = np.flatnonzero((size > 0) & (size < literals))
    lo, hi = t.words[short], t.words[short + 1]
    return lo, spans_hash(t.word_hash, lo, hi, 7).view(np.int64)


def slots_agree(pairs: list[tuple[str, str]]) -> float:
    """Share of (item value, document value) fillings that agree with a one to
    one replacement; 1 where there are none."""
    if not pairs:
        return 1.0
    there: dict[str, Counter] = defaultdict(Counter)
    for a, b in pairs:
        there[a][b] += 1
    used, good = set(), 0
    for a in sorted(there, key=lambda a: (-max(there[a].values()), a)):
        for b, n in sorted(there[a].items(), key=lambda x: (-x[1], x[0])):
            if b not in used:
                used.add(b)
                good += n
                break
    return good / len(pairs)


Places = dict[int, dict[int, list[tuple[int, str, str]]]]


def _places(hits: list[dict]) -> Places:
    """Of each item position, the places in the document and the slots filled there."""
    out: Places = defaultdict(dict)
    for x in hits:
        out[x["pos"]][x["doc_pos"]] = [(s["at"], s["a"], s["b"]) for s in x["slots"]]
    return out


def best_alignment(places: Places, least: int, consistent: float) -> tuple[int, float] | None:
    """Windows and slot agreement of the consistent alignment of the most windows,
    ``least`` or more. An alignment starts from a diagonal (place in the document
    less position in the item): every window takes its place nearest to it, and
    windows farther than some distance are left out. The alignment of all windows
    at their first places is tried too."""
    if len(places) < max(least, 1):
        return None

    def agreement(chosen: list[tuple[int, int]]) -> float:
        fills = {f for p, j in chosen for f in places[p][j]}
        return slots_agree([(a, b) for _, a, b in fills])

    best = None
    first = agreement([(p, min(at)) for p, at in places.items()])
    if first >= consistent:
        best = (len(places), first)
    lists = {p: sorted(at) for p, at in places.items()}
    diagonals = Counter(j - p for p, at in lists.items() for j in at)
    for d, _ in sorted(diagonals.items(), key=lambda x: (-x[1], x[0])):
        if best == (len(places), 1.0):
            break
        near = []
        for p, at in lists.items():
            i = bisect_left(at, p + d)
            j = min(at[max(i - 1, 0) : i + 1], key=lambda j: (abs(j - p - d), j))
            near.append((abs(j - p - d), p, j))
        near.sort()
        n = len(near)
        while n >= max(least, 1) and (best is None or n >= best[0]):
            agree = agreement([(p, j) for _, p, j in near[:n]])
            if agree >= consistent:
                best = max(best or (0, 0.0), (n, agree))
                break
            n = bisect_left(near, (near[n - 1][0],))
    return best


def item_windows(items: DataFrame, width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """item_id, h, pos, exact, width, n_windows, n_exact, slots (at, a).
    ``exact`` rows are windows of lower-cased tokens, the others of template
    tokens; pos counts words."""

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for b in batches:
            rows = []
            for i, text in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                t, typed, k = templates([text], known), [], 0
                if len(t.ids) >= literals:
                    k = min(width, len(t.kind))
                    w = windows(t, k, literals)
                    typed = [(h, int(t.at[lo]), False, k, filled(t, lo, hi)) for lo, hi, _, h in zip(*(x.tolist() for x in w), strict=True)]
                    k = min(width, len(t.ids))
                slots = filled(t, 0, len(t.kind))
                exact = [(h, p, True, k, [s for s in slots if p <= s[0] < p + k]) for p, h in zip(*(x.tolist() for x in exact_windows(t, k, literals)), strict=True)]
                rows += [(i, h, p, x, k, len(typed), len(exact), [{"at": at, "a": a} for at, a in f]) for h, p, x, k, f in typed + exact]
            yield _batch(rows, list(_ITEM_KINDS), _ITEM_KINDS)

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        cut_items, "item_id long, h long, pos int, exact boolean, width int, n_windows int, n_exact int, slots array<struct<at:int,a:string>>")


class Keys:
    """A set of hashes: a table of their last bits, then a search."""

    def __init__(self, hashes: list[int]) -> None:
        self.sorted = np.array(sorted(hashes), np.int64)
        self.mask = (1 << (16 * len(hashes) + 1024).bit_length()) - 1
        self.table = np.zeros(self.mask + 1, bool)
        self.table[self.sorted & self.mask] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places of ``h`` that are in the set."""
        at = np.flatnonzero(self.table[h & self.mask])
        found = np.minimum(np.searchsorted(self.sorted, h[at]), max(len(self.sorted) - 1, 0))
        return at[self.sorted[found] == h[at]] if len(at) else at


def document_windows(t: Template, widths: list[tuple[bool, int]], literals: int, keys: Keys | None, valued: bool) -> list[tuple]:
    """(text, h, word position in it, slot values) of the windows of texts, those
    with a hash in ``keys``. Values are null for exact windows, or unless ``valued``."""
    out = []
    for exact, k in widths:
        if exact:
            at, h = exact_windows(t, k, literals)
            hit = np.arange(len(h)) if keys is None else keys.among(h)
            at, values, h = at[hit], [None] * len(hit), h[hit]
        else:
            w = windows(t, k, literals, running=True)
            hit = np.arange(len(w.lo)) if keys is None else keys.among(w.hash)
            at, h = t.at[w.lo[hit]], w.hash[hit]
            values = [[v for _, v in filled(t, *x)] if valued else None for x in zip(*(x[hit].tolist() for x in (w.lo, w.hi, w.form)), strict=True)]
        text = np.searchsorted(t.words, at, side="right") - 1
        out += zip(text.tolist(), h.tolist(), (at - t.words[text]).tolist(), values, strict=True)
    return out


def match_windows(docs: DataFrame, items: DataFrame, width: int = WIDTH, literals: int = LITERALS, max_broadcast: int = 32_000_000) -> DataFrame:
    """doc_id, text_hash, item_id and the matched windows of both with the values
    of their slots."""
    known = cut(item_windows(items, width, literals), "benchmark")
    widths = sorted((r["exact"], r["width"]) for r in known.select("exact", "width").distinct().collect())  # at most 2 * width + 1 of them
    size = known.agg(F.sum(48 + F.aggregate("slots", F.lit(0), lambda n, x: n + 12 + F.octet_length(x["a"])))).first()[0] or 0
    small = size <= max_broadcast
    keys = Keys([r["h"] for r in known.select("h").distinct().collect()]) if small else None

    # beyond the bound only hashes move; the values of matched windows are cut afterwards
    text_hash = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), "text")

    def cut_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Tokens()
        for b in batches:
            for lo, hi in slices(b["text"]):
                seen = seen.trimmed()
                found = document_windows(templates(b["text"].slice(lo, hi - lo).to_pylist(), seen), widths, literals, keys, small)
                ids, hashes = (b[c].slice(lo, hi - lo).to_pylist() for c in ("doc_id", "text_hash"))
                yield _batch([(ids[i], hashes[i], *w) for i, *w in found], list(_KINDS), _KINDS)

    found = rows.mapInArrow(cut_docs, _SCHEMA)
    if small:
        return found.join(F.broadcast(known), "h")
    hits = cut(found.join(known.select("h").distinct(), "h").select("doc_id", "text_hash", "h", "doc_pos"), "hits")
    asked = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("h").alias("hs"))

    def cut_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Tokens()
        for b in batches:
            out, seen = [], seen.trimmed()
            for d, x, text, hs in zip(*(b[c].to_pylist() for c in ("doc_id", "text_hash", "text", "hs")), strict=True):
                out += [(d, x, *w) for _, *w in document_windows(templates([text], seen), widths, literals, Keys(hs), True)]
            yield _batch(out, list(_KINDS), _KINDS)

    one = rows.dropDuplicates(["doc_id", "text_hash"])  # rows equal in both have the same windows
    again = one.alias("r").join(asked.alias("a"), F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.text_hash") == F.col("a.text_hash"))).select("r.doc_id", "r.text_hash", "r.text", "a.hs")
    return again.mapInArrow(cut_hits, _SCHEMA).join(known, "h")


_SCHEMA = "doc_id long, text_hash struct<a:bigint,b:bigint>, h long, doc_pos int, b array<string>"
_KINDS = {"doc_id": pa.int64(), "text_hash": pa.struct([("a", pa.int64()), ("b", pa.int64())]), "h": pa.int64(), "doc_pos": pa.int32(), "b": pa.list_(pa.string())}
_ITEM_KINDS = {"item_id": pa.int64(), "h": pa.int64(), "pos": pa.int32(), "exact": pa.bool_(), "width": pa.int32(), "n_windows": pa.int32(), "n_exact": pa.int32(), "slots": pa.list_(pa.struct([("at", pa.int32()), ("a", pa.string())]))}
_PAIR_KINDS = {"doc_id": pa.int64(), "item_id": pa.int64(), "n_matched": pa.int64(), "n_windows": pa.int32(), "slot_agreement": pa.float64()}


def _batch(rows: list[tuple], names: list[str], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[n]) for c, n in zip(columns, names, strict=True)], names)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, literals: int = LITERALS, cover: float = COVER, consistent: float = CONSISTENT, max_broadcast: int = 32_000_000, by_text: bool = False) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, slot_agreement of the
    pairs that are reported; with ``by_text`` doc_id and text_hash of the
    documents that are."""
    hits = match_windows(docs, items, width, literals, max_broadcast)
    # every place of every window of an item, with the slots it fills; an exact window fills them alike
    slots = F.transform("slots", lambda s, i: F.struct(s["at"].alias("at"), s["a"].alias("a"), F.coalesce(F.get("b", i), s["a"]).alias("b")))
    pairs = hits.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_exact").alias("n_exact"), F.collect_set(F.struct("pos", "doc_pos", "exact", slots.alias("slots"))).alias("hits"),
    )
    typed = F.filter("hits", lambda x: ~x["exact"])
    enough = (F.size(F.array_distinct(typed["pos"])) >= F.greatest(F.ceil(F.lit(cover) * F.col("n_windows")), F.lit(1))) | (F.size(F.array_distinct(F.col("hits.pos"))) >= F.ceil(F.lit(cover) * F.col("n_exact")))
    pairs = pairs.where(enough)
    names = ["doc_id", *(["text_hash"] if by_text else []), *list(_PAIR_KINDS)[1:]]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, x, i, n, n_exact, found in zip(*[b[c].to_pylist() for c in ("doc_id", "text_hash", "item_id", "n_windows", "n_exact", "hits")], strict=True):
                best = best_alignment(_places([x for x in found if not x["exact"]]), ceil(cover * n), consistent)
                if best is None:  # template windows don't tell: all windows of the item
                    n, best = n_exact, best_alignment(_places(found), ceil(cover * n_exact), consistent)
                if best:
                    rows.append((d, *([x] if by_text else []), i, best[0], n, best[1]))
            yield _batch(rows, names, _PAIR_KINDS | _KINDS)

    key = "text_hash struct<a:bigint,b:bigint>, " if by_text else ""
    checked = pairs.mapInArrow(check, f"doc_id long, {key}item_id long, n_matched long, n_windows int, slot_agreement double")
    if by_text:
        return checked.select("doc_id", "text_hash").distinct()
    coverage = F.col("n_matched") / F.col("n_windows")
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct(coverage.alias("coverage"), "slot_agreement", "n_matched", "n_windows")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_matched", "b.n_windows", "b.slot_agreement", "b.coverage")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents of reported pairs, each judged by its own
    text, whatever its id."""
    bad = contaminated(docs, items, by_text=True, **options).select("text_hash").distinct()
    text_hash = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    key = next(k for k in ("_key", "_key_", "_key__") if k not in docs.columns)
    return docs.withColumn(key, text_hash).join(bad.withColumnRenamed("text_hash", key), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "benchmark"))
