"""Personal data by weak supervision, with DataFrame functions only.

Spans come from patterns: the base patterns, whose valid matches always stay,
and looser ones (spelled-out mail addresses, phone numbers without a plus, cards
and addresses written with other signs), which are candidates. Cards and phone
numbers in their usual groups are candidates too: a base match that runs on into the
digits after it (a number, then a network address) fails and is not tried again, so
what it swallowed is found here. Candidates that repeat a base span, and numbers that
fail the checksum, add no span but teach the labelers' reliabilities what a
candidate's votes are worth. Five labelers
vote yes, no or abstain on every span: form, checksum, gazetteer, context before
it, and edges. Counts of vote patterns, a table of at most 3**5 rows a kind, go
to the driver, where expectation-maximisation (Dawid and Skene, 1979) estimates
each labeler's reliability and the chance of each pattern. With these chances as
soft labels a naive Bayes span classifier is trained on counts of the votes and
of length, digits and signs of the spans, also a bounded table. Candidates that
it gives ``least`` or more become spans, if they overlap no base span.

Positions are code points: the text is split at a pattern's matches, and the
lengths of the pieces before a match add up to its start. Running sums and
maxima over a text's spans are folded in blocks, and texts are cut through pieces
of ``CHUNK`` code points, so that the work grows with the text, not with the
square of its spans. Every pattern runs once a text.

Defined cases: a null text is empty; a text without spans has zero counts, the
hash of the empty string and an empty list. Repeated rows get equal results.
Extra columns are kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import cut, documents_of

KINDS = ("email", "ip", "card", "phone")

#: Patterns of the contract in a form that is linear in long runs: possessive
#: repeats, tries at the start of a run or at the end of the last match only,
#: and at least the twelve digits that a card must have.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}+)+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\[\.\]|\x20\.\x20)[0-9]{1,3}+(?:\[\.\]|\x20\.\x20)[0-9]{1,3}+(?:\[\.\]|\x20\.\x20)[0-9]{1,3}+",
    "card": r"(?<![0-9])(?:[0-9]{4}(?<sign>[\x20./_-]?)[0-9]{4}\k<sign>[0-9]{4}\k<sign>[0-9]{4}|3[0-9]{3}(?<mark>[\x20./_-]?)[0-9]{6}\k<mark>[0-9]{5})(?![0-9])",
    "phone": r"\+[0-9]{1,3}+[\x20.-]?\(?[0-9]{2,4}+\)?[\x20.-]?[0-9]{3,4}+[\x20.-]?[0-9]{3,4}+(?![0-9])|(?<![0-9+])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,5}[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,5})?(?![0-9])",
}

#: Fixed values of the gazetteer and context labelers.
SUFFIXES = "com org net edu gov mil info biz io co de fr es uk us it nl eu ch at be ca au in jp cn br ru pl se no dk fi pt".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 95 98".split()
HINTS = {
    "email": r"mail|contact|write|reach|address|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|login|logged|client|from",
    "card": r"card|visa|master|credit|debit|amex|paid|pay|carte|karte|tarjeta",
    "phone": r"tel|phone|call|mobile|cell|fax|contact|ruf|llam|appel",
}
AGAINST = r"version|isbn|order|invoice|page|section|figure|table|chapter|item|serial|part\b"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_ABSTAIN, _YES, _NO = 0, 1, 2
N_LABELERS, LEAST = 5, 0.9
#: Items of a block of a fold; code points of a piece of a text.
BLOCK, CHUNK = 256, 1_000
SPANS = "array<struct<kind:int,start:int,end:int,base:boolean,code:int,size:int,digits:int,signs:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _plain(kind: str, value: Column) -> Column:
    """A candidate's value in the base form of its kind."""
    if kind == "email":
        at = F.regexp_replace(value, r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?", "@")
        return F.regexp_replace(at, r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?", ".")
    if kind == "ip":
        return F.regexp_replace(value, r"\[\.\]|\x20\.\x20", ".")
    return value


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(value))
    return n.between(9, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, _YES).when(no, _NO).otherwise(_ABSTAIN)


def _votes(kind: str, base: bool, value: Column, before: Column, after: Column) -> list[Column]:
    plain, digits = _plain(kind, value), _digits(value)
    known = {
        "email": F.lower(F.regexp_extract(plain, r"\.([A-Za-z0-9-]+)$", 1)).isin(SUFFIXES),
        "ip": ~plain.rlike(r"^(?:0|255)\."),
        "card": digits.rlike(r"^[3-6]"),
        "phone": digits.rlike("^(?:" + "|".join(COUNTRY_CODES + ["0"]) + ")"),
    }[kind]
    near = F.lower(before)
    return [
        F.lit(_YES if base else _ABSTAIN),
        _vote(_valid(kind, plain), ~_valid(kind, plain)),
        _vote(known, ~known),
        _vote(near.rlike(HINTS[kind]), near.rlike(AGAINST)),
        _vote(~before.rlike(r"[\w@/]$") & ~after.rlike(r"^[\w@/]"), before.rlike(r"[\w@/]$") | after.rlike(r"^[\w@/]")),
    ]


def _guard(kind: str, loose: bool, text: Column) -> Column:
    """A cheap test that a text without it has no match."""
    if kind == "email":
        return (text.rlike(r"\bat\b") & text.contains("dot")) if loose else text.contains("@")
    return text.contains("+") if kind == "phone" and not loose else text.rlike(r"[0-9]")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often it is used,
    also inside the lambdas of ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(items: Column, zero: Column, step: Callable[[Column, Column], Column], block: int = BLOCK) -> Column:
    """The state of a fold after each item. Blocks of items are folded one after
    the other, so that appending to a result copies a block, not all of it."""
    kind = F.slice(F.array(zero), 1, 0)  # an empty array of the state's type

    def fold(items: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("now"), kind.alias("out"))
        return F.aggregate(items, start, lambda a, x: bound(step(a["now"], x), lambda n: F.struct(n.alias("now"), F.concat(a["out"], F.array(n)).alias("out"))))

    def many(items: Column) -> Column:
        firsts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
        start = F.struct(zero.alias("now"), F.slice(F.array(kind), 1, 0).alias("outs"))
        blocks = F.aggregate(firsts, start, lambda a, i: bound(fold(F.slice(items, i + 1, F.lit(block)), a["now"]), lambda f: F.struct(f["now"].alias("now"), F.concat(a["outs"], F.array(f["out"])).alias("outs"))))
        return F.flatten(blocks["outs"])

    return bound(items, many)


def _form_spans(kind: str, loose: bool, text: Column) -> Column:
    """Spans of one pattern in a text."""
    pattern = (LOOSE if loose else BASE)[kind]

    def found(x: Column) -> Column:
        n = F.size(x["m"])
        return F.transform(
            F.arrays_zip(x["m"].alias("m"), F.slice(x["gaps"], F.lit(1), n).alias("gap"), F.slice(x["gaps"], F.lit(2), n).alias("next")),
            lambda p: F.struct(p["m"].alias("m"), F.length(p["m"]).alias("len"), (F.length(p["gap"]) + F.length(p["m"])).alias("step"), F.right(p["gap"], F.lit(40)).alias("before"), F.left(p["next"], F.lit(2)).alias("after")),
        )

    def span(p: Column) -> Column:
        m, item = p["p"]["m"], p["p"]
        votes = _votes(kind, not loose, m, item["before"], item["after"])
        code = votes[0]
        for j, v in enumerate(votes[1:], 1):
            code = code + v * 3**j
        signs = F.when(m.contains(" "), 1).when(m.contains("-"), 2).when(m.contains("."), 3).when(m.contains("("), 4).otherwise(0)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (p["end"] - item["len"]).alias("start"), p["end"].alias("end"), F.lit(not loose).alias("base"), code.alias("code"),
            F.least(F.floor(item["len"] / 4), F.lit(15)).cast("int").alias("size"), F.least(F.length(_digits(m)), F.lit(20)).alias("digits"), signs.alias("signs"),
        )

    def placed(items: Column) -> Column:
        both = F.arrays_zip(items.alias("p"), scanned(items, F.lit(0), lambda at, x: at + x["step"]).alias("end"))
        return F.transform(both if loose else F.filter(both, lambda p: _valid(kind, p["p"]["m"])), span)

    none = F.array().cast(SPANS)
    every = bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps")), lambda x: bound(found(x), placed))
    return F.when(_guard(kind, loose, text), every).otherwise(none)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_spans``: kind, start, end, base, code (votes in base 3),
    features and ``free`` of every valid base match and every loose candidate,
    by start. ``free``: no base span overlaps it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.array_sort(F.concat(*[_form_spans(k, loose, text) for loose in (False, True) for k in KINDS]), _by_start)
    return docs.select("*", bound(spans, _marked_free).alias("_spans"))


def _by_start(a: Column, b: Column) -> Column:
    """Order of spans: start, kind, end."""
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["end"] - b["end"])


def _marked_free(spans: Column) -> Column:
    """A span overlaps none of the base spans if those that begin before its own
    place in the order have ended, and the next one begins after it."""
    ended = scanned(spans, F.lit(0), lambda top, s: F.when(s["base"], F.greatest(top, s["end"])).otherwise(top))
    far = F.lit(2**31 - 1)
    begun = F.reverse(scanned(F.reverse(spans), far, lambda low, s: F.when(s["base"], s["start"]).otherwise(low)))
    both = F.arrays_zip(spans.alias("s"), ended.alias("ended"), begun.alias("begun"))
    return F.transform(both, lambda p: p["s"].withField("free", (p["ended"] <= p["s"]["start"]) & (p["begun"] >= p["s"]["end"])))


FEATURES = ("size", "digits", "signs", *(f"vote{j}" for j in range(N_LABELERS)))


def _features(span: Column) -> list[Column]:
    votes = [F.pmod(F.floor(span["code"] / 3**j).cast("int"), F.lit(3)) for j in range(N_LABELERS)]
    return [span["size"], span["digits"], span["signs"], *votes]


def reliabilities(counts: dict[int, int], steps: int = 60, known: dict[int, float] | None = None) -> dict[int, float]:
    """Chance of being personal data for each vote pattern, by EM over counts of
    patterns with two classes and labelers independent given the class. Patterns in
    ``known`` keep their chance."""
    known = known or {}
    votes = {c: [c // 3**j % 3 for j in range(N_LABELERS)] for c in counts}
    chance = {c: 1 / (1 + math.exp(-1.5 * (v.count(_YES) - 1.5 * v.count(_NO)))) for c, v in votes.items()}
    chance |= known
    for _ in range(steps):
        total = [1.0, 1.0]
        seen = [[[1.0, 1.0] for _ in range(3)] for _ in range(N_LABELERS)]
        for c, n in counts.items():
            for z, p in ((0, 1 - chance[c]), (1, chance[c])):
                total[z] += n * p
                for j, v in enumerate(votes[c]):
                    seen[j][v][z] += n * p
        for c, v in votes.items():
            log = [math.log(total[z] / sum(total)) + sum(math.log(seen[j][x][z] / sum(s[z] for s in seen[j])) for j, x in enumerate(v)) for z in (0, 1)]
            chance[c] = known.get(c, 1 / (1 + math.exp(max(-500.0, min(500.0, log[0] - log[1])))))
    return chance


def train_classifier(spanned: DataFrame) -> dict[tuple[int, int, int], float]:
    """Weights (log odds) by (kind, feature, value); feature -1 is the prior.
    ``spanned``: (_spans, ...). Only bounded tables of counts are collected."""
    each = spanned.select(F.explode("_spans").alias("s"))
    codes = each.groupBy("s.kind", "s.code").agg(F.count("*").alias("n")).collect()
    # a span that fails the check of its kind (checksum, parts, digits) is known to be none
    failed = {r["code"]: 0.0 for r in codes if r["code"] // 3 % 3 == _NO}
    chance = {}
    for k in {r["kind"] for r in codes}:
        own = {r["code"]: r["n"] for r in codes if r["kind"] == k}
        chance[k] = reliabilities(own, known={c: p for c, p in failed.items() if c in own})
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), x.cast("int").alias("v")) for i, x in enumerate(_features(F.col("s")))])
    cells = each.select("s.kind", "s.code", F.explode(pairs).alias("p")).groupBy("kind", "code", "p.f", "p.v").agg(F.count("*").alias("n")).collect()
    seen: dict[tuple[int, int, int], list[float]] = {}
    for r in cells:
        cell = seen.setdefault((r["kind"], r["f"], r["v"]), [0.5, 0.5])
        p = chance[r["kind"]][r["code"]]
        cell[0] += r["n"] * (1 - p)
        cell[1] += r["n"] * p
    weights = {}
    for k in chance:
        total = [sum(r["n"] * (1 - chance[k][r["code"]]) for r in codes if r["kind"] == k) + 1, sum(r["n"] * chance[k][r["code"]] for r in codes if r["kind"] == k) + 1]
        weights[(k, -1, 0)] = math.log(total[1] / total[0])
        for (kind, f, v), (no, yes) in seen.items():
            if kind == k:
                weights[(k, f, v)] = math.log(yes / total[1]) - math.log(no / total[0])
    return weights


def chosen(spans: Column, weights: dict[tuple[int, int, int], float], least: float = LEAST) -> Column:
    """Base spans and the candidates that the classifier takes, by start, then
    kind, then end."""
    if not weights:
        return F.transform(F.filter(spans, lambda s: s["base"]), _placed)
    table = F.create_map(*[x for (k, f, v), w in sorted(weights.items()) for x in (F.lit(k * 10_000 + (f + 1) * 100 + v), F.lit(round(w, 9)))])
    limit = math.log(least / (1 - least))

    def taken(s: Column) -> Column:
        odds = F.coalesce(F.try_element_at(table, s["kind"] * 10_000), F.lit(0.0))
        for i, x in enumerate(_features(s)):
            odds = odds + F.coalesce(F.try_element_at(table, (s["kind"] * 10_000 + (i + 1) * 100 + x).cast("int")), F.lit(0.0))
        return s["base"] | (s["free"] & (odds >= limit))

    return F.transform(F.filter(spans, taken), _placed)


def _placed(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans of each row."""
    spanned = cut(with_spans(docs.select("doc_id", "text")).select("doc_id", "_spans"), "spans")
    weights = train_classifier(spanned)
    base = F.filter("_spans", lambda s: s["base"])

    def of_kind(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spanned.select("doc_id", *counts, F.sha2(_listed(F.transform(base, _placed)).cast("binary"), 256).alias("base_sha256"), _listed(chosen(F.col("_spans"), weights, least)).alias("spans"))


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind
    in brackets; spans that overlap are replaced together, by the first's kind.
    All other columns, and texts without spans, stay as they are."""
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in named.items()], F.col("text").alias("text"))
    spanned = cut(with_spans(plain).drop("text"), "spans")
    weights = train_classifier(spanned.select("_spans"))
    text = F.col(named["text"])
    picked = chosen(F.col("_spans"), weights, least)
    new = F.when(F.size("_spans") > 0, bound(picked, lambda spans: F.when(F.size(spans) > 0, _redacted(text, spans)).otherwise(text))).otherwise(text)
    return spanned.select(*[new.alias(c) if c == "text" else F.col(k).alias(c) for c, k in named.items()])


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with marks in place of ``spans``, which are not empty and sorted."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # how far the spans before each reach, and whether it begins a mark of its own
    reach = scanned(spans, F.lit(0), lambda top, s: F.greatest(top, s["end"]))
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    rest = F.struct(F.length(text).alias("start"), F.lit(-1).alias("kind"), F.length(text).alias("end"))

    def pieces(x: Column) -> Column:
        """Text between the marks and the marks, in order."""
        parts = F.arrays_zip(F.concat(x["spans"], F.array(rest)).alias("s"), F.concat(F.array(F.lit(0)), x["reach"]).alias("from"))
        own = F.filter(parts, lambda p: (p["s"]["start"] >= p["from"]) | (p["s"]["kind"] < 0))
        return F.array_join(F.transform(own, lambda p: F.concat(_between(x["chunks"], p["from"], p["s"]["start"]), F.when(p["s"]["kind"] >= 0, F.get(marks, p["s"]["kind"])).otherwise(F.lit("")))), "")

    return bound(F.struct(spans.alias("spans"), reach.alias("reach"), chunks.alias("chunks")), pieces)


def _between(chunks: Column, lo: Column, hi: Column) -> Column:
    """Code points lo to hi of a text in chunks."""

    def piece(at: Column) -> Column:
        first, last = at["lo"], at["hi"]
        i, j = F.floor(first / CHUNK).cast("int"), F.floor(last / CHUNK).cast("int")
        head, tail = F.get(chunks, i), F.coalesce(F.get(chunks, j), F.lit(""))
        inner = F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return (
            F.when(last <= first, F.lit(""))
            .when(i == j, F.substring(head, first % CHUNK + 1, last - first))
            .otherwise(F.concat(F.substring(head, first % CHUNK + 1, F.lit(CHUNK)), inner, F.substring(tail, F.lit(1), last % CHUNK)))
        )

    return bound(F.struct(lo.alias("lo"), hi.alias("hi")), piece)


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents_of(spark, sf_dir))
