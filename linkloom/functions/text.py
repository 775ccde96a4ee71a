"""String functions as Column expressions; each takes and returns Columns.

Java's ``\\w``, ``\\d`` and ``\\b`` are ASCII; patterns that must see Arabic use
``(?U)`` or explicit ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import dictionaries as d

_WORD = r"a-zA-Z؀-ۿ"


def present(c: Column) -> Column:
    """Empty text is absent."""
    return F.nullif(c, F.lit(""))


def first_present(*cs: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[present(c) for c in cs])


def first_nonzero(*cs: Column) -> Column:
    """The first number that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c.cast("double"), F.lit(0.0)) for c in cs])


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Tokens between white space; empty for blank text."""
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " "), lambda t: t != "")


def joined(ts: Column) -> Column:
    return F.array_join(ts, " ")


def separate_scripts(c: Column) -> Column:
    c = F.regexp_replace(c, r"([a-zA-Z])([؀-ۿ])", "$1 $2")
    return F.regexp_replace(c, r"([؀-ۿ])([a-zA-Z])", "$1 $2")


def strip_signs(c: Column) -> Column:
    return F.regexp_replace(c, r"""[*|+/\-_\\(){}\[\]"'&]""", " ")


def clean(c: Column) -> Column:
    return collapse(strip_signs(separate_scripts(F.lower(c))))


def strip_trailing_dots(c: Column) -> Column:
    return joined(F.transform(tokens(c), lambda t: F.regexp_replace(t, r"\.+$", "")))


def strip_packaging(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)\bx\s*(\d+)\s*p(?:cs)?\b", "$1")
    return F.regexp_replace(c, r"(?i)\b(\d+)\s*p(?:cs)?\b", "$1")


def split_combined_doses(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)(\d+\.?\d*)/(\d+\.?\d*)\s*(mg|mcg|ml|gm|iu)\b", "$1 $3 $2 $3")
    return F.regexp_replace(c, r"(\d+)/(\d+)", "$1 $2")


def separate_units(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(\d+\.?\d*)\s*([{_WORD}]+)", "$1 $2")
    return F.regexp_replace(c, rf"([{_WORD}]+)\s*(\d+\.?\d*)", "$1 $2")


def _number(t: Column) -> Column:
    """Whether a token is a plain number: digits with one optional point."""
    return t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$")


def _shown(v: Column) -> Column:
    """A double without a trailing .0."""
    return F.when(v == F.floor(v), F.floor(v).cast("long").cast("string")).otherwise(v.cast("string"))


def _pairs(ts: Column, change) -> Column:
    """``change(token, next, previous)`` for each token, nulls dropped."""
    at = F.transform(ts, lambda t, i: change(t, F.get(ts, i + 1), F.when(i > 0, F.get(ts, i - 1))))
    return F.filter(at, lambda t: t.isNotNull())


def strengths(c: Column) -> Column:
    """Grams of at most 5 become whole milligrams; spelled-out units short."""
    ts = tokens(c)
    grams = ("g", "gm", "gram", "grams")

    def change(t: Column, after: Column, before: Column) -> Column:
        small = t.cast("double") <= 5.0
        value = F.when(after.isin(*grams) & t.rlike(r"^\d+\.?\d*$") & small, F.floor(t.cast("double") * 1000).cast("long").cast("string"))
        unit = F.when(t.isin(*grams) & before.rlike(r"^\d+\.?\d*$"), F.when(before.cast("double") <= 5.0, F.lit("mg")).otherwise(F.lit("gm")))
        spelled = F.when(t.isin("microgram", "micrograms"), F.lit("mcg")).when(t.isin("milliliter", "milliliters"), F.lit("ml"))
        return F.coalesce(value, unit, spelled, t)

    return joined(_pairs(ts, change))


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, d.DIACRITICS, "")


def fold_arabic(c: Column) -> Column:
    """One form for variants of letters, Latin digits."""
    return F.translate(F.translate(c, *d.ARABIC_LETTERS), *d.ARABIC_DIGITS)


def drop_tokens(c: Column, words: Sequence[str]) -> Column:
    return joined(F.filter(tokens(c), lambda t: ~t.isin(*words))) if words else c


def map_tokens(c: Column, table: dict[str, str]) -> Column:
    """Whole tokens replaced by a small dictionary; keys of several words first."""
    for key in sorted((k for k in table if " " in k), key=len, reverse=True):
        c = F.regexp_replace(c, rf"(?U)(?<!\w){key}(?!\w)", table[key])
    single = {k: v for k, v in table.items() if " " not in k}
    if not single:
        return c
    entries = F.create_map(*[F.lit(x) for kv in sorted(single.items()) for x in kv])
    return collapse(joined(F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(entries, t), t))))


def equivalent_doses(c: Column) -> Column:
    """``number gm`` of at most 5 to mg, ``number l`` to ml."""
    ts = tokens(c)

    def change(t: Column, after: Column, before: Column) -> Column:
        gram, litre = (after == "gm") & (t.cast("double") <= 5.0), after == "l"
        value = F.when(_number(t) & (gram | litre), _shown(t.cast("double") * 1000))
        unit = F.when(_number(before) & (t == "gm") & (before.cast("double") <= 5.0), F.lit("mg")).when(_number(before) & (t == "l"), F.lit("ml"))
        return F.coalesce(value, unit, t)

    return joined(_pairs(ts, change))


def reorder(c: Column, forms: Sequence[str] = d.FORMS) -> Column:
    """Tokens by class: name, dose, form, quantity. A number takes the unit or
    form after it along; a single token stays as it is."""
    ts = tokens(c)

    def klass(t: Column, after: Column, before: Column) -> Column:
        dose = F.coalesce(after.isin(*d.DOSE_UNITS), F.lit(False))
        quantity = F.coalesce(after.isin(*d.UNITS) | after.isin(*forms), F.lit(False))
        led = F.coalesce(_number(before), F.lit(False))
        own = F.when(_number(t), F.when(dose, 1).when(quantity, 3).otherwise(0))
        taken = F.when(led & t.isin(*d.DOSE_UNITS), 1).when(led & (t.isin(*d.UNITS) | t.isin(*forms)), 3)
        return F.coalesce(own, taken, F.when(t.isin(*forms) | t.isin(*d.UNITS), 2).otherwise(0))

    tagged = F.transform(ts, lambda t, i: F.struct(klass(t, F.get(ts, i + 1), F.when(i > 0, F.get(ts, i - 1))).alias("k"), i.alias("i"), t.alias("t")))
    return F.when(F.size(ts) <= 1, c).otherwise(joined(F.transform(F.array_sort(tagged), lambda s: s["t"])))


def lookup_key(c: Column) -> Column:
    """Trimmed text, ``123.0`` as ``123``, null as empty."""
    return F.regexp_replace(F.coalesce(F.trim(c.cast("string")), F.lit("")), r"^(\d+)\.0$", "$1")


def cell_text(c: Column) -> Column:
    return present(lookup_key(c))


def price_of(c: Column) -> Column:
    return F.expr("cast(null as double)") if c is None else present(F.regexp_extract(c.cast("string"), r"[-+]?\d*\.\d+|\d+", 0)).try_cast("double")


def stock_of(c: Column, default: int = 0) -> Column:
    return F.coalesce(present(F.regexp_extract(c.cast("string"), r"\d+", 0)).try_cast("int"), F.lit(default))


def page_price(c: Column, divisor: int = 1) -> Column:
    """Digits and points of a price text; minor units divided."""
    v = present(F.regexp_replace(c, r"[^\d.]", "")).try_cast("double")
    return F.round(F.when((F.lit(divisor) > 1) & (v >= 100), v / divisor).otherwise(v), 2)


def minor_price(c: Column, divisor: int = 100) -> Column:
    """A price of store JSON: a plain number of 100 or more is in minor units; of
    other texts the digits and points count as they are."""
    number = F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")
    units = F.when(number >= 100, number / divisor).otherwise(number)
    return F.coalesce(F.round(units, 2), present(F.regexp_replace(c, r"[^\d.]", "")).try_cast("double"))


def valid_gtin(c: Column) -> Column:
    """Digits of length 8, 12, 13 or 14 with a right mod-10 check digit."""
    code = F.trim(c)
    ds = F.transform(F.split(F.reverse(code), ""), lambda x: x.try_cast("int"))
    total = F.aggregate(F.transform(ds, lambda x, i: F.when(i == 0, 0).when(i % 2 == 1, x * 3).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(code.rlike(r"^\d+$") & F.length(code).isin(8, 12, 13, 14) & (F.pmod(10 - total % 10, F.lit(10)) == F.get(ds, F.lit(0))), F.lit(False))


def first_valid_gtin(*cs: Column) -> Column:
    return F.coalesce(*[F.when(valid_gtin(c), F.trim(c)) for c in cs])


UNIT_LABELS = (
    ("Tablet", r"\btab(?:let)?s?\b"), ("Capsule", r"\bcap(?:sule)?s?\b"), ("Syrup", r"\bsyrup\b"), ("Injection", r"\b(?:inj(?:ection)?|ampoules?|vials?)\b"),
    ("Cream", r"\bcream\b"), ("Ointment", r"\bointment\b"), ("Gel", r"\bgel\b"), ("Drops", r"\bdrops?\b"), ("Sachet", r"\bsachets?\b"),
    ("Suppository", r"\bsupp(?:ositor(?:y|ies))?\b"), ("Spray", r"\bspray\b"),
)


def unit_of(*fields: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(None).cast("string")
    for label, pattern in reversed(UNIT_LABELS):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def same_domain(host: Column, domain: Column) -> Column:
    h, w = F.regexp_replace(F.lower(host), r"^www\.", ""), F.regexp_replace(F.lower(domain), r"^www\.", "")
    return (h == w) | h.endswith(F.concat(F.lit("."), w))


def basename(url: Column) -> Column:
    return F.regexp_extract(F.split_part(url, F.lit("?"), F.lit(1)), r"[^/]*$", 0)


def basenames(urls: Column) -> Column:
    """Base names of a comma list, joined again."""
    return F.array_join(F.filter(F.transform(F.split(urls, ","), lambda u: basename(F.trim(u))), lambda b: b != ""), ",")


def safe_filename(url: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(basename(url), r"[^A-Za-z0-9._-]", "_"), r"_+", "_")
    return F.when(F.regexp_replace(name, r"[._]", "") == "", F.md5(url)).otherwise(name)


def fix_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)(?<!\.)(png|jpe?g|webp|gif)$", ".$1")


def cut_before_public(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?://[^/]+)/.*?(/public/)", "$1$2")


def slug_words(url: Column) -> Column:
    """Search text of the last path segment, without a trailing id."""
    last = F.element_at(F.filter(F.split(F.split_part(F.url_decode(url), F.lit("?"), F.lit(1)), "/"), lambda x: x != ""), -1)
    return joined(F.filter(F.split(F.regexp_replace(last, r"[-_]\d+$", ""), r"[-_]+"), lambda p: p.rlike(r"[a-zA-Z0-9]")))


def has_arabic(c: Column) -> Column:
    return c.rlike(r"[؀-ۿ]")


def has_latin(c: Column) -> Column:
    return c.rlike(r"[a-zA-Z]")


def bilingual(c: Column) -> Column:
    """struct(ar, en): the first Arabic and the first Latin part of a title."""
    parts = F.transform(F.split(c, r"\s+-\s+|\|"), lambda p: F.trim(p))
    return F.struct(F.get(F.filter(parts, has_arabic), 0).alias("ar"), F.get(F.filter(parts, lambda p: has_latin(p) & ~has_arabic(p)), 0).alias("en"))


def clean_title(c: Column, site: str = "") -> Column:
    out = collapse(c)
    return F.trim(F.regexp_replace(F.regexp_replace(out, rf"\s*[|\-]\s*{site}$", ""), rf"^{site}\s*[|\-]\s*", "")) if site else out


def site_title(c: Column, hints: Sequence[str] = ("home", "login", "cart", "search", "menu", "not found")) -> Column:
    t = F.lower(collapse(c))
    return F.coalesce((F.length(t) < 3) | t.isin(*hints) | ((F.length(t) > 90) & t.contains("|")), F.lit(True))


def letters_only(c: Column, arabic: bool = False) -> Column:
    return collapse(F.regexp_replace(c, r"[^؀-ۿ\s]" if arabic else r"[^a-zA-Z\s]", " "))


def valid_word(c: Column, least: int = 3) -> Column:
    return F.coalesce((F.length(c) >= least) & c.rlike(r"^[a-zA-Z]+$|^[؀-ۿ]+$"), F.lit(False))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)[\w؀-ۿ]+"), F.lit(0))


def scanner_text(c: Column) -> Column:
    """Lower case, punctuation and digits as spaces."""
    return collapse(F.regexp_replace(F.lower(c), r"[^a-zA-Z؀-ۿ\s]", " "))


def relevance(words_: Column, hay: Column, least: int = 3) -> Column:
    h = F.lower(hay)
    return F.size(F.filter(words_, lambda w: (F.length(w) >= least) & h.contains(F.lower(w))))


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def sanitized(c: Column) -> Column:
    """Without control characters."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
