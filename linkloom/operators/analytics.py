"""Counts, rollups, dictionary mining and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.functions import text as t
from linkloom.operators import quantiles
from linkloom.operators.tables import numbered
from linkloom.sources.shared import written


def counts_by(df: DataFrame, key: str | Column, first: Sequence[str] = (), order: str | None = None, name: str = "key") -> DataFrame:
    """Rows by key, with the values of ``first`` of the key's first row."""
    k = (F.col(key) if isinstance(key, str) else key).alias(name)
    keep = [F.min_by(c, order).alias(c) for c in first]
    return df.groupBy(k).agg(F.count("*").alias("n"), *keep)


def status_counts(df: DataFrame, status: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One column a status, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def status_by_run(df: DataFrame, run: str, status: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(run).pivot(status, list(values)).count().na.fill(0)


def taxonomy_rollup(df: DataFrame, levels: Sequence[str], unit: str | None = None) -> DataFrame:
    """Counts at every depth of a path of levels: one pass of grouping sets.
    ``unit`` counts distinct things (a product in two branches once a node)."""
    sets = [levels[:i] for i in range(1, len(levels) + 1)]
    agg = F.count_distinct(unit) if unit else F.count("*")
    return df.where(F.col(levels[0]).isNotNull()).groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(c) for c in levels]).agg(F.grouping_id().alias("_g"), agg.alias("n")).withColumn("level", F.lit(len(levels)) - F.bit_count("_g")).drop("_g")


def taxonomy_tree(rollup: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Two upper levels nested: children by count, then name."""
    top, mid = levels[0], levels[1]
    child = rollup.where("level = 2").groupBy(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(mid).alias("name"), F.col("n").alias("count")))).alias("children"))
    return rollup.where("level = 1").select(top, "n").join(child, top, "left").withColumn("children", F.transform("children", lambda c: F.struct(c["name"].alias("name"), c["count"].alias("count"))))


def index_codes(counted: DataFrame, order: Sequence[Column | str], out: str = "index_code") -> DataFrame:
    """Dense 1-based codes. ``counted`` is an aggregate of one row an entity; the
    numbering is ranged, so that many entities do not meet in one task."""
    return numbered(counted, list(order), out)


def entity_table(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """slug, level, parent, n over all levels of a path; the first parent seen."""
    parts = [df.where(F.col(c).isNotNull()).select(F.col(c).alias("slug"), F.lit(i + 1).alias("level"), (F.col(levels[i - 1]) if i else F.lit(None)).cast("string").alias("parent"), F.col("ord")) for i, c in enumerate(levels)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("slug", "level").agg(F.min_by("parent", "ord").alias("parent"), F.count("*").alias("n"))


def unmapped_tokens(texts: DataFrame, column: str, known: Sequence[DataFrame], name: str = "token") -> DataFrame:
    """Words that no dictionary holds, with their counts. Words are counted
    before the dictionaries are taken away, so that only distinct words move."""
    out = texts.select(F.explode(t.words(t.scanner_text(F.col(column)))).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    for k in known:
        out = out.join(k.select(F.col(k.columns[0]).alias(name)).distinct(), name, "left_anti")
    return out


def token_frequency(df: DataFrame, column: str, separator: str = ",", k: int = 100) -> DataFrame:
    """The k most frequent parts of a separated list."""
    return df.select(F.explode(F.split(column, separator)).alias("token")).select(F.trim("token").alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


#: A word that a great part of the documents hold is spread over this many tasks.
SALTS = 16


def _weighed(rows: DataFrame, side: str, word: str, count: str, least: int) -> tuple[DataFrame, DataFrame]:
    """_id, words: the words of each row's list ``side`` that occur ``least`` times, with
    how often each occurs over all rows and its number; and the table of these words."""
    terms = rows.select("_id", "_m", F.explode(side).alias(word))
    counts = terms.groupBy(word).agg(F.sum("_m").alias(count)).where(F.col(count) >= least)
    counts = written(counts.withColumn(f"_{word}", F.monotonically_increasing_id()), "words")
    salted = terms.withColumn("_salt", F.pmod(F.col("_id"), F.lit(SALTS)))
    known = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(known, [word, "_salt"]).groupBy("_id", "_m").agg(F.collect_list(F.struct(f"_{word}", word, count)).alias(f"_{word}s")), counts


def _pairs_of(pairs: DataFrame, left: str, right: str, distinct: bool, least: int, least_jaccard: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs of ``word_pairs`` with the numbers _a and _b of their words, and the
    words of both sides: (a, n_a, _a) and (b, n_b, _b)."""
    each = F.array_distinct if distinct else (lambda c: c)
    rows = pairs.select(each(F.col(left)).alias("_l"), each(F.col(right)).alias("_r")).groupBy("_l", "_r").agg(F.count("*").alias("_m"))
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "rows")  # read four times below
    floor = least if distinct else 1
    (a, known_a), (b, known_b) = _weighed(rows, "_l", "a", "n_a", floor), _weighed(rows, "_r", "b", "n_b", floor)
    both = a.join(b.drop("_m"), "_id").select("_m", F.explode("_as").alias("_x"), "_bs").select("_m", "_x.*", F.explode("_bs").alias("_y")).select("_a", "a", "n_a", "_y.*", "_m")
    if distinct and least_jaccard > 0:
        both = both.where(F.least("n_a", "n_b") >= F.lit(least_jaccard - 1e-9) * F.greatest("n_a", "n_b"))
    return both, known_a, known_b


def word_pairs(pairs: DataFrame, left: str, right: str, distinct: bool = True, least: int = 1, least_jaccard: float = 0.0) -> DataFrame:
    """a, n_a, b, n_b, _m: the pairs of words of the lists of one row that can reach
    ``least`` and ``least_jaccard``. Equal rows are taken once with their number _m.
    With ``distinct`` words that occur less than ``least`` times go before any pair is
    formed, as co <= min(n_a, n_b), and pairs whose counts are too far apart go before
    they are counted, as the Jaccard similarity is at most min / max."""
    return _pairs_of(pairs, left, right, distinct, least, least_jaccard)[0].select("a", "n_a", "b", "n_b", "_m")


def cooccurrence(pairs: DataFrame, left: str, right: str, distinct: bool = True, least: int = 1, least_jaccard: float = 0.0) -> DataFrame:
    """a, b, co, n_a, n_b of token lists of the same rows with a count of ``least`` or
    more, and with ``least_jaccard`` only pairs that can reach it. Pairs are counted by
    the numbers of their words, which take less room than the words and their counts."""
    both, known_a, known_b = _pairs_of(pairs, left, right, distinct, least, least_jaccard)
    co = both.groupBy("_a", "_b").agg(F.sum("_m").alias("co")).where(F.col("co") >= least)
    return co.join(known_a, "_a").join(known_b, "_b").select("a", "b", "co", "n_a", "n_b")


def word_profile(pairs: DataFrame, left: str, right: str, word: str, k: int = 15) -> DataFrame:
    """The k words of ``right`` that occur most with one word of ``left``."""
    held = pairs.where(F.array_contains(left, word)).select(F.explode(F.array_distinct(right)).alias("b"))
    return held.groupBy("b").agg(F.count("*").alias("co")).orderBy(F.desc("co"), "b").limit(k)


def mine_translations(co: DataFrame, least_support: int = 5, least_jaccard: float = 0.40, known: DataFrame | None = None) -> DataFrame:
    """The best b for each a by co / (n_a + n_b - co); ties to the first b."""
    scored = co.where(F.col("co") >= least_support).withColumn("jaccard", F.col("co") / (F.col("n_a") + F.col("n_b") - F.col("co"))).where(F.col("jaccard") >= least_jaccard)
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "b", "co")).alias("x")).select("a", F.col("x.b").alias("b"), (-F.col("x.j")).alias("jaccard"), F.col("x.co").alias("co"))
    return best.join(known.select(F.col(known.columns[0]).alias("a")), "a", "left_anti") if known is not None else best


def first_word_pairs(df: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """First word of ``left`` to first word of ``right``, the last row wins."""
    a, b = F.get(t.tokens(F.lower(F.col(left))), 0), F.get(t.tokens(F.lower(F.col(right))), 0)
    return df.select(a.alias("a"), b.alias("b"), order).where(t.valid_word(F.col("a")) & t.valid_word(F.col("b"))).groupBy("a").agg(F.max_by("b", order).alias("b"))


def ambiguous_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Values of ``left`` with more than one value of ``right``; distinct pairs are
    made first, so a group holds distinct values only."""
    g = df.select(left, right).distinct().where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left).agg(F.collect_set(right).alias("_s"))
    return g.select(left, F.size("_s").alias("n"), F.array_join(F.array_sort("_s"), "|").alias("values")).where("n > 1")


def uniqueness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column and distinct whole rows."""
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)
    return df.agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns], F.count_distinct(content).alias("n_content"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def latency(df: DataFrame, value: str, by: Sequence[str], shares: Mapping[str, float] | None = None) -> DataFrame:
    """Count, mean, exact quantiles (the median unless ``shares`` names others), least,
    most and total by group."""
    v, wanted = F.col(value), shares or {"median": 0.5}
    sums = df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.sum(v), 2).alias("total"))
    return quantiles.with_quantiles(sums, quantiles.exact_quantiles(df, value, by, wanted), by).select(*by, "n", "mean", *wanted, "least", "most", "total")


def numeric_mismatch(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two names both hold numbers but share none."""
    def numbers(c: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))

    return df.where((F.size(numbers(left)) > 0) & (F.size(numbers(right)) > 0) & ~F.arrays_overlap(numbers(left), numbers(right)))


def run_transitions(first: DataFrame, second: DataFrame, key: str | Sequence[str], status: str) -> DataFrame:
    """before, after, n: how the status of the same rows changed."""
    keys = [key] if isinstance(key, str) else list(key)
    return first.select(*keys, F.col(status).alias("before")).join(second.select(*keys, F.col(status).alias("after")), keys).groupBy("before", "after").agg(F.count("*").alias("n"))


def score_bands(df: DataFrame, score: str, order: str, bands: Sequence[tuple[float, float]], k: int = 20) -> DataFrame:
    """The first k rows of each band [low, high) of scores."""
    band = F.coalesce(*[F.when((F.col(score) >= lo) & (F.col(score) < hi), i) for i, (lo, hi) in enumerate(bands)])
    w = Window.partitionBy("band").orderBy(F.desc(score), order)
    return df.withColumn("band", band).where("band is not null").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def changed_values(df: DataFrame, raw: str, new: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.trim(raw) != F.col(new)).alias("modified"))


def accuracy(df: DataFrame, good: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(good).alias("matched")).withColumn("accuracy", s.share(F.col("matched"), F.col("total")))
