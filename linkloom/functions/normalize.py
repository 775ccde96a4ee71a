"""The name normaliser as one Column builder, with switches and extra steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import dictionaries as d
from linkloom.functions import text as t
from linkloom.functions.phrases import replaced

Step = Callable[[Column], Column]


@dataclass(frozen=True)
class Options:
    arabic: bool = True
    number_words: bool = True
    synonyms: bool = True
    doses: bool = True
    reorder: bool = True
    combined_doses_first: bool = False
    forms: Sequence[str] = d.FORMS
    stop_words: Sequence[str] = d.STOP_WORDS
    extra: Sequence[Step] = field(default_factory=tuple)


def _steps(o: Options) -> tuple[list[Step], list[Step]]:
    """Steps before and after the dictionaries of phrases."""
    before = ([t.split_combined_doses] if o.combined_doses_first else []) + [t.clean, t.strip_trailing_dots, t.strip_packaging]
    if o.arabic:
        before += [t.strip_diacritics, t.fold_arabic]
    before += [t.split_combined_doses, t.separate_units, t.strengths]
    if o.arabic:
        before.append(lambda c: t.drop_tokens(c, o.stop_words))
        if o.number_words:
            before.append(lambda c: t.map_tokens(c, d.NUMBER_WORDS))
    after: list[Step] = [lambda c: F.translate(c, "%", " "), lambda c: t.map_tokens(c, d.ABBREVIATIONS)]
    if o.synonyms:
        after.append(lambda c: t.map_tokens(c, d.FORM_SYNONYMS))
    if o.doses:
        after.append(t.equivalent_doses)
    if o.reorder:
        after.append(lambda c: t.reorder(c, o.forms))
    return before, [*after, t.collapse, F.lower, *o.extra]


def normalized(df: DataFrame, name: str, out: str = "normalized_name", options: Options | None = None, phrases: DataFrame | Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with the normalised ``name`` in column ``out``. Each distinct name is
    normalised once, by as many tasks as the session names: names are small rows with
    much work each, and a file of millions may be read by one task. So extra steps see
    the name alone. Steps that read a token list more than once are projected one by
    one, so that Spark keeps them apart and no list is built twice. ``phrases``: a table
    of words and phrases (see ``phrases.phrase_table``), replaced between the Arabic and
    the English steps."""
    before, after = _steps(options or Options())
    own = [F.col(f"`{c}`") for c in df.columns if c != out]
    given = F.coalesce(F.col(name), F.lit(""))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cur = df.select(given.alias("_given")).distinct().repartition(tasks).withColumn("_n", F.col("_given"))
    for step in before:
        cur = cur.withColumn("_n", step(F.col("_n")))
    if phrases is not None:
        cur = replaced(cur, "_n", phrases)
    for step in after:
        cur = cur.withColumn("_n", step(F.col("_n")))
    new = cur.select("_given", F.col("_n").alias("_normalized"))
    return df.join(new, given == F.col("_given"), "left").select(*own, F.col("_normalized").alias(out))


def normalize_missing(df: DataFrame, names: Sequence[str], out: str = "normalized_name_en", options: Options | None = None) -> DataFrame:
    """Rows whose ``out`` is null or empty get the normalised first present of
    ``names``; the others stay as they are."""
    todo = df.where(F.col(out).isNull() | (F.col(out) == ""))
    done = df.where(F.col(out).isNotNull() & (F.col(out) != ""))
    new = normalized(todo.withColumn("_name", t.first_present(*[F.col(n) for n in names])), "_name", "_new", options)
    return done.unionByName(new.drop("_name", out).withColumnRenamed("_new", out).select(df.columns))


def normalize_fields(df: DataFrame, fields: Sequence[str] | None = None, options: Options | None = None) -> DataFrame:
    """``normalized_<field>`` beside every text column whose name holds ``name``
    or is ``title_en`` or ``title_ar``."""
    picked = list(fields) if fields is not None else [f.name for f in df.schema if f.dataType.simpleString() == "string" and ("name" in f.name.lower() or f.name in ("title_en", "title_ar"))]
    for f in picked:
        df = normalized(df, f, f"normalized_{f}", options)
    return df
