"""Dictionaries of words and phrases as tables.

Every run of tokens of a name whose length occurs in the dictionary is looked up by
an equality join, so the dictionary may be of any size and is part of no closure; a
phrase that a great part of the names hold is a skewed key, which Spark splits.
The phrases that stay are chosen by a fold over a name's hits: from the left, the
longest at each place. Names are looked up once each.

Defined cases: a null name stays null; runs of white space become one blank; a phrase
of no token is left out; an empty value removes the phrase; of equal phrases the last
by ``order`` stays, without one the greatest value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as t

HITS = "array<struct<pos:int,back:int,value:string>>"


def phrase_table(entries: DataFrame, key: str = "key", value: str = "value", order: str | None = None) -> DataFrame:
    """phrase, n, value: one row a phrase, ``n`` its number of tokens."""
    ts = t.tokens(F.col(key))
    rank = F.struct(F.col(order) if order else F.lit(0), F.col("value"))
    rows = entries.select(F.array_join(ts, " ").alias("phrase"), F.size(ts).alias("n"), F.coalesce(F.col(value), F.lit("")).alias("value"), *([order] if order and order != value else []))
    return rows.where("n > 0").groupBy("phrase", "n").agg(F.max_by("value", rank).alias("value"))


def phrase_hits(names: DataFrame, phrases: DataFrame) -> DataFrame:
    """_name, _hits of names that hold a phrase: (pos, -n, value), by place, the
    longest first. ``names``: (_name, _ts). An outer join, as only the dictionary may
    be broadcast: Spark doesn't count how many runs the names are exploded to."""
    lengths = F.array(*[F.lit(r["n"]) for r in phrases.select("n").distinct().orderBy("n").collect()]).cast("array<int>")  # at most the words of the longest phrase
    size = F.size("_ts")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(lengths, lambda n: i + n <= size), lambda n: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice(F.col("_ts"), i + 1, n), " ").alias("phrase")))))
    asked = names.select("_name", F.explode(runs).alias("_w")).select("_name", "_w.*")
    found = asked.join(phrases.select("phrase", "value"), "phrase", "left")
    hit = F.when(F.col("value").isNotNull(), F.struct("pos", (-F.col("n")).alias("back"), "value"))
    return found.groupBy("_name").agg(F.array_sort(F.collect_list(hit)).cast(HITS).alias("_hits")).where(F.size("_hits") > 0)


def _assembled(ts: Column, hits: Column) -> Column:
    """The tokens with the chosen hits in place."""
    none = F.struct(F.lit(0).alias("until"), F.array().cast(HITS).alias("kept"))
    kept = F.aggregate(hits, none, lambda a, x: F.when(x["pos"] >= a["until"], F.struct((x["pos"] - x["back"]).alias("until"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a), lambda a: a["kept"])

    def parts(k: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(k, lambda x: x["pos"] - x["back"]))
        inner = F.transform(k, lambda x, i: F.concat(F.slice(ts, F.get(ends, i) + 1, x["pos"] - F.get(ends, i)), F.array(x["value"])))
        last = F.element_at(ends, -1)
        return F.concat(F.flatten(inner), F.slice(ts, last + 1, F.size(ts) - last))

    # an array of one makes the fold run once, however often its result is read
    return F.array_join(F.filter(F.flatten(F.transform(F.array(kept), parts)), lambda x: x != ""), " ")


def replaced(df: DataFrame, name: str, phrases: DataFrame | Mapping[str, str], out: str | None = None) -> DataFrame:
    """``df`` with the phrases of ``phrases`` (see ``phrase_table``; a small dictionary
    may be a mapping) replaced in ``name``, the result in column ``out`` (else in
    ``name``)."""
    out = out or name
    if isinstance(phrases, Mapping):
        phrases = phrase_table(df.sparkSession.createDataFrame(list(phrases.items()), "key string, value string"))
    names = df.select(F.col(f"`{name}`").alias("_name")).where("_name is not null").distinct().withColumn("_ts", t.tokens(F.col("_name")))
    new = phrase_hits(names, phrases).select("_name", _assembled(t.tokens(F.col("_name")), F.col("_hits")).alias("_new"))
    value = F.coalesce(F.col("_new"), F.array_join(t.tokens(F.col(f"`{name}`")), " "))
    kept = [value.alias(c) if c == out else F.col(f"`{c}`") for c in df.columns] + ([] if out in df.columns else [value.alias(out)])
    return df.join(new, F.col(f"`{name}`") == F.col("_name"), "left").select(*kept)
