"""Pairs of texts of which one holds the other, by an index of their rarest parts.

A name of three letters or more has an anchor: of its three-letter parts the one that
fewest names hold. A text holds the name only if it holds the anchor, so the parts of
each text are joined with the anchors by equality and what meets is compared whole. A
shorter name is its own anchor, joined with parts of its length. The other way round,
a name holds a text only if it holds all parts of it: the text's rarest part, counted
over the names, is joined with the parts of the names, and a text with a part that no
name has is held by none. Nothing is compared with everything, and no side has to fit
in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a part.
PART = 3


def _parts(text: Column, n: Column) -> Column:
    """Distinct parts of ``n`` letters."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))


def _size(text: Column) -> Column:
    return F.least(F.length(text), F.lit(PART))


def holding_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """x, y of all pairs of a text (``texts``: x) and a name (``names``: y), both
    distinct and not empty, of which one holds the other."""
    x, y = F.col("x"), F.col("y")
    of_names = names.select("y", _size(y).alias("n")).withColumn("part", F.explode(_parts(y, F.col("n"))))
    held_by = of_names.groupBy("n", "part").agg(F.count("*").alias("held"))
    anchors = of_names.join(held_by, ["n", "part"]).groupBy("y", "n").agg(F.min_by("part", F.struct("held", "part")).alias("part"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(PART))).alias("n")
    of_texts = texts.select("x", sizes).withColumn("part", F.explode(_parts(x, F.col("n"))))
    down = of_texts.join(anchors, ["n", "part"]).where(x.contains(y)).select("x", "y")

    # names that hold the text: its rarest part in parts of its size of all names
    own = texts.select("x", _size(x).alias("n")).withColumn("part", F.explode(_parts(x, F.col("n"))))
    every = names.select("y", sizes).withColumn("part", F.explode(_parts(y, F.col("n"))))
    known = every.groupBy("n", "part").agg(F.count("*").alias("held"))
    rarest = own.join(known, ["n", "part"], "left").groupBy("x", "n").agg(F.min_by("part", F.struct(F.coalesce("held", F.lit(0)), "part")).alias("part"))
    up = rarest.join(every, ["n", "part"]).where(y.contains(x)).select("x", "y")
    return down.union(up).distinct()
