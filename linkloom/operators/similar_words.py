"""Similar words of two vocabularies: each distinct pair is scored once, whatever
the number of names that hold the words.

The similarity of two words is above 0.7 only if at most D of their characters are
inserted or deleted, D the greatest whole number below 0.3 times both lengths. Cut
into D + 1 pieces, one word then has a piece that the other holds unchanged, moved by
so few places that the rest of the lengths can still be made up. So the pairs come
from a join by equality on (both lengths, number of the piece, piece) and no pair is
lost. Pieces grow with the square of the length; words of more than ``LONG`` letters
are joined on two letters in a row instead: without any in common, at most a third of
the letters of both (and one) could be matched, which from 20 letters on is too few.
What remains is scored by its characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.sources.shared import written

#: Longest word that is cut into pieces.
LONG = 24


def pairs(asked: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, similarity of the distinct words (``word``) of both sides that differ and
    are more similar than ``LEAST``. Words with a digit are similar to none."""
    plain = "word <> '' AND NOT word RLIKE '\\\\p{Nd}'"
    left, right = asked.where(plain).select(F.col("word").alias("a")).distinct(), known.where(plain).select(F.col("word").alias("b")).distinct()
    total = F.col("na") + F.col("nb")
    # the most characters that may be inserted or deleted: below 0.3 of both lengths
    edits = (F.ceil(total * 3 / 10) - 1).cast("int")
    ratio = F.lit(s.LEAST / (2 - s.LEAST))
    begin, end = F.floor(F.col("nb") * F.col("i") / (F.col("d") + 1)).cast("int"), F.floor(F.col("nb") * (F.col("i") + 1) / (F.col("d") + 1)).cast("int")

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("d", edits).where("d > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("lo", begin).withColumn("n", end - begin).where("n > 0")

    # lengths that can be similar and are there
    known_lengths = right.select(F.length("b").alias("nb")).distinct()
    shortest, longest = F.greatest(F.floor(F.col("na") * ratio), F.lit(1)).cast("int"), F.ceil(F.col("na") / ratio).cast("int")
    lengths = left.select(F.length("a").alias("na")).distinct().withColumn("nb", F.explode(F.sequence(shortest, longest))).join(known_lengths, "nb", "left_semi")
    lengths = written(lengths, "word_lengths")
    few, many = lengths.where(F.greatest("na", "nb") <= LONG), lengths.where(F.greatest("na", "nb") > LONG)
    left, right = left.withColumn("na", F.length("a")), right.withColumn("nb", F.length("b"))

    moved = F.explode(F.filter(F.sequence(-F.col("d"), F.col("d")), lambda x: F.abs(x) + F.abs(F.col("na") - F.col("nb") - x) <= F.col("d")))
    tried = cut(left.join(few, "na")).withColumn("_x", moved).withColumn("_at", F.col("lo") + F.col("_x")).where("_at >= 0 AND _at + n <= na")
    tried = tried.select("a", "na", "nb", "i", F.expr("substring(a, _at + 1, n)").alias("piece")).distinct()
    held = cut(right.join(few, "nb")).select("b", "na", "nb", "i", F.expr("substring(b, lo + 1, n)").alias("piece"))
    short = tried.join(held, ["na", "nb", "i", "piece"])

    def twos(df: DataFrame, word: str, n: str) -> DataFrame:
        return df.withColumn("two", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col(n) - 1), lambda i: F.substring(F.col(word), i, F.lit(2))))))

    long = twos(left.join(many, "na"), "a", "na").join(twos(right.join(many, "nb"), "b", "nb"), ["na", "nb", "two"])
    near = short.select("a", "b", "na", "nb").union(long.select("a", "b", "na", "nb")).where("a <> b").select("a", "b", total.alias("n")).distinct()
    prefix = F.col("a").startswith(F.col("b")) | F.col("b").startswith(F.col("a"))
    near = near.where(prefix | (s.ratio_bound(F.col("a"), F.col("b"), F.col("n")) > s.LEAST))
    return near.select("a", "b", s.word_similarity("a", "b").alias("similarity")).where(F.col("similarity") > s.LEAST)


def attached(facts: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """``facts`` (key, _q) with ``near`` in _q, the similar words of each of its words,
    ``similar``, all of these, and ``similar_first``, those of the first word."""
    each = facts.select(key, F.posexplode("_q.words").alias("at", "a"))
    lists = words.groupBy("a").agg(F.array_sort(F.collect_list(F.struct(F.col("b").alias("word"), "similarity"))).alias("near"))
    found = each.join(lists, "a").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "near"))).alias("_near"))
    none = F.array().cast("array<struct<word:string,similarity:double>>")
    near = F.transform(F.col("_q.words"), lambda w, at: F.coalesce(F.try_element_at(F.col("_near"), at), none))
    q = facts.join(found, key, "left").select(key, F.col("_q").withField("near", near).alias("_q"))
    similar, first = F.array_distinct(F.flatten("_q.near")["word"]), F.coalesce(F.get("_q.near", 0), none)["word"]
    return q.select(key, F.col("_q").withField("similar", similar).withField("similar_first", first).alias("_q"))


def facts(queries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts ``_q`` of each row of ``queries`` (key, name) and ``_c`` of each row of
    ``names`` (key, name), the former with the similar words of the latter; written."""
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, known = (df.repartition(tasks).select(df.columns[0], s.name_facts(F.col(df.columns[1])).alias(as_)) for df, as_ in ((queries, "_q"), (names, "_c")))
    asked = written(asked, "facts")
    words = pairs(asked.select(F.explode("_q.words").alias("word")), known.select(F.explode("_c.words").alias("word")))
    return written(attached(asked, queries.columns[0], words), "asked_facts"), written(known, "known_facts")


def scored_names(rows: DataFrame, query: str, entry: str, w_jaccard: float = 0.7, w_sequence: float = 0.3) -> DataFrame:
    """``rows`` with the pair score of the columns ``query`` and ``entry``."""
    own = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (query, entry)]
    asked, known = facts(*(rows.select(x.alias(k), x.alias("_name")).distinct() for x, k in zip(own, ("_qk", "_ck"), strict=True)))
    both = rows.withColumn("_qk", own[0]).withColumn("_ck", own[1]).join(asked, "_qk").join(known, "_ck")
    return s.with_score(both, w_jaccard, w_sequence).drop("_q", "_c", "_qk", "_ck")
