"""The best candidates by shared tokens, without all pairs of a common token.

Every name is a set of tokens in one global order of rarity (how many entries hold
a token, then the token). If two sets share at least o tokens, the first one they
share has o - 1 tokens of the order behind it on both sides. So a pair is formed on
a token only if the token stands in the first n - o + 1 places of both sets, the
prefix that the overlap demands; a token that nearly all names hold stands last
and is in the prefix of few.

The overlap that a query demands follows from the score of its last wanted
candidate. A first lower bound comes from a bounded number of entries of each of its
tokens, the shortest names by idx; queries whose entries these are all are done. An
entry that is not among these and shares one token only is never wanted: all those
before it share that token too and are no longer. So the others have an overlap of
two or more, and the threshold gives, for every length of a name, the least overlap
of a pair that reaches it, and with it the prefixes.

How many entries share any token with a query is counted without pairs: a token's
entries are bitmaps, and a query's count is that of their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources.shared import written


def document_frequency(index: DataFrame) -> DataFrame:
    """token, df: how many entries of ``index`` (idx, tokens) hold it."""
    return index.select("idx", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def by_rarity(rows: DataFrame, key: str, tokens: str, df: DataFrame) -> DataFrame:
    """key, t: the distinct tokens as structs (df, token), the rarest first."""
    each = rows.select(key, F.explode(F.array_distinct(tokens)).alias("token")).join(df, "token", "left")
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("t"))


def postings_of(entries: DataFrame) -> DataFrame:
    """token, idx, n_c, pc (place in the entry's order), df of (idx, t)."""
    each = entries.select("idx", F.size("t").alias("n_c"), F.posexplode("t").alias("pc", "_t"))
    return each.select(F.col("_t.token").alias("token"), "idx", "n_c", "pc", F.col("_t.df").alias("df"))


def compared(pairs: DataFrame, asked: DataFrame, entries: DataFrame) -> DataFrame:
    """q_id, idx, overlap, fast_jaccard, branded of distinct pairs (q_id, idx)."""
    both = pairs.join(asked.select("q_id", "brand", F.col("t.token").alias("_q")), "q_id").join(entries.select("idx", F.col("t.token").alias("_c")), "idx")
    both = both.withColumn("overlap", F.size(F.array_intersect("_q", "_c")).cast("long"))
    jaccard = F.col("overlap") / (F.size("_q") + F.size("_c") - F.col("overlap"))
    return both.select("q_id", "idx", "overlap", jaccard.alias("fast_jaccard"), F.coalesce(F.array_contains("_c", F.col("brand")), F.lit(False)).alias("branded"))


def sharing(queries: DataFrame, index: DataFrame, least: Column) -> DataFrame:
    """q_id, idx, overlap, fast_jaccard, branded of all pairs that share at least
    ``least`` tokens, a column of ``queries`` (q_id, q_tokens, brand) of 1 or more."""
    df = document_frequency(index)
    entries = written(by_rarity(index, "idx", "tokens", df), "entries")
    asked = written(queries.select("q_id", "brand", least.alias("need")).join(by_rarity(queries, "q_id", "q_tokens", df), "q_id"), "asked")
    each = asked.select("q_id", "need", F.size("t").alias("n_q"), F.posexplode("t").alias("pq", "_t")).where("pq <= n_q - need").select("q_id", "need", F.col("_t.token").alias("token"))
    pairs = each.join(postings_of(entries), "token").where("pc <= n_c - need").select("q_id", "idx").distinct()
    return compared(pairs, asked, entries).join(asked.select("q_id", "need"), "q_id").where("overlap >= need").drop("need")


def union_sizes(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """q_id, candidate_count: how many entries share a token with each query."""
    bits = postings_of(entries).join(entries.select("idx", F.monotonically_increasing_id().alias("_n")), "idx")
    bits = bits.groupBy("token", F.bitmap_bucket_number("_n").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits"))
    # counted once a distinct set of known tokens
    sets = asked.select("q_id", F.filter("t", lambda x: x["df"] > 0)["token"].alias("_set"))
    one = written(sets.groupBy("_set").agg(F.min("q_id").alias("_rep")), "token_sets")
    each = one.select("_rep", F.explode("_set").alias("token")).join(bits, "token")
    count = each.groupBy("_rep", "_b").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_k")).groupBy("_rep").agg(F.sum("_k").alias("candidate_count"))
    return sets.join(one.join(count, "_rep"), "_set").select("q_id", "candidate_count")


def top_by_tokens(queries: DataFrame, index: DataFrame, budget: int) -> DataFrame:
    """q_id, idx, bucket, overlap, fast_jaccard, candidate_count of up to ``budget``
    entries a query: those with its brand token by idx (bucket 0), then the best of
    the others that share a token by Jaccard and idx (bucket 1).

    ``queries``: (q_id, q_tokens, brand), one row a query; ``index``: (idx, tokens)."""
    df = document_frequency(index)
    entries = written(by_rarity(index, "idx", "tokens", df), "entries")
    postings = written(postings_of(entries), "postings")
    asked = queries.select("q_id", "brand").join(by_rarity(queries, "q_id", "q_tokens", df), "q_id")
    n_brand = F.coalesce(F.get(F.filter("t", lambda x: x["token"] == F.col("brand")), 0)["df"], F.lit(0))
    reach = 2 * budget  # of which fewer than ``budget`` hold the brand token, where others are wanted
    asked = asked.withColumn("want", F.lit(budget) - F.least(n_brand, F.lit(budget))).withColumn("whole", ~F.exists("t", lambda x: x["df"] > reach))
    asked = written(asked, "asked")

    def best_of(pairs: DataFrame) -> DataFrame:
        kept = pairs.withColumn("bucket", F.when(F.col("branded"), 0).otherwise(1))
        own = Window.partitionBy("q_id").orderBy("bucket", F.when(F.col("bucket") == 1, -F.col("fast_jaccard")).otherwise(0.0), "idx")
        return kept.withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= budget)

    # queries of rare tokens only: their few pairs are all counted
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few queries make many pairs
    each = asked.where("whole").repartition(tasks, "q_id").select("q_id", "brand", F.size("t").alias("n_q"), F.explode("t.token").alias("token"))
    counted = each.join(postings.select("token", "idx", "n_c"), "token").groupBy("q_id", "idx").agg(
        F.count("*").alias("overlap"), F.max("n_q").alias("n_q"), F.max("n_c").alias("n_c"), F.max(F.coalesce(F.col("token") == F.col("brand"), F.lit(False))).alias("branded"))
    jaccard = F.col("overlap") / (F.col("n_q") + F.col("n_c") - F.col("overlap"))
    rare = best_of(counted.select("q_id", "idx", "overlap", jaccard.alias("fast_jaccard"), "branded"))

    # the others: entries with the brand token, the first by idx of each token that is a brand
    open_ = asked.where("NOT whole")
    brands = open_.where("brand IS NOT NULL").select(F.col("brand").alias("token")).distinct()
    low = Window.partitionBy("token").orderBy("idx")
    of_brand = postings.join(brands, "token", "left_semi").withColumn("_rn", F.row_number().over(low)).where(F.col("_rn") <= budget)
    branded = open_.select("q_id", F.col("brand").alias("token")).join(of_brand.select("token", "idx"), "token").select("q_id", "idx")

    # a bounded look at each token's entries gives the threshold
    short = Window.partitionBy("token").orderBy("n_c", "idx")
    nearest = postings.withColumn("_rn", F.row_number().over(short)).where(F.col("_rn") <= reach).select("token", "idx")
    looked = open_.where("want > 0").select("q_id", F.explode("t.token").alias("token")).join(nearest, "token").select("q_id", "idx")
    seen = written(compared(branded.union(looked).distinct(), asked, entries), "seen")
    best = Window.partitionBy("q_id").orderBy(F.desc("fast_jaccard"), "idx")
    ranked = seen.where("NOT branded").withColumn("_rn", F.row_number().over(best)).join(open_.select("q_id", "want"), "q_id")
    least = ranked.where("_rn = want").select("q_id", F.col("fast_jaccard").alias("least"))

    # and the threshold the prefixes of whatever else can be among the best
    sought = open_.where("want > 0").join(least, "q_id", "left").select("q_id", "t", F.size("t").alias("n_q"), F.coalesce("least", F.lit(0.0)).alias("least"))
    longest = entries.agg(F.max(F.size("t"))).first()[0] or 0
    lo, hi = F.greatest(F.ceil(F.col("least") * F.col("n_q") - 1e-9), F.lit(1)), F.least(F.when(F.col("least") > 0, F.floor(F.col("n_q") / F.col("least") + 1e-9)).otherwise(longest), F.lit(longest))
    sized = sought.where(lo <= hi).withColumn("n_c", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    need = F.greatest(F.ceil(F.col("least") * (F.col("n_q") + F.col("n_c")) / (1 + F.col("least")) - 1e-9), F.lit(2)).cast("int")
    each = sized.withColumn("need", need).select("q_id", "n_c", "n_q", "need", F.posexplode("t").alias("pq", "_t")).where("pq <= n_q - need").select("q_id", "n_c", "need", F.col("_t.token").alias("token"))
    found = each.join(postings.select("token", "n_c", "pc", "idx"), ["token", "n_c"]).where("pc <= n_c - need").select("q_id", "idx").distinct()
    fresh = compared(found.join(seen.select("q_id", "idx"), ["q_id", "idx"], "left_anti"), asked, entries)
    kept = rare.unionByName(best_of(seen.union(fresh)))
    return kept.join(union_sizes(asked, entries), "q_id").select("q_id", "idx", "bucket", "overlap", "fast_jaccard", "candidate_count")
