"""Linking sheet rows to catalog entries: exact keys, then token blocking, a
bounded number of candidates, an explained score and the best k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import dictionaries as d
from linkloom.functions import similarity as s
from linkloom.functions import text as t
from linkloom.functions.phrases import phrase_table, replaced
from linkloom.operators import prefix_index, similar_words
from linkloom.sources.shared import written

BUDGET = 200


def catalog_index(catalog: DataFrame, name: str, order: str) -> DataFrame:
    """``catalog`` with ``idx`` (the numeric key ``order``, which ranks entries as
    well as a dense number would), ``normalized`` and ``tokens``."""
    return catalog.withColumn("idx", F.col(order).cast("long")).withColumn("normalized", F.col(name)).withColumn("tokens", F.array_distinct(t.tokens(F.col(name))))


def explode_variants(products: DataFrame, variants: str = "product_variants") -> DataFrame:
    """One row a variant; the variant's name, price and sku first, the product's
    where they are absent. Products without variants stay one row."""
    v = F.col("_v")
    flat = products.withColumn("_v", F.explode_outer(variants))
    pick = {"title_en": ("name_en", t.first_present), "title_ar": ("name_ar", t.first_present), "price": ("price", t.first_nonzero)}
    out = flat
    for column, (field, rule) in pick.items():
        if column in products.columns:
            out = out.withColumn(column, rule(v[field], F.col(column)))
    return out.withColumn("variant_id", v["id"]).withColumn("sku", v["sku"]).withColumn("stock", F.when(F.coalesce(v["in_stock"], F.col("in_stock")), 10).otherwise(0)).drop("_v")


def last_by_key(catalog: DataFrame, key: Column, order: str = "idx") -> DataFrame:
    """_key, hit: one row a non-empty key, of repeated keys the last by ``order``."""
    row = F.struct(*[F.col(f"`{c}`") for c in catalog.columns])
    return catalog.withColumn("_key", t.lookup_key(key)).where("_key <> ''").groupBy("_key").agg(F.max_by(row, order).alias("hit"))


def exact_lookup(sheet: DataFrame, key: Column, catalog: DataFrame, catalog_key: Column, order: str = "idx") -> DataFrame:
    """``sheet`` with the struct ``hit`` of the catalog row of the same key."""
    return sheet.withColumn("_sheet_key", t.lookup_key(key)).join(last_by_key(catalog, catalog_key, order), F.col("_sheet_key") == F.col("_key"), "left").drop("_key", "_sheet_key")


def skipped(name: Column) -> Column:
    """Names that are not matched at all."""
    return F.lower(name).rlike("|".join(p.replace(" ", r"\x20") for p in d.SKIP))


def brand_token(tokens: Column) -> Column:
    """The first token with a letter that is not of low weight."""
    return F.get(F.filter(tokens, lambda x: x.rlike(r"[a-zA-Z؀-ۿ]") & ~x.isin(*d.LOW_WEIGHT)), 0)


def all_pairs(queries: DataFrame, index: DataFrame) -> DataFrame:
    """q_id, idx, bucket, overlap, fast_jaccard, candidate_count of every entry that
    shares a token with a query: the plain join on tokens, for small tables."""
    terms = index.select("idx", F.size("tokens").alias("n_c"), F.explode("tokens").alias("token"))
    asked = queries.select("q_id", F.size(F.array_distinct("q_tokens")).alias("n_q"), brand_token(F.col("q_tokens")).alias("brand"), F.explode(F.array_distinct("q_tokens")).alias("token"))
    pairs = asked.join(terms, "token").groupBy("q_id", "idx").agg(F.count("*").alias("overlap"), F.first("n_q").alias("n_q"), F.first("n_c").alias("n_c"), F.max(F.col("token") == F.col("brand")).alias("branded"))
    pairs = pairs.withColumn("bucket", F.when(F.coalesce("branded", F.lit(False)), 0).otherwise(1)).withColumn("fast_jaccard", F.col("overlap") / (F.col("n_q") + F.col("n_c") - F.col("overlap")))
    return pairs.withColumn("candidate_count", F.count("*").over(Window.partitionBy("q_id"))).select("q_id", "idx", "bucket", "overlap", "fast_jaccard", "candidate_count")


def token_candidates(queries: DataFrame, index: DataFrame, budget: int = BUDGET) -> DataFrame:
    """q_id, idx, bucket, overlap, fast_jaccard, candidate_count.

    ``queries``: (q_id, q_tokens), one row a distinct name; ``index``: (idx,
    tokens). Entries with the query's brand token come first (bucket 0, by idx), the
    rest of the budget goes to the best by token Jaccard (bucket 1). No pair is formed
    on a common token unless it can be among these (see ``prefix_index``)."""
    return prefix_index.top_by_tokens(queries.select("q_id", "q_tokens", brand_token(F.col("q_tokens")).alias("brand")), index, budget)


def facts_of(queries: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of the names of both sides (q_id, _q and idx, _c), worked out once."""
    return similar_words.facts(queries.select("q_id", "q_name"), index.select("idx", "normalized"))


def scored(candidates: DataFrame, queries: DataFrame, index: DataFrame, facts: tuple[DataFrame, DataFrame] | None = None, w_jaccard: float = 0.7, w_sequence: float = 0.3) -> DataFrame:
    """``candidates`` with the fields of the pair score."""
    asked, known = facts or facts_of(queries, index)
    full = candidates.join(asked, "q_id").join(known, "idx").withColumn("q_name", F.col("_q.name")).withColumn("normalized", F.col("_c.name"))
    return s.with_score(full, w_jaccard, w_sequence).drop("_q", "_c")


def top_candidates(pairs: DataFrame, k: int = 5, by: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """The best k of each query: by score, then bucket, token Jaccard and idx."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "bucket", F.desc("fast_jaccard"), "idx")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def best_scored(candidates: DataFrame, queries: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """The best k of each query with the fields of the score; the same rows as
    ``top_candidates(scored(...))``. A cheap bound of the score is made for every pair
    and the k pairs of the highest are scored. Of the others only those whose bound
    reaches the least of these scores get a nearer bound, and only those that still
    reach it are scored."""
    facts = facts_of(queries, index)

    # pairs are small rows with much work each: as many tasks as the session names, not as few as their bytes would fill
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def known(pairs: DataFrame) -> DataFrame:
        return pairs.repartition(tasks, "q_id").join(facts[0], "q_id").join(facts[1], "idx")

    first = Window.partitionBy("q_id").orderBy(F.desc("bound"), "idx")
    bounded = s.with_bound(known(candidates)).drop("_q", "_c")
    bounded = written(bounded.withColumn("_first", F.row_number().over(first) <= k), "bounded")
    seeds = written(scored(bounded.where("_first").repartition(tasks, "q_id"), queries, index, facts), "seeds")
    least = seeds.groupBy("q_id").agg(F.min("score").alias("_least"))
    reached = F.col("bound") >= F.col("_least") - 1e-6
    rest = known(bounded.where(~F.col("_first")).join(least, "q_id").where(reached))
    # written before the filter, which would else be worked out beneath the columns it reads
    rest = written(s.with_nearer_bound(rest).drop("_q", "_c"), "nearer").where(reached).drop("_least")
    return top_candidates(seeds.unionByName(scored(rest.repartition(tasks, "q_id"), queries, index, facts)), k).drop("bound", "_first")


def fuzzy_matches(names: DataFrame, index: DataFrame, k: int = 5, matched: float = 0.60, review: float = 0.40, budget: int = BUDGET) -> DataFrame:
    """name, matches (best first) of every distinct name; each is matched once."""
    queries = names.select("name").where("name is not null").distinct().withColumn("q_id", F.xxhash64("name")).withColumn("q_name", F.col("name")).withColumn("q_tokens", t.tokens(F.col("name"))).where((F.size("q_tokens") > 0) & ~skipped(F.col("name")))
    queries = written(queries, "queries")  # read four times below
    best = best_scored(token_candidates(queries, index, budget), queries, index, k)
    match = F.struct("rank", "score", s.status_of(F.col("score"), matched, review).alias("status"), "idx", "normalized", "jaccard", "sequence", "matched", "unmatched_query", "unmatched_catalog", "candidate_count")
    return best.groupBy("q_name").agg(F.array_sort(F.collect_list(match)).alias("matches")).withColumnRenamed("q_name", "name")


def match_cascade(sheet: DataFrame, index: DataFrame, barcode: str | None = None, code: str | None = None, name: str = "normalized_name", **options) -> DataFrame:
    """``sheet`` with matching_method and matches: by barcode, else by code, else
    by name. Rows that a key resolves are never compared by name."""
    exact = F.lit(None).cast("long")
    cur = sheet
    for label, column in (("by_barcode", barcode), ("by_code", code)):
        if column is None or column not in index.columns:
            cur = cur.withColumn(label, exact)
            continue
        hits = last_by_key(index.select("idx", column), F.col(column)).select("_key", F.col("hit.idx").alias(label))
        cur = cur.withColumn("_k", t.lookup_key(F.col(column))).join(hits, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")
    cur = cur.withColumn("exact_idx", F.coalesce("by_barcode", "by_code"))
    method = F.when(F.col("by_barcode").isNotNull(), "international barcode").when(F.col("by_code").isNotNull(), "code").when(skipped(F.col(name)), "skipped").otherwise("normalizer")
    fuzzy = fuzzy_matches(cur.where("exact_idx is null").select(F.col(name).alias("name")), index, **options)
    cur = cur.withColumn("matching_method", method).withColumn("_ask", F.when(F.col("exact_idx").isNull(), F.col(name)))
    out = cur.join(fuzzy.withColumnRenamed("name", "_name"), F.col("_ask") == F.col("_name"), "left")
    return out.withColumn("top_score", F.when(F.col("exact_idx").isNotNull(), 1.0).otherwise(F.coalesce(F.col("matches")[0]["score"], F.lit(0.0)))).drop("_ask", "_name", "by_barcode", "by_code")


def match_summary(results: DataFrame, score: str = "top_score", matched: float = 0.60, review: float = 0.40, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by status, share matched and mean score, over all or by group."""
    st = s.status_of(F.col(score), matched, review)
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(st == "matched").alias("matched"), F.count_if(st == "review").alias("review"),
        F.count_if(st == "no_match").alias("no_match"), F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_score"),
    ).withColumn("matched_pct", s.share(F.col("matched"), F.col("total")))


def fuzzy_dictionary(tokens: DataFrame, keys: DataFrame, most: int = 2, share: float = 0.20, least: int = 4) -> DataFrame:
    """token, key, distance: the nearest dictionary key within ``most`` edits and
    ``share`` of the longer length, the first by ``ord`` among equals.

    A key is cut into ``most + 1`` pieces; a token within ``most`` edits of it
    holds one of them unchanged, moved by at most ``most`` places. So the join is
    by equality on (length of the key, number of the piece, piece): no pair is
    lost and no nested loop is planned."""
    parts = most + 1
    begin, end = F.floor(F.col("n") * F.col("i") / parts).cast("int"), F.floor(F.col("n") * (F.col("i") + 1) / parts).cast("int")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(most)))
    right = keys.select("key", "ord", F.length("key").alias("n")).where("n > 0").withColumn("i", numbers).withColumn("p", F.substring(F.col("key"), begin + 1, end - begin))
    left = tokens.select("token").where(F.length("token") >= least).distinct()
    left = left.select("token", F.explode(F.sequence(F.greatest(F.length("token") - most, F.lit(1)), F.length("token") + most)).alias("n")).withColumn("i", numbers)
    left = left.withColumn("_b", F.explode(F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda x: x + begin))).where("_b >= 0")
    left = left.withColumn("p", F.substring(F.col("token"), F.col("_b") + 1, end - begin)).where(F.length("p") == end - begin).select("token", "n", "i", "p").distinct()
    near = left.join(right, ["n", "i", "p"]).select("token", "key", "ord").distinct().withColumn("distance", F.levenshtein("token", "key", most))
    ok = near.where((F.col("distance") >= 0) & (F.col("distance") <= share * F.greatest(F.length("token"), F.length("key"))))
    return ok.groupBy("token").agg(F.min(F.struct("distance", "ord", "key")).alias("b")).select("token", F.col("b.key").alias("key"), F.col("b.distance").alias("distance"))


def map_brands(df: DataFrame, name: str, brands: DataFrame, out: str | None = None) -> DataFrame:
    """``df`` with brands replaced in ``name``: equal phrases first, then each word
    with an Arabic letter that is left by the brand nearest to it (``fuzzy_dictionary``).
    ``brands``: (key, value, ord)."""
    # written, as each table is read several times below
    exact = written(replaced(df, name, written(phrase_table(brands, order="ord"), "brands"), out), "exact")
    words = exact.select(F.explode(F.array_distinct(t.tokens(F.col(f"`{out or name}`")))).alias("token")).where(t.has_arabic(F.col("token"))).distinct()
    known = brands.groupBy("key").agg(F.min("ord").alias("ord"), F.max_by("value", "ord").alias("value"))
    near = fuzzy_dictionary(words, known).join(known.select("key", "value"), "key")
    return replaced(exact, out or name, written(phrase_table(near, "token"), "near"))


def membership(df: DataFrame, column: str, names: DataFrame, name: str, out: str = "exact_in_destination") -> DataFrame:
    """A flag whether ``column`` is among ``names``."""
    known = names.select(F.col(name).alias("_m")).where("_m is not null").distinct().withColumn("_f", F.lit(True))
    return df.join(known, F.col(column) == F.col("_m"), "left").withColumn(out, F.col("_f").isNotNull()).drop("_m", "_f")


def append_new(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` and the rows of ``source`` whose key it lacks."""
    return target.unionByName(source.join(target.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def search(catalog_index_: DataFrame, query: str, k: int = 200, **options) -> DataFrame:
    """Entries for one query text, best first, one row an entry."""
    spark = catalog_index_.sparkSession
    found = fuzzy_matches(spark.createDataFrame([(query,)], "name string"), catalog_index_, k, **options)
    return found.select(F.explode("matches").alias("m")).select("m.*").orderBy("rank")


def reinvestigate(missed: DataFrame, index: DataFrame, least: int = 2, least_score: float = 0.40, k: int = 3, second: str = "title_ar") -> DataFrame:
    """For names without a match: entries that share ``least`` tokens (one for
    names of at most two) and whose sequence ratio, of ``normalized`` or of the
    column ``second`` where the index has it, is above ``least_score``. All are scored."""
    q = missed.select(F.col("name").alias("q_name")).distinct().withColumn("q_id", F.xxhash64("q_name")).withColumn("q_tokens", t.tokens(F.col("q_name")))
    names = ["normalized"] + [c for c in (second,) if c in index.columns]
    asked = q.where(F.size("q_tokens") > 0).withColumn("brand", brand_token(F.col("q_tokens")))
    pairs = prefix_index.sharing(asked, index, F.when(F.size("q_tokens") <= 2, 1).otherwise(least)).withColumn("bucket", F.when(F.col("branded"), 0).otherwise(1))
    pairs = pairs.join(q, "q_id").join(index.select("idx", *names), "idx")
    ratios = [F.coalesce(s.sequence_ratio("q_name", F.coalesce(c, F.lit(""))), F.lit(0.0)) for c in names]
    pairs = pairs.withColumn("score", F.greatest(*ratios) if len(ratios) > 1 else ratios[0]).where(F.col("score") > least_score)
    return top_candidates(pairs, k).select("q_name", "rank", "idx", "normalized", "overlap", "score")
