"""Registered queries: each applies operators of the library to whole driver
tables; ``sql`` is the same result for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.functions import text as t
from linkloom.functions.normalize import Options, normalized
from linkloom.operators import analytics, enrichment, feeds, matching, pages, results, tables
from linkloom.plans import linking
from linkloom.sources import sheets
from linkloom.sources.shared import new_path, written
from linkloom.streaming import matching as stream
from linkloom.streaming.counters import Counters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct catalog names of ``part`` with the least key as idx."""
    return table(spark, sf, "part").groupBy(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name")).agg(F.min("p_partkey").alias("idx"))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return matching.catalog_index(_names(spark, sf), "name", "idx")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct sheet names: brand, then name, of every part."""
    q = table(spark, sf, "part").select(F.lower(F.concat_ws(" ", "p_name", F.regexp_replace("p_brand", "#", " "))).alias("q_name")).distinct()
    return q.withColumn("q_id", F.xxhash64("q_name")).withColumn("q_tokens", t.tokens(F.col("q_name")))


# matching


@query()
def match_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: a noisy sheet over every part against the catalog of distinct
    names: normalise, block, score, rank, classify."""
    part = table(spark, sf, "part")
    noisy = F.concat_ws(" ", F.upper("p_name"), F.concat(F.col("p_size").cast("string"), F.lit("MG")), F.initcap("p_type"), F.lit("x10P"))
    sheet = part.select(F.col("p_partkey").alias("row_index"), noisy.alias("name"), F.concat(F.col("p_partkey").cast("string"), F.lit(".0")).alias("code"))
    catalog = _names(spark, sf).withColumn("title", F.concat_ws(" ", "name", F.lit("mg"))).withColumn("code", F.when(F.col("idx") % 5 == 0, F.col("idx").cast("string")))
    out = linking.match_sheet(sheet, catalog, "title", "idx")
    return out.select("row_index", "normalized_name", "matching_method", F.round("top_score", 6).alias("top_score"), s.status_of(F.col("top_score")).alias("status"), F.size("matches").alias("n_matches"), results.top("idx").alias("best_idx"))


@query()
def match_export(spark: SparkSession, sf: str) -> DataFrame:
    """The matched sheet with candidates and catalog fields."""
    part = table(spark, sf, "part")
    sheet = part.select(F.col("p_partkey").alias("row_index"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    catalog = _names(spark, sf).withColumn("title", F.col("name"))
    return linking.export_sheet(linking.match_sheet(sheet, catalog, "title", "idx"), catalog, "idx", {"name[en]": "title"})


@query()
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = _asked(spark, sf).select(F.col("q_name").alias("name"))
    return linking.coverage(rows, _index(spark, sf), "name")[1]


@query("""
WITH n AS (SELECT lower(p_name || ' ' || p_type) AS name, min(p_partkey) idx FROM part GROUP BY 1),
c AS (SELECT idx, list_distinct(string_split(name, ' ')) tk FROM n),
q AS (SELECT DISTINCT lower(p_name || ' ' || replace(p_brand, '#', ' ')) q FROM part),
qt AS (SELECT q, list_distinct(string_split(q, ' ')) tk, string_split(q, ' ')[1] brand FROM q),
p AS (SELECT q, idx, len(list_intersect(qt.tk, c.tk)) o, len(qt.tk) nq, len(c.tk) nc, list_contains(c.tk, brand) b FROM qt, c),
s AS (SELECT q AS name, idx, o AS overlap, CASE WHEN b THEN 0 ELSE 1 END AS bucket, o::DOUBLE / (nq + nc - o) AS jac, count(*) OVER (PARTITION BY q) AS candidate_count FROM p WHERE o > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY bucket, CASE WHEN bucket = 1 THEN -jac ELSE 0.0 END, idx) rn FROM s)
SELECT name, idx, bucket, overlap, round(jac, 9) AS fast_jaccard, candidate_count FROM r WHERE rn <= 40""")
def token_blocking(spark: SparkSession, sf: str) -> DataFrame:
    q = _asked(spark, sf)
    got = matching.token_candidates(q, _index(spark, sf), budget=40).join(q.select("q_id", "q_name"), "q_id")
    return got.select(F.col("q_name").alias("name"), "idx", "bucket", "overlap", F.round("fast_jaccard", 9).alias("fast_jaccard"), "candidate_count")


@query("""
WITH n AS (SELECT lower(p_name || ' ' || p_type) AS name, min(p_partkey) idx FROM part GROUP BY 1),
c AS (SELECT idx, list_distinct(string_split(name, ' ')) tk FROM n),
q AS (SELECT q, list_distinct(string_split(q, ' ')) tk FROM (SELECT DISTINCT lower(p_name || ' ' || replace(p_brand, '#', ' ')) q FROM part)),
p AS (SELECT q, idx, len(list_intersect(q.tk, c.tk)) o, len(q.tk) + len(c.tk) n FROM q, c),
r AS (SELECT q AS name, idx, o::DOUBLE / (n - o) j, row_number() OVER (PARTITION BY q ORDER BY o::DOUBLE / (n - o) DESC, idx) AS rn FROM p WHERE o > 0)
SELECT name, rn::INTEGER AS rank, idx, round(j, 9) AS score FROM r WHERE rn <= 5""")
def top_by_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    q = _asked(spark, sf)
    pairs = matching.token_candidates(q, _index(spark, sf), budget=1_000_000).withColumn("score", F.col("fast_jaccard")).withColumn("bucket", F.lit(0))
    return matching.top_candidates(pairs, 5).join(q.select("q_id", "q_name"), "q_id").select(F.col("q_name").alias("name"), "rank", "idx", F.round("score", 9).alias("score"))


@query("""
WITH c AS (SELECT (c_custkey // 2)::VARCHAR AS k, max_by(c_name, c_custkey) AS hit_name, max(c_custkey) hit_key FROM customer GROUP BY 1)
SELECT o_orderkey, hit_key, hit_name FROM orders LEFT JOIN c ON (o_custkey // 2)::VARCHAR = k""")
def exact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Keys as sheets have them (``12.0``) against repeated catalog codes: the
    last catalog row of a code wins."""
    sheet = table(spark, sf, "orders").select("o_orderkey", F.concat(F.floor(F.col("o_custkey") / 2).cast("string"), F.lit(".0")).alias("code"))
    catalog = table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), "c_name", F.concat(F.lit(" "), F.floor(F.col("c_custkey") / 2).cast("string")).alias("code"))
    return matching.exact_lookup(sheet, F.col("code"), catalog, F.col("code")).select("o_orderkey", F.col("hit.idx").alias("hit_key"), F.col("hit.c_name").alias("hit_name"))


@query("""
WITH k AS (SELECT word AS k, min(item_id) o FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) word FROM benchmark) WHERE length(word) >= 4 GROUP BY 1),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) tk FROM conversations),
p AS (SELECT tk, k, o, levenshtein(tk, k) dist FROM w, k WHERE length(tk) >= 4 AND abs(length(tk) - length(k)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY tk ORDER BY dist, o, k) rn FROM p WHERE dist <= 2 AND dist <= 0.2 * greatest(length(tk), length(k)))
SELECT tk AS token, k AS key, dist::INTEGER AS distance FROM r WHERE rn = 1""")
def fuzzy_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    def split(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*more, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))

    keys = split(table(spark, sf, "benchmark"), "item_id").where(F.length("token") >= 4).groupBy(F.col("token").alias("key")).agg(F.min("item_id").alias("ord"))
    return matching.fuzzy_dictionary(split(table(spark, sf, "conversations")), keys)


@query("""
SELECT o_orderkey, lower(o_orderpriority) IN (SELECT lower(o_orderpriority) FROM orders WHERE o_orderstatus = 'P') AS exact_in_destination FROM orders""")
def membership_flag(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("n", F.lower("o_orderpriority"))
    return matching.membership(o, "n", o.where("o_orderstatus = 'P'"), "n").select("o_orderkey", "exact_in_destination")


# functions


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[*|+/\-_\\(){}\[\]"''&]', ' ', 'g'), '\s+', ' ', 'g'))) AS cleaned FROM documents""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(t.clean(F.col("text"))).alias("cleaned"))


@query("""
WITH w AS (SELECT p_partkey, p_size, list_filter(string_split(lower(p_name), ' '), lambda x: x NOT IN ('large', 'small', 'medium')) AS name, list_filter(string_split(lower(p_name), ' '), lambda x: x IN ('large', 'small', 'medium')) AS form FROM part)
SELECT p_partkey, array_to_string(list_concat(name, [CASE WHEN p_size <= 5 THEN (p_size * 1000)::VARCHAR || ' mg' ELSE p_size::VARCHAR || ' gm' END], form, ['tab']), ' ') AS normalized_name FROM w""")
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    """``*COLD WIDGET 3GM TABS.`` to name, dose, forms; grams up to 5 are mg."""
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("*"), F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("GM TABS.")).alias("n"))
    return normalized(part, "n").select("p_partkey", "normalized_name")


@query("""
WITH c AS (SELECT o_orderkey, lpad((o_orderkey * 97)::VARCHAR, 13, '4') AS code FROM orders),
d AS (SELECT o_orderkey, code, list_sum(list_transform(range(1, 13), lambda i: code[i]::INTEGER * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) s FROM c)
SELECT o_orderkey, code, (10 - s % 10) % 10 = code[13]::INTEGER AS valid FROM d""")
def gtin_check(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 97).cast("string"), 13, "4").alias("code"))
    return o.withColumn("valid", t.valid_gtin(F.col("code")))


@query(r"""
SELECT o_orderkey, o_totalprice AS price, (o_custkey % 40)::INTEGER AS stock, o_custkey::VARCHAR AS key FROM orders""")
def sheet_cells(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("EGP "), F.format_string("%.2f", "o_totalprice")).alias("p"), F.concat((F.col("o_custkey") % 40).cast("string"), F.lit(" pcs")).alias("n"), F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0 ")).alias("k"))
    return o.select("o_orderkey", t.price_of(F.col("p")).alias("price"), t.stock_of(F.col("n")).alias("stock"), t.lookup_key(F.col("k")).alias("key"))


@query(r"""
SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS domain, count(*) AS n, count(*) FILTER (regexp_matches(url, '\.html$')) AS n_html,
 count(*) FILTER (regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') = 'example.net' OR lower(regexp_extract(url, '://([^/?#]*)', 1)) LIKE '%.example.net') AS n_net
FROM pages GROUP BY 1""")
def page_domains(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("domain", t.domain_of(F.col("url")))
    return p.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(t.basename(F.col("url")).endswith(".html")).alias("n_html"), F.count_if(t.same_domain(F.col("domain"), F.lit("www.example.net"))).alias("n_net"))


@query("""
SELECT p_type AS unit_text, CASE p_size % 4 WHEN 0 THEN 'Tablet' WHEN 1 THEN 'Capsule' WHEN 2 THEN 'Syrup' END AS unit, count(*) AS n FROM part GROUP BY 1, 2""")
def unit_distribution(spark: SparkSession, sf: str) -> DataFrame:
    word = F.element_at(F.array(F.lit("20 tabs"), F.lit("CAPSULES"), F.lit("syrup 100ml"), F.lit("stable captor")), (F.col("p_size") % 4 + 1).cast("int"))
    p = table(spark, sf, "part").select("p_type", t.unit_of(F.col("p_name"), word).alias("unit"))
    return p.groupBy(F.col("p_type").alias("unit_text"), "unit").agg(F.count("*").alias("n"))


# results and audits

_SCORED = "SELECT doc_id, coalesce(quality, 0) * 0.5 + coalesce(toxic, 0) * 0.3 + (doc_id % 5) * 0.05 AS score FROM labels"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", (F.coalesce("quality", F.lit(0)) * 0.5 + F.coalesce("toxic", F.lit(0)) * 0.3 + (F.col("doc_id") % 5) * 0.05).alias("score"))


def _status(score: str = "score") -> str:
    return f"CASE WHEN {score} >= 0.6 THEN 'matched' WHEN {score} >= 0.4 THEN 'review' ELSE 'no_match' END"


@query(f"""
WITH r AS (SELECT d.source, s.score, {_status('s.score')} st FROM ({_SCORED}) s JOIN documents d USING (doc_id))
SELECT source, count(*) AS total, count(*) FILTER (st = 'matched') AS matched, count(*) FILTER (st = 'review') AS review, count(*) FILTER (st = 'no_match') AS no_match,
 round(avg(score), 6) AS avg_score, round(count(*) FILTER (st = 'matched') / count(*) * 100, 1) AS matched_pct FROM r GROUP BY source""")
def match_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = _scored(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return matching.match_summary(r, "score", by=("source",)).withColumn("avg_score", F.round("avg_score", 6))


@query(f"""
WITH r AS (SELECT doc_id, score, CASE WHEN score >= 0.6 THEN 0 WHEN score >= 0.4 THEN 1 WHEN score >= 0.2 THEN 2 END AS band FROM ({_SCORED})),
n AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score DESC, doc_id) AS rn FROM r WHERE band IS NOT NULL)
SELECT doc_id, round(score, 6) AS score, band, rn::INTEGER AS rn FROM n WHERE rn <= 20""")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.score_bands(_scored(spark, sf), "score", "doc_id", [(0.6, 2.0), (0.4, 0.6), (0.2, 0.4)]).select("doc_id", F.round("score", 6).alias("score"), "band", "rn")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 'matched' WHEN l_quantity > 15 THEN 'review' ELSE 'no_match' END st FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * (1 + l_tax) > 30 THEN 'matched' WHEN l_quantity * (1 - l_discount) > 15 THEN 'review' ELSE 'no_match' END st FROM lineitem)
SELECT a.st AS before, b.st AS after, count(*) AS n FROM a JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1, 2""")
def run_transitions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")

    def run(high, low) -> DataFrame:
        return li.select("l_orderkey", "l_linenumber", F.when(high > 30, "matched").when(low > 15, "review").otherwise("no_match").alias("status"))

    q = F.col("l_quantity")
    return analytics.run_transitions(run(q, q), run(q * (1 + F.col("l_tax")), q * (1 - F.col("l_discount"))), ["l_orderkey", "l_linenumber"], "status")


@query("""
SELECT l_linestatus AS run, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1""")
def status_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.status_by_run(table(spark, sf, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"]).withColumnRenamed("l_linestatus", "run")


@query(r"""
WITH p AS (SELECT p_partkey, p_name || ' ' || p_size::VARCHAR || ' mg' a, p_name || ' ' || (p_size + p_partkey % 3)::VARCHAR || ' mg' b FROM part)
SELECT p_partkey, a, b FROM p WHERE len(list_intersect(regexp_extract_all(a, '\d+(?:\.\d+)?'), regexp_extract_all(b, '\d+(?:\.\d+)?'))) = 0""")
def numeric_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("mg")).alias("a"), F.concat_ws(" ", "p_name", (F.col("p_size") + F.col("p_partkey") % 3).cast("string"), F.lit("mg")).alias("b"))
    return analytics.numeric_mismatch(p, "a", "b")


@query(f"""
SELECT doc_id, round(score, 6) AS score, {_status()} AS status FROM ({_SCORED}) ORDER BY CASE {_status()} WHEN 'matched' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, doc_id LIMIT 50 OFFSET 20""")
def status_page(spark: SparkSession, sf: str) -> DataFrame:
    """Second page of results, by status then row: a page is the feature."""
    r = _scored(spark, sf).withColumn("status", s.status_of(F.col("score")))
    return tables.page(r, [results.status_rank(F.col("status")), "doc_id"], 20, 50).select("doc_id", F.round("score", 6).alias("score"), "status")


# enrichment

_ENRICH = """
SELECT p_partkey AS row_index, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (s_suppkey * 11)::VARCHAR END AS sheet_barcode,
 CASE WHEN p_size > 40 THEN NULL WHEN p_size > 20 THEN (s_suppkey * 11)::VARCHAR ELSE (s_suppkey * 13)::VARCHAR END AS db_barcode, p_size / 50.0 AS score, s_suppkey
FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)"""
_ENRICHED = f"""
SELECT *, CASE WHEN sheet_barcode IS NULL THEN 'review' WHEN score < 0.4 THEN 'no_match' WHEN score < 0.6 THEN 'review' WHEN db_barcode IS NULL THEN 'matched'
  WHEN db_barcode = sheet_barcode THEN 'already_synced' ELSE 'review' END AS st,
 CASE WHEN sheet_barcode IS NULL THEN 'missing_sheet_barcode' WHEN score < 0.4 THEN NULL WHEN score < 0.6 THEN 'low_confidence' WHEN db_barcode IS NULL THEN NULL
  WHEN db_barcode = sheet_barcode THEN NULL ELSE 'barcode_conflict' END AS why FROM ({_ENRICH})"""


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    sup = table(spark, sf, "supplier")
    n = sup.agg(F.count("*").alias("n")).scalar()
    part = table(spark, sf, "part").withColumn("_s", F.col("p_partkey") % n)
    j = part.join(sup, F.col("_s") == F.col("s_suppkey"))
    code, other = (F.col("s_suppkey") * 11).cast("string"), (F.col("s_suppkey") * 13).cast("string")
    rows = j.select(F.col("p_partkey").alias("row_index"), F.when(F.col("p_partkey") % 7 != 0, code).alias("sheet_barcode"), F.when(F.col("p_size") > 40, None).when(F.col("p_size") > 20, code).otherwise(other).alias("db_barcode"), (F.col("p_size") / 50.0).alias("top_score"), "s_suppkey")
    return enrichment.enrich(rows, "sheet_barcode", "db_barcode")


@query(f"SELECT row_index, st AS enrichment_status, why AS review_reason FROM ({_ENRICHED})")
def enrichment_status(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("row_index", "enrichment_status", "review_reason")


@query(f"""
SELECT count(*) FILTER (st = 'matched') AS matched, count(*) FILTER (st = 'review') AS review, count(*) FILTER (st = 'no_match') AS no_match, count(*) FILTER (st = 'already_synced') AS already_synced,
 count(*) FILTER (st = 'already_synced') AS applied, count(*) FILTER (st = 'matched') AS pending_apply FROM ({_ENRICHED})""")
def enrichment_counts(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.recount(_enriched(spark, sf))


@query(f"""
WITH e AS ({_ENRICHED}), m AS (SELECT s_suppkey, min_by(sheet_barcode, row_index) code FROM e WHERE st = 'matched' GROUP BY 1)
SELECT s.s_suppkey AS s_suppkey, coalesce(code, s_name) AS s_name FROM supplier s LEFT JOIN m ON s.s_suppkey = m.s_suppkey""")
def enrichment_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Matched codes written to the live table (here: over the supplier's name)."""
    live, _ = enrichment.apply_matched(_enriched(spark, sf), table(spark, sf, "supplier"), "s_suppkey", "s_name", "sheet_barcode")
    return live.select("s_suppkey", "s_name")


@query("""
WITH p AS (SELECT s_suppkey k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Brand#' || s_nationkey::VARCHAR END b, s_acctbal v FROM supplier)
SELECT p_partkey, coalesce(b, p_brand) AS p_brand, coalesce(v, p_retailprice) AS p_retailprice,
 CASE WHEN k IS NULL THEN 'not_in_lookup' WHEN coalesce(b <> p_brand, false) OR coalesce(v <> p_retailprice, false) THEN 'updated' ELSE 'already_set' END AS outcome
FROM part LEFT JOIN p ON k = p_partkey""")
def catalog_patch(spark: SparkSession, sf: str) -> DataFrame:
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string"))).alias("p_brand"), F.col("s_acctbal").alias("p_retailprice"))
    return tables.patch_columns(table(spark, sf, "part"), sup, "p_partkey", ["p_brand", "p_retailprice"]).select("p_partkey", "p_brand", "p_retailprice", "outcome")


@query("""
WITH r AS (SELECT user_id, event_type, value / 500.0 AS v, event_id, (event_id % 3)::INTEGER pr FROM events WHERE value IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (v >= 0.6) DESC, CASE WHEN v >= 0.6 THEN 0 ELSE -v END, pr, event_id) rn FROM r)
SELECT user_id, event_id, round(v, 9) AS score, CASE WHEN v >= 0.6 THEN 'found' WHEN v >= 0.4 THEN 'review' ELSE 'not_found' END AS discovery_status FROM f WHERE rn = 1""")
def best_source(spark: SparkSession, sf: str) -> DataFrame:
    """The first hit at or above the threshold by source priority, else the best."""
    hits = table(spark, sf, "events").where("value is not null").select("user_id", "event_id", (F.col("value") / 500.0).alias("score"), (F.col("event_id") % 3).alias("priority"))
    return enrichment.best_source(hits, "user_id", "score", ["priority", "event_id"]).select("user_id", "event_id", F.round("score", 9).alias("score"), "discovery_status")


# tables


@query("""
SELECT user_id, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type, min(event_id) AS place FROM events GROUP BY user_id""")
def first_and_last(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    first = tables.first_by(ev, "user_id", "event_id").select("user_id", F.col("event_type").alias("first_type"))
    return tables.last_in_first_place(ev, "user_id", "event_id").select("user_id", F.col("event_type").alias("last_type"), "place").join(first, "user_id")


@query("""
WITH n AS (SELECT user_id k, max_by(event_type, event_id) v FROM events GROUP BY 1)
SELECT c_custkey, coalesce(v, c_name) AS c_name FROM customer LEFT JOIN n ON k = c_custkey UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_name"), "event_id")
    return tables.upsert(table(spark, sf, "customer").select("c_custkey", "c_name"), ev, "c_custkey", "event_id")


@query("""
WITH a AS (SELECT DISTINCT o_orderkey k FROM orders), b AS (SELECT DISTINCT l_orderkey k FROM lineitem)
SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS n_new, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS n_discontinued, (SELECT count(*) FROM a JOIN b USING (k)) AS n_up_to_date""")
def key_delta(spark: SparkSession, sf: str) -> DataFrame:
    return tables.key_delta(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("""
SELECT k, CASE WHEN a IS NULL THEN 'right_only' WHEN b IS NULL THEN 'left_only' ELSE 'both' END AS side FROM
(SELECT DISTINCT c_custkey k, 1 a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey k, 1 b FROM orders) USING (k)""")
def reconciled_keys(spark: SparkSession, sf: str) -> DataFrame:
    return tables.reconcile(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""
SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer)""")
def append_new_names(spark: SparkSession, sf: str) -> DataFrame:
    return matching.append_new(table(spark, sf, "customer").select(F.col("c_name").alias("name")), table(spark, sf, "supplier").select(F.col("s_name").alias("name")), "name")


@query("""
WITH ar AS (SELECT s_nationkey k, max_by(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END, s_suppkey) n FROM supplier GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(nullif(n, ''), n_name) AS n_name_ar FROM nation LEFT JOIN ar ON k = n_nationkey""")
def localized_merge(spark: SparkSession, sf: str) -> DataFrame:
    ar = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_name")).alias("n_name"), "s_suppkey")
    return tables.localized(table(spark, sf, "nation"), ar, "n_nationkey", ["n_name"], "s_suppkey").select("n_nationkey", "n_name", "n_name_ar")


@query("""
SELECT c_custkey, n_nationkey AS nation FROM customer LEFT JOIN nation ON lower(n_name) = 'nation_' || (c_custkey % 30)::VARCHAR""")
def resolve_entities(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("txt", F.concat(F.lit(" Nation_"), (F.col("c_custkey") % 30).cast("string"), F.lit(" ")))
    nation = table(spark, sf, "nation").withColumn("alt", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    return tables.resolve_by_names(c, "txt", nation, ["n_name", "alt"], "n_nationkey").select("c_custkey", F.col("entity.n_nationkey").alias("nation"))


@query("""
WITH t AS (SELECT DISTINCT lower(p_name) x FROM part),
n AS (SELECT r_regionkey::BIGINT o, substr(r_name, 1, 1) AS shown FROM region UNION ALL SELECT 100 + min(p_partkey), split_part(p_name, ' ', 2) FROM part GROUP BY 2
  UNION ALL SELECT 1000000 + min(p_partkey), 'The ' || p_name || ' ' || lower(p_type) FROM part WHERE p_partkey % 3 = 0 GROUP BY 2),
h AS (SELECT x, min_by(shown, o) r FROM t JOIN n ON contains(x, lower(shown)) OR contains(lower(shown), x) GROUP BY x)
SELECT p_partkey, coalesce(r, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS resolved FROM part LEFT JOIN h ON x = lower(p_name)""")
def resolve_contained(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name against names of one letter, of a word and of more words than
    the part's; those that nothing holds stay in title case."""
    part = table(spark, sf, "part")
    letters = table(spark, sf, "region").select(F.substring("r_name", 1, 1).alias("n"), F.col("r_regionkey").cast("long").alias("ord"))
    words = part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("n")).agg((F.min("p_partkey") + 100).alias("ord"))
    longer = part.where("p_partkey % 3 = 0").groupBy(F.concat(F.lit("The "), "p_name", F.lit(" "), F.lower("p_type")).alias("n")).agg((F.min("p_partkey") + 1_000_000).alias("ord"))
    return tables.resolve_contained(part, "p_name", letters.union(words).union(longer), "n", "ord").select("p_partkey", "resolved")


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) rn FROM orders)
SELECT o_orderkey, rn AS rn, floor((rn - 1) / ceil((SELECT count(*) FROM orders) / 7.0))::INTEGER AS part FROM r""")
def sheet_chunks(spark: SparkSession, sf: str) -> DataFrame:
    placed = tables.numbered(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])
    return tables.chunks(placed, 7).select("o_orderkey", "rn", "part")


# analytics


@query("""
SELECT r_name, n_name, c_mktsegment, (CASE WHEN c_mktsegment IS NOT NULL THEN 3 WHEN n_name IS NOT NULL THEN 2 ELSE 1 END)::INTEGER AS level, count(*) AS n
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (r_name, n_name, c_mktsegment))""")
def taxonomy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return analytics.taxonomy_rollup(paths, ["r_name", "n_name", "c_mktsegment"]).select("r_name", "n_name", "c_mktsegment", F.col("level").cast("int").alias("level"), "n")


@query("""
WITH g AS (SELECT p_brand, count(*) n, min_by(p_name, p_partkey) AS first_name FROM part GROUP BY 1)
SELECT p_brand, n, first_name, row_number() OVER (ORDER BY n DESC, p_brand) AS index_code FROM g""")
def brand_codes(spark: SparkSession, sf: str) -> DataFrame:
    g = analytics.counts_by(table(spark, sf, "part").withColumn("first_name", F.col("p_name")), "p_brand", ["first_name"], "p_partkey", "p_brand")
    return analytics.index_codes(g, [F.desc("n"), "p_brand"])


@query("""
WITH p AS (SELECT p_partkey ord, p_type l1, p_type || '/' || split_part(p_name, ' ', 2) l2 FROM part)
SELECT l1 AS slug, 1 AS level, NULL AS parent, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT l2, 2, min_by(l1, ord), count(*) FROM p GROUP BY 1""")
def category_entities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("l1"), F.concat_ws("/", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))).alias("l2"))
    return analytics.entity_table(p, ["l1", "l2"])


_TURNS = """
WITH u AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3)) w FROM conversations WHERE role = 'user'),
v AS (SELECT conv_id, turn - 1 AS turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3)) w FROM conversations WHERE role = 'assistant'),
j AS (SELECT u.w a, v.w b FROM u JOIN v USING (conv_id, turn)),
co AS (SELECT a, b, count(*) co FROM (SELECT a, unnest(b) b FROM (SELECT unnest(a) a, b FROM j)) GROUP BY 1, 2),
na AS (SELECT a, count(*) n_a FROM (SELECT unnest(a) a FROM j) GROUP BY 1), nb AS (SELECT b, count(*) n_b FROM (SELECT unnest(b) b FROM j) GROUP BY 1)"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    w = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 3))
    user = c.where("role = 'user'").select("conv_id", "turn", w.alias("ar"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), w.alias("en"))
    return user.join(answer, ["conv_id", "turn"])


@query(_TURNS + "SELECT a, b, co, n_a, n_b FROM co JOIN na USING (a) JOIN nb USING (b) WHERE co >= 3")
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.cooccurrence(_turns(spark, sf), "ar", "en", least=3)


@query(_TURNS + ", top AS (SELECT a FROM na ORDER BY n_a DESC, a LIMIT 1) SELECT b, co FROM co WHERE a = (SELECT a FROM top) ORDER BY co DESC, b LIMIT 15")
def word_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The words that occur most with the most frequent word of the questions."""
    turns = _turns(spark, sf)
    top = turns.select(F.explode("ar").alias("a")).groupBy("a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a").first()
    return analytics.word_profile(turns, "ar", "en", top["a"] if top else "")


@query(_TURNS + """, s AS (SELECT a, b, co, co::DOUBLE / (n_a + n_b - co) j FROM co JOIN na USING (a) JOIN nb USING (b) WHERE co >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) rn FROM s WHERE j >= 0.2)
SELECT a, b, round(j, 9) AS jaccard, co FROM r WHERE rn = 1""")
def mined_translations(spark: SparkSession, sf: str) -> DataFrame:
    co = analytics.cooccurrence(_turns(spark, sf), "ar", "en", least=2, least_jaccard=0.2)
    return analytics.mine_translations(co, 2, 0.2).withColumn("jaccard", F.round("jaccard", 9))


@query(r"""
WITH w AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '[a-z]+')) AS token FROM documents),
k AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(lower(text), '[^a-z\s]', ' ', 'g'), '[a-z]+')) AS token FROM benchmark)
SELECT token, count(*) AS n FROM w WHERE token NOT IN (SELECT token FROM k) GROUP BY 1""")
def unmapped_tokens(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "benchmark").select(F.explode(t.words(t.scanner_text(F.col("text")))).alias("token"))
    return analytics.unmapped_tokens(table(spark, sf, "documents"), "text", [known])


@query("""
WITH p AS (SELECT conv_id, turn, string_split(lower(conversations.text), ' ')[1] a, lang b FROM conversations JOIN documents ON doc_id = conv_id WHERE role = 'user'),
g AS (SELECT b, list_sort(list(DISTINCT a)) s FROM p WHERE a IS NOT NULL GROUP BY 1)
SELECT b AS lang, len(s)::INTEGER AS n, array_to_string(s, '|') AS values FROM g WHERE len(s) > 1""")
def ambiguous_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "conversations").where("role = 'user'").join(table(spark, sf, "documents").select("doc_id", "lang"), F.col("conv_id") == F.col("doc_id")).select("lang", F.get(F.split(F.lower("text"), " "), 0).alias("a"))
    return analytics.ambiguous_pairs(p, "lang", "a")


@query("""
WITH p AS (SELECT p_partkey o, string_split(lower(p_name), ' ')[1] a, string_split(lower(p_type), ' ')[1] b FROM part)
SELECT a, max_by(b, o) AS b FROM p WHERE regexp_full_match(a, '[a-z]{3,}') AND regexp_full_match(b, '[a-z]{3,}') GROUP BY 1""")
def first_word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.first_word_pairs(table(spark, sf, "part"), "p_name", "p_type", "p_partkey")


@query("""
SELECT token, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name || ',' || p_type || ',' || p_brand, ','))) AS token FROM part) WHERE token <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 100""")
def token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.token_frequency(table(spark, sf, "part").withColumn("l", F.concat_ws(",", "p_name", "p_type", "p_brand")), "l")


@query("""
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderkey) AS n_o_orderkey, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS n_content FROM orders""")
def uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.uniqueness(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"])


_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _TABLES))
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.row_counts({n: table(spark, sf, n) for n in _TABLES})


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS least, max(value) AS most, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.latency(table(spark, sf, "events"), "value", ["event_type"])


# pages


_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PLAIN = r"regexp_replace(h, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]+>', ' ', 'g')"
for _entity, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_sign}')"


@query(
    r"""
SELECT page_id, coalesce(trim(regexp_replace(""" + _PLAIN + ", '" + _SPACE + r"""', ' ', 'g')), '') AS title,
 CASE WHEN regexp_matches(html, '(?i)cdn\.shopify\.com|Shopify\.theme') THEN 'shopify' WHEN regexp_matches(html, '(?i)woocommerce|wp-content/plugins') THEN 'woocommerce' WHEN regexp_matches(html, '(?i)__NEXT_DATA__') THEN 'next' ELSE 'custom' END AS platform
FROM (SELECT page_id, html, regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) AS h FROM pages)"""
)
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", F.coalesce(pages.tag_text(F.col("html"), "h1"), F.lit("")).alias("title"), pages.platform(F.col("html"), F.col("url")).alias("platform"))


@query(r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]*)["'']', 1)) h, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"''#]*)["'']', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, pos::INTEGER AS pos, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || h END AS href FROM a""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.anchors(table(spark, sf, "pages")).select("page_id", "pos", "href")


@query()
def ranked_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.ranked_links(pages.anchors(table(spark, sf, "pages")), F.array(F.lit("the"), F.lit("and"), F.lit("tion")), exclude=r"/cart|/login")


@query()
def page_products(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_products(table(spark, sf, "pages"))


@query(r"""
WITH t AS (SELECT unnest(['h1', 'h2', 'title', 'article', 'nav', 'footer', 'p', 'li', 'a', 'img', 'table', 'form']) AS tag),
e AS (SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS domain, tag, len(regexp_extract_all(html, '(?i)<' || tag || '\b')) AS k FROM pages, t)
SELECT domain, tag, count(*) AS pages, sum(k)::BIGINT AS n FROM e WHERE k > 0 GROUP BY 1, 2""")
def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    return pages.element_profile(table(spark, sf, "pages"))


@query()
def discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation openers as unmatched names against products of all pages."""
    products = written(pages.page_products(table(spark, sf, "pages")), "products")
    profiles = products.select("domain").distinct().withColumn("enabled", F.lit(True)).withColumn("priority", F.pmod(F.xxhash64("domain"), F.lit(3)))
    missed = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_index"), t.clean(F.split_part("text", F.lit("."), F.lit(1))).alias("name"))
    return linking.discover(missed, products, profiles).select("row_index", "name", "discovery_status", F.round("score", 6).alias("score"), "domain", "url")


# sheets and streams


@query()
def sheet_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Shares by column of a sheet over every part."""
    part = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("barcode"), F.col("p_brand").alias("brand"))
    return sheets.role_profile(part)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return spark.readStream.schema(ev.schema).parquet(f"{sf}/events*.parquet")


@query("SELECT user_id % 10 AS run, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Running counters of a file stream: each batch writes the keys it changed; the
    state is written once, then read by key."""
    counts = stream.running_counts(_events(spark, sf).withColumn("run", F.col("user_id") % 10), ["run", "event_type"], "value")
    kept = Counters(spark, new_path(spark, "counters"), ["run", "event_type"], counts.schema)
    kept.start(counts, new_path(spark, "checkpoint")).awaitTermination()
    kept.compact()
    return kept.current().select("run", "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hourly_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters by hour under a watermark that no row of the table falls behind."""
    events = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.running_counts(events, ["event_type"], "value", ("ts", "36500 days"), "1 hour")
    kept = Counters(spark, new_path(spark, "counters"), ["event_type", "window_start"], counts.schema)
    kept.start(counts, new_path(spark, "checkpoint")).awaitTermination()
    return kept.current().select("event_type", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "n", F.round("total", 2).alias("total"))


@query("""
WITH c AS (SELECT c_custkey % 50 AS k, max(c_custkey) hit FROM customer GROUP BY 1)
SELECT event_id, hit AS hit_key FROM events LEFT JOIN c ON k = user_id % 50""")
def stream_match(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of rows matched by key against the static catalog."""
    catalog = written(table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_custkey") % 50).cast("string").alias("code")), "codes")
    out = new_path(spark, "matched")

    def match(batch: DataFrame) -> DataFrame:
        rows = batch.select("event_id", F.concat((F.col("user_id") % 50).cast("string"), F.lit(".0")).alias("code"))
        return matching.exact_lookup(rows, F.col("code"), catalog, F.col("code")).select("event_id", F.col("hit.idx").alias("hit_key"))

    stream.match_stream(_events(spark, sf), match, out, new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "hit_key")


# feeds and media


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS spec_k FROM events""")
def flattened_props(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("specification"))
    return feeds.flatten_map(ev, "specification")


@query(r"""
WITH a AS (SELECT page_id o, regexp_extract(split_part(url, '?', 1), '[^/]*$') f, url, 0 w FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, regexp_extract(split_part(url, '?', 1), '[^/]*$'), url, 1 FROM pages),
m AS (SELECT url, min(w) w FROM a GROUP BY 1)
SELECT url, CASE w WHEN 0 THEN 'products' ELSE 'brands' END AS folder FROM m""")
def image_tasks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return enrichment.image_tasks(p.where("page_id % 2 = 0"), p, "url", "page_id").select("url", "folder")


@query(r"""
WITH f AS (SELECT DISTINCT regexp_extract(split_part(url, '?', 1), '[^/]*$') f, page_id % 3 AS kind FROM pages WHERE page_id % 3 < 2),
p AS (SELECT page_id, regexp_extract(split_part(url, '?', 1), '[^/]*$') b FROM pages)
SELECT page_id, CASE WHEN b IN (SELECT f FROM f WHERE kind = 0) THEN 'products' WHEN b IN (SELECT f FROM f WHERE kind = 1) THEN 'brands' END AS media FROM p""")
def media_status(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    files = p.select(t.basename(F.col("url")).alias("filename"), (F.col("page_id") % 3).alias("kind"))
    return feeds.media_found(p, "url", [("products", files.where("kind = 0")), ("brands", files.where("kind = 1"))]).select("page_id", "media")


@query("""
WITH e AS (SELECT o_custkey k, 1 FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN k IS NOT NULL THEN 'order-' || c_custkey::VARCHAR WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS gallery FROM customer LEFT JOIN e ON k = c_custkey""")
def galleries(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("image", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.array(F.concat(F.lit("order-"), F.col("o_custkey").cast("string"))).alias("images"))
    return feeds.with_gallery(c, o, "c_custkey").select("c_custkey", F.array_join("gallery", ",").alias("gallery"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""")
def fetch_list(spark: SparkSession, sf: str) -> DataFrame:
    """What no former crawl has details of."""
    cached = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return feeds.reuse(table(spark, sf, "orders").select("o_orderkey"), cached, "o_orderkey", ["l_quantity"])[1]


@query("""
WITH c AS (SELECT DISTINCT c_nationkey n, c_mktsegment s FROM customer)
SELECT n AS nation, s AS slug, s || '-' || n::VARCHAR AS name_en, CASE WHEN n % 2 = 0 THEN 'ar-' || s ELSE s || '-' || n::VARCHAR END AS name_ar FROM c""")
def nested_names(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("s")).distinct()
    en = c.groupBy("nation").agg(F.sort_array(F.collect_list(F.struct(F.col("s").alias("slug"), F.concat_ws("-", "s", F.col("nation").cast("string")).alias("name")))).alias("subs")).withColumn("name", F.concat(F.lit("n"), F.col("nation").cast("string")))
    ar = c.where("nation % 2 = 0").groupBy("nation").agg(F.collect_list(F.struct(F.col("s").alias("slug"), F.concat(F.lit("ar-"), "s").alias("name"))).alias("subs")).withColumn("name", F.lit(""))
    return feeds.nested_localized(en, ar, "nation", "subs").select("nation", F.explode("subs").alias("x")).select("nation", "x.slug", "x.name_en", "x.name_ar")


@query("""
SELECT 'brands' AS dictionary, p_brand AS key, p_type AS value, count(*) AS n FROM part WHERE contains(p_brand, '#1') OR contains(p_type, '#1') GROUP BY 2, 3
UNION ALL SELECT 'names', p_name, p_type, count(*) FROM part WHERE contains(p_name, '#1') OR contains(p_type, '#1') GROUP BY 2, 3""")
def dictionary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    brands, names = p.select(F.col("p_brand").alias("key"), F.col("p_type").alias("value")), p.select(F.col("p_name").alias("key"), F.col("p_type").alias("value"))
    return feeds.lookup([("brands", brands), ("names", names)], "#1").groupBy("dictionary", "key", "value").agg(F.count("*").alias("n"))


@query("""
SELECT c_mktsegment AS name, min_by(c_name, c_custkey) AS first_name, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM customer GROUP BY 1""")
def segment_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("first_name", F.col("c_name"))
    g = analytics.counts_by(c, "c_mktsegment", ["first_name"], "c_custkey", "name")
    return g.join(c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count_distinct("c_nationkey").alias("n_nations")), "name")


@query("""
SELECT o_orderpriority AS status, sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END)::BIGINT AS selected, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) AS total FROM orders GROUP BY 1""")
def selected_totals(spark: SparkSession, sf: str) -> DataFrame:
    g = analytics.status_counts(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"], ["o_orderpriority"])
    return g.select(F.col("o_orderpriority").alias("status"), (F.col("F") + F.col("O")).alias("selected"), "F", "O", "total")


@query("""
WITH d AS (SELECT r_name, n_name, count(*) n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2)
SELECT r_name, sum(n)::BIGINT AS n, string_agg(n_name || '=' || n::VARCHAR, ',' ORDER BY n DESC, n_name) AS children FROM d GROUP BY 1""")
def taxonomy_tree(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tree = analytics.taxonomy_tree(analytics.taxonomy_rollup(paths, ["r_name", "n_name"]), ["r_name", "n_name"])
    return tree.select("r_name", "n", F.array_join(F.transform("children", lambda c: F.concat_ws("=", c["name"], c["count"].cast("string"))), ",").alias("children"))


@query()
def reinvestigated(spark: SparkSession, sf: str) -> DataFrame:
    """Unmatched names again, by shared tokens and sequence ratio."""
    missed = table(spark, sf, "part").select(F.lower(F.concat_ws(" ", F.reverse("p_type"), "p_name")).alias("name"))
    return matching.reinvestigate(missed, written(_index(spark, sf), "index"))


@query()
def page_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Elements, search forms and platforms of all domains."""
    p = table(spark, sf, "pages")
    kinds = p.groupBy(t.domain_of(F.col("url")).alias("domain"), pages.platform(F.col("html"), F.col("url")).alias("platform")).agg(F.count("*").alias("n"))
    return kinds.join(pages.search_forms(p), "domain", "left")
