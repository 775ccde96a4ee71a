"""Registered queries of views, statistics and page parses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.functions import text as t
from linkloom.operators import pages, views
from linkloom.plans.queries import _ENRICHED, _SCORED, _enriched, _scored, _status, query, table


@query(f"SELECT row_index, sheet_barcode, db_barcode FROM ({_ENRICHED}) WHERE st = 'matched' AND sheet_barcode IS DISTINCT FROM db_barcode AND contains(concat_ws('|', sheet_barcode, db_barcode), '3')")
def pending_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return views.enriched(_enriched(spark, sf), "3", pending=True, columns=("sheet_barcode", "db_barcode")).select("row_index", "sheet_barcode", "db_barcode")


@query("SELECT o_orderkey, o_orderpriority AS name, o_orderstatus AS discovery_status FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'high')")
def discovery_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("discovery_status"))
    return views.discovered(rows, "HIGH", "O", ("name",))


@query("SELECT p_partkey AS id, p_name AS name, p_size AS category_id FROM part WHERE (p_size = 7 OR p_partkey % 50 = 7) AND p_partkey % 3 = 1 AND contains(lower(p_name), 'a')")
def crawled_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("category_id"), (F.col("p_partkey") % 50).alias("subcategory_id"), (F.col("p_partkey") % 3).alias("brand_id"))
    return views.crawled(rows, "A", 7, 1).select("id", "name", "category_id")


@query("SELECT s_suppkey AS id, s_name AS filename, n_name AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE contains(lower(concat_ws('|', s_name, n_name, s_suppkey::VARCHAR)), '1')")
def gallery_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return views.gallery(rows.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("filename"), F.col("n_name").alias("label")), "1", ("filename", "label", "id"))


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 10")
def jobs_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of jobs, newest first: a page is the feature."""
    return views.jobs(_runs(spark, sf), "F", offset=10, limit=25).select("run_id", "status", "created_at")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("filename"))


_NAMED_RUNS = "SELECT c_custkey AS run_id, c_name AS filename, CASE c_mktsegment WHEN 'BUILDING' THEN 'completed' WHEN 'MACHINERY' THEN 'stopped' WHEN 'AUTOMOBILE' THEN 'running' ELSE 'failed' END AS status, floor(greatest(c_acctbal, 0))::BIGINT AS no_match_count, c_nationkey::BIGINT AS applied FROM customer"


def _named_runs(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    status = F.when(segment == "BUILDING", "completed").when(segment == "MACHINERY", "stopped").when(segment == "AUTOMOBILE", "running").otherwise("failed")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("filename"), status.alias("status"), F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("long").alias("no_match_count"), F.col("c_nationkey").cast("long").alias("applied"))


@query(f"SELECT run_id, status FROM ({_NAMED_RUNS}) WHERE status IN ('completed', 'stopped') AND no_match_count > 0")
def eligible_runs(spark: SparkSession, sf: str) -> DataFrame:
    return views.eligible_runs(_named_runs(spark, sf)).select("run_id", "status")


@query(f"SELECT run_id, filename FROM ({_NAMED_RUNS}) WHERE contains(lower(filename || '|' || run_id::VARCHAR), '42')")
def run_search(spark: SparkSession, sf: str) -> DataFrame:
    return views.runs_like(_named_runs(spark, sf), "42").select("run_id", "filename")


@query(f"SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'running') AS active, sum(applied)::BIGINT AS applied, sum(no_match_count)::BIGINT AS matched FROM ({_NAMED_RUNS})")
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return views.run_totals(_named_runs(spark, sf).withColumnRenamed("no_match_count", "matched"))


@query(r"SELECT page_id, url, regexp_matches(url, '^https?://') OR regexp_matches(url, '^[\w-]+(\.[\w-]+)*\.(com|eg|net|org|shop)/') AS product FROM pages WHERE url IS NOT NULL")
def product_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", "url", views.product_url(F.col("url")).alias("product"))


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://([^/?#]+\.)?example\.com/(en|de)/')")
def site_hits(spark: SparkSession, sf: str) -> DataFrame:
    return views.site_hits(table(spark, sf, "pages"), "example.com", r"^/(en|de)/").select("page_id")


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_SCORED}) WHERE {_status()} = 'matched' AND score < 0.75")
def suspicious_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).withColumn("status", s.status_of(F.col("score")))
    return views.suspicious(rows).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A' AND l_quantity / 50 > 0.7 AND l_discount * 10 < 0.6")
def penalty_cases(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "matched").otherwise("no_match")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"), (F.col("l_quantity") / 50).alias("sequence"), (F.col("l_discount") * 10).alias("score"))
    return views.penalty_cases(rows).select("l_orderkey", "l_linenumber")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
ORDER BY l_orderkey * 10 + l_linenumber LIMIT 50""")
def resolving_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose keys all resolve, the first 50: a sample is the feature."""
    rows = table(spark, sf, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    known = [("l_partkey", table(spark, sf, "part").where("p_size > 25"), "p_partkey"), ("l_suppkey", table(spark, sf, "supplier").where("s_acctbal > 0"), "s_suppkey")]
    return views.resolving_sample(rows, known, 50, "at").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id, lang AS name FROM documents WHERE lang IS NOT NULL AND trim(lang) NOT IN ('', 'nan')")
def named_rows(spark: SparkSession, sf: str) -> DataFrame:
    return views.named(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("name")), "name")


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_name, c_custkey) AS rn FROM customer) WHERE rn BETWEEN 101 AND 150")
def export_range(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 101 to 150 of the customers by name: a range is the feature."""
    return views.export_range(table(spark, sf, "customer").select("c_custkey", "c_name"), 101, 150, ["c_name", "c_custkey"])


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation ORDER BY n_name LIMIT 5")
def preview_rows(spark: SparkSession, sf: str) -> DataFrame:
    return views.preview(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_name"])


@query("""
SELECT count(*) AS n_live, count(*) FILTER (p_size > 5) AS n_normalized, count(*) FILTER (p_size % 2 = 0) AS n_code, count(*) FILTER (p_size % 5 = 0) AS n_barcode,
 (SELECT count(*) FROM supplier) AS n_staging, (SELECT max(o_orderdate) FROM orders) AS last_promoted_at FROM part""")
def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    def some(test) -> F.Column:
        return F.when(test, F.col("p_name")).otherwise("")

    live = table(spark, sf, "part").select(some(F.col("p_size") > 5).alias("normalized_name"), some(F.col("p_size") % 2 == 0).alias("code"), F.when(F.col("p_size") % 5 == 0, F.col("p_partkey")).alias("barcode"))
    return views.catalog_stats(live, table(spark, sf, "supplier"), table(spark, sf, "orders").select(F.col("o_orderdate").alias("promoted_at")))


@query("""
SELECT count(*) AS n_products, count(*) FILTER (p_size > 10) AS with_image, count(*) FILTER (p_size > 10 AND p_size % 3 = 0) AS local, count(*) FILTER (p_size > 10 AND p_size % 3 <> 0) AS missing,
 count(DISTINCT p_brand) AS brand_urls FROM part""")
def gallery_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.when(F.col("p_size") > 10, F.col("p_name")).alias("image"), F.when(F.col("p_size") % 3 == 0, "store").alias("media"), F.col("p_brand").alias("brand_url"))
    return views.gallery_stats(rows)


@query("SELECT l_shipdate::DATE::VARCHAR AS job, count(*) AS n_files, sum(l_quantity::BIGINT)::BIGINT AS bytes, max(l_quantity::BIGINT) AS largest FROM lineitem GROUP BY GROUPING SETS ((1), ())")
def disk_usage(spark: SparkSession, sf: str) -> DataFrame:
    return views.disk_usage(table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("job"), F.col("l_quantity").cast("long").alias("size_bytes")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N'")
def no_match_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("status", F.when(F.col("l_returnflag") != "N", "matched"))
    return views.no_match_feed(rows, "O", ["l_orderkey", "l_linenumber"], "l_linestatus")


_DIAGNOSED = "SELECT p_brand AS run, CASE WHEN p_size > 30 THEN 'matched' ELSE 'no_match' END AS status, p_name || ' ' || p_type AS name FROM part"


def _diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("run"), F.when(F.col("p_size") > 30, "matched").otherwise("no_match").alias("status"), F.concat_ws(" ", "p_name", "p_type").alias("name"))


@query(f"SELECT run, status, count(*) AS n, min(name) AS sample FROM ({_DIAGNOSED}) GROUP BY ALL")
def run_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return views.diagnosis(_diagnosed(spark, sf), "run")[0]


@query(f"SELECT run, token, count(*) AS n FROM (SELECT run, unnest(list_distinct(string_split(lower(name), ' '))) AS token FROM ({_DIAGNOSED}) WHERE status = 'no_match') GROUP BY ALL")
def missed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return views.diagnosis(_diagnosed(spark, sf), "run")[1]


@query("""
SELECT 'brand' AS kind, p_brand AS key, min(p_type) AS value FROM part GROUP BY p_brand UNION ALL
SELECT 'token', p_type, max(p_name) FROM part GROUP BY p_type UNION ALL SELECT 'stop', n_name, NULL FROM nation""")
def dictionary_export(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    brands, words = part.groupBy(F.col("p_brand").alias("key")).agg(F.min("p_type").alias("value")), part.groupBy(F.col("p_type").alias("key")).agg(F.max("p_name").alias("value"))
    return views.dictionary_export(brands, words, table(spark, sf, "nation").select(F.col("n_name").alias("key")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT'")
def without_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("run_id"))
    return views.without_run(rows, rows, "1-URGENT")[0].drop("run_id")


@query("""
WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul\\b|</ul>|<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>')) AS part, generate_subscripts(regexp_extract_all(html, '(?is)<ul\\b|</ul>|<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>'), 1) - 1 AS pos FROM pages),
d AS (SELECT *, sum(CASE WHEN lower(part) LIKE '<ul%' THEN 1 WHEN lower(part) = '</ul>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM e)
SELECT page_id, pos::INTEGER AS pos, regexp_extract(part, '(?i)href="([^"]*)"', 1) AS href, trim(regexp_replace(part, '<[^>]*>', '', 'g')) AS label, depth::BIGINT AS depth FROM d WHERE lower(part) LIKE '<a%'""".replace("\\\\", "\\"))
def page_menus(spark: SparkSession, sf: str) -> DataFrame:
    return pages.menus(table(spark, sf, "pages"))


@query("""
WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>')) AS part FROM pages),
l AS (SELECT page_id, lower(regexp_extract(regexp_extract(part, '(?i)href="([^"]*)"', 1), '^/([^/?#]+)', 1)) AS slug, trim(regexp_replace(part, '<[^>]*>', '', 'g')) AS label FROM e)
SELECT slug, min(label) AS label, count(DISTINCT page_id) AS n_pages FROM l WHERE slug <> '' GROUP BY slug""".replace("\\\\", "\\"))
def brand_listing(spark: SparkSession, sf: str) -> DataFrame:
    return pages.brand_links(pages.menus(table(spark, sf, "pages")), r"^/([^/?#]+)")


_ARABIC = "translate(lower(p_name), 'aeioub12', 'أإآةىب١٢')"


@query(f"SELECT p_partkey, {_ARABIC} AS raw, translate({_ARABIC}, 'أإآةى١٢', 'اااهي12') AS folded, regexp_matches({_ARABIC}, '[؀-ۿ]') AS arabic FROM part")
def folded_names(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.translate(F.lower("p_name"), "aeioub12", "أإآةىب١٢")
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"), t.fold_arabic(raw).alias("folded"), t.has_arabic(raw).alias("arabic"))


@query("""
WITH n AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) a, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard FROM n""")
def name_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    a, b = t.tokens(F.lower("p_name")), t.tokens(F.lower(F.concat_ws(" ", "p_type", "p_name")))
    return table(spark, sf, "part").select("p_partkey", F.round(s.jaccard(a, b), 9).alias("jaccard"))


@query("""
SELECT user_id, (count(*) FILTER (event_type = 'view') * 2)::BIGINT AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY user_id""")
def merged_stats(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("view", "click", "error")
    counts = table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])

    def stats(by: int):
        return F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k) * by)])

    merged = counts.select("user_id", views.merged_stats(stats(1), stats(2), ["view"]).alias("m"))
    return merged.select("user_id", *[F.col("m")[k].alias(f"n_{k}") for k in kinds])
