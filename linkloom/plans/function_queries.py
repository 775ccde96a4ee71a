"""Registered queries of string functions, similarities, decisions and sources over
whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import dictionaries as d
from linkloom.functions import similarity as s
from linkloom.functions import text as t
from linkloom.functions.normalize import Options, normalize_fields, normalize_missing, normalized
from linkloom.functions.phrases import phrase_table, replaced
from linkloom.operators import analytics, enrichment, feeds, matching, pages, results, similar_words, tables
from linkloom.plans import linking
from linkloom.plans.queries import query, table
from linkloom.sources import catalog, sheets
from linkloom.sources.shared import new_path, written
from linkloom.streaming import matching as stream

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_ARABIC = "أإآةىابتثجحخدذرزسشصضطظعغفق"
_FOLDED = "اااهيابتثجحخدذرزسشصضطظعغفق"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def _choice(n: Column, *values: str) -> Column:
    """One of ``values`` by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# names


@query(f"""
SELECT doc_id, md5(translate(lower(text), '{_LATIN}', '{_FOLDED}')) AS folded, regexp_matches(lower(text), '[a-z]') AS has_arabic FROM documents""")
def arabic_folding(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in Arabic letters with marks and Arabic digits, folded again."""
    c = F.translate(F.lower("text"), _LATIN + "0123456789", _ARABIC + "٠١٢٣٤٥٦٧٨٩")
    marked = F.replace(F.replace(c, F.lit("ب"), F.lit("بَ")), F.lit("ت"), F.lit("تّ"))
    folded = t.fold_arabic(t.strip_diacritics(marked))
    return table(spark, sf, "documents").select("doc_id", F.md5(folded).alias("folded"), t.has_arabic(folded).alias("has_arabic"))


@query(r"""
WITH m AS (SELECT doc_id, translate(lower(text), 'aeiou', 'اوةيى') x FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(x, '([a-z])([ء-ي])', '\1 \2', 'g'), '([ء-ي])([a-z])', '\1 \2', 'g')) AS separated, regexp_matches(x, '[a-z]') AS has_latin,
 md5(trim(regexp_replace(regexp_replace(x, '[^a-z\t\n\x0B\f\r ]', ' ', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS latin, md5(trim(regexp_replace(regexp_replace(x, '[^ء-ي\t\n\x0B\f\r ]', ' ', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS arabic FROM m""")
def script_separation(spark: SparkSession, sf: str) -> DataFrame:
    x = F.translate(F.lower("text"), "aeiou", "اوةيى")
    return table(spark, sf, "documents").select("doc_id", F.md5(t.separate_scripts(x)).alias("separated"), t.has_latin(x).alias("has_latin"), F.md5(t.letters_only(x)).alias("latin"), F.md5(t.letters_only(x, arabic=True)).alias("arabic"))


@query("""
SELECT p_partkey, p_name || ' ' || p_size::VARCHAR AS packed, p_name || ' ' || p_size::VARCHAR || ' mg ' || (p_size + 5)::VARCHAR || ' mg' AS doses, p_size::VARCHAR || ' ' || (p_size + 1)::VARCHAR AS ratio FROM part""")
def packaging(spark: SparkSession, sf: str) -> DataFrame:
    """``x10p``, ``5/160mg`` and ``5/6`` beside every name."""
    n, m = _text("p_size"), (F.col("p_size") + 5).cast("string")
    packed = F.concat("p_name", _choice(F.col("p_partkey"), " x", " "), n, _choice(F.col("p_partkey") + F.col("p_size"), "p", "pcs", " P"))
    combined = F.concat("p_name", F.lit(" "), n, F.lit("/"), m, F.lit("mg"))
    return _parts(spark, sf).select("p_partkey", t.strip_packaging(packed).alias("packed"), t.split_combined_doses(combined).alias("doses"), t.split_combined_doses(F.concat_ws("/", n, (F.col("p_size") + 1).cast("string"))).alias("ratio"))


@query("""
SELECT p_partkey, p_name AS stopped, p_name || ' ' || ['3', '7', '0.5', '10'][p_size % 4 + 1] AS counted, p_name || ' ' || ['tab', 'injectable', 'syrup', 'drops', 'infant supp'][p_size % 5 + 1] AS short,
 p_name || ' ' || ['gel', 'sachet', 'inhaler', 'tab'][p_size % 4 + 1] AS form, p_size % 3 <> 0 AS numeric FROM part""")
def token_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Stop words, number words, abbreviations, synonyms and the test of numbers."""
    n, name = F.col("p_size"), F.col("p_name")

    def beside(*words: str) -> Column:
        return F.concat_ws(" ", name, _choice(n, *words))

    return _parts(spark, sf).select(
        "p_partkey", t.drop_tokens(F.concat_ws(" ", F.lit("مضاد"), name, F.lit("علاج")), d.STOP_WORDS).alias("stopped"), t.map_tokens(beside("ثلاثه", "سبعه", "نص", "عشره"), d.NUMBER_WORDS).alias("counted"),
        t.map_tokens(beside("tablets", "ampoules", "syp.", "gtt", "infant supp"), d.ABBREVIATIONS).alias("short"), t.map_tokens(beside("emulgel", "bags", "hfa", "caplets"), d.FORM_SYNONYMS).alias("form"), t._number(_choice(n, "mg5", "12.5", "7")).alias("numeric"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_name = 'cold widget' THEN 'frio' WHEN starts_with(p_name, 'cold ') THEN 'kalt ' || split_part(p_name, ' ', 2) ELSE p_name END || ' ' || p_type AS mapped FROM part""")
def phrase_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """The longest phrase at each place wins."""
    phrases = spark.createDataFrame([("cold", "kalt"), ("cold widget", "frio"), ("cold widget of gold", "oro")], "key string, value string")
    rows = _parts(spark, sf).select("p_partkey", F.concat_ws("  ", "p_name", "p_type").alias("mapped"))
    return replaced(rows, "mapped", phrase_table(phrases))


@query("""
WITH w AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b FROM part), k AS (SELECT DISTINCT a AS k FROM w)
SELECT p_partkey, p_partkey || ' ' || 'B-' || a || ' عقار ' || upper(b) || CASE WHEN p_partkey % 3 = 0 THEN ' fast' ELSE ' علاجون' END AS mapped FROM w""")
def brand_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Two dictionaries at once, exact phrases first, then words one letter off: one of
    phrases taken from the parts themselves, one of Arabic brands."""
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    parts = _parts(spark, sf)
    own = parts.select(F.concat_ws(" ", first, F.lit("دواء")).alias("key"), F.concat(F.lit("B-"), first, F.lit(" عقار")).alias("value")).union(parts.select(second, F.upper(second)))
    brands = own.distinct().union(spark.createDataFrame([("بانادول اكسترا", "fast")], "key string, value string"))
    brands = brands.union(spark.createDataFrame([("بانادولين", "fast")], "key string, value string")).withColumn("ord", F.xxhash64("key"))
    tail = F.when(F.col("p_partkey") % 3 == 0, "بانادولبن").otherwise("علاجون")
    rows = parts.select("p_partkey", F.concat_ws("  ", _text("p_partkey"), first, F.lit("دواء"), second, tail).alias("mapped"))
    return matching.map_brands(rows, "mapped", brands)


_NAME_FORMS = "list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('large', 'small', 'medium')) AS words, list_filter(string_split(p_name, ' '), lambda x: x IN ('large', 'small', 'medium')) AS forms"


@query(f"""
SELECT p_partkey, upper(array_to_string(list_concat(words, [p_size::VARCHAR], forms), ' ')) AS name_pct, upper(array_to_string(list_concat(words, forms), ' ')) AS title_en FROM (SELECT p_partkey, p_size, {_NAME_FORMS} FROM part)""")
def normalizer_options(spark: SparkSession, sf: str) -> DataFrame:
    """The configurable normaliser with an extra step, by fields of a row."""
    rows = _parts(spark, sf).select("p_partkey", F.concat("p_name", F.lit(" "), _text("p_size"), F.lit("%")).alias("name_pct"), F.initcap("p_name").alias("title_en"), "p_type")
    out = normalize_fields(rows, options=Options(extra=[F.upper]))
    return out.select("p_partkey", F.col("normalized_name_pct").alias("name_pct"), F.col("normalized_title_en").alias("title_en"))


@query(f"""
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'kept ' || p_type ELSE array_to_string(list_concat(words, forms), ' ') END AS normalized_name_en FROM (SELECT p_partkey, p_size, p_type, {_NAME_FORMS} FROM part)""")
def staging_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows without a normalised name get one, from the first title present."""
    done = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("kept "), "p_type")).when(F.col("p_size") % 3 == 1, F.lit(""))
    en, other = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")), F.initcap("p_name")
    rows = _parts(spark, sf).select(F.col("p_partkey").alias("id"), en.alias("title_en"), other.alias("title_ar"), done.alias("normalized_name_en"))
    return normalize_missing(rows, ["title_en", "title_ar"]).select("id", "normalized_name_en")


# values


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS price, CASE WHEN o_orderkey >= 100 THEN round(o_orderkey / 100.0, 2) ELSE o_orderkey END::DOUBLE AS minor, round(o_totalprice, 2) AS many FROM orders""")
def page_prices(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.format_string("%.2f", "o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", t.page_price(F.concat(F.lit("EGP "), shown, F.lit(" only"))).alias("price"), t.page_price(_text("o_orderkey"), 100).alias("minor"), t.page_price(F.concat(F.lit("LE"), F.format_number("o_totalprice", 2))).alias("many"))


@query("""
WITH c AS (SELECT o_orderkey, lpad((o_orderkey * 97)::VARCHAR, 12, '4') b FROM orders),
g AS (SELECT o_orderkey, b || ((10 - list_sum(list_transform(range(1, 13), lambda i: b[i]::INTEGER * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::INTEGER::VARCHAR AS good FROM c)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN good END AS barcode FROM g""")
def first_gtins(spark: SparkSession, sf: str) -> DataFrame:
    """The valid one of several candidates, which stands at different places."""
    o = table(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 97).cast("string"), 12, "4").alias("b"))
    digit = F.transform(F.split("b", ""), lambda x: x.cast("int"))
    total = F.aggregate(F.transform(digit, lambda x, i: x * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    o = o.withColumn("good", F.concat("b", ((10 - total % 10) % 10).cast("string"))).withColumn("bad", F.concat("b", F.lit("x")))
    k = F.col("o_orderkey") % 3
    return o.select("o_orderkey", t.first_valid_gtin(F.col("bad"), F.when(k == 0, F.concat(F.lit(" "), "good")), F.lit("123"), F.when(k == 1, F.col("good"))).alias("barcode"))


@query(r"""
WITH b AS (SELECT page_id, url, regexp_extract(split_part(url, '?', 1), '[^/]*$') b FROM pages),
f AS (SELECT *, regexp_replace(regexp_replace(b, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g') f FROM b)
SELECT page_id, CASE WHEN regexp_replace(f, '[._]', '', 'g') = '' THEN md5(url) ELSE f END AS filename, page_id::VARCHAR || '.png' AS fixed, 'https://cdn.x.org/public/' || page_id::VARCHAR AS cdn, page_id::VARCHAR || '.jpg,b.png' AS names FROM f""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    n = _text("page_id")
    return table(spark, sf, "pages").select(
        "page_id", t.safe_filename(F.col("url")).alias("filename"), t.fix_extension(F.concat(n, F.when(F.col("page_id") % 2 == 0, "png").otherwise(".png"))).alias("fixed"),
        t.cut_before_public(F.concat(F.lit("https://cdn.x.org/size/w400/public/"), n)).alias("cdn"), t.basenames(F.concat(F.lit("https://s.com/i/"), n, F.lit(".jpg?w=1, /x/b.png,"))).alias("names"),
    )


@query("""
SELECT p_partkey, p_name AS slug_words, p_name || ' ' || lower(p_type) AS title, p_name AS en, 'ال' || p_size::VARCHAR AS ar, p_size % 4 < 2 AS site,
 'https://s.com/p/' || replace(p_name, ' ', '-') AS link, p_size::VARCHAR || '.0%' AS pct, (1 + (p_type = 'PROMO')::INTEGER)::INTEGER AS relevance, lower(p_type) <> 'promo' AS valid FROM part""")
def titles(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs, page titles, store links, scores as text and relevance."""
    n, name, slug = _text("p_size"), F.col("p_name"), F.replace("p_name", F.lit(" "), F.lit("-"))
    title = F.concat(_choice(F.col("p_partkey"), "", "Shop | "), name, F.lit("  "), F.lower("p_type"), _choice(F.col("p_partkey") + 1, "", " - Shop"))
    return _parts(spark, sf).select(
        "p_partkey", t.slug_words(F.concat(F.lit("https://s.com/p/"), slug, F.lit("-"), _text("p_partkey"), F.lit("?x=1"))).alias("slug_words"), t.clean_title(title, "Shop").alias("title"),
        t.bilingual(F.concat(name, _choice(F.col("p_partkey"), " - ", "|"), F.lit("ال"), n))["en"].alias("en"), t.bilingual(F.concat(F.lit("ال"), n, F.lit(" | "), name))["ar"].alias("ar"),
        t.site_title(_choice(F.col("p_size"), "Home", "ab", "red widget", "a menu of gear")).alias("site"), results.store_link(slug, "https://s.com/p/").alias("link"), t.percent(F.col("p_size") / 100.0).alias("pct"),
        t.relevance(F.array(F.lit("SHOP"), F.lit("promo"), F.lit("ab")), F.concat_ws(" ", F.lit("/shop/ab"), "p_type")).alias("relevance"),
        t.valid_word(F.when(F.col("p_type") == "PROMO", F.lit("pr0mo")).otherwise(F.lower("p_type"))).alias("valid"),
    )


# similarities


@query("""
WITH p AS (SELECT p_partkey, p_name a, p_name || ' ' || lower(p_type) b, 2.0 * length(p_name) / (2 * length(p_name) + length(p_type) + 1) r FROM part),
j AS (SELECT *, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(b, ' '))) j FROM p)
SELECT p_partkey, round(j, 9) AS jaccard, round(r, 9) AS ratio, round(0.7 * j + 0.3 * r, 9) AS score FROM j""")
def simple_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A name against itself with a word more: the ratio has a closed form."""
    a, b = F.col("p_name"), F.concat_ws(" ", "p_name", F.lower("p_type"))
    p = _parts(spark, sf).withColumn("ratio", s.sequence_ratio(a, b))
    return p.select("p_partkey", F.round(s.jaccard(F.split(a, " "), F.split(b, " ")), 9).alias("jaccard"), F.round("ratio", 9).alias("ratio"), F.round(s.simple_score(a, b, F.col("ratio")), 9).alias("score"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 4 k, length(p_name) n, split_part(p_name, ' ', 1) brand, split_part(p_name, ' ', 2) word FROM part)
SELECT p_partkey, round(CASE k WHEN 0 THEN 1.0 WHEN 1 THEN (0.7 * 4.2 / 7.2 + 0.3 * (n + 4) / (n + 5)) * 0.60 * 0.65 WHEN 2 THEN (0.7 * 4 / 4.1 + 0.3 * 2 * n / (2 * n + 5)) * 1.10 * 0.70
 ELSE (0.7 * 1.0 / 5 + 0.3 * (length(word) + 1) / n) * 0.50 END, 9) AS score,
 CASE k WHEN 0 THEN [] WHEN 1 THEN [((p_partkey + 1) % 9 + 1)::VARCHAR] WHEN 2 THEN ['plus'] ELSE [repeat('q', length(brand)::INTEGER)] END::VARCHAR[]::VARCHAR AS unmatched FROM p""")
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The explained score of names that are equal, differ in a dose, in a
    combination word or in the brand; each has a closed form."""
    k, name = F.col("p_size") % 4, F.col("p_name")
    dose = [F.concat(name, F.lit(" "), ((F.col("p_partkey") + i) % 9 + 1).cast("string"), F.lit(" mg")) for i in (0, 1)]
    other = F.concat(F.repeat(F.lit("q"), F.length(F.split_part(name, F.lit(" "), F.lit(1)))), F.lit(" "), F.split_part(name, F.lit(" "), F.lit(2)))
    pairs = _parts(spark, sf).select("p_partkey", F.when(k < 2, dose[0]).otherwise(name).alias("q"), F.when(k == 0, dose[0]).when(k == 1, dose[1]).when(k == 2, F.concat(name, F.lit(" plus"))).otherwise(other).alias("c"))
    out = similar_words.scored_names(pairs, "q", "c")
    return out.select("p_partkey", F.round("score", 9).alias("score"), F.concat(F.lit("["), F.array_join("unmatched_catalog", ", "), F.lit("]")).alias("unmatched"))


# pages of products


@query("""
WITH p AS (SELECT *, p_partkey % 5 k, (p_partkey % 900 + 100)::VARCHAR || '.50' price FROM part)
SELECT p_partkey AS page_id, 's.com' AS domain, p_name || ' x' AS title, CASE WHEN k = 4 THEN NULL ELSE (p_partkey % 900 + 100) + 0.5 END::DOUBLE AS price,
 CASE k WHEN 0 THEN 'https://s.com/m/' || p_partkey::VARCHAR || '.png' WHEN 3 THEN 'https://s.com/l/' || p_partkey::VARCHAR || '.png' ELSE 'https://s.com/i/' || p_partkey::VARCHAR || '.jpg' END AS image,
 CASE k WHEN 4 THEN NULL ELSE p_brand END AS brand, CASE WHEN k IN (2, 3) THEN '4006381333931' END AS barcode FROM p""")
def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for every part with its fields in meta tags (0), marked elements (1),
    a table (2), linked data (3) or absent (4), through the chains."""
    k, name, n, shown = F.col("p_partkey") % 5, F.col("p_name"), _text("p_partkey"), F.concat((F.col("p_partkey") % 900 + 100).cast("string"), F.lit(".50"))
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.concat(name, F.lit(" x")).alias("name"), F.concat(F.lit("https://s.com/l/"), n, F.lit(".png")).alias("image"), F.col("p_brand").alias("brand"), F.lit("4006381333931").alias("gtin13"), F.struct(shown.alias("price")).alias("offers")))
    heads = (
        F.when(k == 0, F.concat(F.lit('<meta property="og:title" content="'), name, F.lit(' x"><meta content="'), shown, F.lit('" property="product:price:amount"><meta property="og:image" content="https://s.com/m/'), n, F.lit('.png">')))
        .when(k == 3, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))).otherwise("")
    )
    body = (
        F.when(k == 0, F.concat(F.lit('<h1>Home</h1><a href="/brands">All Brands</a><a href="/brand/1"><b>'), "p_brand", F.lit("</b></a>")))
        .when(k == 1, F.concat(F.lit("<h1>"), name, F.lit(' x</h1><span itemprop="price">EGP '), shown, F.lit('</span><b itemprop="brand">'), "p_brand", F.lit("</b>")))
        .when(k == 2, F.concat(F.lit("<table><tr><th>Trade name</th><td>"), name, F.lit(" <i>x</i></td></tr><tr><td>Price</td><td>"), shown, F.lit(" EGP</td></tr><tr><td>one</td></tr><tr><td>Manufacturer</td><td>"), "p_brand", F.lit("</td></tr><tr><td>Barcode</td><td>4006381333931</td></tr></table>")))
        .when(k == 4, F.concat(F.lit("<h2>"), name, F.lit(" x</h2>"))).otherwise("")
    )
    img = F.concat(F.lit('<img src="https://s.com/logo.png"><img src="https://s.com/i/'), n, F.lit('.jpg">'))
    html = F.concat(F.lit("<html><head>"), heads, F.lit("</head><body>"), body, img, F.lit("</body></html>"))
    made = _parts(spark, sf).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://www.s.com/p/"), n).alias("url"), html.alias("html"))
    return pages.page_products(made).select("page_id", "domain", "title", "price", "image", "brand", "barcode")


@query("""
SELECT o_custkey AS page_id, min(round(o_totalprice, 2)) AS least, max(round(o_totalprice, 2)) AS most, count(*) AS n FROM orders GROUP BY 1""")
def listings(spark: SparkSession, sf: str) -> DataFrame:
    """A listing page for every customer with the prices of all its orders."""
    tags = table(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), F.concat(F.lit('<b itemprop="price" content="'), F.format_string("%.2f", "o_totalprice"), F.lit('"></b>')).alias("tag"))
    made = written(tags.groupBy("page_id").agg(F.concat_ws("", F.collect_list("tag")).alias("html")), "listings")
    counts = made.select("page_id", F.regexp_count("html", F.lit("itemprop")).cast("long").alias("n"))
    return pages.listing_prices(made).select("page_id", "least", "most").join(counts, "page_id")


# catalog documents and feeds


@query("""
SELECT n_nationkey::VARCHAR AS id, 'n' || n_nationkey::VARCHAR AS title_en, CASE n_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS l2, 'r' || n_regionkey::VARCHAR AS l1, CASE WHEN n_nationkey % 2 = 0 THEN 'B' || n_nationkey::VARCHAR ELSE 'slug' END AS brand_id,
 CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey END::DOUBLE AS final_price, 'feed' AS source FROM (SELECT p_partkey AS n_nationkey, p_size AS n_regionkey FROM part)""")
def catalog_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON document for every part, written, read and shaped; categories are an
    object, a list or absent."""
    k = F.col("p_partkey") % 3
    l2 = F.when(k == 0, F.lit('{"slug":"a"}')).when(k == 1, F.lit('[{"slug":"b"},{"slug":"c"}]')).otherwise("null")
    brand = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"id":"B'), _text("p_partkey"), F.lit('"}'))).otherwise('{"id":"","slug":"slug"}')
    doc = F.concat(F.lit('{"slug":"'), _text("p_partkey"), F.lit('","name_en":"n'), _text("p_partkey"), F.lit('","title_en":"","price":'), _text("p_partkey"), F.lit(',"final_price":0,"level_one_category":{"slug":"r'), _text("p_size"), F.lit('"},"level_two_category":'), l2, F.lit(',"brands":'), brand, F.lit("}"))
    path = new_path(spark, "documents") + ".json"
    _parts(spark, sf).select(doc.alias("value")).write.text(path)
    rows = catalog.catalog_rows(spark.read.schema(catalog.DOCUMENT).json(path))
    back = catalog.decoded(rows)
    return back.select("id", "title_en", F.col("category_l2_slug").alias("l2"), F.col("doc.level_one_category.slug").alias("l1"), "brand_id", "final_price", "source")


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders)
SELECT o_orderkey AS id, l_linenumber::VARCHAR AS variant_id, CASE WHEN l_linenumber IS NULL OR l_linenumber % 2 = 0 THEN o_orderpriority ELSE 'line ' || l_linenumber::VARCHAR END AS title_en,
 CASE WHEN l_linenumber IS NULL OR l_linenumber % 3 = 0 THEN o_totalprice ELSE l_extendedprice END AS price, (CASE WHEN l_quantity > 20 OR l_quantity IS NULL THEN 10 ELSE 0 END)::INTEGER AS stock FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as products, their lines as variants, one row a variant."""
    line = F.struct(_text("l_linenumber").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat(F.lit("line "), _text("l_linenumber"))).alias("name_en"), F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("price"), F.lit(None).cast("string").alias("sku"), (F.col("l_quantity") > 20).alias("in_stock"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("product_variants"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title_en"), F.col("o_totalprice").alias("price"), F.lit(True).alias("in_stock"))
    return matching.explode_variants(o.join(lines, F.col("id") == F.col("l_orderkey"), "left")).select("id", "variant_id", "title_en", "price", "stock")


@query("""
SELECT p_partkey AS row, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey::VARCHAR END, 's' || p_size::VARCHAR) AS id, 's' || p_size::VARCHAR AS slug, p_name AS name_en, upper(p_name) AS name_ar, p_type AS colour,
 'a_' || p_partkey::VARCHAR || '.png' AS picture, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_size END::DOUBLE AS variant_price FROM part""")
def crawl_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested crawl records made flat, ids repaired, images and variants shaped."""
    n = F.col("p_size")
    rows = _parts(spark, sf).select(
        F.col("p_partkey").alias("row"), F.when(n % 3 == 0, "").otherwise(_text("p_partkey")).alias("id"), F.concat(F.lit("s"), _text("p_size")).alias("slug"), F.struct(F.col("p_name").alias("en"), F.upper("p_name").alias("ar")).alias("name"),
        F.create_map(F.lit("colour"), F.col("p_type")).alias("specification"), F.array(F.concat(F.lit("https://s.com/a%20"), _text("p_partkey"), F.lit(".png"))).alias("images"),
        F.array(F.struct(F.when(n % 2 == 1, n).otherwise(0).cast("double").alias("price"))).alias("variants"), F.col("p_retailprice").alias("price"),
    )
    out = feeds.shaped(feeds.repaired_ids(feeds.flatten_crawl(rows)))
    colour = next(c for c in out.columns if c.endswith("colour"))
    picture = F.regexp_replace(F.get("images", 0)["filename"], "_20", "_")
    return out.select("row", "id", "slug", "name_en", "name_ar", F.col(colour).alias("colour"), picture.alias("picture"), F.get("variants", 0)["price"].alias("variant_price"))


@query("""
WITH f AS (SELECT p_name || '.png' AS filename, min(p_partkey) AS p FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'none' WHEN p_name LIKE 'cold%' THEN 'local' ELSE 'cdn' END AS image_status, (SELECT min(p_partkey) FROM part q WHERE q.p_name = part.p_name AND q.p_size % 5 <> 0) AS first_product FROM part""")
def image_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Image status by a listing of files, and the first product of each file."""
    p = _parts(spark, sf).withColumn("image", F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("https://s.com/"), "p_name", F.lit(".png?v=1"))))
    files = p.select(F.concat("p_name", F.lit(".png")).alias("filename"), "p_name").distinct()
    status = results.with_image_status(p, "image", files.where("p_name like 'cold%'"))
    owners = feeds.product_of_file(files.select("filename"), p.select("image", F.col("p_partkey").alias("first_product")), "image", "first_product", "first_product")
    return status.withColumn("filename", F.concat("p_name", F.lit(".png"))).join(owners, "filename", "left").select("p_partkey", "image_status", "first_product")


@query("""
SELECT 'disc-' || c_mktsegment || '-' || substr(md5(c_mktsegment || ':' || c_name), 1, 10) AS id, lower(replace(c_name, '#', '-')) AS slug, c_name AS title_en, 'uncategorized' AS category_l1_slug, c_mktsegment AS source FROM customer""")
def discovered_rows(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.discovered_products(table(spark, sf, "customer"), "c_mktsegment", "c_name")


# results and decisions


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    """Two candidates for every part; scores by size."""
    def one(idx: Column, score: Column) -> Column:
        return F.struct(idx.cast("long").alias("idx"), score.alias("score"), s.status_of(score).alias("status"), F.concat(F.col("p_type"), F.lit(" "), idx.cast("string")).alias("normalized"))

    first, second = F.col("p_size") / 50.0, F.col("p_size") / 100.0
    p = _parts(spark, sf)
    return p.select(F.col("p_partkey").alias("row_index"), F.col("p_name").alias("original_name"), F.col("p_brand").alias("matching_method"), first.alias("top_score"), F.array(one(F.col("p_partkey"), first), one(F.col("p_partkey") + 1, second)).alias("matches"))


_ST = "CASE WHEN p_size / 50.0 >= 0.6 THEN 'matched' WHEN p_size / 50.0 >= 0.4 THEN 'review' ELSE 'no_match' END"


@query(f"""
SELECT p_partkey AS row_index, p_brand AS matching_method, {_ST} AS status FROM part WHERE (contains(p_name, 'cold') OR contains(lower(p_type), 'cold') OR contains(p_partkey::VARCHAR, 'cold')) AND {_ST} IN ('matched', 'review') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#13')""")
def result_filters(spark: SparkSession, sf: str) -> DataFrame:
    """By text in the name or a candidate, by statuses and by methods."""
    out = results.filtered(_matched(spark, sf), "COLD", ("matched", "review"), ("Brand#1", "Brand#2", "Brand#13"))
    return out.select("row_index", "matching_method", results.top_status().alias("status"))


_PICKED = "p_size > 40"


@query(f"""
SELECT p_partkey AS row_index, CASE WHEN {_PICKED} THEN p_partkey + 1 ELSE p_partkey END AS best, round(CASE WHEN {_PICKED} THEN 1.0 ELSE p_size / 50.0 END, 9) AS score, CASE WHEN {_PICKED} THEN 'matched' ELSE {_ST} END AS status,
 CASE WHEN {_PICKED} THEN p_partkey ELSE p_partkey + 1 END::VARCHAR AS candidate_2_id, p_brand AS method FROM part""")
def match_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """The second candidate promoted for every part of a large size."""
    decisions = _parts(spark, sf).where(_PICKED).select(F.col("p_partkey").alias("row_index"), (F.col("p_partkey") + 1).alias("idx"))
    out = results.promote(_matched(spark, sf), decisions)
    cols = out.select("*", *results.candidate_columns(2))
    picked = {"best": results.top("idx"), "score": F.round("top_score", 9), "status": results.top_status(), "method": F.col("matching_method")}
    return results.picked_fields(cols, picked | {"row_index": F.col("row_index")}, ["row_index", "best", "score", "status", "method", "unknown", "orig_col_0"], ["candidate_2_id"])


@query(f"""
WITH r AS (SELECT p_partkey, CASE WHEN {_PICKED} THEN p_partkey + 1 ELSE p_partkey END AS best, CASE WHEN {_PICKED} THEN 1.0 ELSE p_size / 50.0 END AS score FROM part)
SELECT r.p_partkey AS row_index, best::VARCHAR AS candidate_1_id, CASE WHEN score >= 0.60 THEN coalesce(c.p_name, '') ELSE '' END AS name FROM r LEFT JOIN part c ON c.p_partkey = best""")
def rebuilt_run(spark: SparkSession, sf: str) -> DataFrame:
    """The final sheet of every part made again from its stored run, with decisions."""
    path = new_path(spark, "runs")
    decisions = _parts(spark, sf).where(_PICKED).select(F.col("p_partkey").alias("row_index"), (F.col("p_partkey") + 1).alias("idx"))
    linking.store_run(_matched(spark, sf).withColumn("exact_idx", F.lit(None).cast("long")), path, "first")
    out = linking.rebuilt_sheet(spark, path, "first", _parts(spark, sf), "p_partkey", {"name[en]": "p_name"}, decisions)
    return out.select("row_index", "candidate_1_id", F.col("`name[en]`").alias("name"))


@query(f"""
WITH r AS (SELECT CASE WHEN {_PICKED} THEN 'matched' ELSE {_ST} END AS st FROM part)
SELECT count(*) AS total, count(*) FILTER (st = 'matched') AS matched, count(*) FILTER (st = 'review') AS review, count(*) FILTER (st = 'no_match') AS no_match, round(count(*) FILTER (st = 'matched') / count(*) * 100, 1) AS accuracy FROM r""")
def override_counts(spark: SparkSession, sf: str) -> DataFrame:
    decisions = _parts(spark, sf).where(_PICKED).select(F.col("p_partkey").alias("row_index"), (F.col("p_partkey") + 1).alias("idx"))
    return results.matched_counts(results.promote(_matched(spark, sf), decisions))


@query("""
SELECT p_partkey AS row_index, p_partkey || '/' || p_name || ';' || (p_partkey + 1) || '/' || coalesce((SELECT q.p_name FROM part q WHERE q.p_partkey = part.p_partkey + 1), '-') AS names FROM part""")
def backfilled_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Stored candidates with names renewed from the catalog, in their order."""
    names = _parts(spark, sf).select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("normalized"))
    out = results.backfilled(_matched(spark, sf), names, ["normalized"])
    return out.select("row_index", F.array_join(F.transform("matches", lambda m: F.concat_ws("/", m["idx"].cast("string"), F.coalesce(m["normalized"], F.lit("-")))), ";").alias("names"))


@query("""
WITH e AS (SELECT o_orderkey k, CASE o_orderstatus WHEN 'O' THEN 'review' ELSE 'matched' END st, o_custkey % 3 a FROM orders)
SELECT k AS row_index, CASE WHEN a = 1 AND st = 'review' THEN 'overridden' WHEN a = 2 THEN 'skipped' ELSE 'pending' END AS apply_status, CASE WHEN a = 0 THEN 'accepted' ELSE st END AS discovery_status FROM e""")
def review_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Override and skip of enrichment rows, plain edits of discovery rows."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_index"), F.when(F.col("o_orderstatus") == "O", "review").otherwise("matched").alias("enrichment_status"), F.lit("pending").alias("apply_status"), (F.col("o_custkey") % 3).alias("a"))
    o = o.withColumn("discovery_status", F.col("enrichment_status"))
    acts = o.where("a > 0").select("row_index", F.when(F.col("a") == 1, "override").otherwise("skip").alias("action"))
    edits = o.where("a = 0").select("row_index", F.lit("accepted").alias("status"))
    return enrichment.status_edits(enrichment.decide(o, acts), edits, "discovery_status").select("row_index", "apply_status", "discovery_status")


@query("""
SELECT count(*) AS total, count(*) FILTER (p_size > 30) AS matched, round(count(*) FILTER (p_size > 30) / count(*) * 100, 1) AS accuracy, count(*) FILTER (p_name LIKE '%small%' OR p_name LIKE '%large%') AS modified FROM part""")
def accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    """Share of good rows, and how many names a change of forms modifies."""
    p = _parts(spark, sf).withColumn("new", F.trim(F.regexp_replace("p_name", "small|large", "")))
    return analytics.accuracy(p, F.col("p_size") > 30).join(analytics.changed_values(p, "p_name", "new").select("total", "modified"), "total")


# dictionaries


@query("""
WITH t AS (SELECT p_partkey, p_brand k, p_type v FROM part),
old AS (SELECT k, min_by(v, p_partkey) v, 'a' || k AS ar FROM t GROUP BY k), new AS (SELECT k, max_by(v, p_partkey) v FROM t WHERE k < 'Brand#2' GROUP BY k)
SELECT o.k AS brand, coalesce(n.v, o.v) AS kind, CASE WHEN n.k IS NULL OR o.k LIKE '%1' THEN o.ar ELSE 'new' END AS title_ar FROM old o LEFT JOIN new n USING (k)""")
def brand_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert of brands in which a stored translation stays."""
    p = _parts(spark, sf)
    old = p.groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("p_type", "p_partkey").alias("kind")).withColumn("title_ar", F.concat(F.lit("a"), "brand"))
    new = p.where("p_brand < 'Brand#2'").groupBy(F.col("p_brand").alias("brand")).agg(F.max_by("p_type", "p_partkey").alias("kind")).withColumn("title_ar", F.lit("new"))
    renewed = new.where("brand not like '%1'")
    return tables.upsert_keeping(tables.upsert(old, renewed, "brand"), new.where("brand like '%1'"), "brand", "title_ar").select("brand", "kind", "title_ar")


@query("""
WITH w AS (SELECT DISTINCT word AS key FROM (SELECT unnest(string_split(p_name, ' ')) word FROM part) UNION SELECT DISTINCT lower(p_type) FROM part)
SELECT key, CASE WHEN key IN ('small', 'large', 'medium') THEN 'form' ELSE 'general' END AS token_type, CASE WHEN key = 'cold' THEN 'kalt' ELSE key END AS value FROM w WHERE key <> 'hot'""")
def token_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of all names with their types, one pair deleted, one renewed."""
    words = _parts(spark, sf).select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("key"), F.col("p_partkey").alias("ord"))
    entries = catalog.dictionary_tables(words.withColumn("value", F.col("key")), d.UNITS, d.FORMS)
    changed = entries.where("key = 'cold'").withColumn("value", F.lit("kalt"))
    return tables.patch_dictionary(entries, entries.where("key = 'hot'").select("key", "value"), changed, "key", "ord").select("key", "token_type", "value")


# files


@query("""
SELECT p_partkey::VARCHAR AS id, p_name || ',' || p_type AS name, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_size % 2 = 0 THEN 'semicolon' ELSE 'tab' END AS kind FROM part""")
def sheet_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every part through sheets of two delimiters, each found by its lines."""
    p = _parts(spark, sf).select(_text("p_partkey").alias("id"), F.concat_ws(",", "p_name", "p_type").alias("name"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("brand"), F.when(F.col("p_size") % 2 == 0, "semicolon").otherwise("tab").alias("kind"))
    semi, tabs = new_path(spark, "semicolon") + ".csv", new_path(spark, "tab") + ".tsv"
    p.where("kind = 'semicolon'").write.option("sep", ";").option("header", True).csv(semi)
    catalog.write_result(p.where("kind = 'tab'"), tabs, "tsv")
    return sheets.read_sheet(spark, semi).unionByName(sheets.read_sheet(spark, tabs)).select("id", "name", "brand", "kind")


@query("""
SELECT 3 AS expected, 4 AS found, p_partkey::VARCHAR || ';"' || p_name || '; x";' || p_size::VARCHAR || ';more' AS record FROM part WHERE p_size % 10 = 0""")
def bad_sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a field more than the header, quotes regarded."""
    line = F.concat(_text("p_partkey"), F.lit(';"'), "p_name", F.lit('; x";'), _text("p_size"), F.when(F.col("p_size") % 10 == 0, ";more").otherwise(""))
    path = new_path(spark, "sheet") + ".csv"
    lines = spark.range(1).select(F.lit("id;name;size").alias("value"))
    n = 4
    rows = _parts(spark, sf).repartition(n, "p_partkey").select(line.alias("value"), F.lit(1).alias("o"), F.spark_partition_id().alias("f"))
    heads = lines.crossJoin(F.broadcast(spark.range(n).select(F.col("id").cast("int").alias("f")))).select("value", F.lit(0).alias("o"), "f")
    rows.unionByName(heads).repartition(n, "f").sortWithinPartitions("f", "o").select("value", "f").write.partitionBy("f").text(path)
    sheet = sheets.read_sheet(spark, path, ";")
    return sheets.bad_rows(sheet.drop("f"), ";")


@query("""
SELECT o_orderstatus AS run_id, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END)::BIGINT AS marks FROM orders GROUP BY 1""")
def replaced_run(spark: SparkSession, sf: str) -> DataFrame:
    """All runs written, one of them again: the others stay, it is replaced."""
    path = new_path(spark, "runs")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("run_id"), F.lit(1).alias("mark"))
    catalog.write_run(rows, path)
    catalog.write_run(rows.where("run_id = 'F'").withColumn("mark", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("mark").alias("marks"))


@query("""
SELECT pos, part, count(*) AS n FROM (SELECT unnest([p_brand, p_name, p_size::VARCHAR]) AS part, unnest([0, 1, 2])::INTEGER AS pos FROM part) GROUP BY 1, 2""")
def name_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``brand | description | size`` lines written and read."""
    path = new_path(spark, "names")
    _parts(spark, sf).select(F.concat_ws(" | ", "p_brand", "p_name", _text("p_size")).alias("value")).write.text(path)
    return catalog.name_dump(spark, path).groupBy("pos", "part").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT count(*) AS c FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) rn FROM customer)
SELECT c_custkey, ((rn - 1) // ceil(c / 7)::BIGINT)::INTEGER AS part FROM r, n""")
def chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    """Contiguous chunks of equal size, one folder each."""
    path = new_path(spark, "chunks")
    catalog.write_chunks(table(spark, sf, "customer").select("c_custkey", "c_name"), path, 7, ["c_name", "c_custkey"])
    return spark.read.parquet(path).select("c_custkey", "part")


@query("""
SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def table_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A selected and a protected table copied; the third is left out."""
    root = new_path(spark, "snapshot")
    names = catalog.snapshot({n: table(spark, sf, n) for n in ("nation", "supplier", "region")}, ["supplier", "unknown"], ["nation"], root)
    out = [spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in sorted(names)]
    return out[0].unionByName(out[1])


@query("""
SELECT user_id::VARCHAR AS job, count(*) AS n, sum(event_id)::BIGINT AS total FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def crawl_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Counters from log lines, as a stream would keep them."""
    found = F.when(F.col("event_type") == "purchase", F.concat(F.lit("[job "), _text("user_id"), F.lit("] found "), _text("event_id"), F.lit(" products"))).otherwise(F.concat(F.lit("[job "), _text("user_id"), F.lit("] "), "event_type"))
    logs = table(spark, sf, "events").select(found.alias("value"))
    return stream.running_counts(stream.progress_of_logs(logs), ["job"], "found")
