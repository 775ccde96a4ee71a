"""Queries over pages with store JSON, nested menus and brand cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import pages
from linkloom.plans.queries import query, table


@query("""
WITH p AS (SELECT page_id, page_id % 5 k, page_id::VARCHAR i FROM pages)
SELECT page_id, 'Item ' || i AS title, CASE k WHEN 0 THEN 'Maker' WHEN 1 THEN 'Maker & Co' END AS vendor, CASE k WHEN 0 THEN 'h-' || i ELSE 'item-' || i END AS slug,
 CASE k WHEN 0 THEN round((page_id % 900 + 1000) / 100.0, 2) WHEN 1 THEN (page_id % 90 + 10) + 0.5 WHEN 2 THEN 1250.0 WHEN 3 THEN (page_id % 900 + 100) + 0.25 ELSE 12.5 END::DOUBLE AS price,
 CASE WHEN k IN (0, 3) THEN '4006381333931' END AS barcode,
 '[' || array_to_string(CASE k WHEN 0 THEN ['https://s.com/a' || i || '.jpg', 'https://shop.example/b.png'] WHEN 1 THEN ['https://s.com/f.jpg', 'https://s.com/x' || i || '.jpg'] WHEN 2 THEN ['https://shop.example/m.jpg']
  WHEN 3 THEN ['https://s.com/l' || i || '.png'] ELSE ['https://s.com/o.jpg'] END, ', ') || ']' AS images FROM p""")
def store_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a store's page: JSON with minor units, prices as text, images as
    texts, objects or media; one form has linked data only, one broken JSON before its
    product and its picture in a meta tag."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    whole, part = (F.col("page_id") % 900 + 1000).cast("string"), (F.col("page_id") % 90 + 10).cast("string")
    forms = [
        F.concat(F.lit('<script>ShopifyAnalytics.meta = {"product":{"title":"Item '), i, F.lit('","vendor":"Maker","handle":"h-'), i, F.lit('","variants":[{"price":'), whole, F.lit(',"barcode":"4006381333931"},{"price":1}],"images":["//s.com/a'), i, F.lit('.jpg","b.png","//s.com/a'), i, F.lit('.jpg","/logo.png"]}};</script>')),
        F.concat(F.lit('<script type="application/json" data-product-json>{"title":"Item '), i, F.lit('","vendor":"Maker & Co","variants":[{"price":"'), part, F.lit('.50","barcode":"123"}],"featured_image":{"url":"//s.com/f.jpg"},"images":[{"src":"https://s.com/x'), i, F.lit('.jpg"}]}</script>')),
        F.concat(F.lit("<script type='application/json'>{\"title\":\"Item "), i, F.lit('","variants":[{"price":"EGP 1,250"}],"media":[{"preview_image":{"src":"/m.jpg"}}]}</script>')),
        F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","name":"Item '), i, F.lit('","image":"https://s.com/l'), i, F.lit('.png","gtin13":"4006381333931","offers":{"price":"'), (F.col("page_id") % 900 + 100).cast("string"), F.lit('.25"}}</script>')),
        F.concat(F.lit('<script>var meta = {"product":};</script><meta property="og:image" content="https://s.com/o.jpg"><script type="application/json">{"title":"Item '), i, F.lit('","price":"12.50","variants":[]}</script>')),
    ]
    html = F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).when(k == 3, forms[3]).otherwise(forms[4])
    shown = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://shop.example/products/item-"), i, F.lit("?v=1")).alias("url"), html.alias("html"))
    found = pages.store_products(shown)
    return found.select("page_id", "title", "vendor", "slug", "price", "barcode", F.concat(F.lit("["), F.array_join("images", ", "), F.lit("]")).alias("images"))


@query("""
WITH p AS (SELECT page_id, page_id::VARCHAR i, page_id % 4 n FROM pages)
SELECT page_id, 'A & ' || i AS name, '/c/a-' || i || '?x=1' AS href, 'a-' || i AS slug,
 array_to_string(list_transform(range(0, n), lambda x: 'Sub ' || x || '=' || 's' || x || '-' || i), ',') AS subs FROM p
UNION ALL SELECT page_id, 'Last', 'https://s.com/c/last/', 'last', '' FROM p""")
def category_menu(spark: SparkSession, sf: str) -> DataFrame:
    """A menu of two levels on every page, with quotes of both kinds and entities."""
    i, n = F.col("page_id").cast("string"), (F.col("page_id") % 4).cast("int")
    subs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda x: x < n), lambda x: F.concat(F.lit("<li><a class=\"l2\" href='/c/s"), x.cast("string"), F.lit("-"), i, F.lit("/'><b>Sub</b> "), x.cast("string"), F.lit("</a></li>")))
    html = F.concat(F.lit("<a href='/home'>Home</a><ul><li><a href=\"/c/a-"), i, F.lit("?x=1\">A &amp; "), i, F.lit("</a><ul>"), F.array_join(subs, ""), F.lit("</ul></li><li><a href='https://s.com/c/last/'>Last</a></li><li><a name='x'>none</a></li></ul>"))
    tree = pages.category_tree(table(spark, sf, "pages").select("page_id", html.alias("html")))
    return tree.select("page_id", "name", "href", "slug", F.array_join(F.transform("sub_categories", lambda x: F.concat_ws("=", x["name"], x["slug"])), ",").alias("subs"))


@query("""
WITH p AS (SELECT page_id, page_id::VARCHAR i FROM pages)
SELECT page_id, 'Brand ' || i AS name, '/now/brands/b-' || i AS href, 'b-' || i AS slug, 'https://s.com/' || i || '.png' AS logo FROM p
UNION ALL SELECT page_id, 'Other', '/brands/other', 'other', '/o.png' FROM p
UNION ALL SELECT page_id, 'Plain Name', '/brands/plain-name', 'plain-name', NULL FROM p""")
def brand_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Brand cards on every page: named by text, by the picture or by the link."""
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<a href='https://s.com/now/brands/b-"), i, F.lit("'><img data-src='//s.com/"), i, F.lit(".png'>Brand "), i, F.lit('</a><a href="/brands/other"><img alt="Other logo" src="/o.png"></a><a href="/brands/plain-name"></a>'),
        F.lit('<a href="/brands/other"><img alt="Other logo" src="/o.png"></a><a href="/cart">Cart</a>'),
    )
    return pages.brand_cards(table(spark, sf, "pages").select("page_id", html.alias("html"))).select("page_id", "name", "href", "slug", "logo")
