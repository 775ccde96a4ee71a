"""Jobs over a table of pages (page_id, url, html): products, links, platforms."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text as t

_LD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
_OFFER = "struct<price:string,priceCurrency:string,gtin13:string,gtin:string>"
_PRODUCT = f"struct<`@type`:string,name:string,image:string,sku:string,gtin13:string,gtin14:string,gtin12:string,gtin8:string,gtin:string,mpn:string,brand:string,offers:{_OFFER}>"
# Labels of table rows by role, texts of brand links that name no brand.
LABELS = {
    "title_en": ("الاسم التجاري", "trade name", "product name", "name"), "title_ar": ("الاسم العربي", "arabic name"),
    "price": ("السعر الحالي الجديد", "current price", "new price", "price"), "brand": ("الشركة المنتجة", "manufacturer", "brand", "company"),
    "barcode": ("رمز الباركود", "barcode", "ean", "gtin"),
}
NO_BRANDS = ("brand", "brands", "all brands", "جميع البرندات")
_BAD_IMAGE = r"(?i)logo|placeholder|sprite|icon|pixel|blank|\.svg|data:"


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element, tags and entities out."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return t.present(plain(inner))


def plain(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return t.collapse(c)


def meta(html: Column, name: str) -> Column:
    """content of a meta tag by property or name."""
    a = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:property|name)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(html, rf"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:property|name)=[\"']{name}[\"']", 1)
    return t.first_present(a, b)


def itemprop(html: Column, name: str) -> Column:
    a = F.regexp_extract(html, rf"(?is)itemprop=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    b = plain(F.regexp_extract(html, rf"(?is)itemprop=[\"']{name}[\"'][^>]*>([^<]*)<", 1))
    return t.first_present(a, b)


def ld_products(pages: DataFrame) -> DataFrame:
    """page_id, ord, product: every linked-data product of every page, whether the
    block is an object, an array, a ``@graph`` or an ``ItemList``."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LD), F.lit(1))).alias("ord", "j"))
    many = F.from_json("j", f"array<{_PRODUCT}>")
    graph = F.from_json("j", f"struct<`@graph`:array<{_PRODUCT}>>")["@graph"]
    items = F.from_json("j", f"struct<itemListElement:array<struct<item:{_PRODUCT}>>>")["itemListElement"]
    listed = F.transform(items, lambda x: x["item"])
    one = F.array(F.from_json("j", _PRODUCT))
    every = F.when(F.trim("j").startswith("["), many).otherwise(F.coalesce(graph, listed, one))
    return blocks.select("page_id", "ord", F.explode(every).alias("product")).where(F.col("product")["@type"] == "Product")


def ld_gtins(product: Column) -> Column:
    offers = product["offers"]
    return F.filter(F.array(*[product[k] for k in ("gtin13", "gtin14", "gtin12", "gtin8", "gtin", "sku", "mpn")], offers["gtin13"], offers["gtin"]), lambda x: x.isNotNull())


def table_rows(html: Column) -> Column:
    """array of struct(label, value): the first two cells of every table row."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)))
    return F.transform(F.filter(cells, lambda c: F.size(c) >= 2), lambda c: F.struct(plain(F.get(c, 0)).alias("label"), plain(F.get(c, 1)).alias("value")))


def tables_of(pages: DataFrame) -> DataFrame:
    """page_id, label, value: the first two cells of every table row."""
    return pages.where(F.col("html").contains("<t")).select("page_id", F.explode(table_rows(F.col("html"))).alias("r")).select("page_id", "r.label", "r.value")


def table_value(rows: Column, role: str) -> Column:
    """Value of the first row whose label holds one of the role's labels."""
    hit = F.filter(rows, lambda r: F.lower(r["label"]).rlike("|".join(LABELS[role])))
    return t.present(F.get(hit, 0)["value"])


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, title of every link, absolute, in page order."""
    each = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*href=[\"']([^\"'#]*)[\"'][^>]*>.*?</a>"), F.lit(0))).alias("pos", "a"))
    href = F.regexp_extract("a", r"(?is)href=[\"']([^\"'#]*)[\"']", 1)
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    return each.select("page_id", "url", "pos", F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat_ws("/", origin, href)).alias("href"), plain(F.col("a")).alias("title"))


def ranked_links(links: DataFrame, words: Column, include: str | None = None, exclude: str | None = None, k: int = 10) -> DataFrame:
    """The k most relevant links of each page; each target once, at its first
    place; relevance is the number of query words in target and title."""
    picked = links
    if include:
        picked = picked.where(F.col("href").rlike(include))
    if exclude:
        picked = picked.where(~F.col("href").rlike(exclude))
    one = picked.groupBy("page_id", "href").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))
    scored = one.withColumn("relevance", t.relevance(words, F.concat_ws(" ", "href", "title")))
    w = Window.partitionBy("page_id").orderBy(F.desc("relevance"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def platform(html: Column, url: Column) -> Column:
    return (
        F.when(html.rlike(r"(?i)cdn\.shopify\.com|Shopify\.theme"), "shopify").when(html.rlike(r"(?i)woocommerce|wp-content/plugins"), "woocommerce")
        .when(html.rlike(r"(?i)__NEXT_DATA__"), "next").otherwise("custom")
    )


def images(html: Column, product: Column | None = None) -> Column:
    """Distinct good image URLs, in page order."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)(?:src|content|href)=[\"'](https?://[^\"']+?\.(?:jpe?g|png|webp))(?:\?[^\"']*)?[\"']"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: ~u.rlike(_BAD_IMAGE)))


def shown_price(html: Column) -> Column:
    """Price beside a currency sign in the page's text."""
    return t.page_price(F.regexp_extract(plain(html), r"(?i)(?:EGP|USD|EUR|LE|\$|€)\s*(\d[\d,]*(?:\.\d+)?)", 1))


def price(html: Column) -> Column:
    """Price by meta tag, itemprop, then a currency text."""
    return F.coalesce(*[t.page_price(meta(html, f"{x}:price:amount")) for x in ("product", "og")], t.page_price(itemprop(html, "price")), shown_price(html))


def _brand_link(html: Column) -> Column:
    texts = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href=[\"'][^\"']*brand[^\"']*[\"'][^>]*>(.*?)</a>"), F.lit(1)), plain)
    return F.get(F.filter(texts, lambda x: (x != "") & ~F.lower(x).isin(*NO_BRANDS)), 0)


def page_products(pages: DataFrame, site: str = "") -> DataFrame:
    """One row a page, each field by its chain, the first that is present.

    title: table, heading that is no site title, ``og:title``, linked data, the
    page's title; a title of two languages is split. price: meta tags, itemprop,
    linked data, table, currency text. image: meta tags, linked data, the first good
    image. brand: table, linked data, itemprop, brand link. barcode: the first valid
    of table, linked data and itemprop. Meta tags and marked elements are cut out of
    the page once, and the chains read these."""
    ld = ld_products(pages).groupBy("page_id").agg(F.min_by("product", "ord").alias("ld"))
    every = lambda pattern: F.concat_ws("\n", F.regexp_extract_all("html", F.lit(pattern), F.lit(0)))
    j = pages.join(ld, "page_id", "left").withColumn("_meta", every(r"(?is)<meta\b[^>]*>")).withColumn("_marked", every(r"(?is)<[a-z][^>]*\bitemprop=[^>]*>[^<]*<"))
    j = j.withColumn("_rows", table_rows(F.col("html"))).withColumn("_h1", t.clean_title(tag_text(F.col("html"), "h1"), site)).withColumn("_h2", t.clean_title(tag_text(F.col("html"), "h2"), site))
    html, ldc, metas, marked, rows, h1, h2 = (F.col(c) for c in ("html", "ld", "_meta", "_marked", "_rows", "_h1", "_h2"))
    og, head = meta(metas, "og:title"), F.when(~t.site_title(h1), h1)
    title = t.clean_title(t.first_present(table_value(rows, "title_en"), head, h2, og, ldc["name"], h1, tag_text(html, "title")), site)
    j = j.withColumn("_title", title)
    two, prices = t.bilingual(F.col("_title")), [t.page_price(meta(metas, f"{x}:price:amount")) for x in ("product", "og")]
    arabic = [table_value(rows, "title_ar"), F.when(t.has_arabic(h2), h2), two["ar"], t.bilingual(og)["ar"], F.when(t.has_arabic(ldc["name"]), ldc["name"])]
    codes = F.concat(F.array(table_value(rows, "barcode")), F.coalesce(ld_gtins(ldc), F.array().cast("array<string>")), F.array(itemprop(marked, "gtin13"), itemprop(marked, "sku")))
    pictures = [*[t.present(meta(metas, x)) for x in ("og:image:secure_url", "og:image", "twitter:image")], t.present(ldc["image"])]
    return j.select(
        "page_id", "url", t.domain_of(F.col("url")).alias("domain"), F.col("_title").alias("title"), t.first_present(two["en"], F.col("_title")).alias("title_en"), t.first_present(*arabic).alias("title_ar"),
        F.coalesce(*prices, t.page_price(itemprop(marked, "price")), t.page_price(ldc["offers"]["price"]), t.page_price(table_value(rows, "price")), shown_price(html)).alias("price"),
        F.coalesce(*[F.when(~x.rlike(_BAD_IMAGE), x) for x in pictures], F.get(images(html), 0)).alias("image"),
        t.first_present(table_value(rows, "brand"), ldc["brand"], itemprop(marked, "brand"), _brand_link(html)).alias("brand"), F.trim(F.get(F.filter(codes, t.valid_gtin), 0)).alias("barcode"),
        platform(html, F.col("url")).alias("platform"),
    )


def listing_prices(pages: DataFrame) -> DataFrame:
    """Least, most and mean of the prices of each page."""
    each = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)itemprop=[\"']price[\"'][^>]*content=[\"']([^\"']*)[\"']"), F.lit(1))).alias("p"))
    return each.select("page_id", t.page_price(F.col("p")).alias("p")).groupBy("page_id").agg(F.min("p").alias("least"), F.max("p").alias("most"), F.avg("p").alias("mean"))


def element_profile(pages: DataFrame, tags: Sequence[str] = ("h1", "h2", "title", "article", "nav", "footer", "p", "li", "a", "img", "table", "form")) -> DataFrame:
    """domain, tag, pages, n: how often each element occurs, per domain."""
    host = t.domain_of(F.col("url"))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("tag"), F.regexp_count("html", F.lit(rf"(?i)<{x}\b")).alias("n")) for x in tags])).alias("e")
    return pages.select(host.alias("domain"), each).where("e.n > 0").groupBy("domain", F.col("e.tag").alias("tag")).agg(F.count("*").alias("pages"), F.sum("e.n").alias("n"))


def search_forms(pages: DataFrame) -> DataFrame:
    """domain, template: a search URL of the first page that gives one: by a /shop/
    path that is no category, else from the page's first form whose action names a
    search or shop and that has a query input."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, d, _search_template(h or "", u or "")) for i, d, u, h in zip(pdf["page_id"], pdf["domain"], pdf["url"], pdf["html"])]
            yield pd.DataFrame(rows, columns=["page_id", "domain", "template"])

    found = pages.select("page_id", t.domain_of(F.col("url")).alias("domain"), "url", "html").mapInPandas(parse, "page_id long, domain string, template string")
    return found.where("template is not null").groupBy("domain").agg(F.min_by("template", "page_id").alias("template"))


class _Forms(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.forms: list[tuple[str, list[str]]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "form":
            self.forms.append((named.get("action") or "", []))
            self.open = True
        elif tag == "input" and self.open and named.get("name"):
            self.forms[-1][1].append(named["name"])

    def handle_endtag(self, tag):
        if tag == "form":
            self.open = False


def _search_template(html: str, url: str) -> str | None:
    parts = re.match(r"(?:(https?)://)?([^/?#]*)([^?#]*)", url, re.I)
    origin, path = f"{parts[1] or 'https'}://{parts[2]}", parts[3].lower()
    if "/shop/" in path and "/category/" not in path:
        return f"{origin}/shop?search={{query}}"
    p = _Forms()
    p.feed(html)
    for action, names in p.forms:
        field = next((n for n in names if n.lower() in ("q", "query", "search", "keyword", "text", "s")), None)
        if field and re.search(r"search|shop", action, re.I):
            target = action if action.startswith("http") else f"{origin}/{action.removeprefix('/')}"
            return f"{target}{'&' if '?' in target else '?'}{field}={{query}}"
    return None


def store_documents(html: Column) -> Column:
    """The JSON texts of a store page that may hold its product, in order of trust:
    the analytics line, a product script, JSON scripts that name variants."""
    lines = F.regexp_extract_all(html, F.lit(r"(?s)(?:ShopifyAnalytics\.meta|var\s+meta)\s*=\s*(\{.*?\});"), F.lit(1))
    script = r"(?is)<script\b(?=[^>]*type=[\"']application/json[\"'])%s[^>]*>(.*?)</script>"
    marked = F.regexp_extract_all(html, F.lit(script % r"(?=[^>]*product-?json)"), F.lit(1))
    others = F.filter(F.regexp_extract_all(html, F.lit(script % ""), F.lit(1)), lambda x: x.contains("variants"))
    return F.concat(lines, marked, others)


def store_product(html: Column) -> Column:
    """The product of a store page as a variant value: the ``product`` object of the
    first of its documents that has one, or a document that has variants or a title
    itself; null where none has. Texts that are no JSON are passed over."""
    parsed = F.transform(store_documents(html), lambda x: F.try_parse_json(x))
    inner = F.transform(parsed, lambda v: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.product", "variant")).startswith("OBJECT"), F.try_variant_get(v, "$.product", "variant")), v))
    return F.get(F.filter(inner, lambda v: F.try_variant_get(v, "$.variants", "array<variant>").isNotNull() | F.try_variant_get(v, "$.title", "string").isNotNull()), 0)


def _source(v: Column) -> Column:
    """Address of an image that is a text or an object."""
    named = F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{x}", "string"), F.lit("")) for x in ("url", "src", "image")])
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(named)


def absolute(address: Column, origin: Column) -> Column:
    return (
        F.when(address.startswith("//"), F.concat(F.lit("https:"), address)).when(address.rlike("^https?:"), address)
        .otherwise(F.concat(origin, F.lit("/"), F.regexp_replace(address, "^/+", "")))
    )


def good_images(addresses: Column, origin: Column) -> Column:
    """Distinct absolute addresses that are no logos or placeholders, in order."""
    found = F.filter(addresses, lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.filter(F.transform(found, lambda x: absolute(x, origin)), lambda x: ~x.rlike(_BAD_IMAGE)))


def store_products(pages: DataFrame, divisor: int = 100) -> DataFrame:
    """page_id, title, vendor, slug, price, barcode, image, images of pages with store
    JSON or linked data. The JSON's product comes first: the first variant's price (in
    minor units from 100 on) and barcode, its featured image, images and media, as
    texts or objects. What it lacks comes from linked data, the page's heading and
    ``og:image``."""
    ld = ld_products(pages).groupBy("page_id").agg(F.min_by("product", "ord").alias("ld"))
    j = pages.select("page_id", "url", "html").withColumn("p", store_product(F.col("html"))).join(ld, "page_id", "left").where("p IS NOT NULL OR ld IS NOT NULL")
    p, ldc, html = F.col("p"), F.col("ld"), F.col("html")

    def text(path: str) -> Column:
        return t.present(F.try_variant_get(p, path, "string"))

    def many(path: str) -> Column:
        return F.coalesce(F.try_variant_get(p, path, "array<variant>"), F.array().cast("array<variant>"))

    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    single = F.filter(F.array(*[F.try_variant_get(p, f"$.{x}", "variant") for x in ("featured_image", "image")]), lambda v: v.isNotNull())
    media = F.transform(many("$.media"), lambda v: F.coalesce(F.try_variant_get(v, "$.src", "string"), F.try_variant_get(v, "$.preview_image.src", "string")))
    own = good_images(F.concat(F.transform(F.concat(single, many("$.images")), _source), media), origin)
    linked = F.when(ldc["image"].startswith("{"), F.coalesce(F.get_json_object(ldc["image"], "$.url"), F.get_json_object(ldc["image"], "$.image"))).otherwise(ldc["image"])
    second, third = (good_images(F.array(x), origin) for x in (linked, meta(html, "og:image")))
    images_ = F.when(F.size(own) > 0, own).when(F.size(second) > 0, second).otherwise(third)
    codes = F.concat(F.array(text("$.variants[0].barcode")), F.coalesce(ld_gtins(ldc), F.array().cast("array<string>")))
    handle = t.present(F.regexp_extract("url", r"/products/([^/?#]+)", 1))
    return j.select(
        "page_id", t.first_present(text("$.title"), ldc["name"], tag_text(html, "h1")).alias("title"), text("$.vendor").alias("vendor"), t.first_present(text("$.handle"), handle).alias("slug"),
        F.coalesce(t.minor_price(t.first_present(text("$.variants[0].price"), text("$.price")), divisor), t.page_price(ldc["offers"]["price"])).alias("price"),
        F.trim(F.get(F.filter(codes, t.valid_gtin), 0)).alias("barcode"), images_.alias("images"),
    ).withColumn("image", F.get("images", 0))


def page_images(pages: DataFrame) -> DataFrame:
    """page_id, image: distinct image addresses anywhere in the source, entities
    and escaped slashes resolved."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)(https?:(?:\\?/){2}[^\s\"'<>]+?\.(?:jpe?g|png|webp|gif))"), F.lit(1))
    plain_url = F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, r"\\/", "/"), "&amp;", "&"))
    return pages.select("page_id", F.explode(F.array_distinct(plain_url)).alias("image"))


_ATTRIBUTE = r"(?is)\b%s\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double or single quotes, entities resolved; null if absent or empty."""
    pattern = _ATTRIBUTE % rf"(?<![-\w]){name}"
    return t.present(plain(F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))))


def last_segment(href: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(href, "[?#].*$", ""), "^/+|/+$", ""), "/"), -1)


def menus(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, label, depth of the links of lists: depth counts the
    lists that are open before the link, so 2 is a sub-entry."""
    parts = F.regexp_extract_all("html", F.lit(r"(?is)(<ul\b|</ul>|<a\b[^>]*>.*?</a>)"), F.lit(1))
    each = pages.select("page_id", F.posexplode(parts).alias("pos", "part"))
    step = F.when(F.lower("part").startswith("<ul"), 1).when(F.lower("part") == "</ul>", -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("page_id").orderBy("pos"))
    links = each.withColumn("depth", depth).where(F.lower("part").startswith("<a")).withColumn("href", attribute(F.regexp_extract("part", r"(?is)^<a\b[^>]*>", 0), "href"))
    return links.where("href IS NOT NULL").select("page_id", "pos", "href", plain(F.col("part")).alias("label"), "depth")


def category_tree(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, href, slug, sub_categories of the first-level links of a
    page's lists: each link of a list in a list belongs to the first-level link that
    was last before it. A sub-entry before any first-level link has no parent."""
    links = menus(pages).where("depth >= 1")
    under = F.max(F.when(F.col("depth") == 1, F.col("pos"))).over(Window.partitionBy("page_id").orderBy("pos"))
    entry = F.struct("pos", F.col("label").alias("name"), "href", last_segment(F.col("href")).alias("slug"))
    placed = links.withColumn("_top", under).where("_top IS NOT NULL").withColumn("_e", entry)
    one = placed.groupBy("page_id", "_top").agg(F.min_by("_e", "pos").alias("top"), F.array_sort(F.collect_list(F.when(F.col("depth") > 1, F.col("_e")))).alias("subs"))
    return one.select("page_id", "top.*", F.transform("subs", lambda x: x.dropFields("pos")).alias("sub_categories"))


def brand_cards(pages: DataFrame) -> DataFrame:
    """page_id, pos, name, href, slug, logo of the links to brands, each once at its
    first place: the link's text, else its picture's ``alt`` without the word logo, else
    the slug in title case; the picture's source or lazily loaded source."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("pos", "a"))
    tag, picture = F.regexp_extract("a", r"(?is)^<a\b[^>]*>", 0), F.regexp_extract("a", r"(?is)<img\b[^>]*>", 0)
    href = F.regexp_replace(attribute(tag, "href"), r"^https?://[^/?#]+", "")
    logo = t.first_present(attribute(picture, "src"), attribute(picture, "data-src"), attribute(picture, "data-lazy"))
    alt = F.trim(F.replace(attribute(picture, "alt"), F.lit(" logo"), F.lit("")))
    cards = each.withColumn("href", href).where(F.col("href").contains("brand")).withColumn("slug", last_segment(F.col("href")))
    name = t.first_present(plain(F.col("a")), alt, F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))))
    shaped = cards.select("page_id", "pos", name.alias("name"), "href", "slug", F.when(logo.startswith("//"), F.concat(F.lit("https:"), logo)).otherwise(logo).alias("logo"))
    return shaped.groupBy("page_id", "name", "href", "slug", "logo").agg(F.min("pos").alias("pos"))


def brand_links(links: DataFrame, pattern: str = r"/brands?/([^/?#]+)") -> DataFrame:
    """slug, label, n_pages: distinct brands that links lead to."""
    slug = F.lower(F.regexp_extract("href", pattern, 1))
    return links.select("page_id", "label", slug.alias("slug")).where("slug <> ''").groupBy("slug").agg(F.min("label").alias("label"), F.count_distinct("page_id").alias("n_pages"))
