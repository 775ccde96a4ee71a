"""Operators that the registered queries do not show whole."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity
from linkloom.operators import enrichment, matching, pages, results, tables
from linkloom.plans import linking
from linkloom.sources import catalog, sheets
from linkloom.streaming import matching as stream


def test_delimiters_and_bad_rows(spark, tmp_path):
    for name, text in (("a", "n,m\n1,2\n3,4,5\n"), ("b", "n;m\n1;2\n"), ("c", "n\tm\nx, y\tz\n"), ("d", "plain\n"), ("e", "n|m|o\n1|2|3\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r["file"].rsplit("/", 1)[-1][0]: r["sep"] for r in sheets.delimiters(spark, str(tmp_path)).collect()}
    assert got == {"a": ",", "b": ";", "c": "\t", "d": ",", "e": "|"}
    sheet = sheets.read_sheet(spark, str(tmp_path / "a.csv"))
    assert sheet.columns == ["n", "m", sheets.BAD] and [tuple(r) for r in sheets.bad_rows(sheet.cache()).collect()] == [(2, 3, "3,4,5")]
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, "x.xlsx")


def test_roles():
    assert sheets.header_role(["Price", "Item Name"], sheets.NAME) == "Item Name"
    assert sheets.header_role(["my barcode no"], sheets.BARCODE) == "my barcode no" and sheets.header_role(["a"], sheets.CODE) is None


def test_documents_to_catalog(spark, tmp_path):
    docs = [
        {"id": "1", "slug": "a", "title_en": "A", "price": 0, "final_price": 5.0, "level_two_category": {"slug": "c2"}, "level_three_category": [{"slug": "c3"}, {"slug": "c4"}], "brands": {"slug": "b"}, "product_variants": [{"id": "v1", "name_en": "A1", "price": 0}, {"id": "v2", "name_en": ""}]},
        {"slug": "only-slug", "name_en": "N", "_source": "x"},
        {"title_en": "no key"},
    ]
    (tmp_path / "docs.json").write_text(json.dumps(docs))
    read = catalog.read_documents(spark, str(tmp_path / "docs.json"))
    rows = {r["id"]: r for r in catalog.catalog_rows(read).collect()}
    assert set(rows) == {"1", "only-slug"} and rows["1"]["price"] is None and rows["1"]["final_price"] == 5 and rows["1"]["category_l2_slug"] == "c2" and rows["1"]["category_l3_slug"] == "c3"
    assert rows["1"]["brand_id"] == "b" and rows["only-slug"]["title_en"] == "N" and rows["only-slug"]["source"] == "x" and rows["1"]["source"] == "feed"
    assert catalog.decoded(catalog.catalog_rows(read)).where("doc.slug = 'a'").count() == 1
    variants = matching.explode_variants(read.where("id = '1'")).collect()
    assert [(v["title_en"], v["variant_id"]) for v in variants] == [("A1", "v1"), ("A", "v2")]


def test_versions_promote(spark, tmp_path):
    staging, live = catalog.Versions(spark, f"file://{tmp_path}/s"), catalog.Versions(spark, f"file://{tmp_path}/l")
    with pytest.raises(ValueError):
        live.read()
    staging.write(spark.range(3))
    staging.promote(live)
    staging.write(spark.range(0))
    with pytest.raises(ValueError):
        staging.promote(live)
    assert live.read().count() == 3


def test_upserts(spark):
    table = spark.createDataFrame([("a", "1", "me"), ("b", "2", None)], "k string, v string, by string")
    new = spark.createDataFrame([("b", "3", "you", 1), ("b", "4", "you", 2), ("c", "5", "you", 3), ("", "6", "you", 4)], "k string, v string, by string, o int")
    assert {tuple(r) for r in tables.upsert(table, new, "k", "o").collect()} == {("a", "1", "me"), ("b", "4", "you"), ("c", "5", "you")}
    kept = tables.upsert_keeping(table, spark.createDataFrame([("a", "9", "you")], "k string, v string, by string"), "k", "by")
    assert ("a", "9", "me") in {tuple(r) for r in kept.collect()}
    gone = tables.patch_dictionary(table, spark.createDataFrame([("a", "1")], "k string, v string"), new.limit(0), "k", "o")
    assert {r["k"] for r in gone.collect()} == {"b"}


def test_cascade_and_decisions(spark):
    index = matching.catalog_index(spark.createDataFrame([(1, "panadol 500 mg tab", "111", "c1"), (2, "brufen 400 mg tab", "222", "c2"), (3, "panadol extra tab", "111", None)], "id int, n string, barcode string, code string"), "n", "id")
    sheet = spark.createDataFrame([(0, "x", "111.0", None), (1, "y", None, "c2"), (2, "panadol 500 mg", None, None), (3, "hair brush", None, None), (4, "zzz", None, None)], "row_index long, normalized_name string, barcode string, code string")
    out = matching.match_cascade(sheet, index, "barcode", "code").cache()
    rows = {r["row_index"]: r for r in out.collect()}
    assert [rows[i]["matching_method"] for i in range(5)] == ["international barcode", "code", "normalizer", "skipped", "normalizer"]
    assert rows[0]["exact_idx"] == 3 and rows[1]["exact_idx"] == 2 and rows[2]["matches"][0]["idx"] == 1 and rows[4]["matches"] is None and rows[4]["top_score"] == 0
    chosen = results.promote(out, spark.createDataFrame([(2, 3)], "row_index long, idx long")).where("row_index = 2").first()
    assert [m["idx"] for m in chosen["matches"]] == [3, 1, 2] and chosen["top_score"] == 1.0
    back = results.backfilled(out.where("row_index = 2"), index.withColumn("normalized", F.upper("n")), ["normalized"]).first()
    assert [m["idx"] for m in back["matches"]] == [m["idx"] for m in rows[2]["matches"]] and back["matches"][0]["normalized"] == "PANADOL 500 MG TAB"
    assert [r["row_index"] for r in results.sorted_by(out, "score", True).collect()][:2] == [0, 1]


def test_budget_prefers_the_brand(spark):
    index = matching.catalog_index(spark.createDataFrame([(i, f"other tab{i} mg x") for i in range(20)] + [(90, "brand z")], "id int, n string"), "n", "id")
    q = spark.createDataFrame([(1, "brand mg x", ["brand", "mg", "x"])], "q_id long, q_name string, q_tokens array<string>")
    got = matching.token_candidates(q, index, budget=3).orderBy("bucket", "idx").collect()
    assert [r["idx"] for r in got] == [90, 0, 1] and got[0]["bucket"] == 0 and got[0]["candidate_count"] == 21


def test_decide_and_apply(spark):
    rows = spark.createDataFrame([(0, "7", None, 0.9, 1), (1, "8", "9", 0.9, 2), (2, "5", "5", 0.9, 3), (3, "6", None, 0.9, 99)], "row_index long, sheet string, db string, top_score double, pid long")
    e = enrichment.enrich(rows, "sheet", "db").cache()
    decided = enrichment.decide(e, spark.createDataFrame([(1, "override"), (0, "skip")], "row_index long, action string")).orderBy("row_index").collect()
    assert [r["apply_status"] for r in decided] == ["skipped", "overridden", "applied", "pending"]
    live = spark.createDataFrame([(1, None), (2, "9"), (3, "5")], "pid long, code string")
    changed, out = enrichment.apply_matched(e, live, "pid", "code", "sheet")
    assert {r["pid"]: r["code"] for r in changed.collect()} == {1: "7", 2: "9", 3: "5"}
    assert [r["outcome"] for r in out.orderBy("row_index").collect()] == ["updated", "not_applied", "not_applied", "missing_product"]


PAGE = """<html><head><title>Panadol | Shop</title><meta property="og:image" content="https://s.com/i/p.png"><script type="application/ld+json">%s</script></head>
<body><h1>Panadol Extra - بنادول اكسترا</h1><table><tr><td>Brand</td><td>GSK</td></tr><tr><td>one</td></tr></table><a href="/p/panadol">Panadol</a><a href="/cart">Cart</a><a href="/p/panadol">again</a></body></html>"""


@pytest.mark.parametrize(
    "ld",
    [
        {"@type": "Product", "name": "P", "gtin13": "4006381333931", "offers": {"price": "12.50"}},
        [{"@type": "Product", "name": "P", "gtin13": "4006381333931", "offers": {"price": "12.50"}}],
        {"@graph": [{"@type": "Product", "name": "P", "gtin13": "4006381333931", "offers": {"price": "12.50"}}]},
        {"@type": "ItemList", "itemListElement": [{"item": {"@type": "Product", "name": "P", "gtin13": "4006381333931", "offers": {"price": "12.50"}}}]},
    ],
)
def test_page_products(spark, ld):
    df = spark.createDataFrame([(1, "https://www.s.com/x", PAGE % json.dumps(ld))], "page_id long, url string, html string")
    r = pages.page_products(df).first()
    assert (r["title_en"], r["title_ar"], r["price"], r["barcode"], r["image"], r["domain"]) == ("Panadol Extra", "بنادول اكسترا", 12.5, "4006381333931", "https://s.com/i/p.png", "s.com")
    assert [tuple(x) for x in pages.tables_of(df).collect()] == [(1, "Brand", "GSK")]
    links = pages.ranked_links(pages.anchors(df), F.array(F.lit("panadol")), exclude="/cart").collect()
    assert [(x["href"], x["relevance"]) for x in links] == [("https://www.s.com/p/panadol", 1)]


def test_stream_of_matches_is_whole_after_a_rerun(spark, tmp_path):
    src, out, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    spark.range(10).write.parquet(str(src))
    read = spark.readStream.schema("id long").parquet(str(src))
    for _ in range(2):
        stream.match_stream(read, lambda b: b.withColumn("m", F.col("id") * 2), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 10
    logs = spark.createDataFrame([("[job 7] found 120 products",), ("noise",)], "value string")
    assert [tuple(r) for r in stream.progress_of_logs(logs).collect()] == [("7", 120)]


def test_numbered_is_dense_and_ordered(spark):
    df = spark.range(500).withColumn("x", F.xxhash64("id") % 50)
    got = tables.numbered(df, ["x", "id"]).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 501)) and [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)


def test_reinvestigate_scores_all_entries(spark):
    rows = [(i, f"panadol extra {'x' * (i % 7 + 20)} {'y' * 20}{i}", None) for i in range(300)] + [(900, "panadol extra red tabs", None), (901, "panadol extra 77", "panadol extra red")]
    index = spark.createDataFrame(rows, "id long, name string, title_ar string")
    index = matching.catalog_index(index, "name", "id")
    missed = spark.createDataFrame([("panadol extra red",)], "name string")
    got = [(r["idx"], r["rank"]) for r in matching.reinvestigate(missed, index).orderBy("rank").collect()]
    assert got[:2] == [(901, 1), (900, 2)]


def test_discover_asks_every_source(spark):
    # the preferred source holds the one page that is good enough, after 300 equal pages of another
    rows = [(i, "big.example", f"http://big.example/{i}", "red cotton shirt large") for i in range(300)] + [(900, "small.example", "http://small.example/", "red cotton shirt large")]
    products = spark.createDataFrame([(i, d, u, x, x) for i, d, u, x in rows], "page_id long, domain string, url string, title string, title_en string")
    profiles = spark.createDataFrame([("big.example", True, 2), ("small.example", True, 1)], "domain string, enabled boolean, priority int")
    missed = spark.createDataFrame([(1, "red cotton shirt large")], "row_index long, name string")
    got = linking.discover(missed, products, profiles).collect()
    assert [(r["domain"], r["discovery_status"]) for r in got] == [("small.example", "found")]


def test_search_forms_beyond_the_first(spark):
    login = '<form action="/login"><input name="user"></form>'
    rows = [
        (1, "http://a.example/x", login + '<form action="/search?lang=en"><input type="hidden" name="t"><input name="Q"></form>'),
        (2, "http://b.example/shop/red-shirt", login), (3, "http://c.example/shop/category/1", login), (4, "http://d.example/", None),
        (5, "http://e.example/", login + '<form action="http://s.example/shop"><input name="text"></form>'),
    ]
    got = {r["domain"]: r["template"] for r in pages.search_forms(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"a.example": "http://a.example/search?lang=en&Q={query}", "b.example": "http://b.example/shop?search={query}", "e.example": "http://s.example/shop?text={query}"}


def test_bound_holds_and_the_best_are_the_same(spark):
    words = ["panadol", "panadole", "pandol", "extra", "plus", "co", "tab", "tabs", "500", "50", "mg", "gel", "gell", "cream", "a", "ab", "qqqq"]
    rows = spark.range(400).select(F.col("id").alias("q_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(words))) + 1).cast("int"))), " ").alias("q_name"))
    queries = rows.withColumn("q_tokens", F.split("q_name", " "))
    index = matching.catalog_index(rows.select(F.concat_ws(" ", "q_name", F.lit("mg")).alias("name"), F.col("q_id").alias("key")), "name", "key")
    candidates = matching.token_candidates(queries, index, 60)
    facts = matching.facts_of(queries, index)
    full = matching.scored(candidates, queries, index, facts).join(facts[0], "q_id").join(facts[1], "idx")
    bounded = similarity.with_bound(full)
    nearer = similarity.with_nearer_bound(bounded.withColumn("far", F.col("bound")))
    assert nearer.count() > 10_000 and nearer.where("bound < score - 1e-9 OR far < bound - 1e-9").count() == 0
    plain, best = matching.top_candidates(matching.scored(candidates, queries, index), 5), matching.best_scored(candidates, queries, index, 5)
    assert best.select(plain.columns).exceptAll(plain).isEmpty() and plain.exceptAll(best.select(plain.columns)).isEmpty()
