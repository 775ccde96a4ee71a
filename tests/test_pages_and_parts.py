"""Containment against all pairs; store pages and menus of odd forms."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as t
from linkloom.operators import containment, pages, tables
from linkloom.plans import queries


def test_holding_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(250)})
    texts, names = words[::2], words[1::2] + words[:40:2]
    got = containment.holding_pairs(spark.createDataFrame([(x,) for x in texts], "x string"), spark.createDataFrame([(y,) for y in names], "y string"))
    want = {(x, y) for x in texts for y in names if x in y or y in x}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 300
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_resolved_names(spark):
    df = spark.createDataFrame([(1, " Hair CARE "), (2, "care"), (3, "hair care for all"), (4, "zzz top"), (5, None), (6, "x")], "i int, txt string")
    names = spark.createDataFrame([("Hair", 2), ("hair care", 5), ("Care", 1), ("CARE", 0), (None, 3), ("", 4)], "n string, ord int")
    got = {r["i"]: r["resolved"] for r in tables.resolve_contained(df, "txt", names, "n", "ord").collect()}
    assert got == {1: "hair care", 2: "CARE", 3: "CARE", 4: "Zzz Top", 5: None, 6: "X"}
    assert {r["resolved"] for r in tables.resolve_contained(df, "txt", names.limit(0), "n", "ord").collect()} == {"Hair Care", "Care", "Hair Care For All", "Zzz Top", "X", None}


@pytest.mark.parametrize(("raw", "want"), [("1250", 12.5), ("1,250", 12.5), ("99", 99.0), ("99.5", 99.5), ("EGP 1250", 1250.0), ("free", None), ("", None), (None, None), ("-5", -5.0)])
def test_minor_units(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(t.minor_price(F.col("x"))).first()[0] == want


def store(spark, *html):
    rows = [(i, "https://shop.example/products/a-b?x=1", h) for i, h in enumerate(html)]
    return {r["page_id"]: r for r in pages.store_products(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_store_pages(spark):
    got = store(
        spark,
        '<script>var meta = {"product":{"id":1,"vendor":"V","variants":[{"price":1250,"sku":"s"}]}};</script><h1>Shown</h1>',
        '<script type="application/json">{"product":"no object","title":"T","variants":[{"price":"12.5"}],"images":["//s.com/a.jpg","//s.com/a.jpg","",null,{"src":"b.png"},{"none":1}]}</script>',
        '<script type="application/json">{"variants": broken</script><p>none</p>', None, "", '<script type="application/json">[1, "variants"]</script>',
    )
    assert set(got) == {0, 1}
    assert (got[0]["title"], got[0]["vendor"], got[0]["price"], got[0]["slug"], got[0]["images"], got[0]["image"]) == ("Shown", "V", 12.5, "a-b", [], None)
    assert (got[1]["title"], got[1]["price"], got[1]["images"]) == ("T", 12.5, ["https://s.com/a.jpg", "https://shop.example/b.png"])


def test_menus_and_cards_of_odd_pages(spark):
    rows = [(1, "<ul><li><a class=x href='/a?b=1&amp;c=2'>A &amp; B</a><ul><li><a data-href=\"/no\" href = '/s'>S</a></ul></ul>"), (2, None), (3, "<ul><ul><a href='/x'>lone</a></ul></ul>"), (4, "<a>no</a>")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    assert sorted((r["page_id"], r["href"], r["label"], r["depth"]) for r in pages.menus(df).collect()) == [(1, "/a?b=1&c=2", "A & B", 1), (1, "/s", "S", 2), (3, "/x", "lone", 2)]
    (tree,) = pages.category_tree(df).collect()
    assert (tree["name"], tree["slug"], [tuple(x) for x in tree["sub_categories"]]) == ("A & B", "a", [("S", "/s", "s")])
    assert pages.brand_cards(df).count() == 0


def test_titles_and_their_sql_resolve_the_same(spark, tmp_path):
    heads = ["a &quot;b&quot; &lt;c&gt; it&#39;s", "a&nbsp;&nbsp;b\u00a0\u2003c\x0bd", "&copy; x &middot; y &amp;lt; z", "<b>x</b><!-- no --> <script>var a = 1;</script>y<STYLE>p{}</style>", " ", "x" * 3 + "\u0085\n\n<i>y</i>&amp;quot;"]
    htmls = [f"<h1 class='t'>{h}</h1><h1>second</h1>" for h in heads] + ["<p>no heading</p>", None]
    spark.createDataFrame(list(enumerate(["https://a.org/"] * len(htmls))), "page_id long, url string").join(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"), "page_id").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["title"], r["platform"]) for r in queries.QUERIES["page_titles"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in duck.execute(f"select page_id, title, platform from ({queries.ORACLE_SQL['page_titles']})").fetchall()} == got
    assert [got[i][0] for i in (0, 1, 2, 3, 6)] == ['a "b" <c> it\'s', "a b c d", "© x · y &lt; z", "x y", ""]
