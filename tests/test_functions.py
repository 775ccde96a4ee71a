"""Table tests of the functions, in one projection each."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.functions import text as t
from linkloom.operators import similar_words
from linkloom.functions.normalize import Options, normalize_fields, normalize_missing, normalized


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


NAMES = {
    "*CIPRALEX 10MG 28T": "cipralex 10 mg 28 tab",
    "SUDOCREM 60GM CREAM": "sudocrem 60 gm cream",
    "AUGMENTIN 1GM TABS": "augmentin 1000 mg tab",
    "ALPHINTERN 30T.": "alphintern 30 tab",
    "ALKA-MISR 12SACH.": "alka misr 12 sachet",
    "ACETYLCISTEINE 200MG x10P": "acetylcisteine 10 200 mg",
    "ALKAPRESS PLUS 5/160MG 14TAB": "alkapress 5 160 mg plus 14 tab",
    "single": "single",
    "": "",
    None: "",
    "BRAND 0.5 GM AMP": "brand 500 mg injectable",
    "SYRUP BRAND 1 L": "brand syrup 1000 ml",
    "كريم ١٠٠ جم": "كريم 100 جم",
}


def test_names(spark):
    df = spark.createDataFrame(list(enumerate(NAMES)), "i int, v string")
    got = {r["v"]: r["o"] for r in normalized(df, "v", "o").collect()}
    assert got == NAMES


def test_names_are_stable_when_normalised_again(spark):
    df = spark.createDataFrame([(v,) for v in NAMES.values() if v], "v string")
    for r in normalized(df, "v", "o").collect():
        assert r["o"].split()[0] == r["v"].split()[0]


def test_phrases_and_extra_steps(spark):
    df = spark.createDataFrame([("بنادول اكسترا ٥٠٠ مجم",)], "v string")
    table = {"بنادول": "panadol", "بنادول اكسترا": "panadol extra", "مجم": "mg"}
    out = normalized(df, "v", "o", Options(extra=(F.upper,)), table).first()["o"]
    assert out == "PANADOL EXTRA 500 MG"


def test_each_distinct_name_is_normalised_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        calls.add(1)
        return v

    df = spark.range(0, 4000, 1, 1).select("id", F.when(F.col("id") % 5 < 4, F.concat(F.lit("Cold pan "), (F.col("id") % 5).cast("string"), F.lit("GM"))).alias("v"))
    got = {(r["id"] % 5, r["o"]) for r in normalized(df, "v", "o", Options(extra=(counted,))).collect()}
    assert got == {(0, "cold pan 0 mg"), (4, "")} | {(i, f"cold pan {i}000 mg") for i in (1, 2, 3)} and calls.value == 5


def test_only_missing_names_are_normalised(spark):
    df = spark.createDataFrame([("1", "A 1GM", None, None), ("2", None, "b 2mg", ""), ("3", "C", None, "kept")], "id string, title_en string, title_ar string, normalized_name_en string")
    got = {r["id"]: r["normalized_name_en"] for r in normalize_missing(df, ["title_en", "title_ar", "id"]).collect()}
    assert got == {"1": "a 1000 mg", "2": "b 2 mg", "3": "kept"}
    assert "normalized_title_en" in normalize_fields(df.select("id", "title_en")).columns


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (t.collapse, {"  a \t b\n": "a b", "": ""}),
        (t.strip_trailing_dots, {"sach. 2.5 x..": "sach 2.5 x"}),
        (t.strip_packaging, {"x10p a": "10 a", "14 pcs": "14", "14 p b": "14 b"}),
        (t.split_combined_doses, {"5/160mg": "5 mg 160 mg", "3/4": "3 4"}),
        (t.separate_units, {"120ml": "120 ml", "mg500": "mg 500", "500مجم": "500 مجم"}),
        (t.fold_arabic, {"أحمد إلى ة ٥": "احمد الي ه 5"}),
        (t.lookup_key, {"123.0": "123", " a ": "a", None: "", "1.50": "1.50"}),
        (t.cell_text, {"": None, "7.0": "7"}),
        (t.price_of, {"EGP 12.50": 12.5, "12": 12.0, "text": None, None: None}),
        (t.stock_of, {"15 pcs": 15, "none": 0, None: 0}),
        (lambda c: t.page_price(c, 100), {"1,250": 12.5, "99": 99.0, "x": None}),
        (t.valid_gtin, {"4006381333931": True, "4006381333932": False, "12345670": True, "abc": False, None: False, "": False}),
        (t.basename, {"https://a/b/c.png?x=1": "c.png", "c": "c"}),
        (t.basenames, {"https://a/b.png, https://a/c.jpg?y": "b.png,c.jpg"}),
        (t.safe_filename, {"https://a/b c.png": "b_c.png"}),
        (t.fix_extension, {"photopng": "photo.png", "photo.png": "photo.png"}),
        (t.domain_of, {"https://WWW.Shop.com/x": "shop.com", "nope": None}),
        (t.slug_words, {"https://s.com/p/panadol-extra-500-1234": "panadol extra 500"}),
        (t.percent, {}),
        (t.clean, {"A*B[c] ÀÉ": "a b c àé"}),
        (t.scanner_text, {"Ab-12, c!": "ab c"}),
        (t.sanitized, {"a\x07b\n": "ab\n"}),
        (t.unit_of, {"20 Tabs": "Tablet", "syrup 100 ml": "Syrup", "stable": None}),
    ],
)
def test_cases(spark, f, cases):
    assert run(spark, f, list(cases)) == list(cases.values())


def test_bilingual_titles(spark):
    got = run(spark, t.bilingual, ["Panadol - بنادول", "بنادول|Panadol Extra", "x"])
    assert [(g["ar"], g["en"]) for g in got] == [("بنادول", "Panadol"), ("بنادول", "Panadol Extra"), (None, "x")]


def scores(spark, *pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, c string")
    return similar_words.scored_names(df, "q", "c").orderBy("i").collect()


def test_pair_score_rules(spark):
    got = scores(
        spark, ("panadol 500 mg tab", "panadol 500 mg tab"), ("", "x"), (None, None), ("panadol 500 mg tab", "panadol 250 mg tab"), ("panadol 500 mg 20 tab", "panadol 500 mg 30 tab"),
        ("panadol tab", "panadol plus tab"), ("panadol tab", "brufen tab"), ("panadol x9", "panadol 500"), ("aspirin 5/10 mg", "aspirin 10 mg"),
    )
    same, empty, none, dose, pack, plus, brand, rest, lists = got
    assert same["score"] == 1.0 and same["matched"] == ["panadol", "500", "mg", "tab"]
    assert empty["score"] == none["score"] == 0 and empty["unmatched_catalog"] == ["x"]
    assert brand["score"] < dose["score"] < pack["score"] < 1 and plus["score"] < 0.9 and lists["score"] > dose["score"]
    assert (rest["matched"], rest["unmatched_query"], rest["unmatched_catalog"]) == (["panadol"], ["x9"], ["500"])
    # by hand: weights 3 and 1, both matched; no rest; ratio 1; covered 1.1 stops at 1
    assert scores(spark, ("alpha beta", "alpha beta"))[0]["jaccard"] == 1.0
    # 3 of 3 + 1 (gamma left over) + 1 (beta of the entry): 3 / 5; "alpha gamma" and "alpha beta" share 7 + 1 of 21 characters at most
    one = scores(spark, ("alpha gamma", "alpha beta"))[0]
    assert one["jaccard"] == 0.6 and one["score"] == pytest.approx(0.7 * 0.6 + 0.3 * SequenceMatcher(None, "alpha gamma", "alpha beta").ratio())
    twice = scores(spark, ("a a bb", "a c a"))[0]
    assert (twice["matched"], twice["unmatched_query"], twice["unmatched_catalog"]) == (["a", "a"], ["bb"], ["c"])
    assert s.token_similarity("panadol", "panadols") == 0.9 and s.token_similarity("1", "120") == 0 and s.token_similarity("a", "a") == 1


def test_scores_are_shares(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("x", "y"), ("", "")], "a string, b string")
    rows = df.select(s.jaccard(t.tokens(F.col("a")), t.tokens(F.col("b"))).alias("j"), s.sequence_ratio("a", "b").alias("r")).collect()
    assert [r["j"] for r in rows] == [0.5, 0, 0] and rows[0]["r"] == pytest.approx(0.6)
    assert all(0 <= r["score"] <= 1 for r in scores(spark, ("a b c", "b c d"), ("x", "y"), ("1 2 3", "1 2 mg")))
    s.register(spark)
    assert spark.sql("SELECT seq_ratio('abc', 'abc') r, word_similarity('panadol', 'panadols') t").first()[:] == (1.0, 0.9)


def test_classification(spark):
    df = spark.createDataFrame([(True, 0.9, "1", None), (True, 0.9, "1", "1"), (True, 0.9, "1", "2"), (True, 0.5, "1", None), (True, 0.1, "1", None), (False, 0.9, None, None), (True, None, "1", None)], "h boolean, s double, a string, b string")
    got = [tuple(r["e"]) for r in df.select(s.enrichment_of(F.col("h"), F.col("s"), F.col("a"), F.col("b")).alias("e")).collect()]
    assert got == [("matched", None), ("already_synced", None), ("review", "barcode_conflict"), ("review", "low_confidence"), ("no_match", None), ("review", "missing_sheet_barcode"), ("no_match", None)]
