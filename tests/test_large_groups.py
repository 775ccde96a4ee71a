"""Phrase tables, pruned pairs, quantiles by ranges, counters by key, rebuilt runs:
each against plain Python or a second way."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions import phrases, similarity
from linkloom.functions.normalize import normalized
from linkloom.operators import analytics, enrichment, matching, quantiles
from linkloom.plans import linking
from linkloom.streaming import matching as stream
from linkloom.streaming.counters import Counters


def plain_replaced(name, table):
    ts, out, i = name.split(), [], 0
    longest = max(len(k) for k in table)
    while i < len(ts):
        n = next((n for n in range(longest, 0, -1) if tuple(ts[i : i + n]) in table), 0)
        out += [table[tuple(ts[i : i + n])]] if n else [ts[i]]
        i += n or 1
    return " ".join(x for x in out if x)


def test_phrases_against_plain_python(spark):
    rng = np.random.default_rng(1)
    words = list("abcdef")
    table = {tuple(rng.choice(words, rng.integers(1, 5))): str(i) for i, _ in enumerate(range(60))} | {("f",): "", ("a", "b", "a"): "x y"}
    names = [" ".join(rng.choice([*words, "g"], rng.integers(0, 14))) for _ in range(300)] + ["a  b\ta", "  ", "", "g"] + ["a b c d"] * 50
    df = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(names)] + [(-1, None, "kept")], "i int, name string, value string")
    entries = spark.createDataFrame([(" ".join(k), v) for k, v in table.items()] + [("", "never"), (None, "never")], "key string, value string")
    got = {r["i"]: r["new"] for r in phrases.replaced(df, "name", phrases.phrase_table(entries), "new").collect()}
    assert got == {i: plain_replaced(n, table) for i, n in enumerate(names)} | {-1: None}
    assert phrases.replaced(df, "name", phrases.phrase_table(entries.limit(0))).where("i = 300").first()["name"] == "a b a"
    assert phrases.replaced(df.limit(0), "name", phrases.phrase_table(entries)).columns == df.columns
    twice = spark.createDataFrame([("k", "new", 2), ("k", "old", 1)], "key string, value string, o int")
    assert phrases.phrase_table(twice, order="o").first()["value"] == "new"


def test_more_phrases_than_a_closure_would_hold(spark):
    entries = spark.range(250_000).select(F.concat_ws(" ", F.lit("foo"), F.col("id").cast("string")).alias("key"), F.col("id").cast("string").alias("value"))
    df = spark.createDataFrame([("one foo 249999 bar foo 7",), ("foo",)], "name string")
    assert {r["n"] for r in normalized(df, "name", "n", phrases=phrases.phrase_table(entries)).collect()} == {"one 249999 bar 7", "foo"}


def test_brands_exact_then_fuzzy(spark):
    brands = spark.createDataFrame([("بانادول", "panadol", 1), ("بانادول اكسترا", "panadol extra", 2), ("اوتريفين", "otrivin", 3)], "key string, value string, ord int")
    names = ["بانادول اكسترا 24", "بانادول 24", "اوترفين نقط", "اوتروفين", "panadl", None]
    got = [r["name"] for r in matching.map_brands(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string"), "name", brands).orderBy("i").collect()]
    assert got == ["panadol extra 24", "panadol 24", "otrivin نقط", "otrivin", "panadl", None]


def test_names_are_never_broadcast(spark):
    # explode multiplies rows that Spark's size estimates don't count, so only the dictionary may be
    df = spark.range(20_000).select(F.concat_ws(" ", F.lit("hot pan"), F.col("id").cast("string"), F.lit("of gold")).alias("name"))
    table = phrases.phrase_table(spark.createDataFrame([("hot pan", "p"), ("of gold", "oro"), ("7 of", "x")], "key string, value string"))
    out = phrases.replaced(df, "name", table)
    got = {r["name"] for r in out.collect()}
    assert len(got) == 20_000 and {"p 8 oro", "p x gold"} <= got
    assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lists(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = 1 / np.arange(1, 201)
    rows = [(list(map(str, rng.choice(vocabulary, rng.integers(0, 12), p=weights / weights.sum()))), list(map(str, rng.choice(vocabulary, 6, p=weights / weights.sum())))) for _ in range(400)]
    rows += [(["hot", "w1"], ["hot", "w2"])] * 150 + [(None, ["w1"]), ([], [])]
    return rows, spark.createDataFrame(rows, "l array<string>, r array<string>")


@pytest.mark.parametrize("distinct", [True, False])
def test_pairs_against_plain_python(lists, distinct):
    rows, df = lists
    one = (lambda x: sorted(set(x or []))) if distinct else (lambda x: x or [])
    co, na, nb = Counter(), Counter(), Counter()
    for left, right in rows:
        na.update(one(left))
        nb.update(one(right))
        co.update((a, b) for a in one(left) for b in one(right))
    for least in (1, 4):
        got = {(r["a"], r["b"]): (r["co"], r["n_a"], r["n_b"]) for r in analytics.cooccurrence(df, "l", "r", distinct, least).collect()}
        assert got == {(a, b): (n, na[a], nb[b]) for (a, b), n in co.items() if n >= least}
    if distinct:
        mined = analytics.mine_translations(analytics.cooccurrence(df, "l", "r", True, 4, 0.4), 4, 0.4)
        plain = analytics.mine_translations(analytics.cooccurrence(df, "l", "r"), 4, 0.4)
        assert mined.exceptAll(plain).count() == plain.exceptAll(mined).count() == 0 < plain.count()


def test_rare_words_form_no_pairs(lists):
    rows, df = lists
    every, kept, near = (analytics.word_pairs(df, "l", "r", True, *x) for x in ((1,), (4,), (4, 0.4)))
    counts = [x.count() for x in (every, kept, near)]
    assert counts[2] < counts[1] < counts[0]
    assert kept.where("n_a < 4 or n_b < 4").count() == 0 and kept.where("a = 'hot' and b = 'hot'").count() == 1  # 150 equal rows are one
    assert [r["b"] for r in analytics.word_profile(df, "l", "r", "hot", 2).collect()] == ["hot", "w2"]


def test_pairs_are_counted_by_numbers(lists):
    # the shuffle of pairs is the largest: it carries two numbers and a count, neither words nor row hashes
    plan = analytics.cooccurrence(lists[1], "l", "r", True, 4)._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("]")[0].split(", ") for x in plan.split("Aggregate(keys=[")[1:]]
    assert [k for k in keys if any(x.startswith("_b#") for x in k)] and not [k for k in keys if any(x.startswith(("a#", "b#", "n_a#")) for x in k)]
    assert "sha2" not in plan


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=3000).round(2), "one": np.array([5.0]), "same": np.full(500, 2.0), None: rng.integers(0, 9, 40).astype(float), "two": np.array([1.0, 4.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "q25": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "v", ["g"], shares, 7).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert [got[k][n] for n in shares] == pytest.approx([np.quantile(vs, q) for q in shares.values()], abs=1e-12)
    out = {r["g"]: r for r in analytics.latency(df, "v", ["g"]).collect()}
    assert out["none"]["n"] == 0 and out["none"]["median"] is None and out[None]["median"] == np.median(groups[None]) and len(out) == 6
    total = quantiles.exact_quantiles(df, "v", [], {"median": 0.5}).first()["median"]
    assert total == pytest.approx(np.median([v for _, v in rows if v is not None]))
    plan = analytics.latency(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "CartesianProduct" not in plan


def test_counters_write_changed_keys_only(spark, tmp_path):
    source, schema = tmp_path / "in", "k string, v long"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    source.mkdir()
    counts = stream.running_counts(spark.readStream.schema(schema).parquet(str(source)), ["k"], "v")
    kept = Counters(spark, str(tmp_path / "out"), ["k"], counts.schema)

    def state():
        return {tuple(r) for r in kept.current().select("k", "n", "total").collect()}

    put([("a", 1), ("b", 2), ("a", 3)])
    kept.start(counts, str(tmp_path / "check")).awaitTermination()
    assert state() == {("a", 2, 4), ("b", 1, 2)}
    put([("b", 5), ("c", 1)])
    kept.start(counts, str(tmp_path / "check")).awaitTermination()
    last = kept.changes().agg(F.max("batch")).first()[0]
    assert {r["k"] for r in kept.changes().where(F.col("batch") == last).collect()} == {"b", "c"}
    want = {("a", 2, 4), ("b", 2, 7), ("c", 1, 1)}
    assert state() == want
    again = kept.changes().where(F.col("batch") == last).drop("batch").collect()
    kept.save(spark.createDataFrame(again, counts.schema), last)  # the batch is run again
    assert kept.changes().where(F.col("batch") == last).count() == 2 and state() == want
    assert kept.compact() == 1 and state() == want
    put([("a", 6)])
    kept.start(counts, str(tmp_path / "check")).awaitTermination()
    assert state() == {("a", 3, 10), ("b", 2, 7), ("c", 1, 1)} and kept.compact() == 2 and len(state()) == 3
    with pytest.raises(ValueError):
        stream.running_counts(spark.range(1), ["id"], window="1 day")


def test_rebuilt_run_equals_its_first_export(spark, tmp_path):
    catalog = spark.createDataFrame([(1, "panadol extra 24 tab"), (2, "panadol 24 tab"), (3, "otrivin drops")], "idx long, title string")
    sheet = spark.createDataFrame([(1, "panadol extra tab"), (2, "otrivin drop"), (3, "something else")], "row_index long, name string")
    matched = linking.match_sheet(sheet, catalog, "title", "idx")
    path, fields = str(tmp_path / "runs"), {"name[en]": "title"}
    linking.store_run(matched, path, "7")
    linking.store_run(matched.where("row_index = 2"), path, "8")

    def rows(df):
        return sorted(map(tuple, df.collect()))

    first = rows(linking.export_sheet(matched, catalog, "idx", fields))
    assert rows(linking.rebuilt_sheet(spark, path, "7", catalog, "idx", fields)) == first and len(first) == 3
    linking.store_run(matched, path, "7")
    assert rows(linking.rebuilt_sheet(spark, path, "7", catalog, "idx", fields)) == first
    chosen = spark.createDataFrame([(1, 2)], "row_index long, idx long")
    changed = rows(linking.rebuilt_sheet(spark, path, "7", catalog, "idx", fields, chosen))
    assert changed == rows(linking.rebuilt_sheet(spark, path, "7", catalog, "idx", fields, chosen)) and changed[1:] == first[1:]
    assert changed[0][-1] == "panadol 24 tab" and first[0][-1] == "panadol extra 24 tab"
    assert len(rows(linking.rebuilt_sheet(spark, path, "8", catalog, "idx", fields))) == 1 and rows(linking.rebuilt_sheet(spark, path, "9", catalog, "idx", fields)) == []


def test_discover_scores_few_pairs_and_chooses_as_if_all_were(spark, monkeypatch):
    words = ["panadol", "panadole", "pandol", "extra", "plus", "co", "tab", "tabs", "500", "50", "mg", "gel", "gell", "cream", "ab", "qqqq", "the"]

    def text(key, n):
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(key, i), F.lit(len(words))) + 1).cast("int"))), " ")

    titles = spark.range(900).select(F.col("id").alias("page_id"), F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("string")).alias("domain"), text(F.col("id") % 600, F.col("id") % 5).alias("title"))
    products = titles.select("*", F.concat("domain", F.lit("/"), "page_id").alias("url"), F.col("title").alias("title_en"))
    profiles = products.select("domain").distinct().select("domain", (F.col("domain") != "s6").alias("enabled"), F.pmod(F.xxhash64("domain"), F.lit(2)).alias("priority"))
    missed = spark.range(60).select(F.col("id").alias("row_index"), F.concat_ws(" ", text(F.col("id") + 5000, F.col("id") % 6), F.lit("the")).alias("name")).unionByName(spark.createDataFrame([(99, "zzz"), (98, ""), (97, None)], "row_index long, name string"))

    counted = []
    plain = similarity.with_score

    def watch(pairs, *weights):
        counted.append(pairs.count())
        return plain(pairs, *weights)

    monkeypatch.setattr(similarity, "with_score", watch)
    got = linking.discover(missed, products, profiles).collect()
    scored = sum(counted)
    monkeypatch.setattr(similarity, "with_score", plain)

    index = matching.catalog_index(normalized(products.join(profiles.where("enabled"), "domain"), "title_en", "_norm"), "_norm", "page_id")
    q = missed.select(F.col("name").alias("q_name")).distinct().withColumn("q_id", F.xxhash64("q_name")).withColumn("q_tokens", F.split("q_name", " ")).where("q_name <> ''")
    pairs = matching.scored(matching.all_pairs(q, index), q, index).join(index.select("idx", "domain", "priority", "url", "title"), "idx")
    hits = matching.top_candidates(pairs, 5, ("q_id", "domain")).select("q_name", "score", "priority", "domain", "rank", "url", "title")
    want = {r["q_name"]: tuple(r)[1:] for r in enrichment.best_source(hits, "q_name", "score", ["priority", "domain", "rank"]).collect()}
    assert len(got) == 63 and len({x[6] for x in want.values()}) > 1
    for r in got:
        own = want.get(r["name"], (None,) * 6 + ("not_found", None))
        assert tuple(r[c] for c in ("score", "priority", "domain", "rank", "url", "title", "discovery_status", "n_candidates")) == own
    assert scored < 0.2 * pairs.count()
