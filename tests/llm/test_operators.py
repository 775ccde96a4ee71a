"""Operators against brute force and defined edge cases, on small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import dart_minhash, decontamination, host_reputation, language, mixing, passages, personal_data, quality, registry, toxicity, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


LETTERS = str.maketrans("0123456789", "abcdefghij")


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.integers(vocab)}".translate(LETTERS) for _ in range(n))


EDGES = [None, "", "   ", "one", "one two three four", "x" * 100_000, "a b " * 30_000, "same text here for all", "same text here for all"]


# mixing


def targets_of(spark, sizes, weights=(5, 2, 1)):
    hist = spark.createDataFrame([(f"0s{i:02d}", x, 1) for i, x in enumerate(sizes)], "key string, size long, n long")
    return [r["target"] for r in mixing.with_targets(mixing.sources_of(hist, weights)).orderBy("key").collect()]


def test_targets_follow_the_rule(spark):
    assert targets_of(spark, [100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert targets_of(spark, [10, 100, 100]) == pytest.approx([30, 120, 60])  # the first stops at 30, the rest shares 180
    assert targets_of(spark, []) == [] and targets_of(spark, [0, 0]) == [0, 0]
    assert targets_of(spark, [8] * 7) == pytest.approx([56 * w / 21 for w in (5, 2, 1, 5, 2, 1, 5)])


def tilted(sizes, target, cap=3.0):
    """Rates by bisection of the one equation, in plain Python."""
    mean = sum(sizes) / len(sizes)
    if target >= cap * sum(sizes):
        return [cap] * len(sizes)
    low, high = -1e4, 1e4
    for _ in range(300):
        lam = (low + high) / 2
        rates = [min(cap, math.exp(min(50, lam * x / mean))) for x in sizes]
        low, high = (lam, high) if sum(r * x for r, x in zip(rates, sizes)) < target else (low, lam)
    return rates


@pytest.mark.parametrize("part_rows", [1000, 10])
def test_mix_against_an_own_solver(spark, part_rows):
    rng = np.random.default_rng(3)
    docs = docs_of(spark, [prose(rng, int(rng.integers(5, 60))) for _ in range(600)] + ["w " * 7] * 80 + [None, ""])
    got = mixing.mix(docs, part_rows=part_rows)
    rows = got.join(docs.select("doc_id", "source"), "doc_id").collect()
    assert sorted(mixing.mix(docs.repartition(7), part_rows=part_rows).collect()) == sorted(r[:-1] for r in rows)  # reruns agree
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source and r["size"]]
        assert sum(r["size"] for r in own) == own[0]["source_size"] and all(r["converged"] for r in own)
        assert [r["rate"] for r in own] == pytest.approx(tilted([r["size"] for r in own], own[0]["target"]), rel=1e-5)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60  # about a document
        assert all(r["copies"] - r["rate"] < 1 and r["rate"] - r["copies"] < 1 for r in own)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_mix_edges(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = {r["doc_id"]: r for r in mixing.mix(docs_of(spark, EDGES).withColumn("size", F.lit("clash"))).collect()}
    assert [rows[i]["size"] for i in range(9)] == [len(WORD.findall(t or "")) for t in EDGES] and rows[0]["taken"] == 0
    taken = mixing.take_mix(docs_of(spark, EDGES).withColumn("copy", F.lit("mine")))
    assert taken.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "copy_"] and taken.where("copy = 'mine'").count() == taken.count()
    huge = 1152921504606846977
    ids = [(huge, "a b c", "s"), (None, "a b", "s"), (None, "a b", "s"), (5, "x", None), (5, "x", None)]
    docs = spark.createDataFrame(ids, "doc_id long, text string, source string")
    assert sorted(str(r["doc_id"]) for r in mixing.mix(docs).collect()) == sorted(str(i[0]) for i in ids)
    got = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got if r["n"]} == {r["doc_id"]: r["count"] for r in mixing.take_mix(docs).groupBy("doc_id").count().collect()}


def test_mix_reruns_agree_for_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 else 7, " ".join(f"w{rng.integers(50)}" for _ in range(6)), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(map(str, mixing.take_mix(docs.repartition(n, F.xxhash64("text", F.lit(n)))).collect())) for n in (2, 7))
    assert one == other


# urls


def test_urls_and_rules(spark):
    urls = [None, "", "nothing", "HTTP://A.Example.NET?x#y", "http://a.example.net/en/1?q", "http://example.net/de/1", "https://x.org/fr/2#t", "https://x.org/fr", "http://b.example.com/de/", "http://xexample.com/de/", "s://É.example.com/de/a?b", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: tuple(r)[1:] for r in host_reputation.judge_urls(pages, none).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "", None, "allow") and got[4] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5] == ("example.net", "/de/1", "net/", "block") and got[6] == ("x.org", "/fr/2", "org/fr/", "allow")
    assert got[7] == ("x.org", "/fr", None, "allow") and got[8][2:] == ("example.com/de/", "block") and got[9][2:] == (None, "allow")
    assert got[10] == ("É.example.com", "/de/a", "example.com/de/", "block") and got[11] == ("b:", "//c/d", None, "allow")
    assert host_reputation.judge_urls(pages.limit(0), none).count() == 0


def test_reputation_blocks_only_the_bad_host(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 7}.example/x") for i in range(400)] + [(1000, "http://new.site1.example/")]
    bad = [(i, int(bool(i % 2) and i % 7 == 3)) for i in range(300)] + [(5, None), (6, 7)]
    got = host_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"))
    assert {r["host"] for r in got.where("verdict = 'block'").collect()} == {"bad.site3.example"}


# language, toxicity, quality: held-out accuracy


def joined(spark, sf, name, labels):
    return registry.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/{labels}.parquet"), "doc_id").collect()


def test_language_held_out(spark):
    rows = joined(spark, "/root/testdata/sf0.01", "op3_rank_order_language", "documents")
    test = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in test) / len(test) > 0.97


def test_language_edges(spark):
    docs = docs_of(spark, ["the cat and the dog"] * 3 + [None, "", "123 ... !", "日本語の文", "x" * 100_000]).withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit_profiles(docs.where("doc_id < 3"))).collect()}
    assert [got[i]["lang_pred"] for i in range(8)] == ["en"] * 3 + ["und"] * 3 + ["en"] * 2 and got[3]["score"] == 0
    empty = language.fit_profiles(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}


def brute_profile(texts):
    grams = Counter()
    for text in texts:
        padded = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
        for n in (1, 2, 3):
            grams.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g.strip() and " " not in g[1:-1])
    return sorted(grams, key=lambda g: (-grams[g], len(g), g))[: language.PROFILE]


def test_out_of_place_distance_against_brute_force(spark):
    rng = np.random.default_rng(2)
    scripts = {"la": range(97, 123), "el": range(0x3B1, 0x3C9), "zh": range(0x4E00, 0x4E00 + 500), "ja": range(0x4E00 + 250, 0x4E00 + 700)}

    def write(name, n):
        letters = list(scripts[name])
        p = np.random.default_rng(len(name) + ord(name[0])).dirichlet(np.ones(len(letters)) * 0.3)
        return " ".join("".join(chr(letters[c]) for c in rng.choice(len(letters), int(rng.integers(1, 7)), p=p)) for _ in range(n)) + ", 7"

    learned = [(lang, write(lang, 60)) for lang in scripts for _ in range(6)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(learned)], "doc_id long, text string, lang string")
    model = language.fit_profiles(docs)
    known = {lang: brute_profile([t for x, t in learned if x == lang]) for lang in scripts}
    for lang in scripts:
        for n in (1, 3, 40):
            text = write(lang, n)
            mine = brute_profile([text])
            want = {x: sum(abs(known[x].index(g) - i) if g in known[x] else language.PROFILE for i, g in enumerate(mine)) for x in scripts}
            assert dict(zip(model.languages, language.distances(language.profile(language.coded(text)), model).tolist(), strict=True)) == want
            best = min(sorted(want), key=lambda x: want[x])
            assert language.predict(text, model) == (best, pytest.approx(1 - want[best] / language.PROFILE / len(mine))) and (best == lang or n < 40)


def test_language_bounds_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "der hund", "de")] * 2 + [(1, "der hund", "de"), (2, "the dog", "en")], "doc_id long, text string, lang string")
    assert language.fit_profiles(docs, max_languages=1).languages == ["de"]
    assert docs.select(language.held_out("doc_id", 4, 2).alias("h")).where("h is null").count() == 0


def test_toxicity_separates_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score_toxicity(docs.join(labels.where("doc_id % 3 = 0"), "doc_id").select("doc_id", "text", F.col("toxic").alias("y")), model, ["doc_id", "y"]).collect()
    assert all(0 <= r["p_toxic"] <= 1 and r["p_toxic"] <= r["expected_grade"] <= 2 for r in rows)
    assert sum(r["p_toxic"] >= 0.5 for r in rows if r["y"] == 1) >= 0.88 * sum(r["y"] for r in rows)  # about 300 toxic documents to learn from
    assert sum(r["p_toxic"] >= 0.5 for r in rows if r["y"] == 0) <= 0.002 * len(rows)


def test_grades_come_from_labels(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 0, 1), (4, 1, 0), (5, 1, None), (None, 1, 0), (6, None, 0), (7, 3, 0)], "doc_id long, toxic int, quality int")
    assert {r["doc_id"]: r["grade"] for r in toxicity.grades_of(labels).collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 1}


def test_ordinal_fit_maximises_the_likelihood():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, 600).astype(float)
    y = ((x + rng.normal(size=600) > 2).astype(int) + (x + rng.normal(size=600) > 4)).clip(0, 2)
    y = np.where(x == 0, 0, y)
    w, t = toxicity.fit_ordinal(np.arange(600), np.zeros(600, np.int64), x, y, 1, steps=2000)

    def loss(w, a, b):  # the penalised likelihood, written out
        above = [np.ones(600), 1 / (1 + np.exp(a - w * x)), 1 / (1 + np.exp(b - w * x)), np.zeros(600)]
        return -sum(math.log(above[k][i] - above[k + 1][i]) for i, k in enumerate(y)) + 0.5 * w * w + 0.5 * math.log(b - a) ** 2

    best = loss(w[0], *t)
    for step in itertools.product((-0.03, 0, 0.03), repeat=3):
        assert best <= loss(w[0] + step[0], t[0] + step[1], t[1] + step[2]) + 1e-3
    assert w[0] > 0.5 and t[0] < t[1]


def test_toxicity_edges(spark):
    docs = docs_of(spark, EDGES).withColumn("toxic", F.lit("clash")).withColumn("p_toxic", F.lit(9)).withColumn("_text", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, none).columns == docs.columns
    assert sorted(toxicity.drop_toxic(docs, none).collect(), key=str) == sorted(docs.collect(), key=str)
    labels = spark.createDataFrame([(i, int(i > 19)) for i in range(40)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    docs = docs_of(spark, [f"calm words number {i % 7}" if i < 20 else f"nasty words number {i % 7}" for i in range(40)])
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()) == list(range(20))
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    model = toxicity.fit_toxicity(docs, labels)
    texts = {"calm": "calm words " * 50_000, "nasty": "nasty words " * 50_000}
    got = {r["doc_id"]: r["p_toxic"] for r in toxicity.score_toxicity(docs_of(spark, [*texts.values(), "calm words", "calm words"]).withColumn("score", F.lit("clash")), model, ["doc_id"]).collect()}
    assert got[0] < 0.5 < got[1] and got[2] == got[3]


def test_quality_held_out(spark):
    rows = joined(spark, "/root/testdata/sf0.01", "op6_quality_qda", "labels")
    test = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in test) / len(test) > 0.93


def test_quality_scores_are_gaussian_posteriors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, quality.N_STATS)) @ rng.normal(size=(quality.N_STATS, quality.N_STATS))
    y = rng.integers(0, 2, 400)
    x[y == 1] = x[y == 1] * 1.5 + 1
    table = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(400)], "doc_id long, stats array<double>, label int")
    model = quality.fit_discriminant(table, 0.2, 0.1)
    logs = []
    scale = np.sqrt(np.diag(sum(np.cov(x[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))))
    z = x / scale
    pool = sum(np.cov(z[y == c].T, bias=True) * (y == c).mean() for c in (0, 1))
    for c in (0, 1):
        s = 0.8 * np.cov(z[y == c].T, bias=True) + 0.2 * pool
        s = 0.9 * s + 0.1 * np.trace(s) / len(s) * np.eye(len(s))
        d = z - z[y == c].mean(axis=0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-6)


def test_quality_edges(spark):
    stats = quality.document_statistics(docs_of(spark, EDGES).withColumn("stats", F.lit(0)))
    only = quality.fit_discriminant(stats.withColumn("label", F.lit(1)))
    assert {r["score"] for r in quality.score_quality(stats, only).collect()} == {1.0}
    assert {r["score"] for r in quality.score_quality(stats, quality.fit_discriminant(stats.limit(0).withColumn("label", F.lit(1)))).collect()} == {0.5}


# vectors


def brute_vectors(rows):
    good = {}
    for i, v, label in rows:
        a = np.array([np.nan if x is None else x for x in (v if v is not None else [])], float)
        if label is not None and len(a) and np.isfinite(a).all() and a.any():
            good[i] = (a / np.abs(a).max(), label)
    links = {i: set() for i, _, _ in rows}
    for (i, (a, x)), (j, (b, y)) in itertools.combinations(good.items(), 2):
        if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
            links[i].add(j)
            links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        v = rng.normal(size=16) if i % 3 or not rows else np.array(rows[int(rng.integers(len(rows)))][1]) + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(300 + i, rows[0][1], 0) for i in range(30)]  # copies
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, rows[1][1], None), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [1e300] * 16, 1), (408, [1.0] * 16, 1), (409, [], 1), (410, [float("inf")] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("cell", F.lit(2))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(table, per_cell=4, block=block).collect()}
    assert got == brute_vectors(rows)


def test_vectors_of_any_length_and_of_repeated_ids(spark):
    def links(rows):
        return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())

    assert links([(1, [1.0], 0), (2, [2.0], 0), (3, [5.0], 0), (4, [1.0, 1.0], 0), (5, [1.0, 1.0], 0), (6, [-1.0], 0)]) == [("1", 2, "1"), ("2", 2, "1"), ("3", 2, "1"), ("4", 1, "4"), ("5", 1, "4"), ("6", 0, "6")]
    a, b, c = [1.0, 0.0], [1.0, 0.01], [0.0, 1.0]  # one id, three vectors
    assert links([(1, a, 0), (1, c, 0), (1, [0.5, 0.5], 0), (2, b, 0), (3, [0.01, 1.0], 0)]) == [("1", 0, "1"), ("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 1, "1")]
    assert links([(None, a, 0), (None, b, 0), (7, a, 0), (None, c, 0)]) == [("7", 2, "7"), ("None", 0, "None"), ("None", 2, "7"), ("None", 2, "7")]


def test_lower_recall_still_links_enough(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 32))
    rows = [(i, [float(x) for x in base[i % 60] + (rng.normal(size=32) * 0.06 if i >= 60 else 0)], 0) for i in range(300)]
    want = brute_vectors(rows)
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), per_cell=4, recall=0.95).collect()
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(n for n, _, _ in want.values()) and all(r["n_links"] <= want[r["vec_id"]][0] for r in got)


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_traversal_is_by_rising_sum():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(9)
    got = vectors.traverse(a, b, 1.1)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(7) for j in range(9) if a[i] + b[j] <= 1.1} and len(set(got)) == len(got)


# benchmark leaks


def test_template_slots():
    t = decontamination.template("Anna has 12 kg of apples. She gives Ben Lee 3.5 kg, and two miles.")
    assert t.marks() == ["anna", "has", "<number>", "<unit>", "of", "apples", "she", "gives", "<name>", "<number>", "<unit>", "and", "<number>", "<unit>"]
    assert decontamination.filled(t, 0, 14) == [(2, "12"), (3, "kg"), (8, "ben lee"), (10, "3.5"), (11, "kg"), (13, "two"), (14, "miles")]
    assert decontamination.slots_agree([("a", "x"), ("a", "x"), ("b", "y")]) == 1
    assert decontamination.slots_agree([("a", "x"), ("b", "x")]) == 0.5 and decontamination.slots_agree([]) == 1


def brute_template(text):
    """Tokens with their values, token by token: (mark or word, value)."""
    out = []
    for line in (text or "").split("\n"):
        start, number, named = True, False, False
        capitals = any(c.isupper() for c in line) and not any(c.islower() for c in line)
        for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+|\w+|[.!?:;]", line):
            raw, word = m.group(), m.group().lower()
            if raw in ".!?:;":
                start, number, named = True, False, False
                continue
            mark = "<number>" if raw[0].isdecimal() or word in decontamination.NUMBER_WORDS else "<unit>" if number and word in decontamination.UNITS else "<name>" if raw[0].isupper() and not start and not capitals else word
            if mark == "<name>" and named:
                out[-1] = (mark, out[-1][1] + " " + word)
            else:
                out.append((mark, word))
            start, number, named = False, mark == "<number>", mark == "<name>"
    return out


def brute_leaks(docs, items, width=8, literals=5, cover=0.5, consistent=0.8):
    """Pairs by template windows, every diagonal tried, and whole verbatim items."""
    out = set()
    for d, text in docs:
        t = brute_template(text)
        for i, item in items:
            q = brute_template(item)
            asked, have = (" ".join(["", *(v for _, v in x), ""]) for x in (q, t))
            if len(q) >= literals and asked in have:
                out.add((d, i))
            if len(q) < literals:
                continue
            ends = {}
            for p in range(len(q)):
                plain, e = 0, p
                while e < len(q) and (e - p < min(width, len(q)) or plain < literals):
                    plain, e = plain + (q[e][0][0] != "<"), e + 1
                if e - p >= min(width, len(q)) and plain >= literals:
                    ends[p] = e
            for shift in range(-len(q), len(t)):
                good = [p for p, e in ends.items() if 0 <= p + shift and [x for x, _ in q[p:e]] == [x for x, _ in t[p + shift : e + shift]]]
                fills = {(at, q[at][1], t[at + shift][1]) for p in good for at in range(p, ends[p]) if q[at][0][0] == "<"}
                if ends and len(good) >= math.ceil(cover * len(ends)):
                    there = Counter((a, b) for _, a, b in fills)
                    used, agree = {}, 0
                    for (a, b), n in sorted(there.items(), key=lambda x: -x[1]):
                        if a not in used and b not in used.values():
                            used[a], agree = b, agree + n
                    if agree >= consistent * len(fills):
                        out.add((d, i))
    return out


@pytest.mark.parametrize("most", [500_000, 1])
def test_leaks_against_brute_force(spark, most):
    rng = np.random.default_rng(9)
    items = [(i, f"A train leaves {rng.choice(['Rome', 'Oslo'])} at {rng.integers(20)} and covers {rng.integers(900)} km in the {prose(rng, 12, 40)} while {prose(rng, 6, 30)}") for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (93, "five plain words are enough"), (94, items0 := "Tom has 3 red pens and Tom gives 3 pens to his friend today")]
    texts = [prose(rng, 60, 40) + " " + items[i % 12][1] + " " + prose(rng, 20, 40) for i in range(24)] + EDGES + ["and five plain words are enough here", items0.replace("3", "7"), items0.replace("3 pens", "9 pens")]
    docs = docs_of(spark, texts).withColumn("h", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench, max_broadcast=most).collect()}
    n = len(texts)
    assert (n - 2, 94) in got and (n - 1, 94) not in got  # 3 became 7 throughout; 3 became both 3 and 9
    assert got == brute_leaks(list(enumerate(texts)), items)
    kept = decontamination.drop_contaminated(docs, bench, max_broadcast=most)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(n)) - {d for d, _ in got}


def leaks_of(spark, texts, items, **options):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs_of(spark, texts), bench, **options).collect()}


@pytest.mark.parametrize("most", [500_000, 1])
def test_leaks_of_parallel_sentences_and_of_two_variants(spark, most):
    item = "A train travels at 60 km per hour for 3 hours. A train travels at 80 km per hour for 2 hours."
    other = item.replace("60", "75").replace("80", "95")
    texts = [item, "A train travels at 50 km per hour for 7 hours and stops.\n" + other, "A train travels at 50 km per hour for 7 hours and stops.\n" + item + "\n" + other]
    got = leaks_of(spark, texts, [item], max_broadcast=most)
    assert all(got[d, 0]["coverage"] == got[d, 0]["slot_agreement"] == 1 for d in range(3)), got


@pytest.mark.parametrize("most", [500_000, 1])
def test_leaks_whatever_the_case(spark, most):
    items = ["Who Wrote The Famous Novel About War And Peace In Russia", "What is the capital city of Peru", "Ada 3 Bob 4 Carl 5 Dora 6 Emil 7 Fred 8", "A train covers 60 km in 3 hours and then it stops", "too short"]
    texts = ["See: " + items[0] + "?", items[0].lower(), "1) What is the capital city of Peru", "so, What is the capital city of Chile", "WHAT IS THE CAPITAL CITY OF PERU", "x " + items[2], "A TRAIN COVERS 75 KM IN 4 HOURS AND THEN IT STOPS", "too short", "Who Wrote The Famous Novel"]
    got = leaks_of(spark, texts, items, max_broadcast=most)
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2), (6, 3), (7, 4)}


def test_leaks_of_short_and_slot_rich_items_and_of_shared_ids(spark):
    items = ["What is 12 plus 7 times 3", "too short", "Add 3 4 5 6 7 8 9 then say 4 5 6 the sum of it all aloud please", "Ann Lee paid forty miles of two pounds to Bob for the green house by a lake today"]
    texts = ["so, What is 12 plus 7 times 3?", "Too short!", "not too short", "Add 9 8 7 6 5 4 3 then say 8 7 6 the sum of it all aloud please", "then Eva Maria Roe paid sixty miles of nine pounds to Carl Doe for the green house by a lake today", "nothing"]
    assert set(leaks_of(spark, texts, items)) == {(0, 0), (1, 1), (3, 2), (4, 3)}
    item = "The old miller sold nine bags of grain to his two sons and kept the rest of it for a long and cold winter at home"
    w = item.split()
    halves = [" ".join(w[:11]), " ".join(w[11:])]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    for ids in ([1, 1, 2], [None, None, 2]):
        docs = spark.createDataFrame(list(zip(ids, [*halves, item])), "doc_id long, text string").withColumn("_key", F.lit("mine"))
        assert [r["doc_id"] for r in decontamination.contaminated(docs, bench).collect()] == [2]
        assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()] == ids[:2] and decontamination.drop_contaminated(docs, bench).columns == docs.columns


def test_leaks_empty(spark):
    docs, bench = docs_of(spark, EDGES), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, bench).count() == 0
    assert decontamination.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")).count() == 0


# near duplicates


def brute_near(texts):
    def shingles(t):
        w = WORD.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [32, 3])
def test_near_classes_against_brute_force(spark, small):
    rng = np.random.default_rng(11)
    texts = [prose(rng, int(rng.integers(40, 90))) for _ in range(40)]
    for i in range(60):
        w = texts[int(rng.integers(12))].split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = "edit"
        texts.append(" ".join(w))
    base = prose(rng, 120).split()
    for i in range(40):  # a group whose members are about as like as the threshold
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 5))):
            w[at] = f"e{i}"
        texts.append(" ".join(w))
    texts += EDGES + ["one", "same  text here\nfor all"]
    docs = docs_of(spark, texts).withColumn("node", F.lit(1)).withColumn("key", F.lit(1)).withColumn("part", F.lit(1))
    rows = {r["doc_id"]: r for r in dart_minhash.near_classes(docs, small=small).collect()}
    want = brute_near(texts)
    assert [rows[i]["class_id"] for i in range(len(texts))] == want
    first = {}
    assert all(rows[i]["copy_of"] == (first.setdefault(t, i) if WORD.findall(t or "") else i) for i, t in enumerate(texts))
    kept = dart_minhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_near_texts_that_differ_by_repetition(spark):
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(25):
        base, line = prose(rng, 104, 5000), prose(rng, 17, 5000)
        texts += [base, base + ("\n" + line) * 200]  # 0.8 or a little above
        own = prose(rng, 30, 5000)
        texts += [own, " ".join([own] * 50)]
    want = brute_near(texts)
    assert sum(c != i for i, c in enumerate(want)) == 50
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_classes(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u v"), (None, None), (3, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in dart_minhash.keep_first(docs).collect()) == ["1", "3", "None", "None"]
    extra = spark.createDataFrame([(1, "a b c d e f", x) for x in (3, 2, 5)], "doc_id long, text string, n int")
    assert [r["n"] for r in dart_minhash.keep_first(extra).collect()] == [2]
    top = 1 << 62  # as large as ids get, with and without a copy of no id
    large = spark.createDataFrame([(top, "a b c d e f"), (top + 5, "q r s t u v"), (None, "q r s t u v"), (top + 9, "a b c d e f")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["copy_of"], r["class_id"]) for r in dart_minhash.near_classes(large).collect()), key=str)
    assert found == [(top, top, top), (top + 5, top + 5, top + 5), (top + 9, top, top), (None, top + 5, top + 5)]
    assert sorted(str(r["doc_id"]) for r in dart_minhash.keep_first(large).collect()) == [str(top), str(top + 5), "None"]
    got = dart_minhash.near_classes(docs)
    assert got.count() == 6 and {r["class_id"] for r in got.where("doc_id in (1, 2)").collect()} == {1}
    assert dart_minhash.near_classes(docs.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 1 << 62, 900, dtype=np.uint64)
    for k in (1, 3, 300):
        a, b = rng.random(k) * 3, rng.random(k) * 3
        s = dart_minhash.signatures(np.tile(pool[:k], 2), np.repeat([0, 1], k), np.concatenate([a, b]), 2, 3000)
        assert (s != 0).all() and (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.05)
    # a document's signature does not depend on the others of its batch
    alone = dart_minhash.signatures(pool[:40], np.zeros(40, int), np.ones(40), 1, 110)
    both = dart_minhash.signatures(np.concatenate([pool[:40], pool]), np.repeat([0, 1], [40, 900]), np.ones(940), 2, 110)
    assert (alone[0] == both[0]).all()


# repeated passages


def brute_passages(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    starts = {}
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            starts.setdefault(tuple(w[i : i + width]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + width))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for w, g in zip(words, gone)]


@pytest.mark.parametrize("vocab", [3, 40, 5000])
def test_passages_against_brute_force(spark, vocab):
    rng = np.random.default_rng(vocab)
    shared = [prose(rng, n, vocab) for n in (9, 10, 11, 25, 60)]
    texts = []
    for i in range(60):
        parts = [prose(rng, int(rng.integers(0, 30)), vocab)]
        for _ in range(int(rng.integers(0, 3))):
            w = shared[int(rng.integers(5))].split()
            lo = int(rng.integers(0, 4))
            parts += [" ".join(w[lo:]), prose(rng, int(rng.integers(0, 12)), vocab)]
        texts.append("\n".join(parts))
    texts += EDGES[:5] + ["é ü " * 40, "b c " * 5, texts[0], texts[0]]
    docs = docs_of(spark, texts).withColumn("row", F.lit(1)).withColumn("a", F.lit(1)).withColumn("s", F.lit(2))
    got = {r["doc_id"]: tuple(r)[1:] for r in passages.remove_repeats(docs, width=10, gram=4, shard_words=300, part_bytes=2_000).collect()}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts, 10)


def test_automaton_finds_every_occurrence():
    rng = np.random.default_rng(0)
    texts = [prose(rng, int(rng.integers(0, 60)), 3) for _ in range(40)] + [""]
    known = [prose(rng, int(rng.integers(3, 6)), 3) for _ in range(6)]
    for text, runs in zip(texts, passages.occurrences(pa.array(known), pa.array(texts)), strict=True):
        w = text.split()
        want = {i + k for p in known for i in range(len(w)) if w[i : i + len(p.split())] == p.split() for k in range(len(p.split()))}
        assert {i for lo, hi in runs for i in range(lo, hi)} == want
    assert passages.occurrences(pa.array([], pa.string()), pa.array(["a b"])) == [[]]


def test_passages_edges(spark):
    docs = spark.createDataFrame([(7, "x " * 50), (7, "y " * 50), (7, "y " * 50), (8, None), (None, "z " * 34)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in passages.remove_repeats(docs).collect())
    assert got == [("7", 50, 50)] * 3 + [("8", 0, 0), ("None", 34, 0)]
    assert passages.remove_repeats(docs.limit(0)).count() == 0


# personal data


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    names = list(BASE)
    return sorted((m.start(), names.index(k), m.end()) for k in names for m in re.finditer(BASE[k], text or "") if ok(k, m.group()))


PII = EDGES + [
    "mail me@example.com_you@example.org..x@y.z@w.v now", "a@b c@d.e. 😀 é me+you%x@a-b.co.uk", "1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004", "1 2 3 4", "1" * 20_000, "+49 (30) 123-4567 8 +1 2 +++12 34567890 12345678 x", "a" * 50_000 + "@",
    "4111111111111111.2.3.4", "+4111111111111111 ", "@@@.a@b.c", "0" * 12, "call 555-123-4567 or 555-123-4567",
]


def test_base_spans_against_brute_force(spark):
    docs = docs_of(spark, PII).withColumn("spans", F.lit("clash"))
    names = list(BASE)
    for r in personal_data.find_personal_data(docs).collect():
        want = brute_spans(PII[r["doc_id"]])
        listed = [f"{names[k]}:{s}:{e}" for s, k, e in want]
        assert [r[f"n_{k}"] for k in names] == [sum(x == i for _, x, _ in want) for i in range(4)], PII[r["doc_id"]][:60]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r["spans"].split(","))
    assert personal_data.find_personal_data(docs.limit(0)).count() == 0


def test_method_adds_spans_and_redacts(spark):
    texts = [f"please call phone 030-555-12{i:02d} or mail jo{i} at site{i % 3} dot com today" for i in range(60)] + ["clean text, nothing here"] * 5
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r["spans"] for r in personal_data.find_personal_data(docs).collect()}
    assert sum("email" in s for s in got.values()) == 60 and got[60] == ""
    out = {r["doc_id"]: r["text"] for r in personal_data.redact(docs_of(spark, texts + PII)).collect()}
    assert "[EMAIL]" in out[0] and "jo0" not in out[0] and out[60] == texts[60] and out[65] is None
    assert out[65 + 10] == "a@b [EMAIL]. 😀 é [EMAIL]"


def with_check_digit(digits):
    total = sum(int(c) if i % 2 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def test_swallowed_numbers_are_added(spark):
    """A phone number that runs on into the next number fails the base pattern as a
    whole; the method adds it, and no number that fails the checksum."""
    rng = np.random.default_rng(3)
    cards = [with_check_digit("4" + "".join(map(str, rng.integers(0, 10, 14)))) for _ in range(40)]
    wrong = [c[:-1] + str((int(c[-1]) + 5) % 10) for c in cards]
    phones = [f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}" for _ in range(40)]
    texts = [f"seen {c} or {p} there" for c, p in zip(cards, phones)] + [f"seen {w} or none there" for w in wrong]
    n = len(texts)
    texts += [f"Des {p} 190.137.223.{i} du" for i, p in enumerate(phones[:10])] + [f"au {w} {c} si" for w, c in zip(wrong[:10], cards[:10])]
    got = {r["doc_id"]: set(r["spans"].split(",")) - {""} for r in personal_data.find_personal_data(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        base = {f"{list(BASE)[k]}:{s}:{e}" for s, k, e in brute_spans(text)}
        if i >= n + 10:  # whether the card is taken is left to the estimate, which on so few spans leaves it out
            assert base <= got[i] <= base | {"card:20:36"}, text
        else:
            added = {f"phone:4:{4 + len(phones[i - n])}"} if i >= n else set()
            assert got[i] == base | added, text


def plain_redaction(text, spans):
    names, at, out = list(BASE), 0, []
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{names[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_many_spans_in_one_text(spark):
    rng = np.random.default_rng(6)
    mails = ["é" * int(rng.integers(0, 9)) + f" me{i}@x{i % 9}.org, 10.0.{i % 256}.1 😀 " for i in range(400)]
    texts = ["".join(mails[:n]) for n in (1, 5, 100, 400)] + ["".join(mails) * 250]
    names = list(BASE)
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(docs_of(spark, texts)).collect()}
    out = {r["doc_id"]: r["text"] for r in personal_data.redact(docs_of(spark, texts).withColumn("_spans", F.lit("clash"))).collect()}
    for i, text in enumerate(texts):
        want = brute_spans(text)
        assert got[i]["spans"] == ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want) and len(want) == got[i]["n_email"] + got[i]["n_ip"]
        assert out[i] == plain_redaction(text, want)
    assert got[4]["n_email"] == 100_000


def test_em_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    counts, truth = Counter(), Counter()
    for _ in range(4000):
        z = rng.random() < 0.3
        votes = [1 if rng.random() < (p if z else 1 - p) else 2 for p in (0.95, 0.9, 0.85, 0.6, 0.5)]
        code = sum(v * 3**j for j, v in enumerate(votes))
        counts[code] += 1
        truth[code] += z
    chance = personal_data.reliabilities(dict(counts))
    big = [c for c in counts if counts[c] > 60]
    assert all(abs(chance[c] - truth[c] / counts[c]) < 0.15 for c in big)
