"""Prefix joins and similar words against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.functions import text as t
from linkloom.operators import matching, prefix_index, similar_words


def names(rng, n, common=("mg", "tab"), vocab=60):
    """Names that nearly all hold the common words; rare words have a long tail."""
    out = []
    for _ in range(n):
        w = [f"w{min(int(rng.paretovariate(0.7)), vocab)}" for _ in range(rng.randrange(1, 6))]
        out.append(" ".join(w + [c for c in common if rng.random() < 0.95]))
    return out


def sides(spark, n_queries=120, n_entries=700, seed=1):
    rng = random.Random(seed)
    asked = [(i, x) for i, x in enumerate(dict.fromkeys(names(rng, n_queries) + ["mg", "tab mg", "zz", "zz mg", "w1"]))]
    queries = spark.createDataFrame(asked, "q_id long, q_name string").withColumn("q_tokens", t.tokens(F.col("q_name")))
    entries = spark.createDataFrame(list(enumerate(names(rng, n_entries))), "key long, name string")
    return queries, matching.catalog_index(entries, "name", "key")


def expected(pairs, budget):
    by = {}
    for r in pairs.collect():
        by.setdefault(r["q_id"], []).append((r["bucket"], 0.0 if r["bucket"] == 0 else -r["fast_jaccard"], r["idx"], r["overlap"], r["fast_jaccard"], r["candidate_count"]))
    return sorted((q, i, b, o, round(j, 12), n) for q, rows in by.items() for b, _, i, o, j, n in sorted(rows)[:budget])


@pytest.mark.parametrize(("budget", "seed"), [(3, 1), (10, 2), (60, 3), (2000, 4)])
def test_candidates_equal_the_full_join(spark, budget, seed):
    queries, index = sides(spark, seed=seed)
    got = matching.token_candidates(queries, index, budget)
    rows = sorted((r["q_id"], r["idx"], r["bucket"], r["overlap"], round(r["fast_jaccard"], 12), r["candidate_count"]) for r in got.collect())
    assert rows == expected(matching.all_pairs(queries, index), budget)


def test_common_tokens_make_few_pairs(spark, monkeypatch):
    queries, index = sides(spark, 60, 3000)
    counted = {}
    plain = prefix_index.compared

    def watch(pairs, asked, entries):
        counted[len(counted)] = pairs.count()
        return plain(pairs, asked, entries)

    monkeypatch.setattr(prefix_index, "compared", watch)
    matching.token_candidates(queries, index, 5)
    every = matching.all_pairs(queries, index).count()
    assert sum(counted.values()) < 0.1 * every


def test_no_candidates_for_empty_sides(spark):
    queries, index = sides(spark, 10, 30)
    assert matching.token_candidates(queries.limit(0), index, 5).count() == 0
    assert matching.token_candidates(queries, index.limit(0), 5).count() == 0


def test_pairs_that_share_enough_tokens(spark):
    queries, index = sides(spark)
    asked = queries.withColumn("brand", matching.brand_token(F.col("q_tokens")))
    for least in (1, 2, 3):
        got = prefix_index.sharing(asked, index, F.lit(least))
        want = matching.all_pairs(queries, index).where(F.col("overlap") >= least)
        assert sorted(map(tuple, got.select("q_id", "idx", "overlap").collect())) == sorted(map(tuple, want.select("q_id", "idx", "overlap").collect()))


def vocabulary(rng, n):
    base = ["".join(rng.choice("abcdeä") for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    for w in list(base):
        w = list(w)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        base.append("".join(w))
    return sorted({*base, "panadol", "panadols", "pan", "panad", "x1", "x2", "b" * 200, "b" * 190 + "a" * 3, "a"} - {""})


def test_similar_words_equal_all_pairs(spark):
    rng = random.Random(5)
    left, right = vocabulary(rng, 120), vocabulary(rng, 120)
    got = similar_words.pairs(*(spark.createDataFrame([(w,) for w in x], "word string") for x in (left, right)))
    want = {(a, b): x for a in left for b in right if a != b and (x := s.token_similarity(a, b)) > s.LEAST}
    assert {(r["a"], r["b"]): r["similarity"] for r in got.collect()} == want and len(want) > 50


def by_hand(query, entry):
    """The assignment, one word after the other."""
    left, taken, near = dict(enumerate(entry)), [], []
    for token in query:
        best = max(((s.token_similarity(token, x), -at) for at, x in left.items()), default=(0.0, 0))
        taken.append(-best[1] if best[0] > 0.7 else -1)
        near.append(best[0] if best[0] > 0.7 else 0.0)
        left.pop(taken[-1], None)
    return taken, near


def test_assignment_in_columns_equals_one_word_after_the_other(spark):
    rng = random.Random(8)
    words = ["panadol", "panadols", "pandol", "tab", "tabs", "tap", "500", "50", "gel", "gell", "a"]
    rows = [(i, *(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 7))) for _ in range(2))) for i in range(500)]
    asked, known = similar_words.facts(*(spark.createDataFrame([(r[0], r[k]) for r in rows], "i long, name string") for k in (1, 2)))
    got = asked.join(known, "i").select("i", s.assigned(F.col("_q"), F.col("_c")).alias("x"), (F.size("_q.similar") == 0).alias("plain")).select("i", "x.*", "plain").collect()
    assert {r["plain"] for r in got} == {True, False}
    for r in got:
        assert (r["taken"], r["near"]) == by_hand(rows[r["i"]][1].split(), rows[r["i"]][2].split())
