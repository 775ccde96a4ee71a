"""The pipeline's stages against plain Python, on a small corpus."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_near, brute_spans, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    bench = [(i, prose(rng, 30, 900)) for i in range(5)]
    texts = [prose(rng, int(rng.integers(30, 80)), 900) for _ in range(120)]
    toxic = set(range(0, 40, 4))
    for i in toxic:
        w = texts[i].split()
        texts[i] = " ".join(x for pair in zip(w, ["idiot", "scum"] * len(w)) for x in pair)
    for i in range(100, 110):  # near copies of clean documents
        w = texts[i - 50].split()
        w[3] = "changed"
        texts[i] = " ".join(w) if i % 2 else texts[i - 50]
    leaks = {90, 91}
    for i in leaks:
        texts[i] = texts[i] + "\n" + bench[i - 90][1] + "\nmore words"
    texts[95] += " mail me@example.com or +49 30 1234567"
    texts += [None, ""]
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts, toxic, leaks


def test_stages(spark, corpus):
    root, texts, toxic, leaks = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    want = set(range(len(texts)))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, root).cache()
        got = {r["doc_id"]: r for r in docs.collect()}
        if k == 0:
            want -= toxic
        elif k == 1:
            ids = sorted(want)
            parts = brute_near([texts[i] for i in ids])
            want = {ids[p] for p in parts}
        elif k == 2:
            want -= leaks
        if k < 4:
            assert set(got) == want, name
            assert docs.columns == columns and docs.count() == len(want)
        if k == 3:
            assert "[EMAIL]" in got[95]["text"] and "[PHONE]" in got[95]["text"]
            assert all(got[i]["text"] == texts[i] for i in want if i != 95 and not brute_spans(texts[i]))
            sizes = {i: len(WORD.findall(got[i]["text"] or "")) for i in want}
        if k == 4:
            assert docs.columns == [*columns, "copy"]
            taken = {}
            for r in docs.collect():
                taken.setdefault(r["doc_id"], []).append(r["copy"])
            assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in taken.values())
            for s in range(4):
                own = [i for i in want if i % 4 == s]
                share = {0: 5, 1: 2, 2: 1, 3: 5}[s] / 13 * sum(sizes.values())
                assert sum(len(taken.get(i, [])) * sizes[i] for i in own) == pytest.approx(min(share, 3 * sum(sizes[i] for i in own)), rel=0.05)


def test_run_is_the_stages(spark, corpus):
    root = corpus[0]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
    assert sorted(map(str, corpus_pipeline.run(spark, root).collect())) == sorted(map(str, docs.collect()))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
