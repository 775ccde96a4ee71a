"""Embedding near-dedup by an inverted multi-index.

Each half of a unit vector has an own codebook; the pair of nearest centroids is
the vector's cell in a product grid (Babenko and Lempitsky, 2012). A query
visits the cells in the order of multi-sequence traversal: two lists, one a
half, sorted by how far the query lies from the border of each centroid's
region, are merged by rising sum of squares. A vector within distance ``delta``
lies in a cell whose borders are, over both halves, no farther than ``delta``
together, so visiting the cells up to that sum reaches every such vector: the
target recall is 1. A lower target takes differences to have no direction of
their own, so that a border is crossed as a normal variable would cross it, and
stops the traversal there. Of two cells only the lesser visits the other, and
links count for both sides. Candidates are verified by cosine in double
precision.

Vectors equal in every component, under one label, are one class with a number
given once in a written table; classes are compared and counted with their
sizes. Each label and vector length has a grid of its own, so that a hot label
gets more cells. A cell is dealt
into blocks of about ``block`` classes; a block of members and a block of
queries meet in one task as a matrix product, so no pair is ever emitted: out
come the number of links of each query and, for the components, one edge a
vector to the smallest number of its connected part of the two blocks.

Codebooks are fitted on at most about ``max_sample`` vectors a label and length,
chosen by a hash, in one task each; every vector is indexed. Classes meet their
codebooks in parts of about ``part_rows``.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and vectors with a null label, link with nothing; vectors of another
length than the query's link with nothing of it; repeated vectors link with each
other; an empty table gives an empty result. Rows that share a vec_id, or have
none, are separate rows that link by their own vectors; a component's id is its
smallest vec_id that is not null. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import components, cut, discard, documents_of

THRESHOLD = 0.98
BLOCK = 256


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else very large components overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k rows spread over the sample."""
    k = min(k, len(x))
    if not x.shape[1]:  # half of a vector of one component
        return np.zeros((1, 0))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        near = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def _usable_flag() -> Column:
    v = F.col("embedding").cast("array<double>")
    real = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col("label").isNotNull() & F.coalesce(real, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (doubles) of the vectors that can link."""
    return vectors.where(_usable_flag()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def classes_of(vectors: DataFrame) -> DataFrame:
    """rep (a number of its own), label, v, len, weight, low (least vec_id): one
    row for each distinct vector of a label."""
    made = vectors.groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    return cut(made.select(F.monotonically_increasing_id().alias("rep"), "label", "v", F.size("v").alias("len"), "weight", "low"), "classes")


def fit_codebooks(classes: DataFrame, per_cell: int = 256, max_sample: int = 10_000, part_rows: int = 5_000) -> DataFrame:
    """label, len, parts, left, right: two codebooks for each label and length,
    whose product grid has about ``per_cell`` classes a cell. ``parts``: in how
    many parts its classes are indexed, so that a copy of the codebooks is small
    beside a part."""
    n = cut(classes.groupBy("label", "len").agg(F.count("*").alias("n")), "label_sizes")
    scale = 1 << 30
    drawn = F.pmod(F.xxhash64(F.lit(17), F.col("v")), F.lit(scale)) < F.least(F.lit(float(scale)), F.lit(float(scale) * max_sample) / F.col("n"))
    sample = classes.select("label", "v", "len").join(n, ["label", "len"]).where(drawn)
    kind = dict(classes.dtypes)["label"]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, length = int(pdf["n"].iloc[0]), int(key[1])
        k = max(2, round((n / per_cell) ** 0.5))
        x = unit(np.vstack(sorted(pdf["v"].to_list(), key=lambda v: tuple(v))))
        books = [_means(h, k) for h in (x[:, : length // 2], x[:, length // 2 :])]
        rows = max(part_rows, 16 * max(map(len, books)))
        return pd.DataFrame({"label": [key[0]], "len": [length], "parts": [-(-n // rows)], "left": [books[0].ravel()], "right": [books[1].ravel()]})

    return cut(sample.groupBy("label", "len").applyInPandas(fit, f"label {kind}, len int, parts long, left array<double>, right array<double>"), "codebooks")


def _borders(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, and the squared distance from each row to the border
    between it and each other centroid."""
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]
    near = np.argmin(d, axis=1)
    gap = (centres**2).sum(axis=1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(axis=1)[None, :]
    apart = 2 * np.sqrt(np.maximum(gap[near], 1e-30))
    far = np.maximum(d - d[np.arange(len(x)), near][:, None], 0) / apart
    far[np.arange(len(x)), near] = 0
    return near, far**2


def traverse(left: np.ndarray, right: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """Cells by rising left + right, up to ``bound``: multi-sequence order."""
    a, b = (i[np.argsort(far[i], kind="stable")] for far, i in ((left, np.flatnonzero(left <= bound)), (right, np.flatnonzero(right <= bound))))
    if not len(a) or not len(b):
        return []
    heap, out = [(left[a[0]] + right[b[0]], 0, 0)], []
    while heap:
        at, i, j = heapq.heappop(heap)
        if at > bound:
            break
        out.append((int(a[i]), int(b[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (left[a[i + 1]] + right[b[0]], i + 1, 0))
    return out


def index_rows(classes: DataFrame, books: DataFrame, threshold: float = THRESHOLD, recall: float = 1.0) -> DataFrame:
    """rep, label, len, v, weight, home, own, cell: each class in its home cell as
    a member (home) and as a query (own), and in the visited cells of a greater
    number as a query."""
    apart = (2 - 2 * threshold) ** 0.5
    part = F.pmod(F.xxhash64(F.lit(23), F.col("rep")), F.col("parts"))
    dealt = classes.select("rep", "label", "len", "v", "weight").join(cut(books.select("label", "len", "parts"), "parts"), ["label", "len"]).withColumn("part", part)
    copies = books.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    kind = dict(classes.dtypes)["label"]

    def place(key: tuple, pdf: pd.DataFrame, book: pd.DataFrame) -> pd.DataFrame:
        length = int(key[1])
        left = np.asarray(book["left"].iloc[0]).reshape(-1, length // 2) if length > 1 else np.zeros((1, 0))
        right = np.asarray(book["right"].iloc[0]).reshape(-1, length - length // 2)
        normal = apart if recall >= 1 else min(apart, NormalDist().inv_cdf(1 - (1 - recall) / 2) * apart / length**0.5)
        bound = normal**2 + 1e-9
        row, cell, home, same = [], [], [], []
        for lo in range(0, len(pdf), 1000):
            x = unit(np.vstack(pdf["v"].iloc[lo : lo + 1000].to_list()))
            near_l, far_l = _borders(x[:, : length // 2], left)
            near_r, far_r = _borders(x[:, length // 2 :], right)
            for i in range(len(x)):
                own = int(near_l[i]) * len(right) + int(near_r[i])
                visits = [own, own, *(c for c in (a * len(right) + b for a, b in traverse(far_l[i], far_r[i], bound)) if c > own)]
                row += [lo + i] * len(visits)
                cell += visits
                home += [True] + [False] * (len(visits) - 1)
                same += [True, True] + [False] * (len(visits) - 2)
        return pdf.iloc[row][["rep", "label", "len", "v", "weight"]].assign(home=home, own=same, cell=cell)

    return dealt.groupBy("label", "len", "part").cogroup(copies.groupBy("label", "len", "part")).applyInPandas(
        place, f"rep long, label {kind}, len int, v array<double>, weight long, home boolean, own boolean, cell long")


def verified(placed: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """rep, n (links to other classes' vectors), root: one row a query, block of
    members. Members of a cell are dealt into blocks by hash, and so are its
    queries; every block of queries meets every block of members."""
    size = placed.groupBy("label", "len", "cell").agg(F.count_if("home").alias("m"), F.count_if(~F.col("home")).alias("q"))
    size = cut(size.select("label", "len", "cell", F.ceil(F.col("m") / block).cast("int").alias("mb"), F.ceil(F.col("q") / block).cast("int").alias("qb")).where("mb > 0 and qb > 0"), "cells")
    dealt = placed.join(size, ["label", "len", "cell"])
    salt = F.xxhash64(F.lit(3), F.col("rep"))
    at = F.when(F.col("home"), F.pmod(salt, F.col("mb"))).otherwise(F.pmod(salt, F.col("qb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("qb")).otherwise(F.col("mb")) - 1))
    met = dealt.withColumn("_at", at).withColumn("_other", other).select(
        "rep", "label", "len", "v", "weight", "home", "own", "cell",
        F.when(F.col("home"), F.col("_at")).otherwise(F.col("_other")).alias("mi"),
        F.when(F.col("home"), F.col("_other")).otherwise(F.col("_at")).alias("qi"),
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        q, m = pdf[~pdf["home"]], pdf[pdf["home"]]
        empty = pd.DataFrame({"rep": np.empty(0, np.int64), "n": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        if not len(q) or not len(m):
            return empty
        links = unit(np.vstack(q["v"].to_list())) @ unit(np.vstack(m["v"].to_list())).T >= threshold
        qr, mr, w = q["rep"].to_numpy(), m["rep"].to_numpy(), m["weight"].to_numpy()
        links &= qr[:, None] != mr[None, :]
        n = links @ w
        across = ~q["own"].to_numpy()
        back_n = links[across].T @ q["weight"].to_numpy()[across]
        root, member = qr.copy(), mr.copy()
        top = np.iinfo(np.int64).max
        while True:  # smallest name of each connected part of the two blocks
            near = np.where(links, member[None, :], top).min(axis=1)
            new = np.minimum(root, near)
            back = np.where(links, new[:, None], top).min(axis=0)
            new_member = np.minimum(member, back)
            if (new == root).all() and (new_member == member).all():
                break
            root, member = new, new_member
        hit = links.any(axis=1)
        touched = links.any(axis=0)
        return pd.concat([pd.DataFrame({"rep": qr[hit], "n": n[hit], "root": root[hit]}), pd.DataFrame({"rep": mr[touched], "n": back_n[touched], "root": member[touched]})])

    return met.groupBy("label", "len", "cell", "mi", "qi").applyInPandas(compare, "rep long, n long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, per_cell: int = 256, max_sample: int = 10_000, recall: float = 1.0, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    good = usable(rows)
    classes = classes_of(good)
    placed = cut(index_rows(classes, fit_codebooks(classes, per_cell, max_sample), threshold, recall), "placed")
    found = cut(verified(placed, threshold, block), "links")
    joined = components(found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = cut(
        classes.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "v", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("part")), "named"
    )
    least = cut(named.groupBy("part").agg(F.min("low").alias("component_id")), "least")
    per_class = cut(named.join(least, "part").select("label", "v", "n_links", "component_id"), "per_class")
    discard(classes, placed, found, named, least)
    linked = good.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    lone = rows.where(~_usable_flag()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.union(lone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(documents_of(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE g AS (
  SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT vec_id, min(reach) component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) n FROM l GROUP BY a)
SELECT c.vec_id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON a = c.vec_id"""
