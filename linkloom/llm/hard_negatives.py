"""Hard-negative mining with bounds along a spanning tree of anchors.

For each anchor the best rows of its own label are its positives; for each
positive the best rows of other labels whose score lies in a window below the
positive's are its hard negatives. Scores are integer inner products of floored
components.

Anchors of one label (of several, where these have few) are a block. In a block
the anchors hang on a spanning tree of least distances (Prim). A candidate x whose
score s is known at a parent has a score of s +- |child - parent| |x| at the child
(Cauchy and Schwarz); a score known only by bounds passes wider bounds on. Only
candidates whose bounds overlap what the child asks for are rescored: at least the
score of its fifth best row (of the row that must be the fifth best by the bounds),
or a window of one of its positives, from the score of the third best row that
surely lies in it. All others can't be among the results, so the result is exact
whatever the distances are; how many are rescored depends on how near the anchors
of a block are.

Blocks of anchors meet blocks of candidates, each pair in a task of its own: a row
is copied once a block of the other side, and what comes out is bounded by the
anchors' number of results. Positives need only the blocks that share a label.
The best of all blocks are chosen by a window over an anchor's (and positive's)
partial results. Both steps are written to the shared folder.

Scores are exact: blocks whose norms multiply to less than 2**53 are scored in
doubles, others in integers of any size; a score that fits no long is returned as
the nearest long.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or
non-finite component take no part; vectors of another length than an anchor's have
no score with it; rows that share an id are separate rows, and equal ones of them
give equal results, each counted; an anchor without another row of its label gives
nothing; ties go to the smaller id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut, discard, documents_of

#: Anchors and candidates of a block.
ANCHORS = 512
CANDIDATES = 4096
_LONG = np.iinfo(np.int64)


def scaled(v: pd.Series, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) as doubles."""
    return np.floor(scale * np.vstack(v.to_list()).astype(np.float64)) if len(v) else np.zeros((0, 0))


def _exact(x: np.ndarray) -> np.ndarray:
    return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order in which Prim's algorithm reaches the rows from the one nearest to
    their mean, each row's parent (itself for the first), and the distance to it."""
    n = len(x)
    root = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    order, parent, apart = np.empty(n, int), np.full(n, root), np.full(n, np.inf)
    left = np.ones(n, bool)
    at = root
    apart[root] = 0
    for i in range(n):
        order[i] = at
        left[at] = False
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        nearer = left & (d < apart)
        apart[nearer], parent[nearer] = d[nearer], at
        if i + 1 < n:
            at = int(np.flatnonzero(left)[np.argmin(apart[left])])
    return order, parent, apart


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value; minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class _Scores:
    """Scores of candidates at the anchors of a block, visited along their tree."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        self.a, self.x = anchors, rows
        self.norm = np.sqrt((rows**2).sum(axis=1))
        reach = np.sqrt((anchors**2).sum(axis=1)).max(initial=0) * self.norm.max(initial=0)
        if not reach < 2**53:
            self.a, self.x = _exact(anchors), _exact(rows)
        self.order, self.parent, self.apart = spanning_tree(anchors)
        self.left = np.bincount(self.parent[self.order[1:]], minlength=len(anchors))  # children to come
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.rescored = 0

    def bound(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each candidate at ``a``, by those at its parent."""
        if a == self.order[0]:
            return np.full(len(self.x), -np.inf), np.full(len(self.x), np.inf)
        p = int(self.parent[a])
        lo, hi = self.bounds[p]
        self.left[p] -= 1
        if not self.left[p]:
            del self.bounds[p]
        # room for the rounding of the distance, of the norm and of the bounds themselves
        room = self.apart[a] * self.norm * (1 + 1e-9) + 1e-9 * np.maximum(np.abs(lo), np.abs(hi)) + 1e-3
        return lo - room, hi + room

    def score(self, a: int, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Exact scores of the candidates ``own`` at ``a``, kept as bounds for its children."""
        exact = self.x[own] @ self.a[a]
        if self.left[a]:
            lo[own] = hi[own] = exact.astype(np.float64)
            if exact.dtype == object:  # the double may lie on either side
                lo[own] -= np.abs(lo[own]) * 1e-9
                hi[own] += np.abs(hi[own]) * 1e-9
            self.bounds[a] = lo, hi
        self.rescored += len(own)
        return exact


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k] if score.dtype != object else np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], int)


def _clip(values: list) -> np.ndarray:
    return np.array([min(max(int(v), _LONG.min), _LONG.max) for v in values], np.int64)


def top_same_label(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    """row, vec_id, other, score: the k best other rows of each anchor's label."""
    out: list[tuple] = []
    if anchors.empty or rows.empty:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("row", "vec_id", "other", "score")})
    a, x = scaled(anchors["v"], scale), scaled(rows["v"], scale)
    # one label's candidates after the other; its anchors have a tree of their own
    for label in anchors["label"].unique():
        of_a, of_x = np.flatnonzero(anchors["label"] == label), np.flatnonzero(rows["label"] == label)
        if not len(of_x):
            continue
        row_a, row_x = anchors["row"].to_numpy()[of_a], rows["row"].to_numpy()[of_x]
        id_a, id_x = anchors["vec_id"].to_numpy()[of_a], rows["vec_id"].to_numpy()[of_x]
        scores = _Scores(a[of_a], x[of_x])
        for i in scores.order.tolist():
            lo, hi = scores.bound(i)
            other = row_x != row_a[i]
            own = np.flatnonzero((hi >= _kth(lo[other], k)) | ~np.isfinite(lo))
            exact = scores.score(i, own, lo, hi)
            real = other[own]
            best = _best(exact[real], id_x[own][real], k)
            out += [(int(row_a[i]), int(id_a[i]), int(i_), s) for i_, s in zip(id_x[own][real][best].tolist(), exact[real][best].tolist(), strict=True)]
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    return pd.DataFrame({"row": np.array(cols[0], np.int64), "vec_id": np.array(cols[1], np.int64), "other": np.array(cols[2], np.int64), "score": _clip(cols[3])})


def top_in_windows(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, scale: int, low: int, high: int) -> pd.DataFrame:
    """row, nth, other, score: the k best rows of another label in the window of each
    positive of each anchor. ``anchors`` has the positives' scores as lists."""
    out: list[tuple] = []
    if anchors.empty or rows.empty:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("row", "nth", "other", "score")})
    label_a, label_x = anchors["label"].to_numpy(), rows["label"].to_numpy()
    row_a, id_x, asked = anchors["row"].to_numpy(), rows["vec_id"].to_numpy(), anchors["scores"].to_list()
    scores = _Scores(scaled(anchors["v"], scale), scaled(rows["v"], scale))
    for i in scores.order.tolist():
        lo, hi = scores.bound(i)
        other = label_x != label_a[i]
        wanted = ~np.isfinite(lo)
        windows = [(-(-low * int(s) // 100), high * int(s) // 100) for s in asked[i]]
        for least, most in windows:
            surely = other & (lo >= least) & (hi <= most)
            floor = max(float(least), _kth(lo[surely], k))
            wanted |= other & (hi >= floor) & (lo <= most)
        own = np.flatnonzero(wanted)
        exact = scores.score(i, own, lo, hi)
        real = np.flatnonzero(other[own])
        exact, ids = exact[real], id_x[own[real]]
        for nth, (least, most) in enumerate(windows):
            fits = np.flatnonzero((exact >= least) & (exact <= most))
            best = fits[_best(exact[fits], ids[fits], k)]
            out += [(int(row_a[i]), nth, o, s) for o, s in zip(ids[best].tolist(), exact[best].tolist(), strict=True)]
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    return pd.DataFrame({"row": np.array(cols[0], np.int64), "nth": np.array(cols[1], np.int32), "other": np.array(cols[2], np.int64), "score": _clip(cols[3])})


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(v) > 0) & real, F.lit(False)))


def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    anchors_a_block: int = ANCHORS, candidates_a_block: int = CANDIDATES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding; ``is_anchor``: a condition on them. A
    negative's score is between ``low`` and ``high`` percent of the positive's.
    Components count as floor(``scale`` * x)."""
    usable = _usable(vectors.select("vec_id", "label", "embedding", F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    rows = cut(usable.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"),
        F.size("embedding").alias("len"), "anchor"), "vectors")
    # labels with many rows are groups of their own, the others are packed; a group is cut into parts by hash
    sizes = cut(rows.groupBy("len", "label").agg(F.count("*").alias("n")), "label_sizes")
    small = sizes.where(F.col("n") < candidates_a_block).groupBy("len").agg(F.ceil(F.sum("n") / candidates_a_block).alias("packs"))
    pack = F.when(F.col("n") < candidates_a_block, F.pmod(F.xxhash64(F.col("label")), F.col("packs")))
    named = sizes.join(small, "len", "left").select("len", "label", F.xxhash64(F.when(pack.isNull(), F.col("label").cast("string")), pack).alias("grp"))
    grouped = cut(rows.join(named, ["len", "label"]), "grouped")
    counts = grouped.groupBy("len", "grp").agg(
        F.ceil(F.count_if("anchor") / anchors_a_block).cast("int").alias("a_parts"), F.ceil(F.count("*") / candidates_a_block).cast("int").alias("x_parts"))
    counts = cut(counts.where("a_parts > 0"), "group_sizes")
    dealt = grouped.join(counts, ["len", "grp"], "left")
    salt = F.xxhash64(F.lit(29), F.col("row"))
    part_a, part_x = (F.pmod(salt, F.col(c)).cast("int") for c in ("a_parts", "x_parts"))

    def each(df: DataFrame, n: Column, name: str, columns: list[str]) -> DataFrame:
        """A copy of each row for each block of the other side, as columns of its own."""
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), n - 1))).select(*(F.col(c).alias(c) for c in columns))

    # positives: blocks of one group
    keys = ["len", "grp", "pa", "px"]
    of_a = each(dealt.where("anchor").withColumn("pa", part_a), F.col("x_parts"), "px", [*keys, "row", "vec_id", "label", "v"])
    of_x = each(dealt.where("a_parts > 0").withColumn("px", part_x), F.col("a_parts"), "pa", [*keys, "row", "vec_id", "label", "v"])
    near = of_a.groupBy(*keys).cogroup(of_x.groupBy(*keys)).applyInPandas(lambda a, x: top_same_label(a, x, n_positives, scale), "row long, vec_id long, other long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "other")
    positives = cut(near.withColumn("nth", F.row_number().over(best) - 1).where(F.col("nth") < n_positives), "positives")

    # negatives: every block of anchors meets every block of candidates
    lists = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("s")).select("row", F.col("s.score").alias("scores"))
    asking = dealt.where("anchor").withColumn("pa", part_a).join(lists, "row")
    blocks = rows.groupBy("len").agg(F.ceil(F.count_if("anchor") / anchors_a_block).cast("int").alias("na"), F.ceil(F.count("*") / candidates_a_block).cast("int").alias("nx"))
    blocks = cut(blocks.where("na > 0"), "blocks")
    keys = ["len", "a", "x"]
    a_block = F.pmod(F.xxhash64(F.lit(31), F.col("grp"), F.col("pa")), F.col("na")).cast("int")
    of_a = each(asking.join(blocks, "len").withColumn("a", a_block), F.col("nx"), "x", [*keys, "row", "label", "v", "scores"])
    of_x = each(rows.join(blocks, "len").withColumn("x", F.pmod(salt, F.col("nx")).cast("int")), F.col("na"), "a", [*keys, "vec_id", "label", "v"])

    def found(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return top_in_windows(a, x, n_negatives, scale, low, high)

    hard = of_a.groupBy(*keys).cogroup(of_x.groupBy(*keys)).applyInPandas(found, "row long, nth int, other long, score long")
    best = Window.partitionBy("row", "nth").orderBy(F.desc("score"), "other")
    negatives = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    made = cut(
        negatives.withColumnRenamed("other", "negative_id").withColumnRenamed("score", "negative_score").join(positives, ["row", "nth"]).select(
            F.col("vec_id").alias("anchor_id"), F.col("other").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
            F.col("score").alias("positive_score"), "negative_score"), "hard_negatives")
    discard(rows, sizes, grouped, counts, positives, blocks)
    return made


def op13_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 50."""
    vectors = documents_of(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH g AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id other, a.label = b.label same, list_inner_product(a.v, b.v)::BIGINT score
  FROM g a JOIN g b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other positive_id, score positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, positive_score, other negative_id, score negative_score,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
WHERE rank <= 3"""
