"""Mixing sources to target weights by entropy balancing.

Every document d of source s gets a rate r_d, the number of copies the mix takes
of it. Among all rates between 0 and ``cap`` whose tokens sum to the source's
target, entropy balancing takes the one nearest to 1 in relative entropy:

    r_d = min(cap, exp(lambda_s * x_d)),  x_d = size_d / mean size of s

The multipliers lambda solve the convex dual by Newton steps, kept within a
bracket so that every source converges. Each step is one distributed aggregation
over the histogram (source, size) of all documents, an exact summary of the
corpus for this problem; the state of the sources is a table, not the driver's.

Rates are rounded to whole copies so that the tokens taken follow the rates. All
documents of one source and size have the same rate. From the longest size to
the shortest, the parts of copies beyond the whole ones are counted up, and a
document takes one copy more where the count passes a whole number. So at every
size the copies given are within one of those owed, and the tokens of a source
within about one document of its target. A document's place in the count comes
from the histogram and its number within a part of at most about ``part_rows``
documents of that source and size; no task sees a whole source.

Sums are exact (whole numbers and decimals), so reruns agree whatever the order
of tasks.

Defined cases: a null or empty text has size 0, rate 1 and takes nothing; a null
source is a source of its own, sorted last; a source without tokens has target
0. An empty table gives an empty result. Repeated rows are separate documents,
null ids too. Extra columns are kept by ``take_mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, cut, discard, documents_of

WEIGHTS = (5, 2, 1)
CAP = 3
#: Parts of a copy are counted in steps of one over this.
PARTS = 1_000_000


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key_of(source: Column) -> Column:
    """A join key that is never null and sorts as the source, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def sources_of(hist: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """key, docs, source_size, weight of each source. ``hist``: (key, size, n).
    Sources are numbered by code point: a range sort deals them into partitions,
    whose counts give each partition its first number."""
    spark = hist.sparkSession
    sums = hist.groupBy("key").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    dealt = cut(sums.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources")
    before, total = {}, 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # one row a partition
        before[r["part"]], total = total, total + r["count"]
    first = spark.createDataFrame(list(before.items()), "part int, first long")
    number = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    return dealt.join(F.broadcast(first), "part").select("key", "docs", "source_size", weight.alias("weight"))


def with_targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` with target: shares of the total size by weight; a target
    stops at cap times its source's size and the excess is shared again by weight
    until none is above."""
    now = cut(sources.withColumn("full", F.lit(False)), "shares")
    while True:
        r = now.agg(F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), F.col("source_size"))).alias("stopped"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weights")).first()
        left, weights = float(r["all"] or 0) - cap * float(r["stopped"] or 0), float(r["weights"] or 1)
        share = F.col("weight") * (left / weights)
        over = ~F.col("full") & (share > cap * F.col("source_size"))
        if now.where(over).isEmpty():
            return now.withColumn("target", F.when(F.col("full"), cap * F.col("source_size").cast("double")).otherwise(share)).drop("full")
        now, old = cut(now.withColumn("full", F.col("full") | over), "shares"), now
        discard(old)


def rate_of(lam: Column, size: Column, mean: Column, cap: float = CAP) -> Column:
    return F.when(size == 0, 1.0).when(lam == float("inf"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(50.0)))))


def newton_multipliers(hist: DataFrame, sources: DataFrame, cap: float = CAP, steps: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """``sources`` (key, docs, source_size, target, ...) with lam and converged.
    A step outside the bracket is replaced by its middle, so that 100 steps use
    up a double's digits."""
    inf = float("inf")
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    # rates below one can be as small as needed, but never zero: lambda starts from a finite bracket
    state = sources.withColumn("mean", F.col("source_size") / F.col("docs")).select(
        "*", F.when(F.col("source_size") == 0, 0.0).when(full, inf).otherwise(0.0).alias("lam"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"),
        ((F.col("source_size") == 0) | full).alias("converged"))
    state = cut(state, "state")
    worded = hist.where("size > 0")
    x = F.col("size") / F.col("mean")
    tokens = F.col("n") * F.col("size")
    for _ in range(steps):
        todo = state.where("not converged")
        if todo.isEmpty():
            break
        rated = worded.join(todo.select("key", "mean", "lam"), "key").withColumn("rate", rate_of(F.col("lam"), F.col("size"), F.col("mean"), cap))
        exact = "decimal(38,9)"  # sums of decimals don't depend on their order
        sums = rated.groupBy("key").agg(
            F.sum((tokens * F.col("rate")).cast(exact)).cast("double").alias("got"),
            F.sum(F.when(F.col("rate") < cap, tokens * x * F.col("rate")).otherwise(0.0).cast(exact)).cast("double").alias("slope"))
        gap = F.col("got") - F.col("target")
        near = F.abs(gap) <= tolerance * F.greatest(F.lit(1.0), F.col("target"))
        moved = state.join(sums, "key", "left").select(
            *[c for c in state.columns if c not in ("low", "high", "converged")], "got", "slope", gap.alias("gap"),
            F.when(gap <= 0, F.greatest("low", "lam")).otherwise(F.col("low")).alias("low"), F.when(gap > 0, F.least("high", "lam")).otherwise(F.col("high")).alias("high"),
            (F.col("converged") | F.coalesce(near, F.lit(False))).alias("converged"))
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
        bounded = (F.col("low") > -inf) & (F.col("high") < inf)
        middle = F.when(bounded, (F.col("low") + F.col("high")) / 2).when(F.col("gap") > 0, F.col("lam") * 2 - 1).otherwise(F.col("lam") * 2 + 1)
        to = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
        state, old = cut(moved.withColumn("lam", F.when(F.col("converged"), F.col("lam")).otherwise(to)).select(state.columns), "state"), state
        discard(old)
    return state.drop("low", "high")


def planned(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, part_rows: int = 1000, keep: Column | None = None) -> DataFrame:
    """size, source_size, target, rate, converged, copies of every row of
    ``docs`` (doc_id, source, text), with ``keep`` as column ``row``."""
    key = _key_of(F.col("source").cast("string"))
    # rows of one id are told apart by what they hold, so that reruns deal copies to the same rows
    own = F.xxhash64("text") if keep is None else F.xxhash64(F.to_json(keep, {"ignoreNullFields": "false"}))
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), key.alias("key"), size_of(F.col("text")).alias("size"), (F.lit(True) if keep is None else keep).alias("row")), "sized")
    hist = cut(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "sizes")
    fitted = newton_multipliers(hist, with_targets(sources_of(hist, weights, cap), cap), cap)
    # the count of parts of copies owed by all longer sizes of the source; a row a size, not a document
    rate = rate_of(F.col("lam"), F.col("size"), F.col("mean"), cap)
    part = F.round((F.col("rate") - F.floor("rate")) * PARTS).cast("long")
    longer = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    plan = hist.join(fitted.drop("docs", "weight"), "key").withColumn("rate", rate).withColumn("part", F.when(F.col("size") == 0, 0).otherwise(part))
    plan = plan.withColumn("owed", F.coalesce(F.sum(F.col("n") * F.col("part")).over(longer), F.lit(0))).withColumn("deals", F.ceil(F.col("n") / part_rows).cast("int"))
    plan = cut(plan.select("key", "size", "source_size", "target", "rate", "converged", "part", "owed", "deals"), "plan")
    # parts of one source and size, each with the number of documents in those before it
    joined = sized.join(plan, ["key", "size"]).withColumn("deal", F.pmod(F.xxhash64(F.lit(5), F.col("doc_id"), F.col("own")), F.col("deals")))
    deals = joined.where("deals > 1").groupBy("key", "size", "deal").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(deals.select("key", "size", "deal", F.coalesce(before, F.lit(0)).alias("before")), "deals")
    number = F.row_number().over(Window.partitionBy("key", "size", "deal").orderBy(F.xxhash64(F.lit(6), F.col("doc_id")), "doc_id", "own")).cast("long")
    counted = joined.join(offsets, ["key", "size", "deal"], "left").withColumn("number", F.coalesce("before", F.lit(0)) + number)
    more = F.expr(f"({PARTS // 2} + owed + number * part) div {PARTS} - ({PARTS // 2} + owed + (number - 1) * part) div {PARTS}")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor("rate") + more).cast("long")
    return counted.select("doc_id", "size", "source_size", "target", "rate", "converged", copies.alias("copies"), "row")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, part_rows: int = 1000) -> DataFrame:
    """doc_id, size, source_size, target, rate, converged, copies, taken of every
    row of ``docs`` (doc_id, source, text)."""
    return planned(docs, weights, cap, part_rows).drop("row").withColumn("taken", F.col("copies") * F.col("size"))


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents_of(spark, sf_dir))


def take_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mixed corpus: each row of ``docs`` once per copy taken, with its number
    from 1 in a last column ``copy`` (``copy_`` where ``docs`` has a ``copy``).
    Every row has its own copies, whatever its id."""
    number = "copy_" if "copy" in docs.columns else "copy"
    rows = planned(docs, weights, cap, keep=F.struct(*[F.col(f"`{c}`") for c in docs.columns])).where("copies > 0")
    copies = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n"))
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("n").alias(number))
