"""Exact quantiles of groups, however large a group is.

Equal values of a group are counted first, which combines before the shuffle. The
counts are dealt into ranges of (group, value), so that a hot group lies in many
ranges; a small table of sums by range and group says how many rows lie before each
range, and the ranges that hold a wanted rank give its value. No group is sorted in
one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources.shared import written


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)], F.lit(True))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], shares: Mapping[str, float], slices: int | None = None) -> DataFrame:
    """One row a group that has a value, null groups included: ``by`` and one column
    of ``shares`` each, interpolated between the two nearest ranks. Nulls are left out."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v"))
    # written, so that finding the bounds of the ranges doesn't read and count the rows again
    counted = written(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), "counted")
    placed = written(counted.repartitionByRange(n, *keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_part", *keys).agg(F.sum("_n").alias("_sum"))
    # one row a range here, so a window of a group holds as many rows as there are ranges
    whole = Window.partitionBy(*keys)
    before = sums.withColumn("_before", F.sum("_sum").over(whole.orderBy("_part")) - F.col("_sum")).withColumn("_all", F.sum("_sum").over(whole))
    ranks = F.array(*[x for q in shares.values() for x in (F.floor((F.col("_all") - 1) * F.lit(q)), F.ceil((F.col("_all") - 1) * F.lit(q)))])
    wanted = before.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_sum")))).where(F.size("_ranks") > 0)
    wanted = wanted.select(F.col("_part").alias("_wp"), *[F.col(k).alias(f"_w{k}") for k in keys], "_before", "_all", "_ranks")
    held = placed.join(wanted, (F.col("_part") == F.col("_wp")) & _same([F.col(k) for k in keys], [F.col(f"_w{k}") for k in keys]))
    inside = Window.partitionBy("_part", *keys).orderBy("_v")
    held = held.withColumn("_to", F.col("_before") + F.sum("_n").over(inside)).withColumn("_from", F.col("_to") - F.col("_n"))
    hits = held.where(F.exists("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_to"))))
    columns = []
    for name, q in shares.items():
        place = (F.col("_all") - 1) * F.lit(q)
        low, high = [F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_v"))) for r in (F.floor(place), F.ceil(place))]
        columns.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return hits.groupBy(*keys).agg(*columns).select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *shares)


def with_quantiles(grouped: DataFrame, quantiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """``grouped`` with the columns of ``quantiles``; null where a group has no value."""
    other = quantiles.select(*[F.col(c).alias(f"_q_{c}") for c in by], *[c for c in quantiles.columns if c not in by])
    joined = grouped.join(other, _same([F.col(c) for c in by], [F.col(f"_q_{c}") for c in by]), "left")
    return joined.drop(*[f"_q_{c}" for c in by])
