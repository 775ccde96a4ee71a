"""Keyed table work: first and last rows by key, upserts, patches, set deltas,
localized merges, chunks and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text as t
from linkloom.operators import containment
from linkloom.sources.shared import written


def _row(df: DataFrame, but: Sequence[str] = ()) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in but])


def _unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("_r")[c].alias(c) for c in columns])


def first_by(df: DataFrame, key: str | Sequence[str], order: str | Column) -> DataFrame:
    """The first row of each key by ``order``: an aggregate, which combines
    before the shuffle, instead of a window over whole groups."""
    keys = [key] if isinstance(key, str) else list(key)
    return _unpacked(df.groupBy(*keys).agg(F.min_by(_row(df), order).alias("_r")), df.columns)


def last_by(df: DataFrame, key: str | Sequence[str], order: str | Column) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return _unpacked(df.groupBy(*keys).agg(F.max_by(_row(df), order).alias("_r")), df.columns)


def last_in_first_place(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key with the place of the first, ``place``."""
    g = df.groupBy(key).agg(F.max_by(_row(df), order).alias("_r"), F.min(order).alias("place"))
    return g.select(*[F.col("_r")[c].alias(c) for c in df.columns], "place")


def upsert(table: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of the same key; of repeated new keys the
    last by ``order`` stays. Rows without a key are dropped from ``new``."""
    rows = new.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    rows = last_by(rows, key, order) if order else rows
    return table.join(rows.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(rows.select([c for c in table.columns]))


def patch_dictionary(table: DataFrame, deletes: DataFrame, upserts: DataFrame, key: str, order: str) -> DataFrame:
    """Exact (key, value) pairs deleted, then pairs upserted."""
    return upsert(table.join(deletes, deletes.columns, "left_anti").select(table.columns), upserts, key, order)


def upsert_keeping(table: DataFrame, new: DataFrame, key: str, kept: str) -> DataFrame:
    """An upsert in which ``kept`` keeps the old value where there is one."""
    old = table.select(key, F.col(kept).alias("_old"))
    return upsert(table, new.join(old, key, "left").withColumn(kept, F.coalesce("_old", kept)).drop("_old"), key)


def patch_columns(table: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``table`` with present values of ``patches`` in ``columns`` and an
    ``outcome``: updated, already_set or not_in_lookup."""
    renamed = patches.select(F.col(key).alias("_pk"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(renamed, F.col(key) == F.col("_pk"), "left")
    new = [F.col(f"_new_{c}") for c in columns]
    changed = F.lit(False)
    for c, n in zip(columns, new, strict=True):
        changed = changed | F.coalesce(n != F.col(c), n.isNotNull() & F.col(c).isNull())
    outcome = F.when(F.col("_pk").isNull(), "not_in_lookup").when(changed, "updated").otherwise("already_set")
    rest = [F.col(f"`{c}`") if c not in columns else F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in table.columns]
    return joined.select(*rest, outcome.alias("outcome"))


def new_keys(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.select(key).distinct().join(old.select(key).distinct(), key, "left_anti")


def key_delta(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Counts of keys that are new, discontinued and up to date."""
    side = new.select(key).distinct().withColumn("_n", F.lit(True)).join(old.select(key).distinct().withColumn("_o", F.lit(True)), key, "full_outer")
    return side.agg(F.count_if(F.col("_o").isNull()).alias("n_new"), F.count_if(F.col("_n").isNull()).alias("n_discontinued"), F.count_if(F.col("_n") & F.col("_o")).alias("n_up_to_date"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side (both, left_only, right_only) of every key."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both").alias("side"))


def localized(en: DataFrame, ar: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """``en`` with ``<column>_ar`` from the last row of ``ar`` of the same key,
    falling back to the English value."""
    other = last_by(ar, key, order).select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    kept = [F.col(f"`{c}`") for c in en.columns]
    return en.join(other, F.col(key) == F.col("_k"), "left").select(*kept, *[t.first_present(F.col(f"_{c}"), F.col(c)).alias(f"{c}_ar") for c in columns])


def resolve_by_names(df: DataFrame, text: str, entities: DataFrame, names: Sequence[str], order: str, out: str = "entity") -> DataFrame:
    """``df`` with the first entity one of whose names equals ``text``, ignoring
    case and outer blanks; else null."""
    keys = F.explode(F.array_distinct(F.array(*[F.lower(F.trim(n)) for n in names])))
    table = entities.withColumn("_name", keys).where("_name is not null and _name <> ''").groupBy("_name").agg(F.min_by(_row(entities), order).alias(out))
    return df.withColumn("_text", F.lower(F.trim(text))).join(table, F.col("_text") == F.col("_name"), "left").drop("_text", "_name")


def resolve_contained(df: DataFrame, text: str, names: DataFrame, name: str, order: str) -> DataFrame:
    """``df`` with ``resolved``: the equal name, else the first name by ``order`` that
    holds the text or is held by it, else the text in title case. Texts are resolved
    once each; neither side needs to be small (see ``containment``)."""
    texts = df.select(F.lower(F.trim(text)).alias("x")).where("x <> ''").distinct()
    table = names.select(F.lower(F.trim(name)).alias("y"), F.col(name).alias("_as"), F.col(order).alias("_ord")).where("y <> ''")
    table = table.groupBy("y").agg(F.min_by("_as", F.struct("_ord", "_as")).alias("_as"), F.min("_ord").alias("_ord"))
    pairs = containment.holding_pairs(texts, table.select("y")).join(table, "y")
    equal = F.col("x") == F.col("y")
    found = pairs.groupBy("x").agg(F.min_by("_as", F.struct(F.when(equal, 0).otherwise(1), "_ord", "_as")).alias("_held"))
    return df.withColumn("_text", F.lower(F.trim(text))).join(found, F.col("_text") == F.col("x"), "left").withColumn("resolved", F.coalesce("_held", F.initcap("_text"))).drop("_text", "_held", "x")


def numbered(df: DataFrame, order: Sequence[str | Column], out: str = "rn", slices: int | None = None) -> DataFrame:
    """``df`` with its 1-based place by a total order, without one task that
    sorts all: rows are dealt into ranges and written, counted by range, and
    numbered within each from what lies before it."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() % (1 << 33)), "ranges")
    before, table = 0, []
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row a range
        table += [F.lit(r["_part"]), F.lit(before)]
        before += r["n"]
    start = F.element_at(F.create_map(*table), F.col("_part")) if table else F.lit(0)
    return placed.withColumn(out, (start + F.col("_in") + 1).cast("long")).drop("_part", "_in")


def chunks(df: DataFrame, parts: int, rn: str = "rn") -> DataFrame:
    """``part`` from 0: contiguous parts of ceil(n / parts) rows by ``rn``."""
    n = df.count()
    return df.withColumn("part", F.floor((F.col(rn) - 1) / max(1, -(-n // parts))).cast("int"))


def page(df: DataFrame, order: Sequence[str | Column], offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def side_by_side(tables: Sequence[DataFrame], column: str, order: str, n: int = 10) -> DataFrame:
    """The first n values of each table in columns ``c1``, ``c2``, ..."""
    out = None
    for i, df in enumerate(tables, 1):
        w = Window.orderBy(order)
        head = df.orderBy(order).limit(n).select(F.row_number().over(w).alias("rn"), F.col(column).alias(f"c{i}"))
        out = head if out is None else out.join(head, "rn", "full_outer")
    return out


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same n rows on every run: those of least seeded hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def sanitize(df: DataFrame) -> DataFrame:
    """Text columns without control characters."""
    return df.select(*[t.sanitized(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields])


def subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, or all where none is listed."""
    kept = [c for c in columns if c in df.columns]
    return df.select(*kept) if kept else df
