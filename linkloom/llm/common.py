"""Shared helpers: tables in the shared folder, samples, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of these; fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the one the cluster names in
    ``spark.checkpoint.dir``. Only where that is unset (local tests, one
    machine) a temporary folder is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="linkloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of
    lineage that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more: what was made
    of them must have been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(id_col, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; never for a
    null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def bounded_sample(df: DataFrame, key: str, bound: int, n_rows: int) -> DataFrame:
    """Rows of a hash threshold chosen so that about ``bound`` of ``n_rows``
    remain. Deterministic; repeated ids stay or go together."""
    if n_rows <= bound:
        return df
    scale = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(scale)) < int(scale * bound / n_rows))


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether every u has one v and no v is a u; one pass over the ends of ``e``."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).union(e.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("x").agg(F.sum("as_u").alias("n"), F.max("as_v").alias("low"))
    return held.where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("low") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (src, dst, longs): rows (node,
    component) for every node of an edge, component = smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    every node hangs on its component's least node; the number of edges never
    grows, and the rounds are logarithmic in practice. Minima are combined before
    the shuffle and written before they are joined, so that a hot node's edges
    can be split by adaptive skew joins. Each round's tables are deleted once the
    next round's edges are written. Empty input gives an empty table."""
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while not _is_forest_of_stars(e):
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        # (one row an edge, equal rows included: the small star makes them distinct)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # small star: u and its smaller neighbours are linked to the least of these
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e, old = cut(small, "edges"), e
        discard(old, low, large, least)
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
