"""Barcode enrichment: classify, apply to the catalog, decide reviews; and the
choice of discovered products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.functions import text as t

STATUSES = ("matched", "review", "no_match", "already_synced")


def enrich(results: DataFrame, sheet_code: str, catalog_code: str, score: str = "top_score", matched: float = 0.60, review: float = 0.40) -> DataFrame:
    """``results`` with enrichment_status, review_reason and apply_status."""
    code = t.cell_text(F.col(sheet_code))
    e = s.enrichment_of(code.isNotNull(), F.col(score), code, t.cell_text(F.col(catalog_code)), matched, review)
    return results.withColumn("_e", e).withColumn("enrichment_status", F.col("_e.status")).withColumn("review_reason", F.col("_e.reason")).drop("_e").withColumn("apply_status", F.when(F.col("enrichment_status") == "already_synced", "applied").otherwise("pending"))


def recount(results: DataFrame) -> DataFrame:
    st, ap = F.col("enrichment_status"), F.col("apply_status")
    return results.agg(*[F.count_if(st == x).alias(x) for x in STATUSES], F.count_if(ap == "applied").alias("applied"), F.count_if((st == "matched") & (ap == "pending")).alias("pending_apply"))


def apply_matched(results: DataFrame, live: DataFrame, key: str, code: str, sheet_code: str) -> tuple[DataFrame, DataFrame]:
    """The new live catalog, and ``results`` with outcome: already_synced,
    updated, missing_product or not_applied. Only matched pending rows apply;
    of several rows for one product the least row_index counts."""
    ready = (F.col("enrichment_status") == "matched") & (F.col("apply_status") == "pending")
    now = live.select(F.col(key).alias("_lk"), t.cell_text(F.col(code)).alias("_live"))
    out = results.join(now, F.col(key) == F.col("_lk"), "left").withColumn(
        "outcome", F.when(~ready, "not_applied").when(F.col("_lk").isNull(), "missing_product").when(F.col("_live").eqNullSafe(t.cell_text(F.col(sheet_code))), "already_synced").otherwise("updated"))
    new = out.where("outcome = 'updated'").groupBy(F.col(key).alias("_nk")).agg(F.min_by(t.cell_text(F.col(sheet_code)), "row_index").alias("_code"))
    changed = live.join(new, F.col(key) == F.col("_nk"), "left").select(*[F.coalesce("_code", c).alias(c) if c == code else F.col(f"`{c}`") for c in live.columns])
    return changed, out.drop("_lk", "_live")


def decide(results: DataFrame, decisions: DataFrame, key: str = "row_index") -> DataFrame:
    """``decisions`` (key, action): override applies a review row, skip closes it."""
    d = decisions.select(F.col(key).alias("_k"), F.col("action").alias("_a"))
    ap = F.when((F.col("_a") == "override") & (F.col("enrichment_status") == "review"), "overridden").when(F.col("_a") == "skip", "skipped").otherwise(F.col("apply_status"))
    return results.join(d, F.col(key) == F.col("_k"), "left").withColumn("apply_status", ap).drop("_k", "_a")


def status_edits(results: DataFrame, decisions: DataFrame, column: str, key: str = "row_index") -> DataFrame:
    """Plain status edits by row (accept, reject, import)."""
    d = decisions.select(F.col(key).alias("_k"), F.col("status").alias("_s"))
    return results.join(d, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_s", column)).drop("_k", "_s")


def best_source(hits: DataFrame, query: str, score: str, order: list[str], found: float = 0.60, review: float = 0.40) -> DataFrame:
    """One hit a query: the first by ``order`` that scores ``found`` or more, else
    the best, of equals the first. ``n_candidates``: how many there are, ten at most."""
    place = F.struct(*[F.col(c) for c in order])
    all_ = F.struct(*[F.col(c) for c in hits.columns])
    g = hits.groupBy(query).agg(
        F.min_by(all_, F.when(F.col(score) >= found, place)).alias("_found"),
        F.min_by(all_, F.struct((-F.col(score)).alias("s"), place.alias("o"))).alias("_best"),
        F.least(F.count("*"), F.lit(10)).cast("int").alias("n_candidates"),
        F.max(score).alias("_top"),
    )
    pick = F.when(F.col("_top") >= found, F.col("_found")).otherwise(F.col("_best"))
    return g.withColumn("_p", pick).select(query, *[F.col("_p")[c].alias(c) for c in hits.columns if c != query], s.status_of(F.col("_p")[score], found, review, ("found", "review", "not_found")).alias("discovery_status"), "n_candidates")


def discovered_products(found: DataFrame, domain: str, title: str) -> DataFrame:
    """Catalog rows of found discoveries: id disc-<domain>-<hash>, slug."""
    h = F.substring(F.md5(F.concat_ws(":", domain, title)), 1, 10)
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return found.select(F.concat_ws("-", F.lit("disc"), domain, h).alias("id"), slug.alias("slug"), F.col(title).alias("title_en"), F.lit("uncategorized").alias("category_l1_slug"), F.col(domain).alias("source"))


def image_tasks(products: DataFrame, brands: DataFrame, url: str, order: str) -> DataFrame:
    """Each image URL once, products before brands, by first place."""
    both = products.select(F.col(url).alias("url"), F.lit("products").alias("folder"), F.col(order).alias("ord"), F.lit(0).alias("w")).unionByName(brands.select(F.col(url).alias("url"), F.lit("brands").alias("folder"), F.col(order).alias("ord"), F.lit(1).alias("w")))
    return both.where("url is not null and url <> ''").groupBy("url").agg(F.min(F.struct("w", "ord", "folder")).alias("m")).select("url", F.col("m.folder").alias("folder"), t.safe_filename(F.col("url")).alias("filename"))


def rank_first(df: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
