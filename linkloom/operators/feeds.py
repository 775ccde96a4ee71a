"""Shapes of crawled and external product feeds, media, and reuse of details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as t


def flatten_map(df: DataFrame, column: str, prefix: str = "spec_", keys: Sequence[str] | None = None, most: int = 500) -> DataFrame:
    """``df`` with one column a key of a map. The keys are read from the data
    unless given; more than ``most`` of them are an error, not a cut."""
    if keys is None:
        keys = sorted(r["k"] for r in df.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(most + 1).collect())
        if len(keys) > most:
            raise ValueError(f"more than {most} keys in {column}")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *[F.try_element_at(F.col(column), F.lit(k)).alias(prefix + k) for k in keys])


def flatten_crawl(df: DataFrame) -> DataFrame:
    """Nested crawl records (name, brand, category, subcategory as structs of en
    and ar, specification as a map) to flat columns."""
    nested = [c for c in ("name", "brand", "category", "subcategory", "overview") if c in df.columns]
    flat = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in nested], *[F.col(c)[k].alias(f"{c}_{k}") for c in nested for k in ("en", "ar")])
    return flatten_map(flat, "specification") if "specification" in flat.columns else flat


def repaired_ids(hits: DataFrame) -> DataFrame:
    """id from slug or objectID where it is absent; slug from id."""
    key = t.first_present(*[F.col(c) for c in ("id", "slug", "objectID") if c in hits.columns])
    return hits.withColumn("id", key).withColumn("slug", t.first_present(F.col("slug"), F.col("id")))


def shaped(products: DataFrame, images: str = "images", variants: str = "variants") -> DataFrame:
    """Products with images as structs by place and variants with prices filled."""
    pics = F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda u, i: F.struct(i.alias("place"), u.alias("url"), t.safe_filename(u).alias("filename")))
    kinds = F.transform(F.coalesce(F.col(variants), F.array().cast(dict(products.dtypes)[variants])), lambda v: v.withField("price", t.first_nonzero(v["price"], F.col("price"))))
    return products.withColumn(images, pics).withColumn(variants, kinds)


def with_gallery(products: DataFrame, enriched: DataFrame, key: str = "id", image: str = "image") -> DataFrame:
    """``gallery``: the enriched images by key, else the product's image, else none."""
    found = enriched.groupBy(F.col(key).alias("_k")).agg(F.min_by("images", F.to_json("images")).alias("_images"))
    one = F.when(F.coalesce(F.col(image), F.lit("")) != "", F.array(F.col(image)))
    return products.join(found, F.col(key) == F.col("_k"), "left").withColumn("gallery", F.coalesce("_images", one, F.array().cast("array<string>"))).drop("_k", "_images")


def media_found(products: DataFrame, image: str, listings: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``media``: the first listing, in the given order, that holds the image."""
    cur = products.withColumn("_b", t.basename(F.col(image)))
    for i, (label, files) in enumerate(listings):
        names = files.select(F.col("filename").alias(f"_f{i}")).distinct().withColumn(f"_m{i}", F.lit(label))
        cur = cur.join(names, F.col("_b") == F.col(f"_f{i}"), "left")
    marks = [f"_m{i}" for i in range(len(listings))]
    return cur.withColumn("media", F.coalesce(*marks)).drop("_b", *marks, *[f"_f{i}" for i in range(len(listings))])


def product_of_file(files: DataFrame, products: DataFrame, image: str, key: str, order: str) -> DataFrame:
    """Each file with its first product."""
    owner = products.withColumn("_b", t.basename(F.col(image))).where("_b <> ''").groupBy("_b").agg(F.min_by(key, order).alias(key))
    return files.join(owner, F.col("filename") == F.col("_b"), "left").drop("_b")


def reuse(new: DataFrame, cached: DataFrame, key: str, detail: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``new`` with the details of a former crawl, and what is still to fetch. Of
    repeated cached keys the least details are taken, whether null or not."""
    row = F.struct(*[F.col(c) for c in detail])
    old = cached.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    have = new.join(old, F.col(key) == F.col("_k")).select(*[F.col(f"`{c}`") for c in new.columns], *[F.col("_row")[c].alias(c) for c in detail])
    return have, new.join(cached.select(key).distinct(), key, "left_anti")


def nested_localized(en: DataFrame, ar: DataFrame, key: str, children: str) -> DataFrame:
    """Two levels merged by slug: the Arabic name of each parent and of each of
    its children (structs of slug and name), English where there is none."""
    def each(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key), F.posexplode(children).alias("pos", "c")).select(key, "pos", F.col("c.slug").alias("slug"), F.col("c.name").alias(name))

    kids = each(en, "name_en").join(each(ar, "name_ar").drop("pos"), [key, "slug"], "left")
    kids = kids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "slug", "name_en", t.first_present(F.col("name_ar"), F.col("name_en")).alias("name_ar")))).alias(children))
    names = en.select(key, F.col("name").alias("name_en")).join(ar.select(key, F.col("name").alias("_ar")), key, "left").select(key, "name_en", t.first_present(F.col("_ar"), F.col("name_en")).alias("name_ar"))
    return names.join(kids, key, "left")


def lookup(dictionaries: Sequence[tuple[str, DataFrame]], word: str, exact: bool = False) -> DataFrame:
    """Entries of (key, value) dictionaries that hold a word."""
    out = None
    for label, df in dictionaries:
        hit: Column = (F.col("key") == word) | (F.col("value") == word) if exact else F.col("key").contains(word) | F.col("value").contains(word)
        one = df.where(hit).select(F.lit(label).alias("dictionary"), "key", "value")
        out = one if out is None else out.unionByName(one)
    return out
