"""Catalog storage: product documents, versioned tables, dictionaries, media."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as t
from linkloom.operators import tables

_CATEGORY = "struct<slug:string,title_en:string,title_ar:string>"
_VARIANT = "struct<id:string,name_en:string,name_ar:string,sku:string,price:double,discount_price:double,stock:int,in_stock:boolean,image:string>"
#: Schema of a product document. Levels two and three may be an object or a list,
#: so they are read as text and coerced.
DOCUMENT = (
    "id string, slug string, title_en string, title_ar string, name_en string, name_ar string, price double, final_price double, in_stock boolean, image string, "
    "description_en string, description_ar string, meta_description_en string, meta_description_ar string, brands struct<id:string,title_en:string,title_ar:string,slug:string,images:string>, "
    f"level_one_category {_CATEGORY}, level_two_category string, level_three_category string, product_variants array<{_VARIANT}>, "
    "code string, international_barcode string, need_prescription boolean, unit string, share_link string, source string, _source string, normalized_name_en string"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Product documents from a JSON array file, or one document a line."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def category_list(c: Column) -> Column:
    """An object or a list as a list of categories."""
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, f"array<{_CATEGORY}>")), F.when(F.trim(c).startswith("{"), F.array(F.from_json(c, _CATEGORY))), F.array().cast(f"array<{_CATEGORY}>"))


def catalog_rows(docs: DataFrame, default_source: str = "feed") -> DataFrame:
    """Catalog rows of product documents; empty and zero values are absent."""
    p = t.first_present
    return docs.select(
        p(F.col("id"), F.col("slug")).alias("id"), p(F.col("title_en"), F.col("name_en")).alias("title_en"), p(F.col("title_ar"), F.col("name_ar")).alias("title_ar"),
        t.present(F.col("normalized_name_en")).alias("normalized_name_en"), F.col("slug"), t.first_nonzero(F.col("price")).alias("price"), t.first_nonzero(F.col("final_price"), F.col("price")).alias("final_price"),
        F.coalesce("in_stock", F.lit(True)).alias("in_stock"), "image", p(F.col("description_en"), F.col("meta_description_en")).alias("description_en"), p(F.col("description_ar"), F.col("meta_description_ar")).alias("description_ar"),
        "unit", "code", "international_barcode", p(F.col("brands.id"), F.col("brands.slug")).alias("brand_id"), F.col("level_one_category.slug").alias("category_l1_slug"),
        F.get(category_list(F.col("level_two_category")), 0)["slug"].alias("category_l2_slug"), F.get(category_list(F.col("level_three_category")), 0)["slug"].alias("category_l3_slug"),
        "share_link", F.coalesce("need_prescription", F.lit(False)).alias("need_prescription"), p(F.col("_source"), F.col("source"), F.lit(default_source)).alias("source"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("raw_json"),
    ).where("id is not null")


def decoded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``doc`` from raw_json; the column of the normalised name wins."""
    doc = F.from_json("raw_json", DOCUMENT)
    return rows.withColumn("doc", doc).withColumn("normalized_name_en", t.first_present(F.col("normalized_name_en"), F.col("doc.normalized_name_en")))


class Versions:
    """A table in versioned folders: a new version is written whole, then the
    pointer, a one-row table of its own version, is added. Readers take the last
    pointer, so a lost job leaves the old version in place."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _last(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.root}/pointer").agg(F.max("version")).first()[0] or 0
        except Exception as e:  # no pointer yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def empty(self) -> bool:
        return self._last() == 0

    def write(self, df: DataFrame) -> int:
        v = self._last() + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{v}")
        self.spark.range(1).select(F.lit(v).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.root}/pointer")
        return v

    def read(self) -> DataFrame:
        v = self._last()
        if not v:
            raise ValueError(f"nothing written at {self.root}")
        return self.spark.read.parquet(f"{self.root}/v{v}")

    def promote(self, to: Versions) -> int:
        """Make this table's last version the other's; an empty one is refused."""
        df = self.read()
        if df.isEmpty():
            raise ValueError("the staging table is empty")
        return to.write(df)


def stage(staging: DataFrame, new: DataFrame, order: str | None = None, clear: bool = False) -> DataFrame:
    """New rows by id over the staging table, or instead of it."""
    return tables.upsert(staging.limit(0) if clear else staging, new, "id", order)


def dictionary_tables(entries: DataFrame, units: Sequence[str], forms: Sequence[str]) -> DataFrame:
    """Token entries (key, value, ord) with token_type; the last of a key stays."""
    kind = F.when(F.col("value").isin(*units), "unit").when(F.col("value").isin(*forms), "form").otherwise("general")
    return tables.last_by(entries.withColumn("token_type", kind), "key", "ord")


def name_dump(spark: SparkSession, path: str) -> DataFrame:
    """pos, part of lines ``brand | description | size``."""
    return spark.read.text(path).select(F.posexplode(F.transform(F.split("value", r"\|"), lambda x: F.trim(x))).alias("pos", "part")).where("part <> ''")


def media_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, size_bytes, modified_at of files, newest first; contents
    are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")).orderBy(F.desc("modified_at"), "path")


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, JSON lines, or TSV with a header and absent values empty."""
    if kind == "tsv":
        tables.sanitize(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).na.fill("")).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    elif kind in ("json", "parquet"):
        getattr(df.write, kind)(path)
    else:
        raise ValueError(f"no writer for {kind}")


def write_run(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Results by run; the runs in ``df`` are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def write_chunks(df: DataFrame, path: str, parts: int, order: Sequence[str]) -> None:
    """Contiguous chunks of equal size, one folder each."""
    tables.chunks(tables.numbered(df, order), parts).drop("rn").write.partitionBy("part").parquet(path)


def snapshot(frames: Mapping[str, DataFrame], names: Sequence[str], protected: Sequence[str], root: str) -> list[str]:
    """Selected and protected tables copied under ``root``."""
    chosen = [n for n in frames if n in {*names, *protected}]
    for n in chosen:
        frames[n].write.parquet(f"{root.rstrip('/')}/{n}")
    return chosen


def refresh(staging: DataFrame, docs: DataFrame, default_source: str = "feed") -> DataFrame:
    """Catalog refresh: documents to rows, over staging, names normalised."""
    from linkloom.functions.normalize import normalize_missing

    return normalize_missing(stage(staging, catalog_rows(docs, default_source)), ["title_en", "title_ar", "id"])
