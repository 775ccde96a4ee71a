"""Uploaded sheets: delimiter detection, loading, bad rows, roles of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import text as t

DELIMITERS = (",", "\t", ";", "|")
BAD = "_corrupt_record"

# Headers of the roles.
NAME = ("name", "product_name", "product name", "item_name", "item name", "drug_name", "drug name", "title", "title_en", "الاسم", "الاسم الانجليزى", "الاسم العربي")
BARCODE = ("barcode", "international_barcode", "international barcode", "gtin", "ean", "upc", "باركود", "الباركود")
CODE = ("code", "item_code", "item code", "sku", "product_code", "كود", "الكود")


def delimiters(spark: SparkSession, path: str, head: int = 5) -> DataFrame:
    """file, sep: the delimiter of each text file from its first lines. One that
    is in every line scores 10 plus its count where the counts agree, else 5
    plus the least; others score their count in the first line. Nothing found: a
    comma. Only the first ``head`` lines of a file leave its tasks."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))).where(F.col("rn") <= head)
    first = first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("head"))
    values = F.transform("head", lambda x: x["value"])

    def score(d: str) -> Column:
        n = F.transform(values, lambda v: F.length(v) - F.length(F.replace(v, F.lit(d), F.lit(""))))
        least, most = F.array_min(n), F.array_max(n)
        return F.when(least > 0, F.when(least == most, 10 + least).otherwise(5 + least)).otherwise(F.get(n, 0))

    scores = F.array(*[F.struct(score(d).alias("s"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    best = F.array_max(scores)
    return first.select("file", F.when(best["s"] > 0, best["d"]).otherwise(",").alias("sep"))


def read_sheet(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A sheet by its extension; all CSV columns as text, bad rows kept in BAD."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind not in ("csv", "tsv", "txt"):
        raise ValueError(f"no reader for .{kind} files")
    if sep is None:
        found = {r["sep"] for r in delimiters(spark, path).select("sep").distinct().collect()}  # at most four
        if len(found) > 1:
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_sheet_files(spark, path, s) for s in sorted(found)])
        sep = next(iter(found), ",")
    return _csv(spark, path, sep)


def read_sheet_files(spark: SparkSession, path: str, sep: str) -> DataFrame:
    files = [r["file"] for r in delimiters(spark, path).where(F.col("sep") == sep).collect()]
    return _csv(spark, files, sep)


def _csv(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    # rows are parsed whole, whatever is selected: else a bad one may pass for good
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*header, BAD])
    return spark.read.schema(schema).options(header=True, sep=sep, mode="PERMISSIVE", columnPruning=False, columnNameOfCorruptRecord=BAD).csv(path)


def bad_rows(sheet: DataFrame, sep: str = ",") -> DataFrame:
    """expected, found, record of the rows that do not fit the header. Fields are
    counted at the sheet's own delimiter, outside quotes. A field is read beside the
    record, as Spark parses no file for the bad record alone."""
    parsed = F.length(F.concat_ws("", f"`{sheet.columns[0]}`")) >= 0
    bare = F.regexp_replace(BAD, r'"(?:[^"]|"")*"', "")
    return sheet.where(F.col(BAD).isNotNull() & parsed).select(F.lit(len(sheet.columns) - 1).alias("expected"), F.size(F.split(bare, "\\Q" + sep + "\\E", -1)).alias("found"), F.col(BAD).alias("record"))


def header_role(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """Exact, then case-insensitive, then a candidate inside the header."""
    for c in columns:
        if c in candidates:
            return c
    lowered = [x.lower() for x in candidates]
    for c in columns:
        if c.strip().lower() in lowered:
            return c
    for c in columns:
        if any(x in c.lower() for x in lowered):
            return c
    return None


def role_profile(sheet: DataFrame) -> DataFrame:
    """column, filled, gtin, digits, letters: shares of the values of every text
    column, in one pass."""
    names = [f.name for f in sheet.schema.fields if f.dataType.simpleString() == "string" and f.name != BAD]
    if not names:
        raise ValueError("no text columns")

    def share(c: Column) -> Column:
        return F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)

    each = [F.struct(F.lit(n).alias("column"), share(F.trim(f"`{n}`") != "").alias("filled"), share(t.valid_gtin(F.col(f"`{n}`"))).alias("gtin"), share(F.trim(f"`{n}`").rlike(r"^\d+$")).alias("digits"), share(F.col(f"`{n}`").rlike(r"[a-zA-Z؀-ۿ]")).alias("letters")) for n in names]
    return sheet.agg(F.array(*each).alias("p")).select(F.explode("p").alias("p")).select("p.*")
