"""Match results: predicates, sorts, decisions, and the export projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.functions import text as t

_RANKS = {"matched": 0, "review": 1, "no_match": 2}


def top(field: str, matches: str = "matches") -> Column:
    return F.get(F.col(matches), 0)[field]


def top_status(matches: str = "matches") -> Column:
    return F.coalesce(top("status", matches), F.lit("no_match"))


def found_by(text: str, name: str = "original_name", matches: str = "matches", field: str = "normalized") -> Column:
    """Case-insensitive: in the row's own name or in any candidate's."""
    q = text.lower()
    return F.lower(F.col(name)).contains(q) | F.coalesce(F.exists(F.col(matches), lambda m: F.lower(m[field]).contains(q)), F.lit(False))


def filtered(results: DataFrame, text: str = "", statuses: Sequence[str] = (), methods: Sequence[str] = ()) -> DataFrame:
    out = results
    if text:
        out = out.where(found_by(text))
    if statuses:
        out = out.where(top_status().isin(*statuses))
    return out.where(F.col("matching_method").isin(*methods)) if methods else out


def status_rank(status: Column) -> Column:
    out = F.lit(3)
    for name, rank in _RANKS.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def sorted_by(results: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """By row_index, score, status (matched, review, no_match), matching_method
    or any other column; row_index settles ties."""
    c = {"score": F.col("top_score"), "status": status_rank(top_status())}.get(key, F.col(key))
    return results.orderBy(c.desc() if descending else c.asc(), "row_index")


def promote(results: DataFrame, decisions: DataFrame, key: str = "row_index") -> DataFrame:
    """Chosen candidates first: ``decisions`` is (key, idx); the chosen one gets
    score 1 and status matched, and others of the same idx go."""
    d = decisions.select(F.col(key).alias("_dk"), F.col("idx").alias("_idx"))
    picked = F.transform(F.filter("matches", lambda m: m["idx"] == F.col("_idx")), lambda m: m.withField("score", F.lit(1.0)).withField("status", F.lit("matched")))
    changed = F.concat(F.slice(picked, 1, 1), F.filter("matches", lambda m: m["idx"] != F.col("_idx")))
    out = results.join(d, F.col(key) == F.col("_dk"), "left").withColumn("matches", F.when(F.col("_idx").isNotNull(), changed).otherwise(F.col("matches")))
    return out.withColumn("top_score", F.when(F.col("_idx").isNotNull() & (F.size("matches") > 0), F.lit(1.0)).otherwise(F.col("top_score"))).drop("_dk", "_idx")


def candidate_columns(k: int = 3) -> list[Column]:
    """candidate_1_score, ... of the first k candidates; empty where absent."""
    out = []
    for i in range(k):
        m = F.get(F.col("matches"), i)
        out += [F.coalesce(m[f].cast("string"), F.lit("")).alias(f"candidate_{i + 1}_{n}") for n, f in (("score", "score"), ("id", "idx"), ("name_en", "normalized"))]
    return out


def backfilled(results: DataFrame, catalog: DataFrame, fields: Sequence[str], key: str = "row_index") -> DataFrame:
    """Stored candidates with fields renewed from the catalog by idx; their order
    is kept."""
    each = results.select(key, F.posexplode("matches").alias("_pos", "_m")).withColumn("_idx", F.col("_m")["idx"])
    renewed = each.join(catalog.select(F.col("idx").alias("_idx"), *[F.col(f).alias(f"_f_{f}") for f in fields]), "_idx", "left")
    m = F.col("_m")
    for f in fields:
        m = m.withField(f, F.col(f"_f_{f}"))
    lists = renewed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", m.alias("m")))).alias("_l")).select(F.col(key).alias("_k"), F.transform("_l", lambda x: x["m"]).alias("_matches"))
    return results.drop("matches").join(lists, F.col(key) == F.col("_k"), "left").withColumnRenamed("_matches", "matches").drop("_k")


def matched_counts(results: DataFrame) -> DataFrame:
    st = top_status()
    return results.agg(F.count("*").alias("total"), *[F.count_if(st == n).alias(n) for n in _RANKS]).withColumn("accuracy", s.share(F.col("matched"), F.col("total")))


#: Export fields: header -> (catalog column, default); bracketed headers as in feeds.
EXPORT = {
    "name[en]": "title_en", "name[ar]": "title_ar", "details[en]": "description_en", "details[ar]": "description_ar", "price": "price",
    "unit": "unit", "image": "image", "brand": "brand_id", "category_l1": "category_l1_slug", "category_l2": "category_l2_slug", "category_l3": "category_l3_slug",
    "slug": "slug", "source": "source",
}


def export_projection(results: DataFrame, matched: Column, fields: Mapping[str, str] = EXPORT, overrides: Mapping[str, Column] | None = None) -> list[Column]:
    """One column a header: the override if present, else the catalog's value
    where the row is matched, else empty."""
    over = dict(overrides or {})
    headers = list(dict.fromkeys([*fields, *over]))
    out = []
    for h in headers:
        value = F.when(matched, F.col(fields[h]).cast("string")) if h in fields and fields[h] in results.columns else F.lit(None).cast("string")
        if h in ("image",):
            value = t.basenames(value)
        first = t.present(over[h].cast("string")) if h in over else F.lit(None).cast("string")
        out.append(F.coalesce(first, value, F.lit("")).alias(h))
    return out


def picked_fields(df: DataFrame, registry: Mapping[str, Column], wanted: Sequence[str], original: Sequence[str] = ()) -> DataFrame:
    """Fields by id; unknown ids are left out, ``orig_col_N`` is the N-th
    uploaded column (from 0)."""
    cols = []
    for f in wanted:
        if f in registry:
            cols.append(registry[f].alias(f))
        elif f.startswith("orig_col_") and f[9:].isdigit() and int(f[9:]) < len(original):
            cols.append(F.col(f"`{original[int(f[9:])]}`"))
    return df.select(*cols)


def store_link(slug: Column, base: str) -> Column:
    return F.when(F.coalesce(slug, F.lit("")) != "", F.concat(F.lit(base), slug)).otherwise("")


def with_image_status(products: DataFrame, image: str, local: DataFrame, filename: str = "filename") -> DataFrame:
    """``image_status``: local where the image's base name is in the listing,
    cdn where it has an image, else none."""
    known = local.select(F.col(filename).alias("_f")).distinct().withColumn("_l", F.lit(True))
    j = products.withColumn("_b", t.basename(F.col(image))).join(known, F.col("_b") == F.col("_f"), "left")
    return j.withColumn("image_status", F.when(F.col("_l"), "local").when(F.coalesce(F.col("_b"), F.lit("")) != "", "cdn").otherwise("none")).drop("_b", "_f", "_l")
