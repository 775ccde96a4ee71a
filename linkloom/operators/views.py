"""Views of jobs, results, catalogs and galleries: filters, ranges, previews and
statistics. All are column predicates or aggregates that combine before a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as s
from linkloom.functions import text as t
from linkloom.functions.normalize import Options, normalized
from linkloom.operators import similar_words, tables


def holds(text: str, *columns: str) -> Column:
    """Whether any of the columns holds the text, whatever the case; true for no text."""
    hay = F.lower(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]))
    return hay.contains(text.lower()) if text else F.lit(True)


def enriched(df: DataFrame, text: str = "", status: str | None = None, applied: str | None = None, pending: bool = False, columns: Sequence[str] = ("name", "sheet_barcode", "db_barcode")) -> DataFrame:
    """Enrichment rows by status, apply status and text; ``pending`` leaves those
    that a barcode would still be written for: matched, and of another barcode."""
    out = df.where(holds(text, *columns))
    if status:
        out = out.where(F.col("enrichment_status") == status)
    if applied:
        out = out.where(F.col("apply_status") == applied)
    if pending:
        out = out.where((F.col("enrichment_status") == "matched") & ~F.col("sheet_barcode").eqNullSafe(F.col("db_barcode")))
    return out


def discovered(df: DataFrame, text: str = "", status: str | None = None, columns: Sequence[str] = ("name", "title", "domain")) -> DataFrame:
    out = df.where(holds(text, *columns))
    return out.where(F.col("discovery_status") == status) if status else out


def crawled(df: DataFrame, text: str = "", category: int | None = None, brand: int | None = None, name: str = "name", key: str = "id") -> DataFrame:
    """By a piece of name or id, a category at either level, a brand."""
    out = df.where(holds(text, name, key))
    if category is not None:
        out = out.where((F.col("category_id") == category) | (F.col("subcategory_id") == category))
    return out.where(F.col("brand_id") == brand) if brand is not None else out


def gallery(df: DataFrame, text: str = "", columns: Sequence[str] = ("filename", "label", "title_ar", "id")) -> DataFrame:
    return df.where(holds(text, *columns))


def jobs(df: DataFrame, status: str | None = None, created: str = "created_at", key: str = "run_id", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Newest first, those of a status, a page of them."""
    out = (df.where(F.col("status") == status) if status else df).orderBy(F.desc(created), key).offset(offset)
    return out.limit(limit) if limit is not None else out


def eligible_runs(df: DataFrame) -> DataFrame:
    """Runs that discovery can start from."""
    return df.where(F.col("status").isin("completed", "stopped") & (F.col("no_match_count") > 0))


def runs_like(df: DataFrame, text: str) -> DataFrame:
    return df.where(holds(text, "filename", "run_id"))


def product_url(url: Column) -> Column:
    """An http address, or a host of a common domain with a path."""
    return url.rlike(r"^https?://") | url.rlike(r"^[\w-]+(\.[\w-]+)*\.(com|eg|net|org|shop)/")


def site_hits(hits: DataFrame, domain: str, path_like: str, url: str = "url") -> DataFrame:
    """Hits on the domain or its subdomains whose path matches the pattern."""
    host = t.domain_of(F.col(url))
    path = F.regexp_extract(F.col(url), r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    return hits.where(t.same_domain(host, F.lit(domain)) & path.rlike(path_like))


def suspicious(df: DataFrame, least: float = 0.75, status: str = "status", score: str = "score") -> DataFrame:
    return df.where((F.col(status) == "matched") & (F.col(score) < least))


def penalty_cases(df: DataFrame, status: str = "status") -> DataFrame:
    """Names alike as strings that penalties keep from matching."""
    return df.where((F.col(status) != "matched") & (F.col("sequence") > 0.7) & (F.col("score") < 0.6))


def resolving_sample(df: DataFrame, known: Sequence[tuple[str, DataFrame, str]], n: int, order: str) -> DataFrame:
    """The first n rows whose columns all resolve: ``known`` has (column of the
    rows, table, column of the table)."""
    out = df
    for column, table, name in known:
        out = out.join(table.select(F.col(name).alias("_k")), out[column] == F.col("_k"), "left_semi")
    return out.orderBy(order).limit(n)


def named(df: DataFrame, name: str) -> DataFrame:
    """Rows with a name: not null, blank or ``nan``."""
    c = F.trim(F.col(name).cast("string"))
    return df.where(c.isNotNull() & (c != "") & (F.lower(c) != "nan"))


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == value)


def export_range(df: DataFrame, first: int, last: int, order: Sequence[str]) -> DataFrame:
    """Rows ``first`` to ``last`` of the order, counted from 1, both included."""
    return tables.numbered(df, order).where(F.col("rn").between(first, last)).drop("rn")


def by_level(df: DataFrame, level: str = "level", count: str = "n", slug: str = "slug") -> DataFrame:
    return df.orderBy(level, F.desc(count), slug)


def by_best_score(df: DataFrame, key: str, score: str = "best_score") -> DataFrame:
    return df.orderBy(F.desc(score), key)


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows, every value as text."""
    return df.orderBy(*order).limit(n).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def catalog_stats(live: DataFrame, staging: DataFrame, promotions: DataFrame) -> DataFrame:
    """One row: sizes, how many have a normalised name, code and barcode, and the
    last promotion. ``promotions``: (promoted_at)."""
    has = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"n_{label}") for label, c in (("normalized", "normalized_name"), ("code", "code"), ("barcode", "barcode"))]
    return live.agg(F.count("*").alias("n_live"), *has).crossJoin(staging.agg(F.count("*").alias("n_staging"))).crossJoin(promotions.agg(F.max("promoted_at").alias("last_promoted_at")))


def gallery_stats(products: DataFrame, image: str = "image", media: str = "media", brand_url: str = "brand_url") -> DataFrame:
    """One row of ``products`` that ``feeds.media_found`` has marked."""
    pictured = F.coalesce(F.col(image), F.lit("")) != ""
    return products.agg(
        F.count("*").alias("n_products"), F.count_if(pictured).alias("with_image"), F.count_if(pictured & F.col(media).isNotNull()).alias("local"),
        F.count_if(pictured & F.col(media).isNull()).alias("missing"), F.count_distinct(brand_url).alias("brand_urls"),
    )


def disk_usage(files: DataFrame, job: str = "job", size: str = "size_bytes") -> DataFrame:
    """Files and bytes of each job, and of all in a row of null job."""
    return files.groupingSets([[F.col(job)], []], job).agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def run_totals(runs: DataFrame) -> DataFrame:
    done, active = F.col("status") == "completed", F.col("status").isin("running", "pending")
    return runs.agg(F.count_if(done).alias("completed"), F.count_if(active).alias("active"), F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"))


def title_score(pairs: DataFrame, query: str, title: str, options: Options | None = None) -> DataFrame:
    """The pair score of a normalised external title."""
    clean = normalized(pairs, title, "_title", options)
    return similar_words.scored_names(clean, query, "_title").drop("_title")


def merged_stats(old: Column, new: Column, keys: Sequence[str]) -> Column:
    """A map of counters with the chosen keys of another over it."""
    chosen = F.map_filter(new, lambda k, v: k.isin(*keys) & v.isNotNull())
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(chosen, k)), chosen)


def no_match_feed(results: DataFrame, run, columns: Sequence[str], run_column: str = "run_id", status: str = "status") -> DataFrame:
    """Rows of a run that found nothing, for discovery."""
    return results.where((F.col(run_column) == run) & (F.coalesce(F.col(status), F.lit("no_match")) == "no_match")).select(*columns)


def diagnosis(results: DataFrame, run: str, status: str = "status", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Counts and a sample name by run and status; and how often each token occurs
    in names without a match, by run."""
    counts = results.groupBy(run, status).agg(F.count("*").alias("n"), F.min(name).alias("sample"))
    missed = results.where(F.col(status) == "no_match").select(run, F.explode(F.array_distinct(t.tokens(F.lower(F.col(name))))).alias("token"))
    return counts, missed.groupBy(run, "token").agg(F.count("*").alias("n"))


def without_regions(df: DataFrame, keys: Sequence[str] = ("zones_variations", "availability")) -> DataFrame:
    return df.drop(*keys)


def copied_once(target: DataFrame, legacy: DataFrame) -> DataFrame:
    """The rows to append to ``target``: all of ``legacy`` if it is empty, else none."""
    return legacy if target.isEmpty() else legacy.limit(0)


def without_run(results: DataFrame, runs: DataFrame, run, column: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """Results and runs without one run."""
    gone = F.col(column).eqNullSafe(F.lit(run))
    return results.where(~gone), runs.where(~gone)


def dictionary_export(brands: DataFrame, words: DataFrame, stops: DataFrame) -> DataFrame:
    """One table of the three dictionaries (kind, key, value), by kind and key; a
    stop word has no value. Write it as JSON."""
    none = F.lit(None).cast("string")
    parts = [df.select(F.lit(kind).alias("kind"), F.col("key"), (F.col("value") if kind != "stop" else none).alias("value")) for kind, df in (("brand", brands), ("token", words), ("stop", stops))]
    return parts[0].union(parts[1]).union(parts[2]).orderBy("kind", "key")


def log_rows(decisions: DataFrame, at: Column) -> DataFrame:
    """Rows of the manual-match log; append them to its table."""
    return decisions.withColumn("logged_at", at)
