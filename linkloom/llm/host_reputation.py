"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes (0 good, 1 bad) are shrunk through beta-binomial priors
along the chain all pages -> suffix -> registered domain -> host. The strength
of the prior at each level is estimated from the data by the method of moments
(Kleinman, 1973). A host is blocked when the lower bound of its posterior bad
rate exceeds ``limit``. Only DataFrame functions are used.

Defined cases: a null url, or one without ``://``, has an empty host and path;
the empty host is judged like any other host. A host of one label is its own
suffix and domain; the domain is the last two labels, the suffix the last one.
Null or other outcomes than 0 and 1 count as unlabelled. Repeated pages and
repeated labels each count. With no labels nothing is blocked but by rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import cut, documents_of

#: (verdict, host, path prefix); fixed by the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _level(hosts: DataFrame, key: str, parent: str | None, mean_of_parent: Column) -> DataFrame:
    """Posterior (a, b) of each group of ``key`` given its parent's mean."""
    up = [parent] if parent else []
    g = hosts.groupBy(key, *up).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first(mean_of_parent).alias("m"))
    seen = g.where("n > 0")
    # weighted moments over groups: between-group variance against the binomial one
    s = seen.agg(
        F.sum("n").alias("N"), F.count("*").alias("G"), F.sum(F.col("n") * F.col("n")).alias("N2"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("S"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("V"),
    )
    # E[S] = v * (G + rho * (N - G)), with v the mean binomial variance
    v = F.try_divide(F.col("V"), F.col("N"))
    rho = F.try_divide(F.try_divide(F.col("S"), v) - F.col("G"), F.col("N") - F.col("G"))
    k = F.when(rho > 0.001, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), 1 / rho - 1))).otherwise(1000.0)
    return g.withColumn("k", s.select(k.alias("k")).scalar()).select(
        key, *up, "n", "bad", (F.col("bad") + F.col("k") * F.col("m")).alias("a"), (F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("m"))).alias("b"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host: labelled count, bad count, posterior mean and lower
    bound of the bad rate. ``pages``: (page_id, url); ``outcomes``: (page_id,
    bad). Hosts are summed before any join, so that a hot host is one row."""
    seen = pages.select(F.col("page_id").alias("_p"), host_of(F.col("url")).alias("host"))
    marks = outcomes.where(F.col("bad").isin(0, 1)).groupBy(F.col("page_id").alias("_p")).agg(F.count("*").alias("_n"), F.sum("bad").alias("_b"))
    parts = F.split("host", r"\.")
    hosts = (
        seen.join(marks, "_p", "left").groupBy("host")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_b"), F.lit(0)).alias("bad"))
        .withColumn("domain", F.when(F.size(parts) > 2, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.col("host")))
        .withColumn("suffix", F.element_at(parts, -1))
    )
    hosts = cut(hosts, "hosts")
    total = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("m0"))
    with_total = hosts.withColumn("m0", total.scalar())
    by_suffix = _level(with_total, "suffix", None, F.col("m0")).select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("m1"))
    by_domain = _level(hosts.join(by_suffix, "suffix"), "domain", "suffix", F.col("m1")).select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("m2"))
    post = _level(hosts.join(by_domain, "domain"), "host", "domain", F.col("m2"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    return post.select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), mean.alias("bad_rate"), F.greatest(F.lit(0.0), mean - z * spread).alias("bad_rate_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, by for every row of ``pages``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    poor = host_reputation(pages, outcomes, z).where(F.col("bad_rate_low") > limit).select("host", F.lit("block").alias("_v"))
    return urls.join(poor, "host", "left").select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.col("_v"), F.lit("allow")).alias("verdict"),
    )


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labels by page id: bad when of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(documents_of(spark, sf_dir, "pages"), outcomes_of(documents_of(spark, sf_dir, "labels")))


def _oracle() -> str:
    def level(key: str, up: str | None, source: str) -> str:
        group = key + (f", {up}" if up else "")
        return f"""SELECT {group}, n, bad, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM
          (SELECT {group}, sum(n) n, sum(bad) bad, any_value(m) m FROM {source} GROUP BY {group}) g,
          (SELECT CASE WHEN rho > 0.001 THEN least(1000.0, greatest(1.0, 1 / rho - 1)) ELSE 1000.0 END k FROM
            (SELECT (S / nullif(V / N1, 0) - G) / nullif(N1 - G, 0) rho FROM
              (SELECT sum(n) N1, count(*) G, sum(n * (bad::DOUBLE / n - m) ** 2) S, sum(n * m * (1 - m)) V FROM
                (SELECT {group}, sum(n) n, sum(bad) bad, any_value(m) m FROM {source} GROUP BY {group}) WHERE n > 0)))"""

    cases = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fit = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in cases)
    say = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in cases)
    return f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') host,
                 regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path FROM pages),
    o AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END bad FROM labels),
    h AS (SELECT host, count(bad) n, coalesce(sum(bad), 0) bad, string_split(host, '.') p FROM u LEFT JOIN o ON doc_id = page_id GROUP BY host),
    hosts AS (SELECT host, n, bad, CASE WHEN len(p) > 2 THEN p[-2] || '.' || p[-1] ELSE host END AS domain, p[-1] AS suffix FROM h),
    l0 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM hosts) m FROM hosts),
    s AS ({level("suffix", None, "l0")}),
    l1 AS (SELECT hosts.*, a / (a + b) m FROM hosts JOIN s USING (suffix)),
    d AS ({level("domain", "suffix", "l1")}),
    l2 AS (SELECT hosts.*, a / (a + b) m FROM hosts JOIN d USING (domain)),
    e AS ({level("host", "domain", "l2")}),
    poor AS (SELECT host FROM e WHERE a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > 0.5),
    r AS (SELECT page_id, host, path, CASE {fit} END AS rule FROM u)
    SELECT page_id, r.host AS host, path, rule,
      coalesce(CASE rule {say} END, CASE WHEN poor.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM r LEFT JOIN poor ON r.host = poor.host"""


ORACLE_SQL = _oracle()
