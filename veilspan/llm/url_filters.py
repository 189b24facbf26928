"""URL filters by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the pairs (suffix of its host at a label boundary, prefix of its path) that a rule could have;
the pairs meet the rules in an equi-join on a short prefix of their SHA-256 digests; the full digests confirm a hit, and of
several hits the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Hex digits of the digest that the join compares first.
SHORT = 8
#: Up to so many rules, and bytes of their hosts and paths, their digests are broadcast (72 bytes more each); more are joined by a shuffle.
BROADCAST_RULES, BROADCAST_BYTES = 100_000, 32 << 20


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: (host, path, verdict), a host that fits itself and its subdomains, a path that is a prefix. The longest host + path wins;
    between equal ones `block`. A URL without a fitting rule has a null rule and the verdict `default`. A null, empty or odd URL has
    an empty host and path, which no rule fits. Repeated rows stay; rules that repeat count once; rules with a null host, path or
    verdict are ignored; columns of pages of the four names are replaced.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n"), F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes")).first()
    known = rules.select(_digest(F.col("host"), F.col("path")).alias("digest"), F.concat("host", "path").alias("rule"), "verdict")
    known = known.withColumn("short", F.substring("digest", 1, SHORT))
    if shape["n"] <= BROADCAST_RULES and (shape["bytes"] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    judged = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - n + 1, F.lit(n)), ".")) for n in sorted(shape["labels"])]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]
    expressions = F.array_compact(F.array(*[F.when(s.isNotNull() & p.isNotNull(), _digest(s, p)) for s in suffixes for p in prefixes])) if shape["n"] else F.array().cast("array<string>")
    hits = (
        judged.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT))
        .join(known, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return judged.join(hits, ["host", "path"], "left").select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
best AS (
  SELECT u.host, u.path, max({'n': length(r.host || r.path), 'verdict': r.verdict, 'rule': r.host || r.path}) AS best
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY ALL)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (host, path)
"""
