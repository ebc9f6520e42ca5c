"""Allow and block rules for URLs, matched through hashed host and path expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or where `://` is missing."""
    there = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = F.when(there, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", short: int = 8) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. `rules` has host, path and verdict.

    Each distinct URL is expanded into host suffixes x path prefixes, only of the label counts and lengths that some rule
    has, so the expansion is bounded by the rules and not by the URL. Expressions meet the rules in an equi-join on the
    first `short` hex digits of their SHA-256; the full digests are compared after it. The longest rule wins (then the
    longer host, then block); pages without a rule get `default` and a null rule. Joins are left to Spark's size checks.

    Null URLs and those without `://` have empty host and path and match nothing. Repeated rows stay repeated; further
    columns of either input are ignored; without rules every page gets the default; without pages there are no rows.
    """
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).filter("r_host <> ''").distinct()
    shapes = rules.agg(
        F.coalesce(F.collect_set(F.size(F.split("r_host", "\\."))), F.array()).alias("labels"),
        F.coalesce(F.collect_set(F.length("r_path")), F.array()).alias("lengths"),
    )
    digest = F.sha2(F.concat("r_host", "r_path").cast("binary"), 256)
    table = rules.select(F.substring(digest, 1, short).alias("key"), digest.alias("r_digest"), "r_host", "r_path", "r_verdict")

    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    host, path = url_parts(F.col("url"))
    found = (
        rows.select("url").distinct().select("url", host.alias("host"), path.alias("path")).filter("host <> ''")
        .withColumn("s", shapes.select(F.struct("labels", "lengths")).scalar())
        .select("url", "path", "s.lengths", F.explode(F.expr("array_distinct(transform(s.labels, n -> substring_index(host, '.', -n)))")).alias("suffix"))
        .select("url", "suffix", F.explode(F.expr("transform(filter(lengths, n -> n <= length(path)), n -> substring(path, 1, n))")).alias("prefix"))
        .select("url", F.sha2(F.concat("suffix", "prefix").cast("binary"), 256).alias("digest"))
        .withColumn("key", F.substring("digest", 1, short))
        .join(table, "key")
        .filter("digest = r_digest")
        .groupBy("url")
        .agg(F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host_size"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    )
    joined = rows.join(found, "url", "left")
    return joined.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
