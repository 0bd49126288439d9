"""URL rules by hashed expressions.

A URL expands into every host suffix (at label borders) combined with every
path prefix that a rule could have.  Expressions meet rules on a short hash
prefix; the full digest then confirms, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hold

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: The verdict of a URL that no rule fits.
DEFAULT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    after = F.substring_index(F.substring_index(after, "#", 1), "?", 1)
    host = F.substring_index(after, "/", 1)
    path = F.substring(after, F.length(host) + 1, F.length(after))
    empty = F.lit("")
    return F.when(has, ascii_lower(host)).otherwise(empty), F.when(has, path).otherwise(empty)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of pages.

    rules: (host, path, verdict).  A rule fits its host and all subdomains if
    the URL's path starts with the rule's path.  The rule with the longest host
    wins, then the longest path; two verdicts for one (host, path): block wins.
    No fit: rule null, verdict `default`.  Null and repeated rows stay rows.
    A rule with an empty host fits every host.  Empty pages give no rows.
    """
    host, path = url_parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # One row a distinct URL: a URL that many pages share is judged once.
    urls = split.select("host", "path").distinct()
    rules = (
        rules.select(
            F.coalesce("host", F.lit("")).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"),
            "verdict",
        )
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))
    )
    expression = lambda h, p: F.unhex(F.sha2(F.concat(h, F.lit("\n"), p), 256))
    rules = rules.withColumn("rule_digest", expression(F.col("rule_host"), F.col("rule_path")))
    rules = hold(rules.withColumn("rule_short", F.substring("rule_digest", 1, 4)))
    # As many as the longest rule path has characters, whatever the pages.
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    if not lengths:
        lengths = [0]
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    suffixes = F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    each = (
        urls.withColumn("suffix", F.explode(suffixes))
        .withColumn("cut", F.explode(cuts))
        .withColumn("digest", expression(F.col("suffix"), F.expr("substring(path, 1, cut)")))
        .select("host", "path", "digest", F.substring("digest", 1, 4).alias("short"))
    )
    # The short hash is the only key of the join; the digest confirms, in a form
    # that is no equality, so that it stays a condition on what meets.
    best = hold(
        each.join(
            rules, (F.col("short") == F.col("rule_short")) & F.startswith(F.col("digest"), F.col("rule_digest"))
        )
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("rule_host").alias("h"),
                    F.length("rule_path").alias("p"),
                    F.concat("rule_host", "rule_path").alias("rule"),
                    "verdict",
                )
            ).alias("best")
        )
    )
    # best is held, so a URL that very many pages share can be split over tasks.
    return split.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP5_SQL = r"""
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(split_part(split_part(rest, '#', 1), '?', 1), '') AS rest FROM a),
u AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM b),
d AS (SELECT DISTINCT host, path FROM u),
m AS (SELECT d.host, d.path, r.h || r.p AS rule, r.v,
  row_number() OVER (PARTITION BY d.host, d.path ORDER BY length(r.h) DESC, length(r.p) DESC) AS k
  FROM d JOIN r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path AND m.k = 1
"""
