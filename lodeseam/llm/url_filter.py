"""URL filter: expressions of host suffix and path prefix, joined with the rules on hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, small_side, table

#: verdict, host, path
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
SHORT = 8  # hex digits of the hash prefix
BROADCAST_RULES = 200_000
PATH_LENGTHS = 10_000


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row for each row of pages(page_id, url): page_id, host, path, rule, verdict.

    rules(verdict, host, path): a rule fits its host and every subdomain if the path starts with
    the rule's. The rule with the longest host and path together decides, then the longer host,
    then block before allow. A url that no rule fits gets default and a null rule. A null url, or
    one without ://, has an empty host and path, which no rule with a host fits. Null parts of a
    rule count as empty; rules without a host are dropped. Repeated pages are judged one by one;
    other columns are not read.

    Each url is expanded into its host suffixes times its path prefixes (of as many labels and
    characters as occur among the rules, so that a host of very many labels stays linear; of all
    where the rules have over PATH_LENGTHS different ones). Expressions and rules meet in an equi-join on the first hex digits of
    the SHA-256 digest, and the full digests confirm a match. Up to BROADCAST_RULES rules are
    broadcast; more are joined by a shuffle, where adaptive execution splits the urls of a frequent suffix.
    """
    clean = rules.select(
        "verdict",
        lower_ascii(F.coalesce("host", F.lit(""))).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
    ).where(F.col("host") != "")
    n_labels = F.size(F.split("host", r"\."))
    numbers = [("path", F.length("path")), ("host", n_labels)]
    shapes = clean.select(F.explode(F.array(*[F.struct(F.lit(k).alias("of"), n.alias("n")) for k, n in numbers])).alias("s"))
    lengths = bounded_rows(shapes.select("s.of", "s.n").distinct(), PATH_LENGTHS)
    digest = F.sha2(F.concat("host", "path"), 256)
    side = clean.select(
        F.substring(digest, 1, SHORT).alias("short"),
        digest.alias("rule_digest"),
        F.struct(
            (F.length("host") + F.length("path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("verdict") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict"),
        ).alias("found"),
    )
    side, _ = small_side(side, BROADCAST_RULES)
    urls = pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    labels = F.split("host", r"\.")

    def taken(of: str) -> Column:
        if lengths is None:  # too many to name: all that the url has
            return F.sequence(F.lit(1), F.size(labels)) if of == "host" else F.sequence(F.lit(0), F.length("path"))
        return F.array(*[F.lit(n) for n in sorted(n for k, n in lengths if k == of)]).cast("array<int>")

    suffixes = F.transform(
        F.filter(taken("host"), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    )
    prefixes = F.transform(
        F.filter(taken("path"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    digests = urls.select(
        "row", "page_id", "host", "path", F.explode_outer(F.transform(expressions, lambda e: F.sha2(e, 256))).alias("digest")
    ).withColumn("short", F.substring("digest", 1, SHORT))
    matched = digests.join(side, "short", "left").withColumn(
        "found", F.when(F.col("digest") == F.col("rule_digest"), F.col("found"))
    )
    judged = matched.groupBy("row", "page_id", "host", "path").agg(F.max("found").alias("found"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )


def rules_frame(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def op9_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
