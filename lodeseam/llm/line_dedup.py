"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, table, text_of, unused

RATIO = 0.1
MIN_PAGES = 3
LINE_BYTES = 24  # of a digest in an array
BROADCAST_BYTES = 32_000_000
SALTS = 64


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, bad (array of MD5 digests): the lines on more than ratio of the pages of their host.

    A page is a distinct text of a host, so that copies of one page count once. A line counts
    once on a page, and must be on min_pages of them at least. Lines of white space only don't
    count. A host has at most (mean lines of its pages) / ratio such lines, whatever its size.
    """
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_of().alias("text"))
    page = F.unhex(F.md5("text"))
    lines = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: ~x.rlike(r"^\s*$"))
    each = pages.select("host", page.alias("page"), F.explode(F.transform(lines, lambda x: F.unhex(F.md5(x)))).alias("line"))
    counts = each.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.select("host", page.alias("page")).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    above = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return above.groupBy("host").agg(F.collect_list("line").alias("bad"))


def line_dedup(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, report: bool = False
) -> DataFrame:
    """docs with the boilerplate lines of their host taken out of the text.

    All rows and columns stay. A null text stays null, an empty one empty; a null host is a host
    of its own (the empty name). A text that is all boilerplate becomes empty. report adds
    n_lines and n_dropped (of blank and other lines alike; in place of columns of that name). The
    boilerplate is written once and broadcast if it takes up to BROADCAST_BYTES; beyond that each host is salted.
    """
    name, lines_out, salt, kept = (unused(docs, n) for n in ("host_key", "bad_lines", "host_salt", "kept_lines"))
    bad = boilerplate(docs, host, ratio, min_pages).select(F.col("host").alias(name), F.col("bad").alias(lines_out))
    bad = materialised(bad, "boilerplate")
    size = bad.agg(F.coalesce(F.sum(F.size(lines_out) * LINE_BYTES + 64), F.lit(0))).first()[0]
    keyed = docs.withColumn(name, F.coalesce(F.col(host).cast("string"), F.lit("")))
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(bad), name, "left").drop(name)
    else:
        # Each host is dealt to SALTS tasks, so that no task gets a large host whole.
        keyed = keyed.withColumn(salt, F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        bad = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.join(bad, [name, salt], "left").drop(name, salt)
    lines = F.split(F.col("text"), "\n")
    good = F.filter(lines, lambda x: ~F.array_contains(lines_out, F.unhex(F.md5(x))) | x.rlike(r"^\s*$"))
    out = joined.withColumn(kept, F.when(F.col(lines_out).isNull(), lines).otherwise(good))
    if report:
        count = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
        n = F.when(F.col("text").isNull(), 0).otherwise(count(lines))
        out = out.withColumns({"n_lines": n, "n_dropped": n - F.when(F.col("text").isNull(), 0).otherwise(count(F.col(kept)))})
    out = out.withColumn("text", F.array_join(kept, "\n"))
    return out.drop(lines_out, kept)


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs, report=True).select("doc_id", "source", "n_lines", "n_dropped", "text")


OP1_SQL = rf"""
WITH p AS (SELECT DISTINCT coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
l AS (SELECT host, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM l WHERE NOT regexp_full_match(line, '\s*') GROUP BY ALL HAVING count(*) >= {MIN_PAGES}),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT host, list(line) AS bad FROM c JOIN t USING (host) WHERE n > {RATIO}::DOUBLE * pages GROUP BY host),
d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines, coalesce(bad, []) AS bad
      FROM documents LEFT JOIN b ON b.host = coalesce(source, '')),
k AS (SELECT *, list_filter(lines, lambda x: NOT list_contains(bad, x)) AS kept FROM d)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines,
       coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM k
"""
