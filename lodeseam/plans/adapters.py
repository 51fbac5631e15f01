"""Cards, edges, registries and snapshots derived from the tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_cards


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_id(key: str = "p_partkey", brand: str = "p_brand") -> Column:
    return F.concat(F.lit("part."), F.replace(F.lower(brand), F.lit("#"), F.lit("-")), F.lit(".p"), F.col(key).cast("string"))


PART_ID_SQL = "'part.' || replace(lower(p_brand), '#', '-') || '.p' || p_partkey"


def part_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each part: its name as role, its type searched for, its brand owned, small parts excluding large ones."""
    p = table(spark, sf_dir, "part")
    return as_cards(
        p.select(
            part_id().alias("id"), F.lit("symbol").alias("scope"), F.col("p_name").alias("role"), F.array("p_type").alias("search"),
            F.array("p_brand").alias("owns"), F.when(F.col("p_size") < 10, F.array(F.lit("bulk orders"))).otherwise(F.array().cast("array<string>")).alias("excludes"),
            F.array(F.when(F.col("p_partkey") % 3 == 0, "money").otherwise("performance")).alias("risk"),
            F.array(F.concat(F.lit("fs."), F.when(F.col("p_partkey") % 5 == 0, "erase").otherwise("read"))).alias("effect"),
            F.when(F.col("p_size") % 2 == 0, "contract").otherwise("architecture").alias("stability"), F.col("p_partkey").alias("card_order"),
            F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"),
            F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("semantic_hash"), F.sha2("p_brand", 256).alias("structure_hash"),
            F.sha2(F.col("p_size").cast("string"), 256).alias("body_hash"), F.concat(F.lit("make("), "p_type", F.lit(")")).alias("signature"),
        )
    )


PART_CARDS_SQL = f"""
cards AS (
  SELECT {PART_ID_SQL} AS id, p_name AS role, p_type AS search, p_brand AS owns,
         CASE WHEN p_size < 10 THEN 'bulk orders' ELSE '' END AS excludes,
         CASE WHEN p_partkey % 3 = 0 THEN 'money' ELSE 'performance' END AS risk,
         'fs.' || CASE WHEN p_partkey % 5 = 0 THEN 'erase' ELSE 'read' END AS effect,
         CASE WHEN p_size % 2 = 0 THEN 'contract' ELSE 'architecture' END AS stability, p_partkey AS card_order,
         'src/' || lower(p_type) || '/p' || p_partkey || '.ts' AS path, 'make(' || p_type || ')' AS signature
  FROM part)"""

FIELDS_SQL = """
fields AS (
  SELECT id, 'id' AS field, 12.0::DOUBLE AS w, replace(id, '.', ' ') AS text FROM cards
  UNION ALL SELECT id, 'role', 8, role FROM cards UNION ALL SELECT id, 'search', 10, search FROM cards
  UNION ALL SELECT id, 'owns', 7, owns FROM cards UNION ALL SELECT id, 'excludes', 0, excludes FROM cards
  UNION ALL SELECT id, 'effect', 5, effect FROM cards UNION ALL SELECT id, 'risk', 4, risk FROM cards
  UNION ALL SELECT id, 'path', 3, path FROM cards UNION ALL SELECT id, 'signature', 3, signature FROM cards),
postings AS (
  SELECT token, id, field, any_value(w) AS w, count(*) AS tf
  FROM (SELECT id, field, w, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)) AS token FROM fields) GROUP BY token, id, field)"""

#: Queries asked of the part cards; one is asked for an excluded scope, one repeats a word, two match nothing.
CARD_QUERIES = [
    (1, "red widget"), (2, "  Small RING economy "), (3, "widget widget promo"), (4, "part.brand-2.p0"), (5, "brand-17"), (6, "excludes: bulk"),
    (7, "zzz qqq"), (8, "standard blue"), (9, "p1"), (10, "money fs read"), (11, "the cheap stuff"), (12, ""),
]
CARD_ALIASES = [("cheap stuff", "part.brand-2.p0"), ("stuff", "part.brand-17.p1"), ("eap", "part.brand-17.p1"), ("red", "no.such")]


def card_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CARD_QUERIES, "query_id long, query string")


def card_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CARD_ALIASES, "alias string, target string")


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)})"


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> supplier of each line, with the discount taken from its confidence."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part/p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("supplier/s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.lit("supplied").alias("kind"), (1 - F.col("l_discount")).alias("confidence"),
    )
    best = rows.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))
    return best.withColumn("id", F.sha2(F.concat_ws("|", "src", "dst", "kind"), 256))


SUPPLY_SQL = """
edges AS (SELECT 'part/p' || l_partkey AS src, 'supplier/s' || l_suppkey AS dst, 'supplied' AS kind, max(1 - l_discount) AS confidence
          FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def document_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids redirect to their half, odd multiples of 7 are replaced by two ids, of 11 by one; 1, 3 and 5 run in a circle."""
    i = F.col("doc_id")
    name = lambda c: F.concat(F.lit("doc.d"), c.cast("string"))
    none = F.array().cast("array<string>")
    state = F.when(i.isin(1, 3, 5), "redirect").when(i % 2 == 0, "redirect").when(i % 7 == 0, "replaced").when(i % 11 == 0, "replaced").when(i % 13 == 0, "retired").otherwise("active")
    to = F.when(i == 1, "doc.d3").when(i == 3, "doc.d5").when(i == 5, "doc.d1").when(i % 2 == 0, name(F.floor(i / 2)))
    by = F.when((i % 2 == 1) & (i % 7 == 0), F.array(name(i + 1), name(i + 2))).when((i % 2 == 1) & (i % 11 == 0), F.array(name(i - 2)))
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(name(i).alias("id"), state.alias("state"), to.alias("to"), by.alias("by"), i.alias("line_no"))
    return rows.withColumn("by", F.when(F.col("state") == "replaced", F.col("by")).otherwise(none))


REGISTRY_SQL = """
reg AS (
  SELECT doc_id AS n, CASE WHEN doc_id IN (1, 3, 5) THEN 'redirect' WHEN doc_id % 2 = 0 THEN 'redirect' WHEN doc_id % 7 = 0 THEN 'ambiguous'
           WHEN doc_id % 11 = 0 THEN 'replaced' WHEN doc_id % 13 = 0 THEN 'retired' ELSE 'active' END AS state,
         CASE WHEN doc_id = 1 THEN 3 WHEN doc_id = 3 THEN 5 WHEN doc_id = 5 THEN 1 WHEN doc_id % 2 = 0 THEN doc_id // 2
           WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN doc_id - 2 END AS nxt
  FROM documents WHERE doc_id IS NOT NULL),
links AS (SELECT n, nxt FROM reg WHERE nxt IS NOT NULL UNION SELECT n, n + 1 FROM reg WHERE state = 'ambiguous' UNION SELECT n, n + 2 FROM reg WHERE state = 'ambiguous'),
onward(a, b) AS (SELECT n, nxt FROM links UNION SELECT o.a, l.nxt FROM onward o JOIN links l ON l.n = o.b),
cyclic AS (SELECT DISTINCT a AS n FROM onward WHERE b IN (SELECT a FROM onward WHERE a = b))"""


def order_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two generations of cards of orders: each lacks a tenth, and prices or states of some differ."""
    o = table(spark, sf_dir, "orders")

    def cards(part: DataFrame, later: bool) -> DataFrame:
        price = F.when(F.lit(later) & (F.col("o_orderkey") % 7 == 0), F.floor("o_totalprice") + 1).otherwise(F.floor("o_totalprice"))
        state = F.when(F.lit(later) & (F.col("o_orderkey") % 5 == 0), F.lit("X")).otherwise(F.col("o_orderstatus"))
        name = lambda c: F.concat(F.lit("order.c"), (c % 50).cast("string"), F.lit(".o"), c.cast("string"))
        rows = part.select(
            name(F.col("o_orderkey")).alias("id"), price.cast("string").alias("semantic_hash"), state.alias("structure_hash"), F.lit("b").alias("body_hash"),
            F.array(F.concat(F.lit("workflow>"), name(F.floor(F.col("o_orderkey") / 2)))).alias("rel"), F.col("o_orderkey").alias("card_order"), state.alias("signature"),
        )
        return as_cards(rows)

    return cards(o.where("o_orderkey % 10 <> 0"), False), cards(o.where("o_orderkey % 10 <> 1"), True)


SNAPSHOT_SQL = """
o AS (SELECT o_orderkey AS k, 'order.c' || (o_orderkey % 50) || '.o' || o_orderkey AS id, 'order.c' || (o_orderkey // 2 % 50) || '.o' || (o_orderkey // 2) AS rel,
             floor(o_totalprice)::BIGINT AS price, o_orderstatus AS st FROM orders),
prev AS (SELECT id, rel, price, st FROM o WHERE k % 10 <> 0),
cur AS (SELECT id, rel, price + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS price, CASE WHEN k % 5 = 0 THEN 'X' ELSE st END AS st FROM o WHERE k % 10 <> 1),
diff AS (SELECT coalesce(p.id, c.id) AS id, CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
                p.id IS NOT NULL AND c.id IS NOT NULL AND p.price <> c.price AS sem, p.id IS NOT NULL AND c.id IS NOT NULL AND p.st <> c.st AS str
         FROM prev p FULL JOIN cur c ON p.id = c.id),
changes AS (SELECT * FROM diff WHERE change <> 'modified' OR sem OR str)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of pages: the path of the url below its host."""
    u = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(u, "/$", "").alias("path"), F.col("html").alias("content"))


PAGES_SQL = "files AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') AS path, html AS content FROM pages)"
