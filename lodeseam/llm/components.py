"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgotten, materialised


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes in links(u, v).

    Alternates large-star and small-star steps until nothing changes; the steps number about the logarithm of the
    longest chain. Each step is written to the shared folder. Loops and repeated links do no
    harm; links with a null end are dropped; no link gives an empty table.
    """
    pairs = materialised(links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL"), "pairs")
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    edges = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialised(edges, "links")
    before, now = None, _state(edges)
    while before != now and now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        shorter = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, materialised(shorter, "links")
        before, now = now, _state(edges)
        forgotten(last)
    roots = edges.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
