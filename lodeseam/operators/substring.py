"""Substring joins: few needles by trial, more through the rarest n-gram of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import is_small, joinable

GRAM, FEW = 3, 100


def _grams(text: Column, n: int) -> Column:
    return F.when(
        F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))


def substring_join(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """needle_id, needle, hay_id, hay: all pairs of needles(needle_id, needle) and haystacks(hay_id, hay) with the needle inside.

    Up to FEW needles are tried on each haystack. More are an equi-join instead of a product: each haystack gives its distinct n-grams,
    each needle only the one that fewest haystacks have, and contains() confirms a match. Needles shorter than GRAM are
    looked up whole. Empty needles match nothing. Haystacks are never broadcast.
    """
    needles, hay = needles.select("needle_id", "needle").where(F.length("needle") > 0), haystacks.select("hay_id", "hay")
    if is_small(needles, "needle", FEW):
        return hay.join(F.broadcast(needles), F.col("hay").contains(F.col("needle"))).select("needle_id", "needle", "hay_id", "hay")
    small = is_small(needles, "needle")
    grams = F.array_distinct(F.concat(*[_grams(F.col("hay"), n) for n in range(1, GRAM + 1)]))
    by_gram = hay.select("hay_id", "hay", F.explode(grams).alias("gram"))
    counts = by_gram.groupBy("gram").agg(F.count("*").alias("n"))
    long = F.length("needle") >= GRAM
    wanted = needles.select(
        "needle_id", "needle", F.explode(F.when(long, F.array_distinct(_grams(F.col("needle"), GRAM))).otherwise(F.array("needle"))).alias("gram")
    )
    rarest = Window.partitionBy("needle_id", "needle").orderBy(F.coalesce("n", F.lit(0)), "gram")
    chosen = wanted.join(counts.hint("merge"), "gram", "left").withColumn("nth", F.row_number().over(rarest)).where("nth = 1").drop("nth", "n")
    return by_gram.join(joinable(chosen, small), "gram").where(F.col("hay").contains(F.col("needle"))).select("needle_id", "needle", "hay_id", "hay")
