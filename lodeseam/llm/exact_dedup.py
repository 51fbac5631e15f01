"""Exact dedup by content sort.

Sampled splitters range-partition the rows by the leading characters of the normalised text, an external sort
brings equal texts together, and each text is compared in full with its neighbour. A run of
equal neighbours is a group. Digests never decide: where very many texts begin alike, a hash of the whole text says
only which range a row goes to. A text with more than hot_rows copies is spread over sub-runs,
whose first texts are compared in full again to merge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, table, text_of

LEAD = 64


def exact_dedup(
    docs: DataFrame,
    keep: str = "smallest",
    normalise=lambda text: text,
    hot_rows: int = 1000,
    broadcast_rows: int = 20_000,
) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest", the identifier that stays. normalise maps the text column
    before it is compared. A null text is an empty text; empty texts are equal to each other. A null
    doc_id stays only if its group has no other id. Of repeated rows with one doc_id and text one
    is kept. An empty table gives an empty table; other columns of docs are not read.
    """
    largest = {"smallest": False, "largest": True}[keep]
    keyed = docs.select(F.col("doc_id"), normalise(text_of()).alias("text"))
    keyed = keyed.select("doc_id", "text", F.substring("text", 1, LEAD).alias("lead"))
    full = F.xxhash64("text")
    begins = keyed.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("lead", F.lit(True).alias("spread"))
    begins, n_begins = small_side(begins, broadcast_rows)
    if n_begins == 0:
        return _runs(keyed, ["lead"], largest, lambda rows: rows)
    # Where many texts begin alike, the hash spreads them over ranges of their own.
    placed = keyed.join(begins, "lead", "left").withColumn("place", F.when(F.col("spread"), full).otherwise(0)).drop("spread")
    hot = placed.where("place <> 0").groupBy("lead", "place").agg(F.count("*").alias("copies")).where(F.col("copies") > hot_rows)
    sub_runs = hot.agg(F.coalesce(F.sum(F.ceil(F.col("copies") / hot_rows)), F.lit(0))).first()[0]
    if not sub_runs:
        return _runs(placed, ["lead", "place"], largest, lambda rows: rows)
    hot, _ = small_side(hot, broadcast_rows)
    salted = placed.join(hot, ["lead", "place"], "left").withColumn(
        "salt",
        F.when(F.col("copies").isNull(), 0).otherwise(
            F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("copies") / hot_rows)).cast("int")
        ),
    )
    keys = ["lead", "place", "salt"]
    merged = _merged(_compared(salted.where(F.col("copies").isNotNull()), keys), largest)
    merged = F.broadcast(merged) if sub_runs <= broadcast_rows else merged

    def joined(rows: DataFrame) -> DataFrame:
        both = rows.join(merged, [*keys, "run"], "left")
        return both.withColumns({x: F.coalesce(f"all_{x}", x) for x in ("group_size", "keep_id")})

    return _runs(salted.drop("copies"), keys, largest, joined)


def _compared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds first (the text differs from its neighbour's) and run (number of runs so far), rows sorted by text.

    The windows ask for no exchange beyond the range partitioning, as their keys are its keys.
    """
    order = Window.partitionBy(*keys).orderBy("text", "doc_id")
    before = F.lag("text").over(order)
    ranged = rows.repartitionByRange(*keys)
    return ranged.withColumn("first", before.isNull() | (before != F.col("text"))).withColumn(
        "run", F.sum(F.col("first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )


def _ends(largest: bool) -> tuple[Column, Column]:
    doc_id = F.col("doc_id")
    return (F.max("doc_id"), doc_id.desc_nulls_last()) if largest else (F.min("doc_id"), doc_id.asc_nulls_last())


def _runs(rows: DataFrame, keys: list[str], largest: bool, joined) -> DataFrame:
    kept_id, order = _ends(largest)
    run = Window.partitionBy(*keys, "run")
    narrow = _compared(rows, keys).select("doc_id", *keys, "run", F.sha2("text", 256).alias("sha"))
    grouped = narrow.select(
        "doc_id",
        *keys,
        "run",
        "sha",
        F.count("*").over(run).alias("group_size"),
        kept_id.over(run).alias("keep_id"),
        F.row_number().over(run.orderBy(order)).alias("nth"),
    )
    return joined(grouped).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _merged(compared: DataFrame, largest: bool) -> DataFrame:
    """Of each sub-run of a hot text: the size and the kept id of all sub-runs of that text."""
    kept_id, _ = _ends(largest)
    keys = ["lead", "place", "salt", "run"]
    runs = compared.groupBy(*keys).agg(
        F.min_by("text", F.struct(~F.col("first"), "doc_id")).alias("text"),
        F.count("*").alias("n"),
        kept_id.alias("id"),
    )
    same = Window.partitionBy("lead", "place", "text")
    end = F.max("id") if largest else F.min("id")
    return runs.select(
        *keys, F.sum("n").over(same).alias("all_group_size"), end.over(same).alias("all_keep_id")
    )


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
