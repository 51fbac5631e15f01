"""Sharding by bytes with sampled splitters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forgotten, materialised, table, text_of

SHARDS = 16
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 32
HOT, OVERFULL = 2, 3
LAW = "bytes"


def _ordered(keys: list[np.ndarray]) -> np.ndarray:
    """Fixed-width byte strings that sort as the tuples of signed longs do."""
    out = np.empty((len(keys[0]), len(keys)), ">u8")
    for i, x in enumerate(keys):
        out[:, i] = np.asarray(x, "i8").view("u8") ^ np.uint64(1 << 63)
    return out.view(f"S{8 * len(keys)}").ravel()


Key = tuple[int, int, int]


def _splitters(sample: list[tuple], ranges: int, hot: set[int]) -> set[Key]:
    """Quantiles of a sample (key, id, row, weight).

    A splitter lies at the first row of its key, so that equal texts share a range; only among the rows of a
    hot key it lies where it was drawn.
    """
    if not sample or ranges < 2:
        return set()
    rows, low = sorted(sample), np.iinfo("i8").min
    sums = np.cumsum([r[3] for r in rows])
    at = np.minimum(np.searchsorted(sums, sums[-1] * np.arange(1, ranges) / ranges), len(rows) - 1)
    chosen = [tuple(rows[i][:3]) for i in np.unique(at).tolist()]
    return {(k, low, low) for k, _, _ in chosen} | {c for c in chosen if c[0] in hot}


def _ranged(rows: DataFrame, cuts: list[Key]) -> DataFrame:
    packed = _ordered(list(np.array(cuts, "i8").reshape(-1, 3).T))

    @F.pandas_udf("int")
    def range_of(key: pd.Series, id: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(packed, _ordered([key, id, row]), side="right").astype("i4"))

    return rows.withColumn("range", range_of("key", "id", "row"))


def _subdivided(ranged: DataFrame, sums: list[tuple], even: float, sampled, hot: set[int]) -> set[Key]:
    """Splitters of the ranges that turned out overfull, from a sample of their own rows."""
    pieces = {r: math.ceil(p / even) for r, _, n, p in sums if n > 1 and p > OVERFULL * even}
    if not pieces:
        return set()
    own: dict[int, list[tuple]] = {r: [] for r in pieces}
    for *key, r in sampled(ranged.where(F.col("range").isin(list(pieces))), 8 * SAMPLES_PER_RANGE, len(sums), "range"):
        own[r].append(tuple(key))
    return set().union(*(_splitters(own[r], pieces[r], hot) for r in pieces))


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, seed: int = 7
) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes of shards differ by no more than about two ranges (1/32 of a shard). Rows are ordered by
    (hash of the text, doc_id). Keys sampled in proportion to size (and evenly to rows, so
    that tiny texts can't pile up in one range) give the quantile splitters of shards x
    ranges_per_shard ranges. Ranges are measured in full; one of over OVERFULL times its share is sampled anew and
    subdivided, until that divides none any more. Each row's shard follows from the
    bytes before it, so the sample bears on the work of tasks only. Equal texts stay in one
    shard unless they have over HOT times the share of a range; then their rows are subdivided by doc_id. A null text has
    size 1 and the CRC of no bytes; a null doc_id sorts first; repeated rows get slots of their
    own; an empty table gives an empty table; other columns aren't read. A doc_id that is no integer is ordered by its hash.
    To the driver come the sample (about shards x ranges_per_shard x 32 keys), the ranges' sums, the hot keys (fewer than ranges) and the shards' counts.
    """
    spark = docs.sparkSession
    raw = F.encode(text_of(), "UTF-8")
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long", "void")
    number = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rows = materialised(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(text_of()).alias("key"),
            F.coalesce(number, F.lit(-(1 << 63))).alias("id"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sharding",
    )
    ranges = shards * ranges_per_shard
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    part = F.col("size") / max(total, 1) + F.lit(1 / max(n, 1))  # all parts together are 2
    even = 2 / ranges
    heavy = rows.groupBy("key").agg(F.sum(part).alias("part"), F.count("*").alias("n")).where((F.col("part") > HOT * even) & (F.col("n") > 1))
    hot = {r["key"] for r in heavy.collect()}

    def sampled(some: DataFrame, per_range: int, salt: int, *columns: str) -> list[tuple]:
        share = part * (per_range / even)
        draw = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
        drawn = some.where(draw < share).select("key", "id", "row", F.greatest(share, F.lit(1.0)).alias("weight"), *columns)
        return [tuple(r) for r in drawn.collect()]

    cuts, ranged, sums = _splitters(sampled(rows, SAMPLES_PER_RANGE, seed), ranges, hot), None, []
    while ranged is None or (more := _subdivided(ranged, sums, even, sampled, hot) - cuts):
        if ranged is not None:
            forgotten(ranged)
            cuts |= more
        ranged = materialised(_ranged(rows, sorted(cuts)).withColumn("hot", F.col("key").isin(list(hot)) if hot else F.lit(False)), "ranged")
        sums = [tuple(r) for r in ranged.groupBy("range").agg(F.sum("size"), F.count("*"), F.sum(part)).orderBy("range").collect()]
    before, bytes_before, rows_before = [], 0, 0
    for number, size, count, _ in sums:
        before.append((number, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + size, rows_before + count
    start = F.broadcast(spark.createDataFrame(before, "range int, bytes_before long, rows_before long"))
    order = Window.partitionBy("range").orderBy("key", "id", "row")
    own = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = (
        ranged.withColumns({"own": own, "nth": F.row_number().over(order)})
        .withColumn("group", F.first("own").over(order.partitionBy("range", "key").orderBy("id", "row")))
        .join(start, "range")
        .withColumn("at", F.col("bytes_before") + F.when(F.col("hot"), F.col("own")).otherwise(F.col("group")))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.lit(shards - 1), F.expr(f"at * {shards} div {max(total, 1)}").cast("int")).alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("nth"),
        )
    )
    placed = materialised(placed, "sharded")
    firsts = [tuple(r) for r in placed.groupBy("shard").agg(F.min("nth").alias("first")).collect()]
    first = F.broadcast(spark.createDataFrame(firsts, "shard int, first long"))
    return placed.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"))
