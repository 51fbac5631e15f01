"""Snapshot diffs, affected boundaries, contracts and incremental reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import as_cards
from .retrieval import relation_edges

DIMENSIONS = ("semantic", "structure", "body")


def compare_cards(previous: DataFrame, current: DataFrame) -> DataFrame:
    """id, change (added, removed or modified), dimensions of cards that differ between two snapshots."""
    hashes = [f"{d}_hash" for d in DIMENSIONS]
    a = as_cards(previous).select("id", F.struct(*hashes).alias("a"))
    b = as_cards(current).select("id", F.struct(*hashes).alias("b"))
    both = a.join(b, "id", "full_outer")
    differing = F.filter(
        F.array(*[F.when(~F.col(f"a.{d}_hash").eqNullSafe(F.col(f"b.{d}_hash")), F.lit(d)) for d in DIMENSIONS]), lambda d: d.isNotNull()
    )
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    empty = F.array().cast("array<string>")
    out = both.select("id", change.alias("change"), F.when(change == "modified", differing).otherwise(empty).alias("dimensions"))
    return out.where((F.col("change") != "modified") | (F.size("dimensions") > 0))


def affected_boundaries(changes: DataFrame, previous: DataFrame, current: DataFrame, depth: int = 2) -> DataFrame:
    """module, changed, related, dependent: counts of changed ids, of ids they relate to and of ids that relate to them."""
    rel = relation_edges(previous).union(relation_edges(current)).select("src", "dst").distinct()
    ids = changes.select("id", T.module_id("id", depth).alias("module"))
    related = ids.join(rel.select(F.col("src").alias("id"), F.col("dst").alias("other")), "id", "left")
    related = related.groupBy("module").agg(F.countDistinct("id").alias("changed"), F.countDistinct("other").alias("related"))
    back = ids.join(rel.select(F.col("dst").alias("id"), F.col("src").alias("other")), "id")
    back = back.groupBy("module").agg(F.countDistinct("other").alias("dependent"))
    return related.join(back, "module", "left").select("module", "changed", "related", F.coalesce("dependent", F.lit(0)).cast("long").alias("dependent"))


def contract_fingerprints(cards: DataFrame, depth: int = 2) -> DataFrame:
    """module, cards, fingerprint: one digest of the signatures of each module's cards."""
    line = F.concat_ws(":", "id", F.coalesce("signature", F.lit("")))
    rows = as_cards(cards).select(T.module_id("id", depth).alias("module"), line.alias("line"))
    return rows.groupBy("module").agg(
        F.count("*").alias("cards"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("fingerprint")
    )


def contract_drift(previous: DataFrame, current: DataFrame, depth: int = 2) -> DataFrame:
    """module, status (added, removed, changed) of modules whose contract differs."""
    a = contract_fingerprints(previous, depth).select("module", F.col("fingerprint").alias("a"))
    b = contract_fingerprints(current, depth).select("module", F.col("fingerprint").alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "module", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("module", status.alias("status"))


def stable_order(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """id, pos: the order so far, then new ids sorted."""
    last = existing.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    fresh = ids.select("id").distinct().join(existing, "id", "left_anti")
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))
    more = fresh.withColumn("nth", nth).crossJoin(F.broadcast(last)).select("id", (F.col("last") + F.col("nth")).cast("long").alias("pos"))
    return existing.select("id", F.col("pos").cast("long").alias("pos")).unionByName(more)


def reuse_plan(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, action: stat (same fingerprint), content (same hash), parse or removed, of files(path, stat, content_hash)."""
    a = previous.select("path", F.col("stat").alias("old_stat"), F.col("content_hash").alias("old_hash"))
    both = current.join(a, "path", "full_outer")
    action = (
        F.when(F.col("content_hash").isNull(), "removed")
        .when(F.col("stat") == F.col("old_stat"), "stat")
        .when(F.col("content_hash") == F.col("old_hash"), "content")
        .otherwise("parse")
    )
    return both.select("path", action.alias("action"))


def reuse_counters(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("files"))


def input_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, problem of files(path, content_hash) that differ between a compiler's input and now."""
    a, b = expected.select("path", F.col("content_hash").alias("a")), actual.select("path", F.col("content_hash").alias("b"))
    problem = F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", problem.alias("problem"))


def affected_catalogs(changed: DataFrame, catalogs: DataFrame) -> DataFrame:
    """file, kind, id of the catalogs(file, kind, id) of both generations that are among changed(path); one row a file, the last by id."""
    files = changed.select(T.to_posix("path").alias("file")).distinct()
    named = catalogs.groupBy("file").agg(F.max(F.struct("id", "kind")).alias("c"))
    return named.join(files, "file", "left_semi").select("file", "c.kind", "c.id")


def reusable_partitions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """current(key, input_hash, resolution_hash) with reused: a partition of the same key and both hashes is there. A null hash is never reused."""
    same = ["key", "input_hash", "resolution_hash"]
    known = previous.select(same).distinct().withColumn("known", F.lit(True))
    return current.join(known, same, "left").withColumn("reused", F.coalesce("known", F.lit(False))).drop("known")
