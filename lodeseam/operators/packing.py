"""Windows of lines, interleaving and packing under byte and token budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CONTEXT_LINES = 8
FILES, WINDOWS, FILES_PER_TERM = 12, 3, 12
NON_PRODUCTION = r"(?i)(^|/)(tests?|__tests__|spec|specs|fixtures?|examples?|scripts?|benchmarks?|mocks?)(/|$)|\.(test|spec)\.[a-z]+$"


def line_hits(files: DataFrame, terms: DataFrame) -> DataFrame:
    """path, line, term: lines of files(path, content) with one of terms(term) in them, case and all."""
    lines = files.select("path", F.posexplode(F.split(T.normalize_newlines("content"), "\n")).alias("at", "text"))
    words = F.broadcast(terms.select("term").distinct())
    return lines.join(words, F.col("text").contains(F.col("term"))).select("path", (F.col("at") + 1).alias("line"), "term")


def source_windows(hits: DataFrame, line_counts: DataFrame, context: int = CONTEXT_LINES) -> DataFrame:
    """path, window, first, last, hits, terms: hits whose contexts touch share a window; line_counts(path, lines)."""
    each = hits.groupBy("path", "line").agg(F.collect_set("term").alias("t"))
    by_line = Window.partitionBy("path").orderBy("line")
    gap = F.col("line") - F.lag("line").over(by_line)
    new = F.when(gap.isNull() | (gap > 2 * context + 1), 1).otherwise(0)
    marked = each.withColumn("new", new).withColumn("window", F.sum("new").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("path", "window").agg(
        F.min("line").alias("low"), F.max("line").alias("high"), F.count("*").alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_list("t")))).alias("terms")
    )
    return out.join(line_counts, "path").select(
        "path", "window", F.greatest(F.lit(1), F.col("low") - context).alias("first"), F.least(F.col("lines"), F.col("high") + context).alias("last"), "hits", "terms"
    )


def focused_terms(hits: DataFrame) -> DataFrame:
    """term: those in at most twice as many files as the rarest identifier-like one has, and flags (--name)."""
    counts = hits.groupBy("term").agg(F.countDistinct("path").alias("files"))
    like_name = ~F.col("term").startswith("-") & F.col("term").rlike(r"[\p{L}_$]")
    least = counts.agg(F.coalesce(F.min(F.when(like_name, F.col("files"))), F.min("files")).alias("least"))
    return counts.crossJoin(F.broadcast(least)).where((F.col("files") <= 2 * F.col("least")) | F.col("term").startswith("--")).select("term")


def best_files(hits: DataFrame, per_term: int = FILES_PER_TERM, top: int = FILES) -> DataFrame:
    """path, terms: of each term's first files the ones with most terms, then by path; production files go first if any match."""
    counts = hits.groupBy("path").agg(F.countDistinct("term").alias("terms"))
    production = counts.withColumn("np", F.col("path").rlike(NON_PRODUCTION))
    any_ = production.agg(F.coalesce(F.min(F.col("np").cast("int")), F.lit(1)).alias("least"))
    counts = production.crossJoin(F.broadcast(any_)).where(F.col("np").cast("int") == F.col("least")).select("path", "terms")
    of_term = hits.select("path", "term").distinct().join(counts, "path")
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("terms"), "path"))
    chosen = of_term.withColumn("nth", nth).where(F.col("nth") <= per_term).select("path", "terms").distinct()
    return chosen.orderBy(F.desc("terms"), "path").limit(top)


def best_windows(windows: DataFrame, top: int = WINDOWS) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("terms"), F.desc("hits"), "first"))
    return windows.withColumn("ordinal", nth).where(F.col("ordinal") <= top)


def interleaved(windows: DataFrame, files: DataFrame) -> DataFrame:
    """windows(path, ordinal) in turns of files: all firsts, then all seconds, each by rank of files(path, terms)."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("terms"), "path"))
    ranked = files.select("path", rank.alias("file_rank"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ordinal", "file_rank"))
    return windows.join(ranked, "path").withColumn("place", place)


def greedy_prefix(items: DataFrame, by: str, order: list[str], budget: int) -> DataFrame:
    """items(text) of each group in order, up to the first that overflows the token budget; adds spent."""
    run = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce(F.col("text"), F.lit(""))
    spent = T.tokens_of_counts(F.sum(T.ascii_count(text)).over(run), F.sum(T.utf16_units(text) - T.ascii_count(text)).over(run))
    rows = items.withColumn("spent", spent)
    return rows.where(F.col("spent") <= budget)


def pack_with_quota(items: DataFrame, by: str, order: str, budget: int, least_quota: int = 256) -> DataFrame:
    """by, order, bytes, used: greedy packing that skips what doesn't fit and goes on; items(bytes).

    What is left is a running state, so each group is folded in order; a group is the packing list of one request.
    """
    kinds = dict(items.dtypes)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group, left, used = group.sort_values(order), budget, []
        quota = max(least_quota, budget // max(1, min(len(group), 6)))
        for n in group["bytes"].tolist():
            take = min(left, quota) if n > min(left, quota) else n
            take = 0 if n > 0 and take < min(n, least_quota) else take
            used.append(int(take))
            left -= take
        return group.assign(used=used)[[by, order, "bytes", "used"]]

    schema = f"{by} {kinds[by]}, {order} {kinds[order]}, bytes long, used long"
    return items.select(by, order, F.col("bytes").cast("long").alias("bytes")).groupBy(by).applyInPandas(pack, schema)


def page(rows: DataFrame, by: str, order: list[str], offset: int, top: int, byte_budget: int) -> DataFrame:
    """The rows offset .. offset + top of each group in order, with omitted where their JSON goes beyond the budget."""
    if offset < 0 or not 1 <= top <= 1000 or byte_budget < 1:
        raise ValueError("offset, top or byte budget out of range")
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    some = rows.withColumns({"position": nth, "json_bytes": size}).where((F.col("position") >= offset) & (F.col("position") < offset + top))
    run = Window.partitionBy(by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return some.withColumn("omitted", F.sum("json_bytes").over(run) > byte_budget)


def overlapping(intervals: DataFrame) -> DataFrame:
    """intervals(path, start, end) that begin before an earlier one of their path ends."""
    before = Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("reached", F.max("end").over(before)).where(F.col("start") < F.col("reached")).drop("reached")


def shared_budget(excerpts: DataFrame, budget: int) -> DataFrame:
    """request, rank, text, truncated: excerpts(request, rank, text) of each request in order, sharing a budget of UTF-8 bytes.

    Line ends become line feeds. A text that doesn't fit is cut between code points; what it leaves goes to the next. Null texts are
    left out, and so is all that follows the last byte. A request's excerpts are few: they meet in one row.
    """
    rows = excerpts.where("text IS NOT NULL").select("request", "rank", T.normalize_newlines("text").alias("text"))
    lists = rows.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("all"))
    kind = f"struct<rest:long,out:array<struct<rank:{excerpts.schema['rank'].dataType.simpleString()},text:string,truncated:boolean>>>"

    def fitting(text: Column, rest: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))

        def more(a: Column, c: Column) -> Column:
            size = F.octet_length(c)
            fits = a["open"] & (a["bytes"] + size <= rest)
            return F.struct(F.when(fits, a["bytes"] + size).otherwise(a["bytes"]).cast("long").alias("bytes"), F.when(fits, a["n"] + 1).otherwise(a["n"]).cast("long").alias("n"), fits.alias("open"))

        return F.substring(text, F.lit(1), F.aggregate(F.split(F.substring(text, F.lit(1), rest.cast("int")), ""), start, more)["n"].cast("int"))

    def take(a: Column, e: Column) -> Column:
        whole = F.octet_length(e["text"]) <= a["rest"]
        text = F.when(whole, e["text"]).otherwise(fitting(e["text"], a["rest"]))
        row = F.struct(e["rank"].alias("rank"), text.alias("text"), (~whole).alias("truncated"))
        used = F.struct((a["rest"] - F.octet_length(text)).cast("long").alias("rest"), F.array_append(a["out"], row).alias("out"))
        return F.when(a["rest"] == 0, a).otherwise(used).cast(kind)

    zero = F.struct(F.lit(budget).cast("long").alias("rest"), F.array().alias("out")).cast(kind)
    packed = lists.select("request", F.explode(F.aggregate("all", zero, take)["out"]).alias("x"))
    return packed.select("request", "x.rank", "x.text", "x.truncated")
