"""Coverage audit of modules: signals, additive scores, priorities and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import extraction
from .graph import reachable
from .joins import dispositions_join

WEIGHTS = {"entrypoint": 50, "public": 45, "command": 40, "boundary": 30, "importer": 5, "importers": 30, "exports": 10, "large": 10}
PENALTIES = {"utility": 30, "non_production": 40, "barrel": 60}
LARGE_BYTES, UTILITY_EXPORTS = 12_000, 10
NON_PRODUCTION = r"(?i)(^|/)(tests?|__tests__|specs?|fixtures?|benchmarks?|mocks?)(/|$)|\.(test|spec)\.[a-z]+$"
UTILITY_NAME = r"(?i)(^|/)(common|helpers?|shared|utils?)(\.[^/]+)?$"
RANK = {"high": 0, "medium": 1, "low": 2}


def fan_in(imports: DataFrame) -> DataFrame:
    """module, importers: distinct modules that import each module, itself included; imports(src_module, dst_module)."""
    return imports.groupBy(F.col("dst_module").alias("module")).agg(F.countDistinct("src_module").alias("importers"))


def module_signals(files: DataFrame, imports: DataFrame, entrypoints: DataFrame, public: DataFrame, covered: DataFrame) -> DataFrame:
    """One row of signals for each module of files(path, content) that covered(path, scope) leaves open.

    imports(src_path, dst_path), entrypoints(path) and public(path). Production files count where a module has any.
    """
    keyed = files.where(~F.col("path").endswith(".d.ts")).withColumn("module", T.module_key("path"))
    done = covered.where("scope = 'module'").select(T.module_key("path").alias("module")).distinct()
    open_ = keyed.join(done, "module", "left_anti").join(covered.where("scope = 'file'").select("path"), "path", "left_anti")
    flagged = open_.withColumn("np", F.col("path").rlike(NON_PRODUCTION))
    production = F.min(F.col("np").cast("int")).over(Window.partitionBy("module"))
    flagged = flagged.withColumn("none", production).where(F.col("np").cast("int") == F.col("none"))
    mark = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(1))
    counts = extraction.declarations(files).where("exported").groupBy("path").agg(F.count("*").alias("exports"))
    rows = flagged.join(mark(entrypoints, "e"), "path", "left").join(mark(public, "p"), "path", "left").join(counts, "path", "left")
    kinds = F.transform(extraction.boundaries(F.col("path"), F.col("content")), lambda b: b["kind"])
    main = F.col("path").rlike(r"(^|/)main\.go$") & F.col("content").rlike(r"(?m)^\s*package\s+main\b")
    rows = rows.select(
        "module", "path", "none", F.coalesce("e", main.cast("int")).alias("e"), F.coalesce("p", F.lit(0)).alias("p"), kinds.alias("kinds"),
        F.coalesce("exports", F.lit(0)).alias("exports"), F.octet_length("content").alias("bytes"), extraction.is_barrel(F.col("content")).alias("barrel"),
    )
    worth = F.col("e") * 1000 + F.least("exports", F.lit(50)) * 10
    groups = rows.groupBy("module").agg(
        F.count("*").alias("files"), F.max("e").alias("entrypoint"), F.max("p").alias("public"), F.sum("exports").alias("exports"), F.sum("bytes").alias("bytes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"), F.max("none").alias("non_production"), F.min("barrel").alias("all_barrel"),
        F.min_by("path", F.struct((-worth).alias("worth"), "path")).alias("representative"),
    )
    links = imports.select(T.module_key("src_path").alias("src_module"), T.module_key("dst_path").alias("dst_module"))
    groups = groups.join(fan_in(links), "module", "left").withColumn("importers", F.coalesce("importers", F.lit(0)))
    wide = (F.col("exports") >= UTILITY_EXPORTS) & (F.col("importers") <= 1) & (F.col("entrypoint") == 0) & (F.col("public") == 0) & (F.size("kinds") == 0) & ~F.col("module").startswith("go:")
    return groups.select("*", ((F.col("files") == 1) & F.col("all_barrel")).alias("barrel"), (F.col("representative").rlike(UTILITY_NAME) | wide).alias("utility"), (F.col("bytes") >= LARGE_BYTES).alias("large"))


def audit_candidates(signals: DataFrame) -> DataFrame:
    """module, path, score, priority of modules with a signal and a positive score."""
    gate = (F.col("entrypoint") > 0) | (F.col("public") > 0) | (F.size("kinds") > 0) | (F.col("importers") > 0) | (F.col("exports") > 0) | F.col("large")
    on = lambda c, n: F.when(c, n).otherwise(0)
    commands = F.array_contains("kinds", "command").cast("int")
    score = (
        on(F.col("entrypoint") > 0, WEIGHTS["entrypoint"])
        + on((F.col("public") > 0) & (F.col("entrypoint") == 0), WEIGHTS["public"])
        + commands * WEIGHTS["command"]
        + (F.size("kinds") - commands) * WEIGHTS["boundary"]
        + F.least(F.col("importers") * WEIGHTS["importer"], F.lit(WEIGHTS["importers"]))
        + on(F.col("exports") > 0, WEIGHTS["exports"])
        + on(F.col("large"), WEIGHTS["large"])
        - on(F.col("utility"), PENALTIES["utility"])
        - on(F.col("non_production") > 0, PENALTIES["non_production"])
        - on(F.col("barrel"), PENALTIES["barrel"])
    )
    rows = signals.where(gate).select("module", F.col("representative").alias("path"), F.greatest(F.lit(0), score).cast("long").alias("score")).where("score > 0")
    return rows.withColumn("priority", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low"))


def audit(files: DataFrame, imports: DataFrame, entrypoints: DataFrame, reexports: DataFrame, covered: DataFrame, dispositions: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Open candidates and the state of dispositions(path, reason); reexports(src, dst) lead from entrypoints(path) to public files."""
    starts = entrypoints.select(F.col("path").alias("node"))
    public = reachable(starts, reexports).join(starts, "node", "left_anti").select(F.col("node").alias("path"))
    found = audit_candidates(module_signals(files, imports, entrypoints, public, covered))
    if dispositions is None:
        return found, None
    state = dispositions_join(found, dispositions, files, covered)
    return found.join(state.where("status = 'suppressed'").select("path"), "path", "left_anti"), state


def ranked_candidates(candidates: DataFrame, minimum: str = "low", top: int = 20) -> DataFrame:
    """candidates of the least priority or above by priority, score and path, with matched and rank."""
    level = F.coalesce(*[F.when(F.col("priority") == p, F.lit(r)) for p, r in RANK.items()])
    rows = candidates.withColumn("level", level).where(F.col("level") <= RANK[minimum])
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("rank", F.row_number().over(every.orderBy("level", F.desc("score"), "path"))).withColumn("matched", F.count("*").over(every))
    return rows.where(F.col("rank") <= top).drop("level")


def audit_summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("priority") == p).alias(p) for p in RANK])


def explain_files(files: DataFrame, covered: DataFrame, candidates: DataFrame, dispositions: DataFrame) -> DataFrame:
    """path, status of each file: stale, not-scanned, carded, suppressed, candidate or not-candidate, the first that fits."""
    mark = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    every = files.select("path").union(dispositions.select("path")).distinct()
    rows = every.join(mark(files, "f"), "path", "left").join(mark(covered, "k"), "path", "left").join(mark(candidates, "c"), "path", "left").join(mark(dispositions, "d"), "path", "left")
    has = lambda n: F.coalesce(F.col(n), F.lit(False))
    status = F.when(has("d") & ~has("c"), "stale").when(~has("f"), "not-scanned").when(has("k"), "carded").when(has("d"), "suppressed").when(has("c"), "candidate")
    return rows.select("path", status.otherwise("not-candidate").alias("status"))


def conformance(results: DataFrame) -> DataFrame:
    """repository, verdict of results(repository, verdict): fail before held before pass; and the verdict over all as repository null."""
    rank = F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "held", 1).otherwise(0)
    return results.rollup("repository").agg(F.max_by("verdict", rank).alias("verdict"))
