"""Joins on prefixes, globs, candidate paths, cards and declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.glob import glob_regex


def longest_prefix_join(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """path, specifier, module, directory: the module with the longest path that is the specifier or a parent of it.

    imports(path, specifier), modules(module_path, directory). Specifiers are expanded into their prefixes, so the match is
    an equi-join; ties go to the first directory.
    """
    parts = F.split("specifier", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("p")))
    each = imports.select("path", "specifier", F.explode(prefixes).alias("x")).select("path", "specifier", "x.n", F.col("x.p").alias("module_path"))
    best = Window.partitionBy("path", "specifier").orderBy(F.desc("n"), "directory")
    hits = each.join(modules, "module_path").withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return hits.select("path", "specifier", F.col("module_path").alias("module"), "directory")


def coverage_join(files: DataFrame, rules: list[dict]) -> DataFrame:
    """path, rule: files(path) that a rule {name, match: globs} covers. Rules are configuration; each becomes one regular expression."""
    out = None
    for rule in rules:
        pattern = "|".join(f"(?:{glob_regex(g)})" for g in rule["match"])
        part = files.where(F.col("path").rlike(pattern)).select("path", F.lit(rule["name"]).alias("rule"))
        out = part if out is None else out.unionByName(part)
    return files.sparkSession.createDataFrame([], "path string, rule string") if out is None else out


def resolve_imports(imports: DataFrame, files: DataFrame, suffixes: list[str], first_only: bool = False) -> DataFrame:
    """src_path, specifier, dst_path, nth of relative imports(src_path, specifier): candidates with each suffix that are files(path)."""
    local = imports.where(F.col("specifier").rlike(r"^\.{1,2}(/|$)"))
    joined = F.concat_ws("/", T.dirname("src_path"), F.col("specifier"))
    base = F.aggregate(
        F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != ".")),
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)),
    )
    ends = F.array(*[F.lit(s) for s in suffixes])
    tried = local.select("src_path", "specifier", F.array_join(base, "/").alias("base"))
    tried = tried.select("src_path", "specifier", F.posexplode(F.transform(ends, lambda s: F.concat("base", s))).alias("nth", "path"))
    hits = tried.join(files.select("path").distinct(), "path").select("src_path", "specifier", F.col("path").alias("dst_path"), "nth")
    if not first_only:
        return hits
    return hits.groupBy("src_path", "specifier").agg(F.min_by("dst_path", "nth").alias("dst_path"), F.min("nth").alias("nth"))


def resolve_rust_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src_path, specifier, dst_path of module paths in imports(src_path, specifier) that are files(path).

    crate:: begins at the nearest folder src (or else the file's), self:: and plain paths at the module's own folder, and each
    super:: one above. name.rs goes before name/mod.rs. Aliases, groups and globs are cut off; what still is no path has no file.
    """
    clean = F.col("specifier")
    for pattern in (r"\s+as\s+.+$", r"(?s)::\{.*$", r"::\*$"):
        clean = F.regexp_replace(clean, pattern, "")
    asked = imports.select("src_path", "specifier", F.trim(clean).alias("name")).where("name <> '' AND NOT name RLIKE '[{}(),]'")
    folders = F.filter(F.split(T.dirname("src_path"), "/"), lambda p: (p != "") & (p != "."))
    stem = F.regexp_replace(F.element_at(F.split("src_path", "/"), -1), r"\.rs$", "")
    own = F.when(stem.isin("lib", "main", "mod"), folders).otherwise(F.array_append(folders, stem))
    src = F.size(folders) - F.array_position(F.reverse(folders), "src").cast("int") + 1
    crate = F.when(F.array_contains(folders, "src"), F.slice(folders, F.lit(1), src)).otherwise(folders)
    parts = F.filter(F.split("name", "::"), lambda p: p != "")
    ups = F.length(F.regexp_extract(F.concat(F.array_join(parts, "::"), F.lit("::")), "^((?:super::)*)", 1)) / F.length(F.lit("super::"))
    split = asked.select("src_path", "specifier", parts.alias("parts"), own.alias("own"), crate.alias("crate"), ups.cast("int").alias("ups"))
    first = F.get("parts", F.lit(0))
    base = F.when(first == "crate", F.col("crate")).when(F.col("ups") > 0, F.slice("own", F.lit(1), F.greatest(F.size("own") - F.col("ups"), F.lit(0)))).otherwise(F.col("own"))
    skipped = F.when(first.isin("crate", "self"), 1).otherwise(F.col("ups"))
    left = F.slice("parts", skipped + 1, F.size("parts"))
    tried = split.where(F.size(left) > 0).select("src_path", "specifier", F.array_join(F.concat(base, left), "/").alias("base"))
    each = tried.select("src_path", "specifier", F.posexplode(F.array(F.concat("base", F.lit(".rs")), F.concat("base", F.lit("/mod.rs")))).alias("nth", "path"))
    hits = each.join(files.select("path").distinct(), "path")
    return hits.groupBy("src_path", "specifier").agg(F.min_by("path", "nth").alias("dst_path"))


def bind_cards(cards: DataFrame, declarations: DataFrame) -> DataFrame:
    """id, key: the only declaration at a card's path and symbol that is at its offset or line."""
    d = declarations.select("key", "path", "symbol", F.col("line").alias("d_line"), F.col("offset").alias("d_offset"))
    both = cards.select("id", "path", "symbol", "line", "offset").join(d, ["path", "symbol"])
    both = both.where((F.col("offset") == F.col("d_offset")) | (F.col("line") == F.col("d_line")))
    n = F.count("*").over(Window.partitionBy("id"))
    return both.withColumn("n", n).where("n = 1").select("id", "key")


def dispositions_join(candidates: DataFrame, dispositions: DataFrame, scanned: DataFrame, covered: DataFrame) -> DataFrame:
    """path, status, reason of dispositions(path, reason): suppressed if a candidate, else stale and why."""
    mark = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    out = dispositions.join(mark(candidates, "c"), "path", "left").join(mark(scanned, "s"), "path", "left").join(mark(covered, "k"), "path", "left")
    why = F.when(F.col("s").isNull(), "file-not-scanned").when(F.col("k"), "already-carded").otherwise("not-a-candidate")
    return out.select("path", F.when(F.col("c"), "suppressed").otherwise("stale").alias("status"), F.when(F.col("c"), F.col("reason")).otherwise(why).alias("reason"))


def members_of(metadata: DataFrame) -> DataFrame:
    """owner, key: members of each definition of metadata(key, owner)."""
    owners = metadata.select(F.col("key").alias("owner"))
    return metadata.where("owner IS NOT NULL").join(owners, "owner", "left_semi").select("owner", "key")


def numbered_identities(rows: DataFrame) -> DataFrame:
    """rows(identity, path, offset, key) with generated_id = identity:occurrence."""
    nth = F.row_number().over(Window.partitionBy("identity").orderBy("path", "offset", "key")) - 1
    return rows.withColumn("generated_id", F.concat_ws(":", "identity", nth.cast("string")))
