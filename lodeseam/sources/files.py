"""Source files, JSON lines, registries, graph inputs, configuration and aliases as DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.glob import matches_any
from ..schema import REGISTRY_SCHEMA

READ_LIMIT = 16 * 1024 * 1024
EXCLUDED_DIRECTORIES = (".git", "node_modules", "dist", "build", "coverage", "vendor", "target", "__pycache__")
JSON_STATES = ("active", "redirect", "replaced", "retired")


def list_files(root: str, extensions: list[str], excluded_directories=EXCLUDED_DIRECTORIES, roots=(".",)) -> list[str]:
    """Relative paths in order; excluded directories and symbolic links aren't entered. Only names are read, on the driver."""
    found, allowed = set(), {e.lower() for e in extensions}
    for start in roots:
        for at, directories, names in os.walk(os.path.join(root, start)):
            directories[:] = sorted(d for d in directories if d not in excluded_directories and not os.path.islink(os.path.join(at, d)))
            for name in names:
                full = os.path.join(at, name)
                if os.path.splitext(name)[1].lower() in allowed and not os.path.islink(full):
                    found.add(os.path.relpath(full, root).replace(os.sep, "/"))
    return sorted(found)


def scan_files(spark: SparkSession, root: str, extensions: list[str], exclude_files=(), limit: int = READ_LIMIT, partitions: int | None = None) -> DataFrame:
    """path, content, content_hash, source_bytes. Contents are read by the executors, which must see root; a file over limit raises."""
    paths = spark.createDataFrame([(p,) for p in list_files(root, extensions)], "path string")
    if exclude_files:
        paths = paths.where(~matches_any("path", list(exclude_files)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path in frame["path"]:
                with open(os.path.join(root, path), "rb") as f:
                    data = f.read(limit + 1)
                if len(data) > limit:
                    raise ValueError(f"{path} has over {limit} bytes")
                rows.append((path, data.decode("utf-8", "replace"), hashlib.sha256(data).hexdigest(), len(data)))
            yield pd.DataFrame(rows, columns=["path", "content", "content_hash", "source_bytes"])

    spread = paths.repartition(partitions) if partitions else paths
    return spread.mapInPandas(read, "path string, content string, content_hash string, source_bytes long")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line_no, value (struct), error of each line that isn't blank or a comment (#)."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    rows = raw.where(~F.trim("line").rlike("^(#.*)?$")).withColumn("line_no", (F.col("at") + 1).cast("long"))
    parsed = F.from_json("line", schema)
    bad = F.try_parse_json("line").isNull() | ~F.trim("line").startswith("{")
    return rows.select("line_no", F.when(~bad, parsed).alias("value"), F.when(bad, F.lit("invalid JSON")).alias("error"))


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid entries, and diagnostics line_no, message of the others."""
    rows = json_lines(spark, path, "id string, state string, to string, by array<string>")
    v = rows.select("line_no", "error", "value.*")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("id").isNull(), "missing id")
        .when(~F.coalesce("state", F.lit("")).isin(*JSON_STATES), "unknown state")
        .when((F.col("state") == "redirect") & F.col("to").isNull(), "redirect without target")
        .when((F.col("state") == "replaced") & (F.coalesce(F.size("by"), F.lit(0)) < 1), "replaced without targets")
    )
    checked = v.withColumn("message", problem)
    names = [x.split(" ")[0] for x in REGISTRY_SCHEMA.split(", ")]
    good = checked.where("message IS NULL").withColumn("by", F.coalesce("by", F.array().cast("array<string>"))).select(names)
    return good, checked.where("message IS NOT NULL").select("line_no", "message")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, target of a lexicon {"aliases": {phrase: id or ids}}."""
    with open(path) as f:
        pairs = json.load(f).get("aliases", {})
    rows = [(a, t) for a, ts in pairs.items() for t in ([ts] if isinstance(ts, str) else ts)]
    return spark.createDataFrame(rows, "alias string, target string")


def read_eval_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries(query_id, query), expected(query_id, id) and negatives(query_id) of an evaluation file."""
    rows = json_lines(spark, path, "query string, expected array<string>, expectNoResults boolean").where("error IS NULL")
    v = rows.select(F.col("line_no").alias("query_id"), "value.*").where("query IS NOT NULL")
    return v.select("query_id", "query"), v.select("query_id", F.explode("expected").alias("id")), v.where("expectNoResults").select("query_id")


def read_graph_input(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """definitions and references of a graph index (versions 1 to 3); ids are qualified, confidence defaults to 0.8."""
    with open(path) as f:
        data = json.load(f)
    version, repository = data.get("schemaVersion"), data.get("repositoryId")
    if version not in (1, 2, 3) or not repository or (version >= 2 and not isinstance(data.get("sourceHashes"), dict)):
        raise ValueError("graph index: unknown version, or repositoryId or sourceHashes missing")
    unknown = set(data) - {"schemaVersion", "repositoryId", "generator", "sourceHashes", "definitions", "references"}
    if unknown:
        raise ValueError(f"graph index: unknown keys {sorted(unknown)}")
    name = lambda x: x if "/" in x else f"{repository}/{x}"
    definitions = sorted((name(d["id"]), d["symbol"], d["path"], d.get("line"), d.get("kind")) for d in data["definitions"])
    if len({d[0] for d in definitions}) < len(definitions):
        raise ValueError("graph index: repeated definition ids")
    refs = [(name(r["from"]), name(r["to"]), r["kind"], r.get("path"), r.get("line"), float(r.get("confidence", 0.8))) for r in data["references"]]
    if any(not 0 <= r[5] <= 1 for r in refs):
        raise ValueError("graph index: confidence outside 0 to 1")
    return (
        spark.createDataFrame(definitions, "id string, symbol string, path string, line int, kind string"),
        spark.createDataFrame(refs, "src string, dst string, kind string, path string, line int, confidence double"),
    )


def deep_merge(base: dict, override: dict) -> dict:
    """Maps are merged, everything else is replaced."""
    out = dict(base)
    for key, value in override.items():
        out[key] = deep_merge(base[key], value) if isinstance(value, dict) and isinstance(base.get(key), dict) else value
    return out


def manifest_entrypoints(manifest: str, directory: str = "") -> list[str]:
    """Paths that main, module, bin and exports (types left out) of a package manifest name."""

    def leaves(value, key="") -> list[str]:
        if isinstance(value, str):
            return [] if key == "types" else [value]
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        return [x for k, v in items for x in leaves(v, k)]

    data = json.loads(manifest)
    found = [x for key in ("main", "module", "bin", "exports") if key in data for x in leaves(data[key])]
    return sorted({os.path.normpath(os.path.join(directory, x)).replace(os.sep, "/") for x in found})


def go_modules(spark: SparkSession, files: DataFrame) -> DataFrame:
    """module_path, directory of each go.mod among files(path, content)."""
    mods = files.where(F.col("path").rlike(r"(^|/)go\.mod$"))
    path = F.regexp_extract("content", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1)
    directory = F.regexp_replace("path", r"(^|/)go\.mod$", "")
    return mods.select(path.alias("module_path"), directory.alias("directory")).where("module_path <> ''")


def file_history(root: str, path: str) -> dict:
    """Last commit of a file and whether it has changes now."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=30).stdout.strip()
    last = git("log", "-1", "--format=%H%x09%cI%x09%s", "--", path).split("\t")
    state = git("status", "--porcelain", "--", path)[:2]
    names = ("commit", "time", "subject")
    return dict(zip(names, last if len(last) == 3 else (None,) * 3, strict=True)) | {"state": "untracked" if state == "??" else "changed" if state else "clean"}
