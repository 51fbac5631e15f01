"""Snapshots with an atomic pointer, shards, catalogs, diagnostics and receipts."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import as_cards

POINTER = "_CURRENT"


def atomic_write(path: str, content: str, expected: str | None = None) -> None:
    """Replaces a file in one step; with expected only if that is what it holds now."""
    if expected is not None:
        with open(path) as f:
            if f.read() != expected:
                raise RuntimeError(f"{path} has changed meanwhile")
    held = f"{path}.{uuid.uuid4().hex}"
    with open(held, "w") as f:
        f.write(content)
    os.replace(held, path)


@contextlib.contextmanager
def generation_lock(root: str, timeout: float = 30.0, poll: float = 0.05):
    """One generation at a time; waits up to timeout seconds for another's lock."""
    path, end = os.path.join(root, "_LOCK"), time.monotonic() + timeout
    while True:
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            if time.monotonic() > end:
                raise TimeoutError(f"{path} is held by another process") from None
            time.sleep(poll)
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        os.unlink(path)


def stable_json(value, indent: int | None = None) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))


def commit_snapshot(root: str, tables: dict[str, DataFrame]) -> str:
    """Writes all tables of a generation, counts them again and only then moves the pointer; the one before stays for a rollback."""
    os.makedirs(root, exist_ok=True)
    name = f"snapshot={uuid.uuid4().hex}"
    staged, manifest = os.path.join(root, name), {}
    with generation_lock(root):
        try:
            for table, df in tables.items():
                df.write.parquet(os.path.join(staged, table))
                again = df.sparkSession.read.parquet(os.path.join(staged, table))
                digest = again.agg(F.count("*"), F.sum(F.xxhash64(*again.columns).cast("decimal(38,0)"))).first()
                manifest[table] = {"rows": digest[0], "hash": str(digest[1] or 0)}
            atomic_write(os.path.join(staged, "_MANIFEST.json"), stable_json(manifest, 2))
            atomic_write(os.path.join(root, POINTER), name)
        except BaseException:
            shutil.rmtree(staged, ignore_errors=True)
            raise
        held = sorted((d for d in os.listdir(root) if d.startswith("snapshot=")), key=lambda d: os.path.getmtime(os.path.join(root, d)))
        for old in [d for d in held if d != name][:-1]:
            shutil.rmtree(os.path.join(root, old), ignore_errors=True)
    return name


def open_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the snapshot that the pointer names just now; a later commit doesn't change them."""
    with open(os.path.join(root, POINTER)) as f:
        at = os.path.join(root, f.read().strip())
    with open(os.path.join(at, "_MANIFEST.json")) as f:
        return {t: spark.read.parquet(os.path.join(at, t)) for t in json.load(f)}


def manifest_violations(spark: SparkSession, root: str) -> list[str]:
    """Tables of the current snapshot that differ from its manifest."""
    with open(os.path.join(root, POINTER)) as f:
        at = os.path.join(root, f.read().strip())
    with open(os.path.join(at, "_MANIFEST.json")) as f:
        manifest = json.load(f)
    bad = []
    for table, want in manifest.items():
        df = spark.read.parquet(os.path.join(at, table))
        n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        if (n, str(total or 0)) != (want["rows"], want["hash"]):
            bad.append(table)
    return bad


def search_shards(cards: DataFrame, size: int) -> DataFrame:
    """id, shard: cards in their order, size to a shard; one shard if that isn't positive or all fit."""
    c = as_cards(cards)
    if size <= 0:
        return c.select("id", F.lit(0).cast("long").alias("shard"))
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("card_order", "id")) - 1
    return c.select("id", F.floor(nth / size).cast("long").alias("shard"))


def catalogs(cards: DataFrame, depth: int = 2, stabilities=("architecture", "contract")) -> DataFrame:
    """module, cards, catalog: the text of each module's cards in order."""
    c = as_cards(cards).where(F.col("stability").isin(*stabilities))
    text = F.concat_ws("\n", F.concat(F.lit("id="), "id"), F.concat(F.lit("role="), "role"), F.when(F.size("search") > 0, F.concat(F.lit("search="), F.array_join("search", "|"))))
    each = c.select(T.module_id("id", depth).alias("module"), "card_order", "id", text.alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("card_order", "id", "text")))
    return each.groupBy("module").agg(F.count("*").alias("cards"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("catalog"))


def prompt_bundle(cards: DataFrame, depth: int = 2) -> DataFrame:
    """module, hash, tokens, text: the parts of a prompt prefix."""
    return catalogs(cards, depth).select("module", F.sha2("catalog", 256).alias("hash"), T.approximate_tokens("catalog").alias("tokens"), F.col("catalog").alias("text"))


def diagnostics_to_sarif(diagnostics: DataFrame) -> str:
    """SARIF 2.1.0 of diagnostics, which a person reads; they are sorted and fetched."""
    rows = diagnostics.orderBy("file", "line", "column", "code", "message").collect()
    uri = lambda p: "/".join("".join(c if c.isalnum() or c in "-_.~" else "".join(f"%{b:02X}" for b in c.encode()) for c in s) for s in p.split("/"))
    results = [
        {
            "ruleId": r["code"], "level": {"info": "note"}.get(r["severity"], r["severity"]), "message": {"text": r["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri(r["file"])}, "region": {"startLine": r["line"], "startColumn": r["column"] or 1}}}],
        }
        for r in rows
    ]
    rules = [{"id": c} for c in sorted({r["code"] for r in rows})]
    return stable_json({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "lodeseam", "rules": rules}}, "results": results}]}, 2)


def diagnostics_to_editor(diagnostics: DataFrame) -> DataFrame:
    """file, items: zero-based positions, grouped by file in order."""
    item = F.struct((F.col("line") - 1).alias("line"), (F.coalesce("column", F.lit(1)) - 1).alias("character"), "severity", "code", "message")
    return diagnostics.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("items"))


def diagnostics_to_lines(diagnostics: DataFrame, form: str = "text") -> DataFrame:
    """line of each diagnostic: text, or an annotation for workflows (github)."""
    if form == "github":
        safe = F.replace(F.replace(F.replace("message", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        return diagnostics.select(F.format_string("::%s file=%s,line=%d,col=%d,title=%s::%s", "severity", "file", "line", F.coalesce("column", F.lit(1)), "code", safe).alias("out"))
    return diagnostics.select(F.format_string("%s:%d:%d %s %s %s", "file", "line", F.coalesce("column", F.lit(1)), "severity", "code", "message").alias("out"))


def write_receipt(root: str, receipt: dict, limit: int = 1 << 20) -> str:
    """Stores a receipt under the digest of its JSON; what is there already stays."""
    text = stable_json(receipt, 2)
    if len(text.encode()) > limit:
        raise ValueError(f"a receipt has {limit} bytes at most")
    name = hashlib.sha256(text.encode()).hexdigest()
    path = os.path.join(root, f"{name}.json")
    if not os.path.exists(path):
        os.makedirs(root, exist_ok=True)
        atomic_write(path, text)
    return name


def receipt_status(receipts: DataFrame, current: DataFrame) -> DataFrame:
    """id, status: matches, stale or unknown, of receipts(id, files map<path, hash>) against current(path, hash)."""
    each = receipts.select("id", F.explode_outer("files").alias("path", "then"))
    now = current.select("path", F.col("hash").alias("now"))
    sums = each.join(now, "path", "left").groupBy("id").agg(
        F.count("path").alias("n"), F.count_if(F.col("path").isNotNull() & ~F.col("then").eqNullSafe(F.col("now"))).alias("off")
    )
    return sums.select("id", F.when(F.col("n") == 0, "unknown").when(F.col("off") > 0, "stale").otherwise("matches").alias("status"))
