"""SimHash near-dedup: sharded BK-trees over fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, materialised, table, text_of
from .components import components

SEED = 42
SLICE_SHINGLES = 1 << 20


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included.

    A-Z become lower case and words end at ASCII white space. Fewer words than a shingle has are
    one shingle; no word gives none.
    """
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, "u8")
    data, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(data, SEED)], "u8")
    ends = np.cumsum(np.fromiter(map(len, found), "i8", len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    return np.array([digest(data[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], "u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 for none."""
    ones = np.zeros(64, "i8")
    for i in range(0, len(hashes), SLICE_SHINGLES):
        part = hashes[i : i + SLICE_SHINGLES].astype(">u8").view("u1").reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row of docs(doc_id, text). No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, "u8").view("i8"))], ["doc_id", "fp"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(hashed, f"doc_id {kind}, fp long")


class BKTree:
    """Children keyed by their Hamming distance from the parent; a query follows the edges within its radius.

    All queries go down the tree together, so that each node costs one vector operation.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        #: node, its members by distance: built when first asked for
        self.root = self._node(np.arange(len(keys)))

    def _node(self, members: np.ndarray) -> tuple[int, list[tuple[int, np.ndarray]]]:
        rest = members[1:]
        d = np.bitwise_count(self.keys[rest] ^ self.keys[members[0]])
        order = np.argsort(d, kind="stable")
        cuts = np.flatnonzero(np.diff(d[order])) + 1
        return members[0], [(int(d[m[0]]), rest[m]) for m in np.split(order, cuts) if len(m)]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """node and the positions of the queries at radius or less from it, node by node."""
        stack = [(self.root, np.arange(len(queries)))] if len(self.keys) else []
        while stack:
            (node, children), asked = stack.pop()
            d = np.bitwise_count(queries[asked] ^ self.keys[node]).astype("i2")
            near = asked[d <= radius]
            if len(near):
                yield node, near
            for key, members in children:
                down = asked[np.abs(d - key) <= radius]
                if len(down):
                    stack.append((self._node(members), down))


def spanning(
    n: int,
    pairs: Iterator[tuple[int, np.ndarray]],
    links: Callable[[int, np.ndarray], np.ndarray] | None = None,
    groups: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Links that join the same members as all pairs do; links() is asked about pairs not yet joined only.

    groups: numbers of groups whose members count as joined from the start.
    """
    group, out = np.arange(n) if groups is None else np.array(groups), []
    left = len(np.unique(group))
    for a, others in pairs:
        others = others[group[others] != group[a]]
        if links is not None and len(others):
            others = others[links(int(a), others)]
        while len(others):
            out.append((int(a), int(others[0])))
            group[group == group[others[0]]] = group[a]
            others = others[group[others] != group[a]]
            left -= 1
        if left == 1:
            break
    return out


def _masks(blocks: int, agreeing: int, bits: np.ndarray) -> list[int]:
    """Masks of all choices of so many of the blocks that the given bit positions are dealt into."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)]
    return [sum(chosen) for chosen in combinations(parts, agreeing)]


def near_fingerprints(fps: DataFrame, radius: int = 2, hot_shard: int = 4096) -> DataFrame:
    """u, v: links that connect the same fingerprints of fps(fp) as all pairs at radius or less do.

    The 64 bits are in radius + 2 blocks; fingerprints within the radius agree on two blocks at least.
    Each choice of two blocks is a table, each value there a shard with a BK-tree of its own. Of
    the pairs in a shard only a spanning set is returned. A shard with more than hot_shard
    fingerprints is dealt anew by the bits that its members need not share, so
    that a shard of any input has at most 2^16 members (for radius 2).
    """
    bits = np.arange(64)
    masks = _masks(radius + 2, 2, bits)
    keyed = fps.select("fp").distinct()
    shard = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))
    keyed = keyed.select("fp", shard.alias("s")).select("fp", "s.t", "s.k")
    hot = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot_shard).select("t", "k")
    found = bounded_rows(hot, 100_000)
    if found != []:
        side = hot if found is None else F.broadcast(fps.sparkSession.createDataFrame(found, hot.schema))
        dealt = keyed.join(side, ["t", "k"], "left_semi")
        finer = F.array(
            *[
                F.struct(F.lit(1000 * (i + 1) + j).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m | more))).alias("k"), F.lit(i).alias("of"))
                for i, m in enumerate(masks)
                for j, more in enumerate(_masks(radius + 2, 2, np.array([b for b in bits if not m >> int(b) & 1])))
            ]
        )
        finer = F.filter(finer, lambda s: s["of"] == F.col("t"))
        dealt = dealt.select("fp", F.explode(finer).alias("s")).select("fp", "s.t", "s.k")
        keyed = keyed.join(side, ["t", "k"], "left_anti").unionByName(dealt)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fp in _runs(frames, ["t", "k"], ["fp"]):
            keys = fp[0].view("u8")
            if len(keys) == 2:
                out = [(0, 1)] if int(np.bitwise_count(keys[0] ^ keys[1])) <= radius else []
            else:
                out = spanning(len(keys), BKTree(keys).within(keys, radius))
            if out:
                yield pd.DataFrame({"u": fp[0][[a for a, _ in out]], "v": fp[0][[b for _, b in out]]})

    return keyed.repartition("t", "k").sortWithinPartitions("t", "k").mapInPandas(search, "u long, v long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _runs(frames: Iterator[pd.DataFrame], by: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The given columns of each run of two or more equal keys in sorted frames."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        held = yield from _cut(frame, by, columns)
    if held is not None and len(held) > 1:
        yield [held[c].to_numpy() for c in columns]


def _cut(frame: pd.DataFrame, by: list[str], columns: list[str]):
    new = np.zeros(len(frame), bool)
    new[0] = True
    for c in by:
        x = frame[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    values = [frame[c].to_numpy() for c in columns]
    sizes = np.diff(starts)
    for i in np.flatnonzero(sizes > 1).tolist():
        yield [v[starts[i] : starts[i + 1]] for v in values]
    return frame.iloc[starts[-1] :].reset_index(drop=True)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, fingerprint, component_id.

    Rows whose fingerprints differ in radius bits at most are linked; component_id is the smallest doc_id that is
    reachable. A null or empty text has fingerprint zero and is linked like any other. A null doc_id never
    is a component_id unless it has no other. Repeated rows are linked rows; an empty table
    gives an empty table; other columns aren't read. Equal fingerprints meet in one row before
    the search, so copies cost nothing there.
    """
    hashed = materialised(fingerprints(docs, words), "fingerprints")
    groups = hashed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_fingerprints(groups, radius))
    joined = groups.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return hashed.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))
