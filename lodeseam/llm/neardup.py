"""Near-duplicates by SimHash candidates and verified shingle similarity; one document of each group stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, small_batches, text_of, unused
from .components import components
from .simhash import BKTree, _runs, fingerprint, shingle_hashes, spanning

WORDS = 5
SIMILARITY = 0.8
RADIUS = 20
ANCHORS = 4
SHARD = 2048  # members of a shard
SHARD_SHINGLES = 500_000  # and their shingles
COMPARED = 1 << 18  # shingles that are looked up at once
SLICE = 256
BATCH = 1000  # rows with their shingles that come to a Python worker together


def _hashed(docs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, key, class, fp, size, a0 to a3, shingles of each row of docs(doc_id, text).

    key: XXH64 of the text; class: digest of its words (ASCII white space and the case of A-Z don't count); fp: SimHash of
    the set of shingles, as its similarity decides; a0 to a3: the smallest hashes of the set; shingles: the set,
    as hashes of 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                some = batch.slice(at, SLICE)
                names, fps, sizes, values, anchors = [], [], [], [], np.zeros((len(some), ANCHORS), "u8")
                held = np.zeros((len(some), ANCHORS), bool)
                for i, text in enumerate(some.column("text")):
                    text = text.as_py()
                    names.append(hashlib.md5(b" ".join(text.encode("utf-8", "replace").lower().split())).digest())
                    found = np.unique(shingle_hashes(text, words))
                    fps.append(fingerprint(found))
                    n = min(len(found), ANCHORS)
                    anchors[i, :n], held[i, :n] = found[:n], True
                    short = np.unique(found.astype("u4"))
                    sizes.append(len(short))
                    values.append(short.tobytes())
                columns = [some.column(c) for c in ("row", "doc_id", "key")]
                columns += [pa.array(names, pa.binary()), pa.array(np.array(fps, "u8").view("i8")), pa.array(sizes, pa.int32())]
                columns += [pa.array(anchors[:, k].view("i8"), mask=~held[:, k]) for k in range(ANCHORS)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.binary())], schema_names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["row long", f"doc_id {kind}", "key long", "class binary", "fp long", "size int", *(f"a{k} long" for k in range(ANCHORS)), "shingles binary"]
    schema_names = [f.split(" ")[0] for f in fields]
    rows = docs.select("doc_id", text_of().alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, ", ".join(fields))


def _search(frames: Iterator[pd.DataFrame], radius: int, similarity: float) -> Iterator[pd.DataFrame]:
    for rows, labels, fps, raw in _runs(frames, ["anchor", "part"], ["row", "label", "fp", "shingles"]):
        groups = np.unique(labels, return_inverse=True)[1]
        if not groups.any():
            continue
        sets = [np.frombuffer(x, "u4") for x in raw]
        sizes = np.array([len(s) for s in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype("i4")
        starts = np.cumsum(sizes) - sizes
        held = np.zeros(int(ids.max(initial=0)) + 1, bool)

        def similar(a: int, others: np.ndarray, ids=ids, starts=starts, sizes=sizes, held=held) -> np.ndarray:
            """Which of the others have that similarity with a."""
            low, high = np.minimum(sizes[a], sizes[others]), np.maximum(sizes[a], sizes[others])
            out = low >= similarity * high
            some = np.flatnonzero(out & (sizes[others] > 0)) if sizes[a] else np.zeros(0, "i8")
            mine = ids[starts[a] : starts[a] + sizes[a]]
            held[mine] = True
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[others[some]]) // COMPARED)) + 1
            for part in np.split(some, cuts) if len(some) else ():
                n = sizes[others[part]]
                first = np.cumsum(n) - n
                every = np.repeat(starts[others[part]] - first, n) + np.arange(int(n.sum()))
                common = np.add.reduceat(held[ids[every]], first, dtype="i8")
                out[part] = common >= similarity * (sizes[a] + n - common) - 1e-9
            held[mine] = False
            return out

        keys = fps.view("u8")
        links = spanning(len(keys), BKTree(keys).within(keys, radius), similar, groups)
        if links:
            yield pd.DataFrame({"u": rows[[a for a, _ in links]], "v": rows[[b for _, b in links]]})


def _links(shards: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """u, v: a spanning set of the links between different labels in each shard of shards(anchor, part, row, label)."""
    full = shards.join(sets.select("row", "fp", "shingles"), "row").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return full.mapInPandas(lambda frames: _search(frames, radius, similarity), "u long, v long")


def _cut(n, shingles):
    """In how many chunks so many members with so many shingles are dealt."""
    return F.greatest(F.ceil(n / F.lit(SHARD)), F.ceil(shingles / F.lit(SHARD_SHINGLES)), F.lit(1)).cast("int")


def near_links(sets: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """u, v: links between the rows of classes(row, size, a0 to a3) whose sets have a Jaccard similarity of at least that.

    Texts are in a shard for each of their ANCHORS smallest shingle hashes. In a shard, a BK-tree over the SimHash
    fingerprints names the members within the radius, and their whole sets of shingles decide. First come the shards of the
    smallest hash alone, which join most copies; of all other shards only those follow that still hold several
    groups. Shards with over SHARD members (or SHARD_SHINGLES shingles) are dealt into chunks, and pairs of chunks are each a task's
    work of bounded size, so that no two members of different groups go unseen; a group that fills chunks of
    its own is not compared with itself again. Two texts of similarity 0.8 share no anchor with a probability below 0.2^4, and differ in
    over 20 bits with one of about 0.0003.
    """
    each = F.explode(F.array(*[F.struct(F.col(f"a{k}").alias("anchor"), F.lit(k == 0).alias("least")) for k in range(ANCHORS)]))
    rows = classes.select("row", "size", each.alias("e")).select("row", "size", "e.anchor", "e.least").where("anchor IS NOT NULL")
    sums = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    rows = materialised(rows.join(sums, "anchor"), "anchors")
    chunk = F.pmod(F.xxhash64("row"), _cut(F.col("n"), F.col("shingles"))).cast("long")
    early = rows.where("least").select("anchor", chunk.alias("part"), "row", F.col("row").alias("label"))
    early = materialised(_links(early, sets, radius, similarity), "early")
    known = components(early).select(F.col("node").alias("row"), "component")

    labelled = rows.join(known, "row", "left").withColumn("label", F.coalesce("component", "row"))
    mixed = labelled.groupBy("anchor").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("anchor")
    labelled = materialised(labelled.join(mixed, "anchor").select("anchor", "row", "label", "size", "n", "shingles"), "labelled")
    is_hot = (F.col("n") > SHARD) | (F.col("shingles") > SHARD_SHINGLES)
    cold = labelled.where(~is_hot).select("anchor", F.lit(0).cast("long").alias("part"), "row", "label")
    hot = labelled.where(is_hot).drop("n", "shingles")
    weights = hot.groupBy("anchor", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    big = (F.col("n") > SHARD // 2) | (F.col("shingles") > SHARD_SHINGLES // 2)
    large = weights.where(big).select("anchor", "label", F.col("label").alias("own"), _cut(F.col("n"), F.col("shingles")).alias("own_chunks"))
    rest = weights.where(~big).groupBy("anchor").agg(_cut(F.sum("n"), F.sum("shingles")).alias("chunks"))
    dealt = hot.join(large, ["anchor", "label"], "left").join(rest, "anchor", "left")
    chunk = F.pmod(F.xxhash64("row"), F.coalesce("own_chunks", "chunks")).cast("int")
    dealt = materialised(dealt.select("anchor", "row", "label", F.struct(F.col("own").isNull().alias("rest"), F.coalesce("own", F.lit(0)).alias("own"), chunk.alias("k")).alias("c")), "dealt")
    names = dealt.select("anchor", "c").distinct()
    two = names.join(names.select("anchor", F.col("c").alias("d")), "anchor").where("c <= d AND (c.rest OR d.rest OR c.own <> d.own)")
    two = two.withColumn("part", F.xxhash64("c", "d"))
    asked = two.select("anchor", "c", "part").union(two.select("anchor", "d", "part")).distinct()
    pairs = dealt.join(asked, ["anchor", "c"]).select("anchor", "part", "row", "label")
    return early.union(_links(cold.union(pairs), sets, radius, similarity))


def near_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key (XXH64 of the text), group of each row of docs: the least row number that it reaches by links.

    Texts with the same words are of one class from the start, and one of them stands for it.
    """
    same = [F.min(c).alias(c) for c in ("row", "size", *(f"a{k}" for k in range(ANCHORS)))]
    with small_batches(docs.sparkSession, BATCH):
        sets = materialised(_hashed(docs, words), "sets")
        classes = materialised(sets.groupBy("class").agg(*same), "classes")
        roots = components(near_links(sets, classes, similarity)).select(F.col("node").alias("row"), "component")
    named = classes.select("class", "row").join(roots, "row", "left").select("class", F.coalesce("component", "row").alias("group"))
    return sets.select("doc_id", "key", "class").join(named, "class").select("doc_id", "key", "group")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest doc_id; all columns stay.

    Texts without words (null, empty, white space) are one group; a text with fewer words than a shingle has is near
    only to texts of the same words. A null doc_id stays only if its group has no other; of rows with one
    doc_id and the same words one stays; rows with one doc_id and other words are texts of their own.
    """
    groups = materialised(near_groups(docs, words, similarity), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("kept")
    # Written, so that the join deals both sides anew and a large group can be split.
    kept = materialised(groups.groupBy("group").agg(best, F.count("*").alias("rows")).where("rows > 1"), "kept")
    held = groups.join(kept, "group")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key"))
    lost_id, lost_key, key = (unused(docs, n) for n in ("lost_id", "lost_key", "text_key"))
    keyed = docs.withColumn(key, F.xxhash64(text_of()))
    same = F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(key) == F.col(lost_key))
    lost = held.where(~stays).select(F.col("doc_id").alias(lost_id), F.col("key").alias(lost_key))
    out = keyed.join(lost, same, "left_anti")
    again = held.where(stays).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(lost_id), F.col("key").alias(lost_key))
    again = materialised(again, "repeated")
    if not again.isEmpty():
        one = out.join(again, same, "left_semi").dropDuplicates(["doc_id", key])
        out = out.join(again, same, "left_anti").unionByName(one)
    return out.drop(key)
