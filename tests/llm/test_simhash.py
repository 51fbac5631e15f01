"""SimHash against a search of all pairs."""

import random

import numpy as np
import pytest
import xxhash

from lodeseam.llm import components, simhash


def plain_fingerprint(text, k=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [words[i : i + k] for i in range(len(words) - k + 1)] if len(words) >= k else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "A b", "a B c", "Ä b c d", "x y z x y z x y z", "a b c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("ä b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("ä b c".encode(), 42)


@pytest.mark.parametrize("radius", [0, 2, 9, 64])
def test_bk_tree_finds_all_within_the_radius(radius):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 300, "u8") & np.uint64(0x00FF00FF00FF)
    found = {(int(n), int(q)) for n, near in simhash.BKTree(keys).within(keys, radius) for q in near}
    assert found == {(i, j) for i in range(300) for j in range(300) if bin(int(keys[i] ^ keys[j])).count("1") <= radius}


@pytest.mark.parametrize("hot_shard", [4096, 3])
def test_near_fingerprints_connect_as_all_pairs_do(spark, hot_shard):
    rng = random.Random(2)
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            base ^= 1 << rng.randrange(64)
            base ^= 1 << rng.randrange(64)
            fps.add(base)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.component for r in components.components(simhash.near_fingerprints(frame, 2, hot_shard)).collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    want = plain_components(pairs, signed)
    assert {n: got.get(n, n) for n in signed} == want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000), (2000, 1999), (1999, 2000), (None, 5)]
    random.Random(3).shuffle(links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 2000: 1999, 1999: 1999}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (None, "one")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("fp", docs["text"])
    rows = docs.collect()
    got = {(r.doc_id): (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    fps = {r.doc_id: plain_fingerprint(r.text or "") for r in rows}
    ids = sorted(i for i in fps if i is not None)
    pairs = [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    want = plain_components(pairs, ids)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids} | {None: (f"{fps[None]:016x}", 9003)}
    assert simhash.simhash_components(docs.limit(0)).collect() == []
