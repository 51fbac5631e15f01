"""Near-dedup against all pairs, and the stages of the pipeline one after another against plain Python."""

import random
import re
import zlib

import sentencepiece

import corpus_pipeline
from lodeseam.llm import decontamination, neardup
from lodeseam.llm.token_files import public_path


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_groups(rows):
    """Index of the group of each text, from all pairs."""
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def planted(seed, n_groups=25):
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(30))
    for _ in range(n_groups):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice((1, 1, 2, 6))):
            text = list(base)
            for _ in range(rng.randint(0, len(text) // 90)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text) + (" " + shared if rng.random() < 0.3 else ""))
    return rows + ["", " \n", None, "one", "ONE ", "one two", "one two three four five", "one two three four five six"]


def kept_of(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, class long")
    return {r.doc_id for r in neardup.drop_near_duplicates(docs, **more).collect()}


def test_near_dedup_equals_all_pairs(spark):
    texts = planted(1)
    assert kept_of(spark, texts) == set(plain_groups(texts))
    held = neardup.SHARD, neardup.SHARD_SHINGLES, neardup.COMPARED
    try:
        for small in ((3, *held[1:]), (held[0], 700, 100)):
            neardup.SHARD, neardup.SHARD_SHINGLES, neardup.COMPARED = small
            assert kept_of(spark, texts) == set(plain_groups(texts))
    finally:
        neardup.SHARD, neardup.SHARD_SHINGLES, neardup.COMPARED = held


def test_near_dedup_of_copies_that_repeat_a_line_more_or_less_often(spark):
    rng, texts = random.Random(4), []
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    for n, length, few, many in ((1000, 15, 1, 30), (1000, 15, 1, 60), (400, 20, 1, 15), (200, 12, 1, 20), (200, 12, 2, 20)):
        for _ in range(4):
            base, line = words(n), "\n" + words(length)
            texts += [base + line * few, base + line * many]
    assert kept_of(spark, texts) == set(plain_groups(texts)) == set(range(0, len(texts), 2))


def test_near_dedup_odd_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "a B"), (3, "a b"), (3, "c"), (3, "c"), (None, "d"), (None, "d")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, n string, rows string")
    got = sorted((str(r.doc_id), r.text.lower()) for r in neardup.drop_near_duplicates(docs).collect())
    assert got == [("3", "a b"), ("3", "c"), ("None", "d")]
    assert neardup.drop_near_duplicates(docs.limit(0)).collect() == []


def test_near_dedup_on_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    docs = spark.createDataFrame(rows)
    got = {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()}
    groups = plain_groups([r.text for r in rows])
    assert got == {rows[i].doc_id for i in set(groups)} and len(got) < len(rows)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], sf_dir)
        if i < 4:
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(out)
    first, toxic, lines, near, clean, ids = ([r for r in k.collect()] for k in kept)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r.doc_id for r in first if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in labels]
    stay = {r.doc_id for r in toxic}
    assert sum((i in stay) == (labels[i] == 0) for i in held) >= 0.9 * len(held)
    assert {r.doc_id for r in lines} == stay
    lines.sort(key=lambda r: r.doc_id)
    assert {r.doc_id for r in near} == {lines[i].doc_id for i in set(plain_groups([r.text for r in lines]))}
    items = [f" {' '.join(decontamination.words_of(r.text))} " for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in near if any(x in f" {' '.join(decontamination.words_of(r.text))} " for x in items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in near} - leaks
    library = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    assert {r.doc_id: r.ids for r in ids} == {r.doc_id: library.encode(r.text) for r in clean} and all(r.round_trip for r in ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in clean)


def test_stages_on_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []
