"""Decontamination against a plain search and planted passages."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lodeseam.llm import decontamination as d


def plain_scores(items, passage):
    """BM25 of each part of each item for a passage, over that part's own score."""
    parts = [(i, p) for i, t in items for p in d.parts_of(d.words_of(t))]
    df = Counter(w for _, p in parts for w in set(p))
    mean = sum(len(p) for _, p in parts) / len(parts)
    out = []
    for _, p in parts:
        c = Counter(p)
        s = {w: math.log(1 + (len(parts) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(p) / mean)) for w, n in c.items()}
        out.append(sum(x for w, x in s.items() if w in passage) / sum(s.values()))
    return out


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.6, 0.99])
def test_blocks_lose_no_entry(items, threshold):
    index, rng = d.BlockMaxIndex(items), random.Random(1)
    vocabulary = sorted(index.ids)
    for _ in range(50):
        passage = set(rng.sample(vocabulary, 60)) | set(d.words_of(rng.choice(items)[1]))
        got = dict(index.above(np.unique([index.ids[w] for w in passage]), threshold))
        want = {i: s for i, s in enumerate(plain_scores(items, passage)) if s >= threshold - 1e-9}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def test_query_finds_what_a_plain_search_of_word_runs_does(spark, sf_dir, items):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.contaminations(docs, bench).collect()}
    want = set()
    for r in docs.collect():
        line = f" {' '.join(d.words_of(r.text))} "
        want |= {(r.doc_id, i) for i, t in items if f" {' '.join(d.words_of(t))} " in line}
    assert want and got == want
    kept = {r.doc_id for r in d.drop_contaminated(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {i for i, _ in want}


def test_planted_passages_at_any_place(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n)) + ". " + word().title() + "?") for i, n in enumerate((3, 20, 63, 64, 65, 130, 400))]
    rows = []
    for i, t in items:
        for before in (0, 1, 63, 100, 127, 500):
            rows.append((1000 * i + before, " ".join(word() for _ in range(before)) + "\n" + t.upper().replace(" ", ",  ") + "\n" + word()))
    rows += [(-1, " ".join(word() for _ in range(3000))), (-2, None), (-3, ""), (None, items[1][1]), (-4, " ".join(items[5][1].split()[:40]))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (50, None), (None, "abcd"), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminations(docs, bench).collect()}
    assert got == {(i, i // 1000) for i, _ in rows if i is not None and i >= 0} | {(None, 1)}
    rows = sorted(map(str, d.contaminations(docs, bench).collect()))
    d.INDEX_ITEMS, held = 2, d.INDEX_ITEMS
    try:
        assert sorted(map(str, d.contaminations(docs, bench).collect())) == rows
        assert {r.doc_id for r in d.drop_contaminated(docs, bench).collect()} == {-1, -2, -3, -4}
    finally:
        d.INDEX_ITEMS = held
    assert d.contaminations(docs, bench.limit(0)).collect() == [] and d.contaminations(docs.limit(0), bench).collect() == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_words_in_order():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 80))] for _ in range(2))
        assert d.in_order(a, b) == pytest.approx(lcs(a, b) / len(a))


def test_query_against_a_full_scan_with_scores_and_overlaps(spark, sf_dir, items):
    """All passages times all entries, without index, blocks or cursors."""
    docs, rng = spark.read.parquet(f"{sf_dir}/documents.parquet"), random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(40).collect()]
    for n, (_, text) in enumerate(items[:30]):  # one word in each is another
        words = text.split(" ")
        words[rng.randrange(len(words) - 1)] = "qqq"
        rows.append((-1 - n, rows[n][1] + "\n" + " ".join(words) + "\n" + rows[n + 1][1]))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    parts = [(i, p) for i, t in items for p in d.parts_of(d.words_of(t))]
    weights = d.Statistics.of(t for _, t in items)
    impacts = [(i, weights.impacts(p)) for i, p in parts]
    want = {}
    for doc, text in rows:
        words, hits = d.words_of(text), {}
        for start in range(0, max(1, len(words) - 64), 64):
            passage = set(words[start : start + 128])
            for item, share in impacts:
                if (s := sum(x for w, x in share.items() if w in passage)) >= d.THRESHOLD - 1e-9:
                    hits.setdefault(item, []).append((start, s))
        texts = dict(items)
        for item, at in hits.items():
            question, answer = d.question_and_answer(texts[item])
            span, best = len(d.words_of(texts[item])), (0, 0)
            for start, _ in at:
                for a in range(max(0, start - span), start + 128, max(1, span // 8)):
                    near = words[a : a + span + span // 4 + 4]
                    best = max(best, (lcs(question, near) / len(question), lcs(answer, near) / len(answer)))
            if best[0] >= 0.8 and best[1] >= 0.5:
                want[doc, item] = (max(s for _, s in at), *best)
    found = d.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in found}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert sum(doc < 0 for doc, _ in got) >= 24
