"""SentencePiece against the library, toxicity against a plain search and held-out labels."""

import itertools
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseam.llm import pieces, toxicity
from lodeseam.llm.token_files import public_path

PATH = public_path("piece_bpe_32k.model")
MODEL = pieces.Pieces.load(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(text, model=MODEL):
    return np.frombuffer(model.encode(text), model.dtype).tolist()


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  \n\t.,'eéthanding▁<s>0Aß梦ﬁ"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_equal_the_library(text):
    ids = ids_of(text)
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == text.replace("▁", " ") == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 999 + "x", "the " * 3000, "\n\n \n  a", "aaaa bbbb  ", "<0x0A><s></s><unk>", "internationalisation" * 50])
def test_ids_of_long_runs_equal_the_library(text):
    assert ids_of(text) == LIBRARY.encode(text)


def test_lattice_equals_merging(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert ids_of(r.text) == LIBRARY.encode(r.text)


def test_invalid_bytes_decode_as_the_library_does():
    ids = [LIBRARY.piece_to_id(p) for p in ("▁a", "<0xE2>", "b", "<0xE6>", "<0xA2>", "<0xA6>", "<0xFF>", "</s>")]
    assert MODEL.decode(ids) == "a�b梦�"


def test_unigram_lattice_finds_the_best_sum():
    names = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "bb"]
    scores = [0.0, -3.0, -2.0, -2.5, -3.1, -3.9, -3.3, -5.0, -9.0]
    model = pieces.Pieces(names, scores, [2, *[1] * 8], pieces.UNIGRAM)
    for word in itertools.product("ab", repeat=7):
        text = "▁" + "".join(word)

        def splits(s):
            return [[]] if not s else [[p, *rest] for p in names[1:] if s.startswith(p) for rest in splits(s[len(p) :])]

        best = max(sum(scores[names.index(p)] for p in s) for s in splits(text))
        assert sum(scores[i] for i in ids_of("".join(word), model)) == pytest.approx(best)


def test_encode_and_decode_frames(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (2, "", "y"), (None, "Über\n x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = pieces.decode_pieces(pieces.encode_pieces(docs, PATH), PATH)
    assert sorted(str(r.text) for r in back.collect()) == sorted([str(t or "") for _, t, _ in rows])
    got = pieces.encode_and_check(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), LIBRARY.encode(t or "")) for i, t, _ in rows)
    assert all(r.round_trip and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert pieces.encode_and_check(docs.limit(0), PATH).collect() == []


@pytest.fixture(scope="module")
def fitted(spark):
    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    return docs, labels, toxicity.fit_examples(docs, labels)


def test_nearest_equals_a_full_scan(fitted):
    docs, _, index = fitted
    dense = np.zeros((len(index.idf), len(index.keys)))
    for t in range(len(index.idf)):
        here = slice(index.starts[t * index.blocks], index.starts[(t + 1) * index.blocks])
        dense[t, index.rows[here]] = index.values[here]
    for r in docs.limit(300).collect():
        ids, x = index.vector(index.vocabulary.counts(r.text))
        if len(ids):
            rows, near = index.nearest(ids, x, 16)
            every = x @ dense[ids]
            best = np.lexsort((np.arange(len(every)), -every))[:16]
            best = best[every[best] > 0]
            assert near == pytest.approx(every[best]) and every[rows] == pytest.approx(every[best])
            but = int(rows[0])
            assert but not in index.nearest(ids, x, 16, but)[0]


def test_scores_are_calibrated_on_held_out_rows(fitted):
    """Of ten bins of scores and in all: the mean score is near the share of label 1; better than uncalibrated votes."""
    docs, labels, index = fitted
    labels = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    rows = [r for r in docs.collect() if r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in rows], float)
    votes = [index.vector(index.vocabulary.counts(r.text)) for r in rows]
    raw = np.array([index.votes(*v)[0] if len(v[0]) else index.prior for v in votes])
    score = np.array([index.calibrated(s) for s in raw])
    loss = lambda p: -np.mean(y * np.log(np.clip(p, 1e-6, 1)) + (1 - y) * np.log(np.clip(1 - p, 1e-6, 1)))
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(score[bins == b].sum() - y[bins == b].sum()) for b in range(10)) / len(y)
    print("held out:", len(y), "brier", np.mean((score - y) ** 2), np.mean((raw - y) ** 2), "loss", loss(score), loss(raw), "ece", error, "line", index.line)
    assert error < 0.03 and loss(score) <= loss(raw) + 0.005 and np.mean((score - y) ** 2) < 0.02


def test_held_out_accuracy(fitted):
    docs, labels, index = fitted
    scored = {r.doc_id: r for r in toxicity.toxicity_scores(docs, index).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [scored[r.doc_id].predicted == r.toxic for r in held]
    assert len(held) > 500 and np.mean(right) > 0.985
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, index).collect()}
    assert kept == {i for i, r in scored.items() if not r.predicted}
    trained = set(index.keys)
    assert not [r for r in held if r.doc_id in trained]


def test_odd_rows_and_tables(spark, fitted):
    docs, labels, index = fitted
    odd = spark.createDataFrame([(1, None, 2), (1, "", 3), (None, "idiot scum", 4)], "doc_id long, text string, score int")
    got = {(r.doc_id, r.predicted) for r in toxicity.toxicity_scores(odd, index).collect()}
    assert (1, 0) in got and len(toxicity.drop_toxic(odd, index).columns) == 3
    assert toxicity.toxicity_scores(odd.limit(0), index).collect() == []
    named = lambda t: t.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    some = named(docs.limit(500))
    by_name = toxicity.fit_examples(some.union(some), named(labels))
    assert {type(k) for r in toxicity.toxicity_scores(some, by_name).collect() for k in r.evidence} <= {str}
    bare = toxicity.fit_examples(docs, labels.limit(0))
    assert {r.score for r in toxicity.toxicity_scores(odd, bare).collect()} == {0.0}
