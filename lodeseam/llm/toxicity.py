"""Toxicity: calibrated, distance-weighted votes of the nearest labelled examples by TF-IDF cosine."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import kept_rows, materialised, table, text_of

PER_CLASS = 2000  # labelled examples of each class in the index
NEIGHBOURS = 16
PREFIXES = (4, 5, 6)
EFFECT = 0.02  # least squared phi of a term and the label
SHARES = (0.0025, 0.005, 0.01, 0.02)
SHRINK = 0.05
BLOCK = 64
CACHED_WORDS = 500_000
START = np.array([1.0, 0.0])
_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)]


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def features_of(base: str) -> list[str]:
    """A word or beginning as such, and once more for each share of a text's words that it may reach."""
    return [base, *(f"{base}%{k}" for k in range(len(SHARES)))]


class Vocabulary:
    def __init__(self, terms: list[str]):
        self.terms = terms
        self.bases: dict[str, list[tuple[float, int]]] = {}
        for i, t in enumerate(terms):
            base, _, share = t.partition("%")
            self.bases.setdefault(base, []).append((SHARES[int(share)] if share else 0.0, i))
        self.cache: dict[str, list[str]] = {}

    def counts(self, text: str) -> Counter:
        """How often each term occurs; 1 for a share that is reached."""
        held, cache = Counter(), self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        words = _WORD.findall(text.lower())
        for word, n in Counter(words).items():
            bases = cache.get(word)
            if bases is None:
                bases = cache[word] = [b for b in terms_of(word) if b in self.bases]
            for b in bases:
                held[b] += n
        return Counter({i: 1 if share else n for b, n in held.items() for share, i in self.bases[b] if n >= share * len(words)})


class Examples:
    """Inverted index of unit vectors: postings by term, and the largest weight of each term in each block of examples."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, counts: list[Counter], labels: np.ndarray, keys: list, weights: np.ndarray, key_type: DataType):
        self.vocabulary, self.idf, self.key_type = vocabulary, idf, key_type
        vectors = [self.vector(c) for c in counts]
        # Examples with a leading term in common share blocks, so that block maxima are tight.
        first = [int(ids[np.argmax(x)]) if len(ids) else -1 for ids, x in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (first[i], i))
        self.vectors = [vectors[i] for i in order]
        self.labels, self.weights, self.keys = labels[order], weights[order], [keys[i] for i in order]
        n, self.blocks = len(order), -(-max(1, len(order)) // BLOCK)
        terms = np.concatenate([np.empty(0, "i8"), *(ids for ids, _ in self.vectors)])
        rows = np.repeat(np.arange(n), [len(ids) for ids, _ in self.vectors])
        values = np.concatenate([np.empty(0), *(x for _, x in self.vectors)])
        by_term = np.lexsort((rows, terms))
        self.rows, self.values, place = rows[by_term], values[by_term], (terms * self.blocks + rows // BLOCK)[by_term]
        #: First posting of each term in each block; the next one's is its end.
        self.starts = np.searchsorted(place, np.arange(len(idf) * self.blocks + 1))
        self.maxima = np.zeros(len(idf) * self.blocks)
        np.maximum.at(self.maxima, place, self.values)
        self.maxima = self.maxima.reshape(len(idf), self.blocks)
        bare = np.array([not len(ids) for ids, _ in self.vectors], bool)
        total = self.weights[bare].sum()
        #: Share of label 1 among examples without any of the terms, or else among all.
        of = bare if total else np.ones(n, bool)
        self.prior = float((self.weights * self.labels)[of].sum() / max(self.weights[of].sum(), 1e-9))
        self.line = self._fitted() if n and 0 < self.labels.mean() < 1 else None

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(sorted(counts), "i8")
        x = (1 + np.log(np.array([counts[i] for i in ids.tolist()], "f8"))) * self.idf[ids] if len(ids) else np.empty(0)
        norm = math.sqrt(float(x @ x))
        return ids, x / norm if norm else x

    def nearest(self, ids: np.ndarray, x: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k best examples (without the one called but) with a positive cosine, best first, ties by position.

        Blocks are read by falling bounds, a few at first; those that can't reach the k-th best aren't read.
        """
        bounds = x @ self.maxima[ids]
        order = np.argsort(-bounds, kind="stable")
        rows, best = np.empty(0, "i8"), np.empty(0)
        at, step = 0, 2
        while at < len(order):
            some = order[at : at + step]
            some = some[bounds[some] >= (best[-1] - 1e-9 if len(best) >= k else 1e-12)]
            if not len(some):
                break
            places = (ids[:, None] * self.blocks + some).ravel()
            starts = self.starts[places]
            n = self.starts[places + 1] - starts
            ends = np.cumsum(n)
            postings = np.repeat(starts - ends + n, n) + np.arange(ends[-1])
            sums = np.bincount(self.rows[postings], self.values[postings] * np.repeat(np.repeat(x, len(some)), n), len(self.keys))
            if but >= 0:
                sums[but] = 0
            found = np.flatnonzero(sums > 0)
            rows, best = np.concatenate((rows, found)), np.concatenate((best, sums[found]))
            keep = np.lexsort((rows, -best))[:k]
            rows, best = rows[keep], best[keep]
            at, step = at + step, 2 * step
        return rows, best

    def votes(self, ids: np.ndarray, x: np.ndarray, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of the neighbours' votes for label 1 (weighted by the squared cosine), the neighbours and their cosines."""
        rows, near = self.nearest(ids, x, NEIGHBOURS, but)
        votes = near**2 * self.weights[rows]
        share = (float((votes * self.labels[rows]).sum()) + SHRINK * self.prior) / (float(votes.sum()) + SHRINK)
        return min(1.0, max(0.0, share)), rows, near

    def _fitted(self) -> tuple[float, float]:
        """Slope and offset of the logistic line from the log-odds of votes to those of label 1.

        Fitted on each example's votes without itself, with smoothed targets and a slight pull to the
        votes as they are (START), by Newton's steps.
        """
        z = _log_odds(np.array([self.votes(ids, x, i)[0] if len(ids) else self.prior for i, (ids, x) in enumerate(self.vectors)]))
        w = self.weights * len(self.weights) / self.weights.sum()
        ones, zeros = float(w @ self.labels), float(w @ (1 - self.labels))
        target = np.where(self.labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        line, design = np.array([1.0, 0.0]), np.stack((z, np.ones(len(z))))
        far = lambda line: float(w @ (np.logaddexp(0, line @ design) - target * (line @ design))) + float((line - START) @ (line - START)) / 2
        for _ in range(50):
            p = np.exp(-np.logaddexp(0, -(line @ design)))
            step = np.linalg.solve((design * (w * p * (1 - p))) @ design.T + np.eye(2), design @ (w * (target - p)) - (line - START))
            while far(line + step) > far(line) and np.abs(step).max() > 1e-9:
                step = step / 2
            line = line + step
            if np.abs(step).max() < 1e-8:
                break
        return float(line[0]), float(line[1])

    def calibrated(self, share: float) -> float:
        """Probability of label 1 where the votes for it have that share; the share itself if no line could be fitted."""
        if self.line is None:
            return share
        x = self.line[0] * float(_log_odds(np.float64(share))) + self.line[1]
        return float(np.exp(-np.logaddexp(0, -x)))

    def score(self, text: str) -> tuple[float, list, list[float]]:
        """Score, and the evidence: keys and cosines of the nearest examples."""
        ids, x = self.vector(self.vocabulary.counts(text))
        if not len(ids):
            return self.calibrated(self.prior), [], []
        share, rows, near = self.votes(ids, x)
        return self.calibrated(share), [self.keys[i] for i in rows.tolist()], np.round(near, 6).tolist()


def _log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def select_terms(texts: list[str], labels: np.ndarray) -> list[str]:
    """Terms whose presence goes with the label: squared phi of EFFECT at least."""
    have = [Counter(), Counter()]
    for text, y in zip(texts, labels.tolist(), strict=True):
        words, held = _WORD.findall(text.lower()), Counter()
        for word, n in Counter(words).items():
            for base in terms_of(word):
                held[base] += n
        for base, n in held.items():
            have[y].update(f for f, s in zip(features_of(base), (0, *SHARES), strict=True) if n >= s * len(words))
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    out = []
    for t in set(have[0]) | set(have[1]):
        a, b = have[1][t], have[0][t]
        below = (a + b) * (n0 + n1 - a - b) * n1 * n0
        if below and (a * (n0 - b) - b * (n1 - a)) ** 2 >= EFFECT * below:
            out.append(t)
    return sorted(out)


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all docs each term occurs, and the number of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, n = Vocabulary(terms), np.zeros(len(terms), "i8"), 0
        for batch in batches:
            for text in batch.column("text"):
                n += 1
                df[list(vocabulary.counts(text.as_py()))] += 1
        yield pa.RecordBatch.from_pydict({"term": np.arange(-1, len(terms)), "n": np.concatenate(([n], df))})

    sums = docs.select(text_of().alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in sums.collect()}
    return np.array([found.get(i, 0) for i in range(len(terms))], "f8"), found.get(-1, 0)


def fit_examples(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Examples:
    """Examples of docs(doc_id, text) with labels(doc_id, toxic), none of them held out.

    Of each class the per_class rows with the smallest hash of their doc_id: the bounded sample
    of labelled rows that the classifier is fitted on. Classes count as often as they occur among all
    labelled rows that aren't held out. Document frequencies of the terms are those of all docs.
    Rows with a null doc_id or label are left out; of several labels of a doc_id the largest holds.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(remainder(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = materialised(known, "labelled")
    sizes = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [r for y in (0, 1) for r in known.where(F.col("__toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    taken = docs.sparkSession.createDataFrame(chosen, known.schema)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(taken), "doc_id")
    # One text of each doc_id, so that repeated rows add nothing to what is fetched.
    rows = sorted(texts.groupBy("doc_id", "__toxic").agg(F.max("text").alias("text")).collect(), key=lambda r: r["doc_id"])
    texts, y = [r["text"] for r in rows], np.array([r["__toxic"] for r in rows], "i8")
    used = Counter(y.tolist())
    weights = np.array([sizes[v] / used[v] for v in y.tolist()])
    terms = select_terms(texts, y)
    df, n = document_frequencies(docs, terms)
    vocabulary = Vocabulary(terms)
    idf = np.log(1 + (n + 1) / (df + 1))
    examples = Examples(vocabulary, idf, [vocabulary.counts(t) for t in texts], y, [r["doc_id"] for r in rows], weights, known.schema["doc_id"].dataType)
    vocabulary.cache.clear()
    examples.vectors = []
    return examples


def toxicity_scores(docs: DataFrame, examples: Examples) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, score, predicted, evidence, cosines.

    evidence: doc_ids of the nearest labelled examples, with their cosines, best first. A null or
    empty text, or one without any of the terms, has no neighbours; its score is the share of label 1
    among such examples, calibrated. Ties go by the order of the index. Repeated rows score alike; other columns aren't
    read. The index is broadcast: PER_CLASS bounds its examples, and EFFECT the terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(examples)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = pa.list_(to_arrow_type(examples.key_type))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [index.score(t.as_py()) for t in batch.column("text")]
            s = [f[0] for f in found]
            columns = [batch.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]
            columns += [pa.array([f[1] for f in found], keys), pa.array([f[2] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "evidence", "cosines"])

    schema = f"doc_id {kind}, score double, predicted int, evidence array<{examples.key_type.simpleString()}>, cosines array<double>"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, examples: Examples) -> DataFrame:
    """docs without the rows whose text is predicted toxic; all columns stay. Rules as toxicity_scores()."""
    shared = docs.sparkSession.sparkContext.broadcast(examples)

    return kept_rows(docs, lambda text: shared.value.score(text)[0] < 0.5)


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    examples = fit_examples(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_scores(docs, examples)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "evidence")
