"""Benchmark decontamination: a BM25 index of test items, asked about every passage of every document."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, table, text_of

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of an entry's own score
PART_WORDS = 64
PASSAGE_WORDS = 2 * PART_WORDS
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.8, 0.5
BLOCK = 4
INDEX_ITEMS = 5000  # items in one broadcast index; more items take more passes
INDEX_CHARS = 20_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"\n|(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last line or sentence of an item, and those of it; both all words if there is one only."""
    cuts = [c for c in (list(words_of(p)) for p in _SENTENCE.split(text)) if c]
    if len(cuts) < 2:
        every = words_of(text)
        return every, every
    return [w for c in cuts[:-1] for w in c], cuts[-1]


def in_order(wanted: list[str], text: list[str]) -> float:
    """Share of the wanted words that stand in the text in that order: their longest common subsequence."""
    places: dict[str, int] = {}
    for i, w in enumerate(wanted):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(wanted)) - 1
    free = full  # bit-parallel: a bit is cleared for each word of the subsequence
    for w in text:
        if w in places:
            hit = free & places[w]
            free = (free + hit | free - hit) & full
    return 1 - free.bit_count() / len(wanted)


def parts_of(words: list[str]) -> list[list[str]]:
    """Even parts of PART_WORDS at most, each of which some passage holds whole."""
    n = -(-len(words) // PART_WORDS)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


class Statistics:
    """Over all parts of all items: how many there are, their mean length, and in how many each word is."""

    def __init__(self, counts: dict[str, int], parts: int, words: int):
        self.counts, self.parts, self.mean = counts, parts, words / max(1, parts)

    @classmethod
    def of(cls, texts: Iterable[str]) -> Statistics:
        parts = [p for t in texts for p in parts_of(words_of(t))]
        return cls(Counter(w for p in parts for w in set(p)), len(parts), sum(map(len, parts)))

    def impacts(self, part: list[str]) -> dict[str, float]:
        """BM25 weights of the words of a part, as shares of the part's own score."""
        length = K1 * (1 - B + B * len(part) / self.mean)
        out = {}
        for w, n in Counter(part).items():
            df = self.counts[w]
            out[w] = math.log(1 + (self.parts - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + length)
        total = sum(out.values())
        return {w: x / total for w, x in out.items()}


class BlockMaxIndex:
    """Postings of words (entry and impact) in order of entry, with the largest impact in each block of entries.

    An entry is a part of an item. The weights come from the statistics of all items, so that a
    benchmark in several indexes scores as one in a single index does.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        statistics = statistics or Statistics.of(t for _, t in items)
        entries = [(item, part) for item, text in items for part in parts_of(words_of(text))]
        self.items = [i for i, _ in entries]
        self.checks = {item: question_and_answer(text) for item, text in items}
        self.spans = {item: len(words_of(text)) for item, text in items}
        self.ids: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for row, (_, part) in enumerate(entries):
            for w, x in statistics.impacts(part).items():
                if self.ids.setdefault(w, len(self.ids)) == len(postings):
                    postings.append([])
                postings[self.ids[w]].append((row, x))
        self.entries, self.blocks = len(entries), -(-len(entries) // BLOCK)
        #: All postings, word by word, and the runs of them in one block: block, maximum and first posting of each
        self.rows, self.values = ([p[k] for of in postings for p in of] for k in (0, 1))
        terms = np.repeat(np.arange(len(postings)), [len(of) for of in postings])
        block = np.array(self.rows, "i8") // BLOCK
        first = np.flatnonzero(np.diff(terms * (self.blocks + 1) + block, prepend=-1))
        self.run_block, self.run_max = block[first], np.maximum.reduceat(self.values, first) if len(first) else np.empty(0)
        self.run_start = [*first.tolist(), len(self.rows)]
        self.starts = np.searchsorted(terms[first], np.arange(len(postings) + 1))

    def above(self, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
        """Entries that a passage of these distinct words scores at the threshold or more.

        Sums of block maxima leave out the blocks that cannot reach it; the others are searched by wand().
        """
        starts = self.starts[terms]
        n = self.starts[terms + 1] - starts
        ends = np.cumsum(n)
        runs = np.repeat(starts - ends + n, n) + np.arange(ends[-1])
        blocks = self.run_block[runs]
        bounds = np.bincount(blocks, self.run_max[runs], self.blocks)
        for b in np.flatnonzero(bounds >= threshold - 1e-9).tolist():
            yield from self.wand(runs[blocks == b].tolist(), threshold)

    def wand(self, runs: list[int], threshold: float) -> Iterator[tuple[int, float]]:
        """Entries of one block at the threshold or more, by cursors over the runs of the passage's words in it.

        Cursors are kept in order of their entries. The first at which the maxima so far reach
        the threshold is the pivot: no entry before it can. Cursors behind skip to the pivot, and only when
        all of them stand there is the entry scored.
        """
        rows, values, start = self.rows, self.values, self.run_start
        cursors = [[rows[start[r]], start[r], start[r + 1], float(self.run_max[r])] for r in runs]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for c in cursors:
                bound += c[3]
                if bound >= threshold - 1e-9:
                    pivot = c[0]
                    break
            if pivot < 0:
                return
            after = pivot
            if cursors[0][0] == pivot:
                score = sum(values[c[1]] for c in cursors if c[0] == pivot)
                if score >= threshold - 1e-9:
                    yield pivot, score
                after += 1
            for c in cursors:
                if c[0] < after:
                    c[1] = bisect_left(rows, after, c[1], c[2])
                    c[0] = rows[c[1]] if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]

    def search(self, text: str) -> list[tuple[int, float, float, float]]:
        """item, best score, overlap of question and answer: the verified items of a text, in order of item.

        Passages of PASSAGE_WORDS begin at every PART_WORDS words.
        """
        words = words_of(text)
        if not words or not self.entries:
            return []
        ids = np.fromiter(map(self.ids.get, words, [-1] * len(words)), "i4", len(words))
        known = np.flatnonzero(ids >= 0)
        # No passage scores more than the whole text does.
        if not len(known) or not any(True for _ in self.above(_distinct(ids[known]), THRESHOLD)):
            return []
        hits: dict[int, list[tuple[int, float]]] = {}
        for start in range(0, max(1, len(words) - PART_WORDS), PART_WORDS):
            lo, hi = np.searchsorted(known, (start, start + PASSAGE_WORDS))
            if hi > lo:
                for entry, score in self.above(_distinct(ids[known[lo:hi]]), THRESHOLD):
                    hits.setdefault(self.items[entry], []).append((start, score))
        out = []
        for item, at in sorted(hits.items()):
            question, answer = max(self._overlaps(item, words, start) for start, _ in at)
            if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP:
                out.append((item, max(s for _, s in at), question, answer))
        return out

    def _overlaps(self, item, words: list[str], start: int) -> tuple[float, float]:
        """Of question and answer of an item, where they overlap most with the words around a passage."""
        span, (question, answer) = self.spans[item], self.checks[item]
        best, reach = (0.0, 0.0), span + span // 4 + 4
        for at in range(max(0, start - span), start + PASSAGE_WORDS, max(1, span // 8)):
            near = words[at : at + reach]
            best = max(best, (in_order(question, near), in_order(answer, near)))
        return best


def _distinct(ids: np.ndarray) -> np.ndarray:
    """np.unique without its overhead, for a few ids at a time."""
    ids = np.sort(ids)
    return ids[np.concatenate(([True], ids[1:] != ids[:-1]))]


def _statistics(items: DataFrame) -> Statistics:
    """Counted in one pass; to the driver come the distinct words of the benchmark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = Statistics.of(t.as_py() for t in batch.column("text"))
            # Words never are empty or blank: these two names are free for the sums.
            sums = one.counts | {"": one.parts, " ": round(one.mean * one.parts)}
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

    found = {r["word"]: r["n"] for r in items.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return Statistics(found, found.pop("", 0), found.pop(" ", 0))


def _indexes(benchmark: DataFrame) -> Iterator[BlockMaxIndex]:
    """Indexes of bounded size that cover all items, fetched one after another; none for no item."""
    items: list[tuple[int, str]] = []
    chars = 0
    rows = benchmark.select("item_id", text_of().alias("text")).where("item_id IS NOT NULL").distinct()
    statistics = _statistics(rows)
    seen: set[int] = set()
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        if items and (len(items) >= INDEX_ITEMS or chars > INDEX_CHARS or item in seen):
            yield BlockMaxIndex(items, statistics)
            items, chars, seen = [], 0, set()
        items.append((item, text))
        seen.add(item)
        chars += len(text)
    yield BlockMaxIndex(items, statistics)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: items of benchmark(item_id, text) in docs(doc_id, text).

    Every passage of every text is asked about: all entries whose BM25 score is THRESHOLD of their own score or more
    are retrieved by block-max WAND, and an item counts if so many of the words of its question (QUESTION_OVERLAP)
    and of its answer (ANSWER_OVERLAP) stand nearby in their order. Case and
    punctuation don't matter. Null and empty texts, and items without words, match nothing; items with a null id are left
    out; repeated rows are answered one by one; other columns aren't read. Documents aren't
    shuffled. An index holds INDEX_ITEMS items at most and is broadcast; a larger benchmark takes
    several passes, with the same rows: weights come from the statistics of all items.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    texts, out = docs.select("doc_id", text_of().alias("text")), None
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [(i, hit) for i, t in enumerate(batch.column("text")) for hit in index.search(t.as_py())]
                if found:
                    columns = [batch.column("doc_id").take(pa.array([i for i, _ in found]))]
                    columns += [pa.array([hit[k] for _, hit in found]) for k in range(4)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = texts.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay. Rules as contaminations()."""
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = kept_rows(docs, lambda text, shared=shared: not shared.value.search(text))
    return docs


def op4_decontamination(spark, sf_dir):
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
