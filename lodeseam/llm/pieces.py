"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of
from .token_files import public_path

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
NONE = float("-inf")
CACHED_CHUNKS = 400_000
CACHED_PAIRS = 400_000
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Pieces(dict):
    """Encoder and decoder of one model; as a dict it holds the ids of chunks that recur.

    An automaton over the pieces reads a chunk once. At each position its output links name the pieces that
    end there, and the best score of the position is relaxed with each: the score at the piece's start plus that of the piece.

    For a unigram model that is all. For a BPE model a step is only allowed if the piece before and this one,
    joined, are split in the same place again by the merges. The allowed path is unique and is what the merges lead
    to: merges within final pieces never cross their ends, so each two neighbours of the merged text are split
    alike on their own; and where all neighbours are, the first merge over an end would, by the same order of
    scores, have been made between these two alone. So the relaxation has one candidate a position, and its score is the
    sum of the merged pieces' scores. Equal scores, where "leftmost first" reaches beyond two neighbours, are only those of
    runs of spaces; merged() does these. Characters outside the vocabulary become bytes and end the lattice.
    """

    def __init__(self, pieces: list[str], scores: list[float], types: list[int], kind: int, dummy_prefix: bool = True):
        super().__init__()
        self.kind, self.dummy_prefix, self.scores, self.pieces = kind, dummy_prefix, scores, pieces
        self.ids = {p: i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t in (NORMAL, USER, UNUSED)}
        self.unknown = types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == BYTE}
        self.known = {c for p in self.ids for c in p}
        if not self.known <= self.ids.keys() or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces must be made of characters that are pieces, with spaces only in front")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        texts = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.texts = [texts.get(i, b"" if t == CONTROL else " ⁇ ".encode()) for i, t in enumerate(types)]
        self.pairs: dict[int, bool] = {}
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is are supported")
        rows = model.pieces
        return cls([p.piece for p in rows], [p.score for p in rows], [p.type for p in rows], model.trainer_spec.model_type, rules.add_dummy_prefix)

    def merged(self, text: str) -> list[int]:
        """Ids by merging the best-scored neighbours, leftmost first: the definition of BPE."""
        left, right, part = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1)), list(text)
        heap: list[tuple[float, int, str, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(text) and (i := self.ids.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, part[a] + part[b], b))

        for a in range(len(text) - 1):
            offer(a, a + 1)
        while heap:
            _, a, both, b = heapq.heappop(heap)
            if not part[a] or not part[b] or right[a] != b or part[a] + part[b] != both:
                continue
            part[a], part[b], right[a] = both, "", right[b]
            if right[b] < len(text):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.ids[p] for p in part if p]

    def fits(self, a: int, b: int) -> bool:
        found = self.pairs.get(a << 24 | b)
        if found is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[a << 24 | b] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return found

    def best_path(self, text: str) -> list[int]:
        """Ids of a text of known characters: one pass that relaxes the best score of each position."""
        best, last, lengths = [0.0] + [NONE] * len(text), [-1] * (len(text) + 1), [0] * (len(text) + 1)
        bpe, scores, pairs, fits = self.kind == BPE, self.scores, self.pairs, self.fits
        for end, (length, i) in self.automaton.iter(text):
            end += 1
            start = end - length
            total = best[start] + scores[i]
            if total > best[end]:
                if bpe and start and not (pairs.get(last[start] << 24 | i) or fits(last[start], i)):
                    continue
                best[end], last[end], lengths[end] = total, i, length
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= lengths[at]
        return out[::-1]

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        start = 0
        for at, c in enumerate([*chunk, ""]):
            if c not in self.known:
                if start < at:
                    part = chunk[start:at]
                    # Runs of spaces share one score, so that what lies left decides; neighbours alone don't.
                    ids += self.merged(part) if self.kind == BPE and SPACE * 2 in part else self.best_path(part)
                start = at + 1
                if c:
                    ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
        out = np.array(ids, self.dtype).tobytes()
        if len(chunk) < 100:
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED_CHUNKS:
            self.clear()
        if not text:
            return b""
        front = SPACE if self.dummy_prefix else ""
        if "  " in text or SPACE in text or text[0] == " ":
            chunks = _CHUNK.findall(front + text.replace(" ", SPACE))
        else:
            chunks = (front + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")
        return b"".join(map(self.__getitem__, chunks))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=1)
def shared_pieces(path: str) -> Pieces:
    """One model for all tasks of a worker process, so that they share the chunks met so far."""
    return Pieces.load(path)


def _lists(parts: list[bytes], dtype: np.dtype) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // dtype.itemsize for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(np.frombuffer(b"".join(parts), dtype).astype("i4")))


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with the column ids (array of int; replaces one of that name) of each text.

    A null or empty text has no ids. All rows and other columns stay as they are, repeated rows too; an
    empty table stays empty. No shuffle; time is linear in the length of a text.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared_pieces(model_path)
        for part in texts:
            yield pd.Series([np.frombuffer(model.encode(t), model.dtype).astype("i4") for t in part], dtype=object)

    return docs.withColumn("ids", ids(text_of()))


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with the column text (replaces one of that name) that its ids stand for; null ids give a null text."""

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared_pieces(model_path)
        for part in ids:
            yield pd.Series([None if x is None else model.decode(x.tolist()) for x in part], dtype=object)

    return encoded.withColumn("text", text(F.col("ids")))


def encode_and_check(docs: DataFrame, model_path: str) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_pieces, ids, ids_crc32, decoded_sha256, round_trip.

    The ids are decoded again in the same pass. A null text counts as empty; other columns aren't read.
    round_trip is false only for texts with the space mark itself, which decodes as a space.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_pieces(model_path)
        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.slice(i, 500)
                texts = some.column("text").to_pylist()
                parts = [model.encode(t) for t in texts]
                ids = [np.frombuffer(p, model.dtype) for p in parts]
                decoded = [model.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": some.column("doc_id"),
                        "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                        "ids": _lists(parts, model.dtype),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                        "round_trip": pa.array([d == t for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                    }
                )

    schema = f"doc_id {kind}, n_pieces long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir):
    return encode_and_check(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))
