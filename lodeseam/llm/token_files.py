"""Token ids in Arrow files of fixed-size lists."""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, new_path, table, text_of

SEQUENCE = 1024
SEQUENCES_PER_BATCH = 512
CACHED_WORDS = 1_000_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Ids of texts as bytes, put together from the ids of their words.

    For tokenizers whose pieces never span white space: the ids of a text are those of its parts
    between spaces. The ids of up to CACHED_WORDS parts are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def __missing__(self, part: str) -> bytes:
        # Between a letter and a full stop or comma words always end.
        if len(part) > 1 and part[-1] in ".," and part[-2].isalpha() and part[-2] < "ɐ":
            ids = self[part[:-1]] + self[part[-1]]
        else:
            ids = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(part) < 100:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        if "<|" not in text:  # where a special token may be, case counts
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        parts = text.replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, parts))


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process, so that they share the words met so far."""
    return WordEncoder(path)


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (pyarrow.fs.LocalFileSystem(), uri)


class SequenceWriter:
    """An Arrow file with batches of ids and mask, both fixed-size lists; the last list is padded."""

    def __init__(self, uri: str, dtype: np.dtype, sequence: int):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.dtype, self.sequence, self.size = dtype, sequence, SEQUENCES_PER_BATCH * sequence * dtype.itemsize
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.fs.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.held_bytes, self.tokens = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.tokens += len(ids) // self.dtype.itemsize
        if self.held_bytes >= self.size:
            self.flush()

    def flush(self, last: bool = False) -> None:
        data = b"".join(self.held)
        whole = len(data) // self.size * self.size
        parts = [data[i : i + self.size] for i in range(0, whole, self.size)]
        rest = data[whole:]
        if last and rest:
            parts.append(rest)
            rest = b""
        self.held, self.held_bytes = [rest] if rest else [], len(rest)
        for part in parts:
            ids = np.frombuffer(part, self.dtype)
            padding = -len(ids) % self.sequence
            mask = np.ones(len(ids) + padding, bool)
            mask[len(ids) :] = False
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.pad(x, (0, n))), self.sequence) for x, n in ((ids, padding), (mask, 0))]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self.flush(last=True)
        self.file.close()
        self.sink.close()


class SequenceReader:
    """Ids of an Arrow file of SequenceWriter by position; a local file is mapped, not copied."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.at, self.ids = -1, np.empty(0)

    def read(self, start: int, n: int) -> np.ndarray:
        per, parts = SEQUENCES_PER_BATCH * self.sequence, []
        while n > 0:
            if start // per != self.at:
                self.at = start // per
                self.ids = self.file.get_batch(self.at).column("ids").flatten().to_numpy()
            part = self.ids[start % per : start % per + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, "u4")

    def masks(self) -> Iterator[np.ndarray]:
        for i in range(self.file.num_record_batches):
            yield self.file.get_batch(i).column("mask").flatten().to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the ids of docs(doc_id, text) to Arrow files under folder; returns what each holds.

    Columns: file, path, tokens, doc_ids, lengths. Files follow the order of doc_id (sampled range partitions,
    sorted within; equal ids stay in one file, in the order of their texts). end_id ends each document. A null
    text is empty; a null doc_id comes first; an empty table writes no file; other columns aren't read.
    Each attempt at a task writes files of its own name, and the returned table, written
    once, names those that count, so a lost executor costs its tasks only. Ids take two bytes
    each if the vocabulary has at most 65,536.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, doc_ids, lengths = shared_encoder(tokenizer_path), None, [], []
        part = TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for text in batch.column("text"):
                out = out or SequenceWriter(path, encoder.dtype, sequence)
                ids = encoder.encode(text.as_py()) + end
                out.add(ids)
                lengths.append(len(ids) // encoder.dtype.itemsize)
            doc_ids.append(batch.column("doc_id"))
        if out:
            out.close()
            ids = pa.concat_arrays(doc_ids)
            # Rows of bounded size: a file with very many documents takes several.
            for i in range(0, len(lengths), 50_000):
                n = lengths[i : i + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([part], pa.int32()),
                        "path": [path],
                        "before": pa.array([sum(lengths[:i])], pa.int64()),
                        "tokens": pa.array([sum(n)], pa.int64()),
                        "doc_ids": pa.array([ids[i : i + 50_000].to_pylist()], pa.list_(ids.type)),
                        "lengths": pa.array([n], pa.list_(pa.int64())),
                    }
                )

    rows = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = f"file int, path string, before long, tokens long, doc_ids array<{kind}>, lengths array<long>"
    return materialised(rows.mapInArrow(write, schema), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Of each document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    To the driver come only the file's numbers and sums, two longs a file.
    """
    sums, before = [], 0
    for file, tokens in sorted(tuple(r) for r in manifest.groupBy("file").agg(F.sum("tokens")).collect()):
        sums.append((file, before))
        before += tokens
    starts = manifest.sparkSession.createDataFrame(sums, "file int, files_before long")
    kind = manifest.schema["doc_ids"].dataType.elementType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                reader, at, rows = SequenceReader(r.path), r.before, []
                for n in r.lengths:
                    rows.append((r.files_before + at, n, zlib.crc32(reader.read(at, n).astype("<u4").tobytes())))
                    at += n
                out = pd.DataFrame(rows, columns=["start", "n_tokens", "ids_crc32"])
                out.insert(0, "doc_id", pd.Series(list(r.doc_ids), dtype=object))
                yield out

    rows = manifest.join(F.broadcast(starts), "file").repartition(max(1, len(sums)), "file")
    return rows.mapInPandas(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = public_path("word_bpe_49k.json")
    return read_token_files(write_token_files(docs, path, 2, new_path(spark, "tokens")))
