"""Operator 9: token ids in binary files, one shared zstandard dictionary.

A dictionary is trained on the serialised ids of a bounded sample of documents
(``SAMPLE_DOCUMENTS``, ``SAMPLE_IDS`` each). Every document's ids are compressed
on their own with it, so one document is read without its neighbours. Files
("shards") hold documents in ascending id order:

    b"TIDZ", u32 version, u32 bytes per id, 32 bytes sha256 of the dictionary,
    the frames, then for each document  u8 has an id, i64 id, u64 offset, u64 n ids
    (columns one after another), u64 documents, u64 offset of that index, b"ZDIT"

The dictionary lies beside them as ``dictionary``; ``manifest`` (Parquet) has one
row per shard. A shard is written under a temporary name and moved into place, so a
repeated task attempt leaves a whole file.

Defined cases: a null or empty text has only the end id; null ids sort first;
repeated rows are each written, in an order fixed by id and frame; an empty table
writes no shard and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanscope.session import checkpoint_dir, materialize

from .chunks import ChunkWords
from .common import Memo, byte_texts, id_and_text, pieces

MAGIC, MAGIC_END, VERSION = b"TIDZ", b"ZDIT", 1
HEAD = len(MAGIC) + 8 + 32
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 64 << 10
SHARD_BYTES = 64 << 20
LEVEL = 3


class ChunkEncoder:
    """The tokenizers library's ids of white-space separated chunks; its model sees each distinct word once."""

    def __init__(self, path: str):
        self.split = ChunkWords(path)
        size = self.split.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._pack = {n: struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}").pack for n in range(64)}
        self._model = self.split.lib.model.tokenize
        self.words = Memo(self._word)
        self.chunks = Memo(self._chunk)

    def _word(self, word: str) -> bytes:
        ids = [self.split.added[word]] if word in self.split.added else [t.id for t in self._model(word)]
        return self._pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, self.dtype).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        words = self.split.words(chunk.decode())
        return self.words[words[0]] if len(words) == 1 else b"".join([self.words[w] for w in words])

    def encode(self, text: bytes, end: bytes) -> bytes:
        get = self.chunks.__getitem__
        return b"".join(map(get, text.split())) + end


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; with too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _sample(docs: DataFrame, tokenizer_path: str, end_id: int) -> list[bytes]:
    share = SAMPLE_DOCUMENTS * 2 / max(1, docs.count())
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)) + 1)

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([enc.encode(t, end)[:SAMPLE_IDS * enc.dtype.itemsize] for t in byte_texts(batch)], pa.binary())],
                names=["doc_id", "ids"])

    rows = picked.mapInArrow(serialise, "doc_id long, ids binary").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).collect()
    return [bytes(r.ids) for r in rows]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_tokens(df: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, compress and write all documents under ``folder``; returns the manifest."""
    spark = df.sparkSession
    docs = id_and_text(df, id_col, text_col)
    raw = train_dictionary(_sample(docs, tokenizer_path, end_id))
    digest = sha256(raw).digest()
    fs, base = _file(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary") as out:
        out.write(raw)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_dict_id=False).compress
        for batch in pieces(batches):
            ids = [enc.encode(t, end) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()),
                 pa.array([squeeze(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "frame"])
        enc.chunks.forget()  # the words, at most two generations of them, serve the worker's next task

    frames = materialize(docs.mapInArrow(compress, "doc_id long, n_tokens long, frame binary"), "token-frames")
    total = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    width = encoder(tokenizer_path).dtype.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, counts, sizes = [], [], []
        out = None
        for batch in batches:
            if batch.num_rows and out is None:
                fs, base = _file(folder)
                name = f"shard-{part:06d}-{uuid.uuid4().hex[:12]}"  # of this attempt; the manifest names the one that counts
                out = fs.open_output_stream(f"{base}/{name}")
                out.write(MAGIC + np.array([VERSION, width], "<u4").tobytes() + digest)
            for frame in batch.column("frame").to_pylist():
                out.write(frame)
                sizes.append(len(frame))
            ids += batch.column("doc_id").to_pylist()
            counts += batch.column("n_tokens").to_pylist()
        if out is None:
            return
        offsets = HEAD + np.concatenate(([0], np.cumsum(sizes)))
        out.write(b"".join([
            np.array([i is not None for i in ids], "u1").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(),
            offsets[:-1].astype("<u8").tobytes(), np.array(counts, "<u8").tobytes(),
            np.array([len(ids), offsets[-1]], "<u8").tobytes(), MAGIC_END]))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, name, len(ids), sum(counts), int(offsets[-1]))],
                                         names=["part", "shard", "n_docs", "n_tokens", "n_bytes"])

    order = F.col("doc_id").asc_nulls_first()
    manifest = (frames.repartitionByRange(max(1, -(-total // SHARD_BYTES)), order).sortWithinPartitions(order, "frame")
                .mapInArrow(write, "part long, shard string, n_docs long, n_tokens long, n_bytes long"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class Shard:
    """Reads one shard; only the index is loaded, frames are fetched as asked for."""

    def __init__(self, folder: str, name: str):
        fs, base = _file(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        head = self.file.read_at(HEAD, 0)
        raw = _read_dictionary(folder, head[12:])
        n, at = np.frombuffer(self.file.read_at(20, self.file.size() - 20)[:16], "<u8").tolist()
        if head[:4] != MAGIC or head[12:] != sha256(raw).digest():
            raise ValueError(f"{name}: not a shard of this dictionary")
        self.dtype = np.dtype(f"<u{int(np.frombuffer(head[8:12], '<u4')[0])}")
        index, self.n = self.file.read_at(25 * n, at), n
        has = np.frombuffer(index[:n], "u1")
        self.ids = [i if h else None for h, i in zip(has, np.frombuffer(index[n:9 * n], "<i8").tolist())]
        self.offsets = np.append(np.frombuffer(index[9 * n:17 * n], "<u8"), np.uint64(at)).astype(np.int64)
        self.counts = np.frombuffer(index[17 * n:], "<u8").astype(np.int64)
        self._inflate = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress

    def tokens(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.frombuffer(self._inflate(self.file.read_at(b - a, a)), self.dtype)

    def find(self, doc_id: int | None) -> np.ndarray | None:
        return self.tokens(self.ids.index(doc_id)) if doc_id in self.ids else None


_dictionaries = Memo(lambda key: b"", 16)


def _read_dictionary(folder: str, digest: bytes) -> bytes:
    """The folder's dictionary; one that a worker remembers counts only with the digest asked for."""
    if (folder, digest) not in _dictionaries:
        fs, base = _file(folder)
        with fs.open_input_file(f"{base}/dictionary") as f:
            _dictionaries[folder, digest] = f.read()
    return _dictionaries[folder, digest]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards: ``doc_id, start, n_tokens, ids_crc32``; start counts the ids before it."""
    shards = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(folder, name)
                sums = [zlib.crc32(shard.tokens(k).astype("<u4").tobytes()) for k in range(shard.n)]
                starts = base + np.concatenate(([0], np.cumsum(shard.counts)[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(shard.counts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    return based.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex[:12]}"
