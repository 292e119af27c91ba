"""Helpers shared by the text operators.

Conventions of every operator here:

* ``id_col`` and ``text_col`` name the input columns; all other columns are
  ignored, whatever they are called.
* A null text counts as the empty text. A null id is an id value of its own.
* Texts are UTF-8 bytes; words are ``[^\\x20\\x09-\\x0D]+``, which is what
  ``bytes.split()`` yields.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.session import table_path

#: Entries in each of the two generations of a worker's lookup of already handled words.
CACHE_ENTRIES = 300_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id`` long, ``text`` string and the named further columns; a null text becomes empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def fold(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo ``modulus`` (a null id: the text is empty)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def fold_col(id_col: str, modulus: int):
    """:func:`fold` as a column."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(step: Callable) -> Callable:
    """``step`` of a mapInArrow that gives its worker's free memory back when a task ends.

    Workers outlive tasks, and those of one stage idle beside those of the next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    col = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if b is None else b for b in col.cast(kind).to_pylist()]


class Memo(dict):
    """A lookup that fills itself with ``fn(key)``.

    At ``limit`` entries it becomes the older generation, whose entries come back
    when asked for, and a new one begins: at most twice ``limit`` are held.
    """

    def __init__(self, fn: Callable, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.fn, self.limit, self.older = fn, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        """Workers outlive tasks; what a task remembered should not."""
        self.older = {}
        self.clear()


# --- vectorised words of a run of bytes -------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, equal for equal bytes.

    Eight bytes are taken at a time, over the spans that are still that long.
    """
    with np.errstate(over="ignore"):
        out = (ends - starts).astype(np.uint64) * _BASE
        padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
        at, left, live = starts.copy(), ends - starts, np.arange(len(starts))
        while len(live):
            word = np.zeros(len(live), dtype=np.uint64)
            for k in range(8):
                byte = np.where(left > k, padded[at + np.minimum(k, left)], 0)
                word |= byte.astype(np.uint64) << np.uint64(8 * k)
            out[live] = mix64(out[live] * _BASE + mix64(word + np.uint64(1)))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return out
