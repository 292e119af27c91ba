"""Operator 10: substring dedup by line or paragraph hashing.

A unit is a line (``\\n``) or a paragraph (``\\n\\n``). It is normalised (A-Z lowered,
white space runs to one space, ends trimmed) and hashed to 128 bits. Digests are
grouped over all documents; the occurrence of the smallest (doc_id, offset) stays and
the others are removed, with their byte offsets in the original text kept. A unit has at
least ``MIN_WORDS`` words (one: blank lines are no units and stay).

Digests are counted with a partial aggregate before the shuffle, and the repeated ones are
written once. Those that hold more than ``1 / HOT_PARTS`` of all repeated units are fewer than
``HOT_PARTS``, so they are broadcast and their units stay where they are; all other repeated
digests meet their units in a shuffle join.

Defined cases: a null or empty text has no unit; null ids rank before all others;
rows that repeat id and text are one document and come back repeated, each with the
same result; equal ids with different texts are different documents, ranked by text
hash; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.session import materialize

from .common import byte_texts, id_and_text

MIN_WORDS = 1
#: A digest with a larger share of the repeated units than one in so many is hot.
HOT_PARTS = 4096
SEPARATORS = {"line": b"\n", "paragraph": b"\n\n"}
#: Stands for a null id where ids are compared and joined.
NULL_ID = -(1 << 63)


def normalised(unit: bytes) -> tuple[bytes, int]:
    words = unit.lower().split()
    return b" ".join(words), len(words)


def units_of(text: bytes, separator: bytes, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, length and digest of each unit of enough words."""
    at = 0
    for unit in text.split(separator):
        plain, words = normalised(unit)
        if words >= min_words:
            yield at, len(unit), blake2b(plain, digest_size=16).digest()
        at += len(unit) + len(separator)


def without(text: bytes, separator: bytes, starts: set[int]) -> bytes:
    """The text less the units that begin at ``starts``, each with one separator."""
    kept, at = [], 0
    for unit in text.split(separator):
        if at not in starts:
            kept.append(unit)
        at += len(unit) + len(separator)
    return separator.join(kept)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, k, h, text``: k and h tell documents apart, also where ids are null or repeat."""
    return id_and_text(df, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("h"), "text")


def repeated_units(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """``k, h, start, length, first_doc`` of every unit that occurred before, from :func:`keyed` documents."""
    separator = SEPARATORS[unit]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for k, h, text in zip(batch.column("k").to_pylist(), batch.column("h").to_pylist(), byte_texts(batch)):
                for start, length, digest in units_of(text, separator, min_words):
                    for col, value in zip(cols, (digest, k, h, start, length)):
                        col.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["digest", "k", "h", "start", "length"])

    units = docs.select("k", "h", "text").mapInArrow(cut, "digest binary, k long, h long, start long, length long")
    first = (units.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "start")).alias("first"))
             .filter("n > 1"))
    first = materialize(first, "repeated-units")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = first.filter(F.col("n") * HOT_PARTS > total).select(F.col("digest").alias("_hot"), F.col("first").alias("hot_first"))
    # at most HOT_PARTS rows
    told = units.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    # units of hot digests are dealt by their place and meet nothing
    spread = F.concat(F.lit("~").cast("binary"), F.col("digest"), F.xxhash64("k", "h", "start").cast("string").cast("binary"))
    told = told.withColumn("key", F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(spread))
    rest = first.filter(F.col("n") * HOT_PARTS <= total).select(F.col("digest").alias("key"), F.col("first").alias("rest_first"))
    told = told.join(rest, "key", "left").withColumn("first", F.coalesce("hot_first", "rest_first"))
    same = (F.col("k") == F.col("first.k")) & (F.col("h") == F.col("first.h")) & (F.col("start") == F.col("first.start"))
    found = told.filter(F.col("first").isNotNull() & ~same)
    return found.select("k", "h", "start", "length", F.when(F.col("first.k") != NULL_ID, F.col("first.k")).alias("first_doc"))


def remove_repeats(df: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_units, n_removed, n_bytes, n_kept_bytes, removed, kept_sha256`` and with ``with_text`` also ``kept``.

    ``removed`` lists ``(start, length, first_doc)`` by start: byte offset and length in the
    original text, and the document that keeps the unit.
    """
    separator = SEPARATORS[unit]
    docs = keyed(df, id_col, text_col)
    found = repeated_units(docs, unit, min_words).groupBy("k", "h").agg(
        F.sort_array(F.collect_set(F.struct("start", "length", "first_doc"))).alias("removed"))
    joined = docs.join(found, ["k", "h"], "left").select("doc_id", "text", "removed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("first_doc", pa.int64())]))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = byte_texts(batch), [x or [] for x in batch.column("removed").to_pylist()]
            kept = [without(t, separator, {s["start"] for s in r}) for t, r in zip(texts, removed)]
            cols = [batch.column("doc_id"), pa.array([sum(1 for _ in units_of(t, separator, min_words)) for t in texts], pa.int64()),
                    pa.array([len(r) for r in removed], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(t) for t in kept], pa.int64()), pa.array(removed, kind), pa.array([sha256(t).hexdigest() for t in kept], pa.string())]
            names = ["doc_id", "n_units", "n_removed", "n_bytes", "n_kept_bytes", "removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([t.decode() for t in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = "doc_id long, n_units long, n_removed long, n_bytes long, n_kept_bytes long, removed array<struct<start: bigint, length: bigint, first_doc: bigint>>, kept_sha256 string"
    return joined.mapInArrow(rest, ddl + ", kept string" * with_text)


def digest_columns(result: DataFrame) -> DataFrame:
    """The result with ``removed`` as text ``start:length:first_doc ...`` and the distinct documents that keep units."""
    return result.select("doc_id", "n_units", "n_removed", "n_bytes", "n_kept_bytes", "kept_sha256",
                         F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["length"], x["first_doc"])), " ").alias("removed"),
                         F.array_sort(F.array_distinct(F.transform("removed", lambda x: x["first_doc"]))).alias("kept_in"))


#: DuckDB SQL of the line query (ids unique and not null, as in the given tables).
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, ord, line, start, words, key FROM (
    SELECT doc_id, unnest(range(1, len(parts) + 1)) AS ord, unnest(parts) AS line,
           unnest(list_transform(range(len(parts)), lambda i: coalesce(list_sum(list_transform(parts[:i], lambda x: strlen(x) + 1)), 0))) AS start,
           unnest(list_transform(parts, lambda x: len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')))) AS words,
           unnest(list_transform(parts, lambda x: array_to_string(list_filter(regexp_split_to_array(
               translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), ' '))) AS key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
marked AS (
  SELECT *, words >= {MIN_WORDS} AND (doc_id, start) <> first_value((doc_id, start)) OVER w AS gone,
         first_value(doc_id) OVER w AS first_doc
  FROM lines WINDOW w AS (PARTITION BY key, words >= {MIN_WORDS} ORDER BY doc_id, start))
SELECT doc_id, count(*) FILTER (words >= {MIN_WORDS}) AS n_units, count(*) FILTER (gone) AS n_removed,
       (sum(strlen(line) + 1) - 1)::BIGINT AS n_bytes,
       greatest(coalesce(sum(strlen(line) + 1) FILTER (NOT gone), 0) - 1, 0)::BIGINT AS n_kept_bytes,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (NOT gone), '')) AS kept_sha256,
       coalesce(string_agg(start::BIGINT || ':' || strlen(line) || ':' || first_doc, ' ' ORDER BY start) FILTER (gone), '') AS removed,
       coalesce(list_sort(list_distinct(list(first_doc) FILTER (gone))), []) AS kept_in
FROM marked GROUP BY doc_id
"""
