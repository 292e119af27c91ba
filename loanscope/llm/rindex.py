"""Operator 8: removal of long repeated byte strings with a run-length index.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts earlier (in a
document of smaller id, or further left in its own). Equal strings are brought together by
content, indexed, and judged exactly:

1. Of equal texts only the first is looked at; a later one of ``LENGTH`` bytes or more goes
   whole, for all its strings start earlier in the first.
2. Every window of ``LENGTH`` bytes is owned by its anchor: the leftmost of its ``GRAM``-byte
   grams with the smallest hash. Equal windows have equal anchors. Neighbouring windows of
   one anchor make a segment. Anchors that occur once are dropped.
3. The segments of an anchor meet in one place. Equal segments are folded into their first
   occurrence (first within a batch, then as they stream in order after the shuffle); the later
   ones go whole. An anchor with many distinct segments (a passage with different surroundings)
   is hot: its windows are dealt one by one, by their content, so that no task gets them all.
   A sample finds the hot anchors; it decides where windows meet, never what goes.
4. Distinct segments are laid end to end in text order, and a run-length index is built:
   the Burrows-Wheeler transform is cut into runs, and only at run starts are a suffix
   position, its neighbour above (the sample at the end of the run before) and their common
   length kept. From these samples phi and the matching statistics of every position are
   streamed: both change by one per step until the next sample. Positions that match their
   neighbour over ``LENGTH`` bytes are chained; all but the first of a chain in text order
   start a repeated string.

Anchors are hashed to 64 bits, so unequal grams may share an anchor; this costs work and
changes nothing. Equal texts and equal segments are told by SHA-256 and 128-bit digests.

Defined cases: null and empty texts have nothing to remove; texts under ``LENGTH`` bytes stay;
null ids come before all others; rows that repeat id and text are one document, and come
back repeated with one result; equal ids with different texts are different documents,
ordered by text hash; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, id_and_text, lean, mix64

LENGTH, GRAM = 100, 32  # the gram is whole eight-byte words
_SPREAD = LENGTH - GRAM  # an anchor lies 0 to _SPREAD bytes into its windows
#: Bytes whose anchors are found together, and bytes of segments indexed together.
BLOCK, INDEX_BYTES = 1 << 19, 1 << 18
#: An anchor with ``HOT`` distinct segments in one of ``SAMPLE`` distinct texts is hot.
SAMPLE, HOT = 64, 64
NULL_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15


def _sliding(x: np.ndarray, size: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over every ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[:len(x) - (size - width)], x[size - width:]) if size > width else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        # Eight-byte words, read unaligned.
        word = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        out = mix64(word[:n] + np.uint64(1))
        for k in range(8, GRAM, 8):
            out = mix64((out ^ word[k:n + k]) * np.uint64(_BASE))
        return out


def anchored(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``text, first, last, anchor, hash`` per segment: windows first..last of the text own the anchor (offsets in the text)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    if not len(texts) or lengths.max() < LENGTH:
        return none
    hashes = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    windows = len(hashes) - _SPREAD
    least = _sliding(hashes, _SPREAD + 1, np.minimum)
    owner = np.repeat(np.arange(len(texts)), lengths)[:windows]
    inside = np.arange(windows) + LENGTH <= begin[owner + 1]
    if not inside.any():
        return none
    # Grams that are the least of some window: the greatest of the least values around them is their own.
    padded = np.concatenate((np.zeros(_SPREAD, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(_SPREAD, np.uint64)))
    place = np.flatnonzero(_sliding(padded, _SPREAD + 1, np.maximum) == hashes)
    value = hashes[place]
    # Of these, each owns the windows after the last one before it that is no greater and before the next smaller one.
    first, last = place - _SPREAD, place.copy()
    for direction in (-1, 1):
        todo, step = np.arange(len(place)), 1
        while len(todo):
            other = todo + direction * step
            todo, other = todo[(other >= 0) & (other < len(place))], other[(other >= 0) & (other < len(place))]
            near = np.abs(place[other] - place[todo]) <= _SPREAD
            todo, other = todo[near], other[near]
            if direction < 0:
                hit = value[other] <= value[todo]
                first[todo[hit]] = place[other[hit]] + 1
            else:
                hit = value[other] < value[todo]
                last[todo[hit]] = np.minimum(last[todo[hit]], place[other[hit]] - _SPREAD - 1)
            todo, step = todo[~hit], step + 1
    text = np.searchsorted(begin, place, side="right") - 1
    first = np.maximum(first, begin[text])
    last = np.minimum(last, begin[text + 1] - LENGTH)
    good = first <= last
    text, at = text[good], begin[text[good]]
    return text, first[good] - at, last[good] - at, place[good] - at, value[good]


# --- the run-length index ----------------------------------------------------


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings laid end to end, with samples at its runs."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.size = n = int(self.starts[-1])
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        #: Bytes from each position to the end of its string.
        self.left = np.repeat(self.starts[1:] - 1, sizes + 1) - np.arange(n)
        self.words = self._words(data)
        suffixes = self._suffixes(int(sizes.max()) + 1)
        # A separator is a symbol of its own: it ends every run.
        before = np.where(suffixes > 0, data[suffixes - 1].astype(np.int64), -1)
        edge = (self.left[suffixes - 1] == 0) | (suffixes == 0)
        head = np.concatenate(([True], (before[1:] != before[:-1]) | edge[1:] | edge[:-1]))
        run = np.flatnonzero(head)
        self.heads, self.run_lengths = before[run], np.diff(np.append(run, n))
        at, above = suffixes[run], np.where(run > 0, suffixes[run - 1], -1)  # samples: run start, end of the run before
        order = np.argsort(at)
        self.at, self.above = at[order], above[order]
        self.common = self._common(self.at, self.above)

    def _words(self, data: np.ndarray) -> np.ndarray:
        """Eight bytes from each position as a big-endian number, zero from the string's end on."""
        wide = np.concatenate((data, np.zeros(8, np.uint8)))
        word = np.ndarray((self.size,), dtype=">u8", buffer=wide, strides=(1,)).astype(np.uint64)
        cut = np.clip(8 - self.left, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(cut == 64, np.uint64(0), (word >> np.minimum(cut, np.uint64(63))) << np.minimum(cut, np.uint64(63)))

    def _suffixes(self, longest: int) -> np.ndarray:
        """Suffix array by prefix doubling; suffixes that are equal to their string's end stand in text order."""
        n = self.size
        # A zero byte may be text: the number of bytes left tells it from the end.
        rank = self._ranks(self.words)
        short = np.minimum(self.left, 8)
        rank = self._ranks(rank * 9 + short)
        depth = 8
        while depth < longest:
            far = np.arange(n) + depth
            ahead = np.where(self.left >= depth, rank[np.minimum(far, n - 1)] + 1, 0)
            rank = self._ranks(rank * (n + 1) + ahead)
            depth *= 2
        return np.argsort(rank * n + np.arange(n))

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        return out

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common length of the strings from x and y on (0 where y is -1)."""
        most = np.where(y >= 0, np.minimum(self.left[x], self.left[y]), 0)
        out, live = np.zeros(len(x), np.int64), np.flatnonzero(most > 0)
        while len(live):
            differ = self.words[x[live] + out[live]] ^ self.words[y[live] + out[live]]
            # Leading zero bytes of the difference.
            same = np.full(len(live), 8)
            for k in range(7, -1, -1):
                same = np.where((differ >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0, k, same)
            out[live] = np.minimum(out[live] + same, most[live])
            live = live[(same == 8) & (out[live] < most[live])]
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position its neighbour above in suffix order and how far they agree, streamed from the samples."""
        since = np.repeat(np.arange(len(self.at)), np.diff(np.append(self.at, self.size)))
        step = np.arange(self.size) - self.at[since]
        return np.where(self.above[since] >= 0, self.above[since] + step, -1), np.maximum(self.common[since] - step, 0)

    def repeated(self, length: int) -> np.ndarray:
        """Positions whose next ``length`` bytes (within their string) also start further left."""
        phi, common = self.statistics()
        here = np.arange(self.size)
        root = np.where(common >= length, phi, here)
        while True:  # pointer doubling up the chains
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        first = here.copy()
        np.minimum.at(first, root, here)
        return (self.left >= length) & (first[root] < here)


# --- Spark stages ------------------------------------------------------------


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes."""
    cols: list[list] = [[] for _ in schema]
    weight = 0
    for row in rows:
        for col, value in zip(cols, row):
            col.append(value)
        weight += 1 + (len(row[-1]) >> 6 if isinstance(row[-1], bytes) else 0)
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            cols, weight = [[] for _ in schema], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_ANCHORS = "key long, sure int, k long, d int, spot long"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``spot`` packs a segment: first window, number of further windows, offset of the anchor.

    An anchor that repeats within the batch is known to repeat: its segments are sure (dealt by a
    key of their own), and one marker tells the other tasks.
    """
    for batch in batches:
        texts = byte_texts(batch)
        k, d = batch.column("k").to_numpy(), batch.column("d").to_numpy()
        parts, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                size += len(texts[end])
                end += 1
            text, first, last, anchor, value = anchored(texts[at:end])
            parts.append((text + at, (first << 16) | ((last - first) << 8) | (anchor - first), value))
            at = end
        if not parts:
            continue
        text, spot, value = (np.concatenate(x) for x in zip(*parts))
        _, number, times = np.unique(value, return_inverse=True, return_counts=True)
        sure = times[number] > 1
        with np.errstate(over="ignore"):
            own = mix64(value + spot.astype(np.uint64) * np.uint64(_BASE) + k[text].view(np.uint64))
        marker = np.unique(value[sure])
        zeros = np.zeros(len(marker), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((_signed(np.where(sure, own, value)), _signed(marker)))),
             pa.array(np.concatenate((sure.astype(np.int32), np.full(len(marker), 2, np.int32)))),
             pa.array(np.concatenate((k[text], zeros))), pa.array(np.concatenate((d[text], zeros)).astype(np.int32)),
             pa.array(np.concatenate((spot, zeros)))], names=["key", "sure", "k", "d", "spot"])


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``k, d, spot`` of the sure segments and of those whose anchor has another row (input sorted by key)."""
    rest = None
    names = ["key", "sure", "k", "d", "spot"]

    def settle(cols: list[np.ndarray], stop: int) -> pa.RecordBatch:
        key, sure, k, d, spot = (c[:stop] for c in cols)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if stop else np.empty(0, np.int64)
        size = np.diff(np.append(start, stop))
        keep = (sure == 1) | ((sure == 0) & (np.repeat(size, size) > 1))
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (k, d, spot)], names=["k", "d", "spot"])

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        stop = int(np.searchsorted(cols[0], cols[0][-1]))
        if len(cols[0]) - stop > 1 << 16:  # a long run of one key: two rows of it suffice to go on
            out, rest = settle(cols, len(cols[0])), [c[-2:] for c in cols]
            rest[1] = np.full(len(rest[1]), 2, np.int32)
            yield out
            continue
        rest = [c[stop:] for c in cols]
        yield settle(cols, stop)
    if rest is not None:
        yield settle(rest, len(rest[0]))


_SEGMENT = pa.schema([("key", pa.int64()), ("k", pa.int64()), ("d", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("piece", pa.binary())])
_SEGMENT_DDL = "key long, k long, d int, first long, last long, piece binary"


def _key(content: bytes) -> int:
    return int.from_bytes(blake2b(content, digest_size=8).digest(), "little", signed=True)


def hot_anchors(docs: DataFrame) -> frozenset[int]:
    """Keys of the anchors that have many distinct segments, by a sample of the distinct texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in byte_texts(batch):
                seen = {(_key(text[at:at + GRAM]), _key(text[first:last + LENGTH])) for _, first, last, at, _ in zip(*(x.tolist() for x in anchored([text])))}
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.int64()) for i in (0, 1)], names=["key", "piece"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counted = some.mapInArrow(lean(cut), "key long, piece long").distinct().groupBy("key").count().filter(F.col("count") >= HOT)
    return frozenset(r.key for r in counted.select("key").collect())


def _segments(batches: Iterator[pa.RecordBatch], hot: frozenset[int] = frozenset()) -> Iterator[pa.RecordBatch]:
    """Texts with their spots to segments by anchor, and to windows by digest where the anchor is hot.

    A null piece is a range that goes whole.
    """

    def cut(k: int, d: int, text: bytes, spot: int) -> Iterator[tuple[bytes, tuple]]:
        """Digest and row of a segment, or of each of its windows."""
        first, more, offset = spot >> 16, (spot >> 8) & 255, spot & 255
        piece = text[first:first + more + LENGTH]
        key = _key(piece[offset:offset + GRAM])
        if key not in hot:
            yield blake2b(piece, digest_size=16).digest(), (k, d, first, first + more, key, piece)
            return
        for at in range(more + 1):
            digest = blake2b(piece[at:at + LENGTH], digest_size=16).digest()
            yield digest, (k, d, first + at, first + at, int.from_bytes(digest[:8], "little", signed=True), digest)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            seen: dict[bytes, tuple] = {}
            gone = []
            for k, d, spots, later, text in zip(*(batch.column(c).to_pylist() for c in ("k", "d", "spots", "later")), byte_texts(batch)):
                for spot in (s["spot"] for s in spots if s["d"] == d and not (later and d in later)):
                    for digest, now in cut(k, d, text, spot):
                        old = seen.setdefault(digest, now)
                        if old is not now:
                            if now[:3] < old[:3]:
                                seen[digest], now = now, old
                            gone.append(now[:4])
            # One row per stretch of a document that goes whole.
            gone.sort()
            held = None
            for k, d, first, last in gone:
                if held and held[:2] == (k, d) and first <= held[3] + 1:
                    held = (k, d, held[2], max(held[3], last))
                    continue
                if held:
                    yield (held[0] ^ held[2], *held, None)
                held = (k, d, first, last)
            if held:
                yield (held[0] ^ held[2], *held, None)
            for k, d, first, last, key, piece in seen.values():
                yield key, k, d, first, last, piece

    yield from _batches(rows(), _SEGMENT)


_RANGE = pa.schema([("k", pa.int64()), ("d", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges to remove, from segments sorted by anchor and place; only distinct segments are held."""

    def rows() -> Iterator[tuple]:
        pending: list[tuple] = []
        weight = 0
        key, seen, distinct = None, set(), []

        def close() -> Iterator[tuple]:
            nonlocal pending, weight
            if len(distinct) > 1:
                pending += distinct
                weight += sum(len(r[5]) for r in distinct)
            if weight >= INDEX_BYTES:
                yield from indexed(pending)
                pending, weight = [], 0

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "k", "d", "first", "last", "piece"))):
                if row[5] is None:
                    yield row[1], row[2], row[3], row[4] + LENGTH
                    continue
                if row[0] != key:
                    yield from close()
                    key, seen, distinct = row[0], set(), []
                if row[5] in seen:
                    yield row[1], row[2], row[3], row[4] + LENGTH
                else:
                    seen.add(row[5])
                    distinct.append(row)
        yield from close()
        yield from indexed(pending)

    def indexed(rows: list[tuple]) -> Iterator[tuple]:
        if not rows:
            return
        rows.sort(key=lambda r: r[1:4])
        index = RunIndex([r[5] for r in rows])
        repeated = np.flatnonzero(index.repeated(LENGTH))
        if not len(repeated):
            return
        number = np.searchsorted(index.starts, repeated, side="right") - 1
        offset = repeated - index.starts[number]
        new = np.concatenate(([True], (number[1:] != number[:-1]) | (offset[1:] != offset[:-1] + 1)))
        for i, j in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(repeated))):
            _, k, d, first, _, _ = rows[number[i]]
            yield k, d, first + int(offset[i]), first + int(offset[j - 1]) + LENGTH

    yield from _batches(rows(), _RANGE)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of the ranges' union."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def cut_out(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in ranges:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                   keep: list[str] | None = None) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    ``spans`` are the removed runs ``(start, end)`` in bytes of the original text. With
    ``with_text`` there is also ``kept``, the rest as text (a character cut in two goes whole),
    and with ``keep`` a struct ``row`` of the named input columns as fields c0, c1, ...
    """
    row = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")] if keep else []
    extra = ["row"] * bool(keep)
    docs = id_and_text(df, id_col, text_col, *row).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), "text", *extra)
    hashed = docs.select("k", F.sha2("text", 256).alias("h"))
    if hashed.groupBy("k").count().filter("count > 1").isEmpty():
        docs, ranked = docs.withColumn("d", F.lit(0)), hashed.withColumn("d", F.lit(0))
    else:  # rows that share an id are numbered by text
        ranked = hashed.distinct().withColumn("d", (F.row_number().over(Window.partitionBy("k").orderBy("h")) - 1).cast("int"))
        known = ranked.select(F.col("k").alias("rk"), F.col("h").alias("rh"), "d")
        docs = docs.join(known, (F.col("k") == F.col("rk")) & (F.sha2("text", 256) == F.col("rh"))).drop("rk", "rh")
    docs = docs.select("k", "d", "text", *extra)
    first = ranked.groupBy("h").agg(F.min(F.struct("k", "d")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = ranked.join(first, "h").filter((F.col("k") != F.col("first.k")) | (F.col("d") != F.col("first.d")))
    later = later.groupBy("k").agg(F.collect_list("d").alias("later")).withColumnRenamed("k", "lk")
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs))
    anchors = docs.mapInArrow(lean(_anchors), _ANCHORS)
    spots = anchors.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_repeating), "k long, d int, spot long")
    by_doc = spots.groupBy("k").agg(F.collect_list(F.struct("d", "spot")).alias("spots")).withColumnRenamed("k", "sk")
    by_doc = by_doc.join(later, F.col("sk") == F.col("lk"), "left").select("sk", "spots", "later")
    # Texts are dealt by k, with the same columns here and below, so that the exchange is made once.
    segments = docs.join(by_doc, F.col("k") == F.col("sk")).select("k", "d", "spots", "later", "text", *extra).mapInArrow(
        lean(lambda batches: _segments(batches, hot.value)), _SEGMENT_DDL)
    ranges = segments.repartition("key").sortWithinPartitions("key", "k", "d", "first").mapInArrow(lean(_judged), "k long, d int, start long, end long")
    by_doc = ranges.groupBy("k").agg(F.collect_list(F.struct("d", "start", "end")).alias("ranges")).withColumnRenamed("k", "sk")
    by_doc = by_doc.join(later, F.col("sk") == F.col("lk"), "full").select(F.coalesce("sk", "lk").alias("sk"), "ranges", "later")
    joined = docs.join(by_doc, F.col("k") == F.col("sk"), "left").select("k", "d", "ranges", "later", "text", *extra)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                            ("kept_sha256", pa.string()), ("spans", kind), *([("kept", pa.string())] if with_text else [])])
        for batch in batches:
            out = []
            for k, d, ranges, later, text in zip(*(batch.column(c).to_pylist() for c in ("k", "d", "ranges", "later")), byte_texts(batch)):
                if d in (later or ()):
                    runs = [(0, len(text))] if len(text) >= LENGTH else []
                else:
                    runs = merged([(r["start"], r["end"]) for r in ranges or () if r["d"] == d])
                kept = cut_out(text, runs)
                out.append([None if k == NULL_ID else k, len(text), len(text) - len(kept), len(runs), sha256(kept).hexdigest(),
                            [{"start": a, "end": b} for a, b in runs], *([kept.decode(errors="ignore")] if with_text else [])])
            cols = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c) for c in extra)], names=[*schema.names, *extra])

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    ddl += ", kept string" * with_text + (f", row {joined.schema['row'].dataType.simpleString()}" if keep else "")
    return joined.mapInArrow(lean(rest), ddl)
