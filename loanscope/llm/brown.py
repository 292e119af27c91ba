"""Operator 1: Brown class-based n-gram language model.

Tokens are the A-Z lowered words of a text and one end token. Words are put into
``CLASSES`` classes by exchange clustering; the model is

    P(w | before) = (1 - MIX) P(class | class before) P(w | class) + MIX P_base(w)

with class transitions smoothed towards class frequencies, and a class's mass for
unknown words taken from its words seen once (they are all one type, as in the base
score). The end token has a class of its own and is the context of a text's first word.
After an unknown word the context is the class most likely to have made it.

How it runs at scale:

* One pass turns documents into blocks of at most ``BLOCK`` bytes of text: the block's
  distinct words and its texts as numbers into them, written to the shared folder. All
  later steps read blocks; words cross the shuffle once per block, not once per token.
* A word meets its rows of all blocks once: their counts by context are summed, and the places
  (block, number) to which its class and count go back are kept beside them. The context of a
  token is the last of the ``CONTEXTS - 1`` most frequent words before it in its text.
* The exchange works on these sums. All words move at once to the class that raises the
  class-context information most, given the counts of the round before; a word has at most
  ``CONTEXTS`` entries, the classes' table ``CONTEXTS x CLASSES``, so only bounded tables are
  broadcast or brought to the driver.
* Contexts are elected exactly (see :func:`context_words`); counts, classes and scores cover every word of
  every document; no word is left out.

Defined cases: a null or empty text is one end token; null ids are in the fold of the empty
id text; repeated rows count each time and come back repeated; with nothing to learn from
all scores are 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.session import materialize

from .common import byte_texts, fold_col, id_and_text, pieces

CONTEXTS, CLASSES, ROUNDS = 128, 128, 6
MIX, SMOOTH = 0.05, 2.0
BLOCK = 6 << 20
#: Entries of word tables that are worked on together.
ENTRIES = 1 << 16
#: Words of a block, most frequent first, that are counted at once in the election of contexts.
CANDIDATES = 4096
#: Words that come into question as contexts and are counted again in all blocks; with more, all words are counted.
FINALISTS = 1024
#: The end token as a word: white space cannot be part of one.
END = b"\n"

_BLOCKS = "block long, docs binary, held binary, lengths binary, ids binary, words binary, counts binary"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def _split_words(packed: bytes) -> list[bytes]:
    """The words of a block; number 0 is the end token."""
    return [END, *zstandard.ZstdDecompressor().decompress(packed).split()]


def blocks(docs: DataFrame) -> DataFrame:
    """Documents (``doc_id, text, held_out``) as numbered words, some megabytes of text to a row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {END: 0}
        rows: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, rows, size, seq
            ids = np.concatenate([r[2] for r in rows])
            learned = ids[np.repeat([not r[1] for r in rows], [len(r[2]) for r in rows])]
            out = (part << 24 | seq, _pack(np.array([-1 if r[0] is None else r[0] for r in rows], np.int64)),
                   _pack(np.array([(r[0] is None) << 1 | r[1] for r in rows], np.uint8)), _pack(np.array([len(r[2]) for r in rows], np.int64)),
                   _pack(ids.astype(np.uint32)), zstandard.ZstdCompressor(level=1).compress(b" ".join(list(number)[1:])),
                   _pack(np.bincount(learned, minlength=len(number)).astype(np.uint32)))
            number, rows, size, seq = {END: 0}, [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=["block", "docs", "held", "lengths", "ids", "words", "counts"])

        for batch in pieces(batches):
            for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), byte_texts(batch)):
                if rows and size + len(text) > BLOCK:
                    yield block()
                add = number.setdefault
                ids = [add(w, len(number)) for w in text.lower().split()]
                ids.append(0)
                rows.append((doc_id, bool(held), np.array(ids, np.uint32)))
                size += len(text)
        if rows:
            yield block()

    return docs.select("doc_id", "held_out", "text").mapInArrow(build, _BLOCKS)


class Block:
    def __init__(self, row: dict):
        flags = _unpack(row["held"], np.uint8)
        self.held, null = (flags & 1).astype(bool), flags > 1
        self.docs = [None if z else d for d, z in zip(_unpack(row["docs"], np.int64).tolist(), null)]
        self.lengths = _unpack(row["lengths"], np.int64)
        self.ids = _unpack(row["ids"], np.uint32).view(np.int32)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def learned(self) -> np.ndarray:
        """Which tokens are in learning documents."""
        return np.repeat(~self.held, self.lengths)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def context_words(enc: DataFrame) -> list[bytes]:
    """The ``CONTEXTS - 1`` most frequent words of the learning documents, equal ones in byte order.

    Each block gives its ``CANDIDATES`` most frequent words and the count of the next one. The sum of
    these next counts bounds what any word's sum lacks, and the whole count of a word that no block
    gave. Words whose sum and bound reach the last elected sum are counted again in all blocks;
    where too many do, or words that no block gave could, all words of all blocks are counted.
    """
    most, tables = CONTEXTS - 1, enc.select("words", "counts")

    def counted(found: Iterator[tuple[list, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for words, n in found:
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    def block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        for batch in batches:
            for row in _rows(batch):
                n = _unpack(row["counts"], np.uint32).astype(np.int64)
                n[0] = 0  # the end token
                yield _split_words(row["words"]), n

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n in block_counts(batches):
            order = np.argsort(-n, kind="stable")
            best = order[:CANDIDATES]
            best = best[n[best] > 0]
            left = n[order[CANDIDATES]] if len(order) > CANDIDATES else 0
            yield from counted([([words[i] for i in best] + [None], np.append(n[best], left))])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n in block_counts(batches):
            some = np.flatnonzero(n)
            for at in range(0, len(some), ENTRIES):
                yield from counted([([words[i] for i in some[at:at + ENTRIES]], n[some[at:at + ENTRIES]])])

    def summed(step, limit: int) -> list:
        total = tables.mapInArrow(step, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return total.orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(limit).collect()

    bound, *sums = summed(top, FINALISTS + 1) or [None]
    if bound is None:
        return []
    last = sums[most - 1].n if len(sums) >= most else 0
    if not bound.n:
        return [bytes(r.word) for r in sums[:most]]
    if bound.n >= last or (len(sums) == FINALISTS and sums[-1].n + bound.n >= last):
        return [bytes(r.word) for r in summed(every, most)]
    finalists = {bytes(r.word) for r in sums if r.n + bound.n >= last}

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n in block_counts(batches):
            some = [i for i, w in enumerate(words) if w in finalists]
            yield from counted([([words[i] for i in some], n[some])])

    return [bytes(r.word) for r in summed(again, most)]


_WORDS = "c long, end boolean, contexts array<long>, blocks array<long>, spots array<int>"


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def word_contexts(enc: DataFrame, frequent: list[bytes]) -> DataFrame:
    """A row per word: ``c`` (count in learning documents), its contexts as ``n * CONTEXTS + g``, and its places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i + 1 for i, w in enumerate(frequent)}
        for batch in batches:
            for row in _rows(batch):
                b, words = Block(row), _split_words(row["words"])
                local = np.array([number.get(w, 0) for w in words], dtype=np.int32)
                own = local[b.ids]
                # Position of the last context word before each token, or the text's start.
                place = np.where(own > 0, np.arange(len(own), dtype=np.int32), np.int32(-1))
                last = np.maximum.accumulate(np.concatenate((place[:1] * 0 - 1, place[:-1])))
                g = np.where(last >= np.repeat(b.first.astype(np.int32), b.lengths), own[last], 0)
                wide = np.int64 if len(words) * CONTEXTS >= 1 << 31 else np.int32
                pairs, n = np.unique((b.ids.astype(wide) * CONTEXTS + g)[b.learned()], return_counts=True)
                pairs = pairs.astype(np.int64)
                sizes = np.bincount(pairs // CONTEXTS, minlength=len(words))
                values, ends = n * CONTEXTS + pairs % CONTEXTS, np.cumsum(sizes)
                for at in range(0, len(words), ENTRIES):
                    some = sizes[at:at + ENTRIES]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words[at:at + ENTRIES], pa.binary()), pa.array(np.full(len(some), row["block"])), pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                         _lists(some, values[ends[at] - some[0]:ends[at + len(some) - 1]])], names=["word", "block", "i", "contexts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        keys, counts, owners, blocks, spots = [], [], [], [], []
        held = 0
        for batch in batches:
            own = np.array([index.setdefault(w, len(index)) for w in batch.column("word").to_pylist()], np.int64)
            owners.append(own)
            blocks.append(batch.column("block").to_numpy())
            spots.append(batch.column("i").to_numpy())
            lists = batch.column("contexts")
            value = lists.flatten().to_numpy()
            keys.append(np.repeat(own, np.diff(lists.offsets.to_numpy())) * CONTEXTS + value % CONTEXTS)
            counts.append(value // CONTEXTS)
            held += len(value)
            if held > 64 * ENTRIES:  # a frequent word's rows are summed as they come
                key, where = np.unique(np.concatenate(keys), return_inverse=True)
                keys, counts, held = [key], [np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)], 0
        if not index:
            return
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
        c = np.bincount(key // CONTEXTS, weights=n, minlength=len(index)).astype(np.int64)
        sizes, ends = np.bincount(key // CONTEXTS, minlength=len(index)), None
        ends = np.cumsum(sizes)
        own = np.concatenate(owners)
        order = np.argsort(own, kind="stable")
        block, spot = np.concatenate(blocks)[order], np.concatenate(spots)[order]
        times = np.bincount(own, minlength=len(index))
        stops = np.cumsum(times)
        packed, end = n * CONTEXTS + key % CONTEXTS, np.zeros(len(index), bool)
        if END in index:
            end[index[END]] = True
        for at in range(0, len(index), ENTRIES):
            to = min(at + ENTRIES, len(index))
            a, b, x, y = ends[at] - sizes[at], ends[to - 1], stops[at] - times[at], stops[to - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[at:to]), pa.array(end[at:to]), _lists(sizes[at:to], packed[a:b]), _lists(times[at:to], block[x:y]), _lists(times[at:to], spot[x:y])],
                names=["c", "end", "contexts", "blocks", "spots"])

    spelled = enc.drop("counts").mapInArrow(count, "word binary, block long, i int, contexts array<long>")
    return spelled.repartition("word").mapInArrow(merge, _WORDS)


def _profile(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries per word, and context and count of all entries of a batch."""
    lists = batch.column("contexts")
    value = lists.flatten().to_numpy()
    return np.diff(lists.offsets.to_numpy()), value % CONTEXTS, value // CONTEXTS


def assign(batch: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """The class of each word: the greatest sum over its contexts of n times the class's score (-1 without contexts)."""
    sizes, g, n = _profile(batch)
    out = np.full(len(sizes), -1)
    words, ends = np.flatnonzero(sizes), np.cumsum(sizes)
    starts = ends - sizes
    at = 0
    while at < len(words):
        a = starts[words[at]]
        to = max(at + 1, int(np.searchsorted(ends[words], a + ENTRIES, side="right")))
        some = words[at:to]
        b = ends[some[-1]]
        out[some] = np.add.reduceat(table[g[a:b]] * n[a:b, None].astype(np.float32), starts[some] - a, axis=0).argmax(axis=1)
        at = to
    return out


def _start_table(totals: np.ndarray) -> np.ndarray:
    """The first assignment: the context a word follows most in proportion to how frequent that context is."""
    return np.diag(1.0 / np.maximum(totals, 1.0))[:, :CLASSES].astype(np.float32)


def exchange(words: DataFrame) -> np.ndarray:
    """Rounds of exchange; returns the last class table, from which every word's class follows."""
    spark = words.sparkSession

    def recount(table: np.ndarray | None) -> np.ndarray:
        shared = spark.sparkContext.broadcast(table)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(CONTEXTS * CLASSES)
            for batch in batches:
                sizes, g, n = _profile(batch)
                own = np.repeat(assign(batch, shared.value), sizes) if shared.value is not None else 0
                total += np.bincount(g * CLASSES + own, weights=n, minlength=len(total))
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell].astype(np.int64))], names=["cell", "n"])

        found = words.select("contexts").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(CONTEXTS * CLASSES)
        out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
        return out.reshape(CONTEXTS, CLASSES)

    table = _start_table(recount(None).sum(axis=1))
    for _ in range(ROUNDS):
        n = recount(table)
        # Gain of a word in a class: its counts times log N(context, class) / N(class).
        table = np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * CONTEXTS)).astype(np.float32)
    return table


class Model:
    """Log10 probabilities from counts: transitions N(before, class), class sizes, words seen once per class."""

    def __init__(self, transitions: np.ndarray, once: np.ndarray, tokens: int, types: int):
        self.tokens, self.types = tokens, types
        size = transitions.sum(axis=0)
        self.size = np.maximum(size, 1)
        share = (size + 1e-9) / (size.sum() + 1e-9 * len(size))
        self.step = (transitions + SMOOTH * share) / (transitions.sum(axis=1, keepdims=True) + SMOOTH)
        self.fresh = (once + 0.5) / (size + 1)
        self.fresh[CLASSES] = 0.0  # the end token is always known
        self.fresh[size == 0] = 1.0
        unknown = self.step * self.fresh
        self.unknown, self.guess = unknown.sum(axis=1), unknown.argmax(axis=1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def log10(self, c: np.ndarray, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per token, in text order; ``own`` is -1 for unknown words, ``first`` the start of each text."""
        before = np.empty(len(own), np.int64)
        before[1:], before[first] = own[:-1], CLASSES
        while (blank := np.flatnonzero(before < 0)).size:  # runs of unknown words, one step at a time
            ready = blank[before[blank - 1] >= 0]
            before[ready] = self.guess[before[ready - 1]]
        known = own >= 0
        safe = np.maximum(own, 0)
        p = np.where(known, self.step[before, safe] * (1 - self.fresh[safe]) * c / self.size[safe], self.unknown[before])
        return np.log10((1 - MIX) * p + MIX * self.base(c))


def score(df: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from rows where ``held_out`` (a column; default: crc32 of the id, modulo
    5, is 1) is false, and scores all rows.
    """
    spark = df.sparkSession
    held = fold_col(id_col, 5) == 1 if held_out is None else held_out
    enc = materialize(blocks(id_and_text(df, id_col, text_col, held.alias("held_out"))), "brown-blocks")
    words = materialize(word_contexts(enc, context_words(enc)), "brown-words")
    known = F.col("c") > 0
    totals = words.agg(F.sum("c").alias("n"), F.count(F.when(known, 1)).alias("v")).first()
    tokens, types = totals.n or 0, totals.v
    table = spark.sparkContext.broadcast(exchange(words))

    def classes(batch: pa.RecordBatch) -> np.ndarray:
        own = assign(batch, table.value)
        own[batch.column("end").to_numpy(zero_copy_only=False) & (own >= 0)] = CLASSES
        return own

    def count_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES + 1, np.int64)
        for batch in batches:
            total += np.bincount(classes(batch)[batch.column("c").to_numpy() == 1], minlength=CLASSES + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 1)), pa.array(total)], names=["class", "n"])

    once = np.zeros(CLASSES + 1)
    for r in words.select("c", "end", "contexts").mapInArrow(count_once, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        once[r["class"]] = r.n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = np.diff(batch.column("blocks").offsets.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("blocks").flatten(), batch.column("spots").flatten(), pa.array(np.repeat(batch.column("c").to_numpy(), times)),
                 pa.array(np.repeat(classes(batch), times).astype(np.int16))], names=["block", "i", "c", "class"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block (input sorted by block and word number): counts and classes of its words."""
        held, parts = None, []

        def out() -> pa.RecordBatch:
            c, own = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([_pack(c)]), pa.array([_pack(own)])], names=["of", "c", "class"])

        for batch in batches:
            block = batch.column("block").to_numpy()
            c, own = (batch.column(x).to_numpy().astype(t) for x, t in (("c", np.int64), ("class", np.int16)))
            start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else []
            for a, b in zip(start, [*start[1:], len(block)]):
                if block[a] != held:
                    if parts:
                        yield out()
                    held, parts = int(block[a]), []
                parts.append((c[a:b], own[a:b]))
        if parts:
            yield out()

    found = (words.mapInArrow(place, "block long, i int, c long, class short")
             .repartition("block").sortWithinPartitions("block", "i").select("block", "c", "class"))
    looked_up = found.mapInArrow(gather, "of long, c binary, class binary")
    ready = materialize(enc.drop("words", "counts").join(looked_up, F.col("block") == F.col("of")).drop("of"), "brown-numbered")

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = CLASSES + 1
        total = np.zeros(wide * wide, np.int64)
        for batch in batches:
            for row in _rows(batch):
                b, own = Block(row), _unpack(row["class"], np.int16).astype(np.int64)
                now = own[b.ids]
                before = np.empty(len(now), np.int64)
                before[1:], before[b.first] = now[:-1], CLASSES
                keep = b.learned()  # every word of these is known
                total += np.bincount(before[keep] * wide + now[keep], minlength=wide * wide)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell])], names=["cell", "n"])

    counted = ready.drop("c").mapInArrow(transitions, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    moves = np.zeros((CLASSES + 1) ** 2)
    moves[counted["cell"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    model = spark.sparkContext.broadcast(Model(moves.reshape(CLASSES + 1, CLASSES + 1), once, tokens, types))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for row in _rows(batch):
                b = Block(row)
                c, own = _unpack(row["c"], np.int64)[b.ids], _unpack(row["class"], np.int16).astype(np.int64)[b.ids]
                base = np.log10(m.base(c))
                full = m.log10(c, own, b.first) if tokens else base
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.docs, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(np.add.reduceat((c > 0).astype(np.int64), b.first)),
                     pa.array(np.full(len(b.docs), tokens, np.int64)), pa.array(np.add.reduceat(base, b.first)), pa.array(np.add.reduceat(full, b.first))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
