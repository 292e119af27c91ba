"""Operator 5: n-gram Jaccard join by vertical partitioning.

A document is the set of its distinct 4-word shingles (64-bit hashes). All shingles
stand in one global order: rare ones first, then those of four common words, then
those seen often in a sample of documents; by hash within each class. Any order gives
the same links - this one keeps shared boilerplate out of the prefixes.

1. Equal sets are one class. Only one document of each goes on.
2. Linked sets share a shingle among the first ``n - ceil(t n) + 1`` of either (the
   prefix). Prefix shingles are grouped; a list of documents pairs with three of its
   members first (stars), so a group of near copies costs its size, not its square.
3. A pair whose sizes or parity bitmaps rule the link out is dropped - both bounds are exact.
4. The global order is cut into ``FRAGMENTS`` ranges. For the pairs left, each
   fragment counts its part of the overlap on its own, and the counts are summed per pair.
5. Linked classes get connected components. What remains are pairs of different components
   that share a prefix shingle; they are compared in blocks (3, then 4): first each
   with its nearest alone, whose links are taken into the components, then all that
   is still apart, which finds every further link. Pairs inside one component need no look:
   they cannot change it.

Lists of often seen shingles are salted by their estimated length, so that no task
gets an unbounded list.

Defined cases: a null or empty text, or one of white space, has no shingles and links
with nothing; its component is its own id. Null ids take part in links but are never
the smallest; a component of null ids alone is null. Repeated rows come back repeated
and link with each other. An empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.session import materialize

from .common import LOWER, SPACE, byte_texts, id_and_text, lean, mix64, pieces, span_hashes, spans
from .components import connected

WORDS, PERCENT = 4, 85
FRAGMENTS = 8
#: Documents in the sample that finds often seen words and shingles (it orders shingles, and decides nothing).
SAMPLE_SHARE, SAMPLE_LEAST = 1 / 32, 4096
COMMON_WORDS, COMMON_SHINGLES = 2048, 1 << 20
#: Members of a list that are handled together.
LIST = 1024
BLOCK = 1 << 20
#: Least bytes of the bitmaps that travel with every list member; pairs that pass meet the full ones.
SHORT_BITMAP = 64
#: Document keys (24 bytes each) that may be broadcast to pick out their texts.
BROADCAST_KEYS = 1 << 18


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its sorted distinct shingle hashes, and the least common word's rank class of each.

    The second array holds, per shingle, the hashes of its words (rows), for ordering.
    """
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        data = LOWER[np.frombuffer(b"\n".join(texts[at:end]), np.uint8)]
        starts, ends = spans(~SPACE[data])
        hashes = span_hashes(data, starts, ends)
        edge = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[at:end]])))
        first = np.searchsorted(starts, edge)
        for a, b in zip(first, first[1:]):
            yield _shingles(hashes[a:b], words)
        at = end


def _shingles(tokens: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(tokens):
        return np.empty(0, np.uint64), np.empty((0, words), np.uint64)
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    rows = np.stack([tokens[k:n + k] for k in range(width)], axis=1)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    out, where = np.unique(out, return_index=True)
    rows = rows[where]
    return out, rows if width == words else np.repeat(rows[:, :1], words, axis=1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Order:
    """The global order: class of a shingle from bounded tables of common words and shingles."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray, counts: np.ndarray, scale: float):
        self.words = np.sort(words)
        at = np.argsort(shingles)
        self.shingles, self.expected = shingles[at], counts[at] * scale

    @staticmethod
    def _in(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(x.shape, bool), np.zeros(x.shape, np.int64)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return table[at] == x, at

    def rank(self, shingles: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the global order (class in the top bit pair, then hash) and expected list lengths."""
        often, at = self._in(self.shingles, shingles)
        common = self._in(self.words, words)[0].all(axis=1)
        length = np.where(often, self.expected[at], 0.0) if len(self.expected) else np.zeros(len(shingles))
        kind = np.where(often, np.minimum(2 + np.log2(np.maximum(length, 1)).astype(np.int64), 31), common.astype(np.int64))
        return (kind.astype(np.uint64) << np.uint64(59)) | (shingles >> np.uint64(5)), length


def prefix_length(n: int, percent: int) -> int:
    """Shingles among which a set of ``n`` shares one with any set it links to."""
    return n - -(-percent * n // 100) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles by their low bits, in 8n to 16n bits (512 to 8192)."""
    bits = 1 << min(13, max(9, (8 * max(1, len(shingles)) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def short(bits: bytes, n: int) -> bytes:
    """The bitmap of ``n`` shingles folded to about a bit per shingle: with fewer, long sets that share nothing would all pass."""
    return fold(np.frombuffer(bits, np.uint8), max(SHORT_BITMAP, 1 << max(0, n - 1).bit_length() - 3 if n > 8 else 1)).tobytes()


def fold(a: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap (rows of bytes) folded to ``size`` bytes."""
    while a.shape[-1] > size:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    return a


def may_link(n_a: np.ndarray, n_b: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether the most overlap that size and differing parities allow is enough to link."""
    overlap = np.minimum(np.minimum(n_a, n_b), (n_a + n_b - differing) // 2)
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _order(docs: DataFrame, words: int) -> Order:
    """Common words and shingles of a hash sample of documents; bounded tables, so they may be broadcast."""
    total = docs.count()
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_LEAST / max(1, total)))
    sample = docs.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, values in (("s", []), ("w", [])):
                for shingles, rows in shingle_sets(byte_texts(batch), words):
                    values.append(shingles if kind == "s" else np.unique(rows))
                found, n = np.unique(np.concatenate(values) if values else np.empty(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.string()), pa.array(signed(found)), pa.array(n, pa.int64())], names=["kind", "v", "n"])

    counted = sample.select("text").mapInArrow(lean(count), "kind string, v long, n long").groupBy("kind", "v").agg(F.sum("n").alias("n"))
    counted = counted.filter("n > 1")
    tables = {k: counted.filter(F.col("kind") == k).orderBy(F.desc("n"), "v").limit(most).select("v", "n").toPandas()
              for k, most in (("w", COMMON_WORDS), ("s", COMMON_SHINGLES))}
    return Order(tables["w"]["v"].to_numpy(np.int64).view(np.uint64), tables["s"]["v"].to_numpy(np.int64).view(np.uint64),
                 tables["s"]["n"].to_numpy(np.float64), 1 / share)


_SETS = "doc_id long, k long, h long, n long, sid long, bits binary, brief binary, tokens array<long>, salts array<int>"


def _sets(docs: DataFrame, order: Order, words: int, percent: int) -> DataFrame:
    """Per row: set size, set id, parity bitmap, and prefix shingles with how many salts each list gets."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in pieces(batches):
            n, sid, bits, brief, tokens, salts = [], [], [], [], [], []
            for shingles, rows in shingle_sets(byte_texts(batch), words):
                n.append(len(shingles))
                digest = blake2b(shingles.tobytes(), digest_size=8).digest()
                sid.append(int.from_bytes(digest, "little", signed=True))
                if not len(shingles):
                    bits.append(b"")
                    brief.append(b"")
                    tokens.append([])
                    salts.append([])
                    continue
                rank, length = order.rank(shingles, rows)
                p = prefix_length(len(shingles), percent)
                first = np.argpartition(rank, p - 1)[:p] if p < len(rank) else np.arange(len(rank))
                bits.append(bitmap(shingles))
                brief.append(short(bits[-1], len(shingles)))
                tokens.append(signed(shingles[first]))
                salts.append(np.ceil(np.maximum(length[first], 1) / LIST).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k"), batch.column("h"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()),
                 pa.array(brief, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int32()))],
                names=["doc_id", "k", "h", "n", "sid", "bits", "brief", "tokens", "salts"])

    return docs.mapInArrow(lean(build), _SETS)


def _lists(postings: DataFrame) -> DataFrame:
    """``token, salts, ids, ns``: a row per list that may hold two sets, members by size, smallest first."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def lists(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            token, salt, salts, n, node = cols
            start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))))
            stop = len(token) if last else int(start[-1])
            size = np.diff(np.append(start, stop)) if last else np.diff(start)
            start = start[:len(size)]
            wanted = (size > 1) | (salts[start] > 1)
            inside = np.repeat(wanted, size)
            bounds = pa.array(np.concatenate(([0], np.cumsum(size[wanted]))).astype(np.int32))
            out = [pa.array(token[start[wanted]]), pa.array(salts[start[wanted]]),
                   *(pa.ListArray.from_arrays(bounds, pa.array(c[:stop][inside])) for c in (node, n))]
            return [c[stop:] for c in cols], pa.RecordBatch.from_arrays(out, names=["token", "salts", "ids", "ns"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "salts", "n", "node")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if len(cols[0]):
                rest, out = lists(cols, False)
                yield out
        if rest is not None and len(rest[0]):
            yield lists(rest, True)[1]

    dealt = postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "node")
    return dealt.select("token", "salt", "salts", "n", "node").mapInArrow(lean(walk), "token long, salts int, ids array<long>, ns array<long>")


_PAIRS = "a long, n_a long, b long, n_b long"


def _pairs(found: set[tuple[int, int, int, int]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["a", "n_a", "b", "n_b"])


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of every list's hubs - its smallest, middle and largest set - with its members; the hub is ``a``."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int, int, int]] = set()
            for ids, ns in zip(batch.column("ids").to_pylist(), batch.column("ns").to_pylist()):
                for hub in {0, len(ids) // 2, len(ids) - 1}:
                    a, n = ids[hub], ns[hub]
                    found.update([(a, n, b, m) for b, m in zip(ids, ns) if b != a and min(n, m) * 100 >= max(n, m) * percent])
            yield _pairs(found)

    stars = lists.select("ids", "ns").mapInArrow(lean(star), _PAIRS)
    # Between the salts of one shingle: their smallest sets with the smallest of all.
    salted = lists.filter("salts > 1").select("token", F.col("ns")[0].alias("n"), F.col("ids")[0].alias("id"))
    centre = salted.groupBy("token").agg(F.min(F.struct("n", "id")).alias("c"))
    between = salted.join(centre, "token").filter("id <> c.id").select(
        F.col("c.id").alias("a"), F.col("c.n").alias("n_a"), F.col("id").alias("b"), F.col("n").alias("n_b"))
    both = stars.union(between)
    # A pair may come from either end: the smaller set is the hub.
    swap = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    return both.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("n_a", "n_b"), ("b", "a"), ("n_b", "n_a"))]).distinct()


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``a, n_a, b, n_b`` the pairs that sizes and parity bitmaps allow."""
    sized = pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    bits = sets.select("node", "bits")
    joined = (sized.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a")
              .join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.empty(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
                u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(u), len(v))
                far[i] = np.bitwise_count(fold(u, size) ^ fold(v, size)).sum()
            ok = may_link(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), far, percent)
            yield batch.select(["a", "n_a", "b", "n_b"]).filter(pa.array(ok))

    return joined.select("a", "n_a", "b", "n_b", "bits_a", "bits_b").mapInArrow(lean(check), "a long, n_a long, b long, n_b long")


def _overlaps(pairs: DataFrame, sets: DataFrame, docs: DataFrame, order: Order, words: int) -> DataFrame:
    """``a, n_a, b, n_b, common``: overlap counted in each fragment of the order, summed per pair.

    Every ``a`` is dealt with its partners in salts of about ``LIST``; the segments of a and of
    its partners meet by (a, salt, fragment).
    """
    hubs = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    dealt = (pairs.join(hubs, "a").withColumn("salts", F.ceil(F.col("partners") / LIST).cast("int"))
             .withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")))
    # What each set takes part in: as a partner once per pair, as a hub once per salt.
    part = dealt.select(F.col("b").alias("node"), F.struct("a", "salt", F.col("n_a"), F.lit(False).alias("hub")).alias("role"))
    hub = dealt.select("a", "salt", "n_a").distinct().select(F.col("a").alias("node"), F.struct("a", "salt", "n_a", F.lit(True).alias("hub")).alias("role"))
    # A set with very many roles is dealt out too: its text is read once per LIST of them.
    roles = part.union(hub).groupBy("node", F.pmod(F.xxhash64("role"), F.lit(16)).alias("some")).agg(F.collect_list("role").alias("roles")).drop("some")
    wanted = sets.select("k", "h", "node").join(roles.select("node").distinct(), "node")
    texts = docs.join(_small(wanted), ["k", "h"]).select("node", "text").join(roles, "node")
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in pieces(batches):
            cols: list[list] = [[] for _ in range(7)]
            pending = 0
            for node, roles, (shingles, rows) in zip(batch.column("node").to_pylist(), batch.column("roles").to_pylist(), shingle_sets(byte_texts(batch), words)):
                rank, _ = order.rank(shingles, rows)
                fragment = fragments(rank)
                parts = [(f, signed(shingles[fragment == f])) for f in range(FRAGMENTS)]
                for role in roles:
                    for f, piece in parts:
                        if len(piece):
                            for col, value in zip(cols, (role["a"], role["salt"], f, node, role["hub"], len(shingles), piece.tobytes())):
                                col.append(value)
                            pending += piece.nbytes
                if pending > BLOCK:
                    yield _segments(cols)
                    cols, pending = [[] for _ in range(7)], 0
            yield _segments(cols)

    segments = texts.select("node", "roles", "text").mapInArrow(lean(cut), "a long, salt int, f int, node long, hub boolean, n long, piece binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, n_mine, last = None, None, 0, None
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for a, salt, f, node, hub, n, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "f", "node", "hub", "n", "piece"))):
                piece = np.frombuffer(piece, np.int64)
                if hub:
                    key, mine, n_mine, last = (a, salt, f), piece, n, None
                elif key == (a, salt, f) and node != last:  # a repeated row is one document
                    last = node
                    common = int(_common(mine, piece))
                    if common:
                        for col, value in zip(out, (a, n_mine, node, n, common)):
                            col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "n_a", "b", "n_b", "part"])

    dealt = segments.repartition("a", "salt", "f").sortWithinPartitions("a", "salt", "f", F.desc("hub"), "node")
    partial = dealt.mapInArrow(lean(count), "a long, n_a long, b long, n_b long, part long")
    return partial.groupBy("a", "n_a", "b", "n_b").agg(F.sum("part").alias("common"))


def fragments(rank: np.ndarray) -> np.ndarray:
    """The vertical cut: the rare class by hash range, all other classes in the last fragment."""
    rare = (rank >> np.uint64(59)) == 0
    return np.where(rare, (rank >> np.uint64(5)) * np.uint64(FRAGMENTS - 1) >> np.uint64(54), np.uint64(FRAGMENTS - 1)).astype(np.int64)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Overlap of two arrays of distinct values, each sorted as unsigned."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return (y[at] == x).sum()


def _segments(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["a", "salt", "f", "node", "hub", "n", "piece"])


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return pairs.filter(100 * F.col("common") >= percent * union).select("a", "b")


def _mixed(lists: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """``token, node, n, total, brief``: the members of the lists that hold more than one component."""
    members = lists.select("token", F.explode(F.arrays_zip("ids", "ns")).alias("m")).select("token", F.col("m.ids").alias("node"), F.col("m.ns").alias("n"))
    mixed = (_rooted(members, roots).groupBy("token").agg(F.count("*").alias("total"), F.min("root").alias("low"), F.max("root").alias("high"))
             .filter("low <> high").select("token", "total"))
    return members.join(mixed, "token").join(sets.select("node", "brief"), "node")


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _across(mixed: DataFrame, roots: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """``a, n_a, b, n_b``: pairs of different components in one list that sizes and short bitmaps allow.

    With ``nearest``, a set meets only the one whose bitmap differs least. Long lists are dealt out in blocks of about ``LIST`` members against blocks of
    minors: members outside the list's largest component.
    """
    inside = _rooted(mixed, roots)
    # Only lists beyond LIST need to know their largest component.
    lengthy = inside.filter(F.col("total") > LIST).groupBy("token", "root").agg(F.count("*").alias("m"))
    major = lengthy.groupBy("token").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("all")).select(
        "token", F.col("top.root").alias("major"), (F.col("all") - F.col("top.m")).alias("minors")).filter("minors > 0")
    columns = ["token", "node", "n", "root", "brief"]
    brief = inside.filter(F.col("total") <= LIST).select(
        *columns, F.lit(True).alias("minor"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(False).alias("visit"), F.lit(1).alias("cells"))
    rows = inside.filter(F.col("total") > LIST).join(major, "token")
    blocks, chunks = F.ceil(F.col("total") / LIST).cast("int"), F.ceil(F.col("minors") / LIST).cast("int")
    spot, minor = F.xxhash64("node"), F.col("root") != F.col("major")
    members = rows.select(*columns, minor.alias("minor"), F.pmod(spot, blocks).alias("i"),
                          F.explode(F.sequence(F.lit(0).cast("long"), (chunks - 1).cast("long"))).alias("j"), F.lit(False).alias("visit"), (blocks * chunks).alias("cells"))
    visitors = rows.filter(minor).select(*columns, F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))).alias("i"),
                                         F.pmod(spot, chunks).alias("j"), F.lit(True).alias("visit"), (blocks * chunks).alias("cells"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        key = None
        for batch in batches:
            out: set[tuple[int, int, int, int]] = set()
            for row in zip(*(batch.column(c).to_pylist() for c in ("token", "i", "j", "visit", "cells", "node", "n", "root", "brief", "minor"))):
                if row[:3] != key:
                    out.update(_cross(pending, percent, nearest))
                    pending, key = [], row[:3]
                pending.append(row[3:])
            yield _pairs(out)
        yield _pairs(set(_cross(pending, percent, nearest)))

    dealt = brief.union(members).union(visitors).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "visit")
    return dealt.mapInArrow(lean(compare), _PAIRS).distinct()


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has few rows (of some ten bytes); else joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _cross(rows: list[tuple], percent: int, nearest: bool) -> list[tuple[int, int, int, int]]:
    """Pairs of one cell; a row is (visit, cells, node, n, root, brief, minor)."""
    if len(rows) < 2 or len({r[4] for r in rows}) < 2:
        return []
    left = [r for r in rows if not r[0]]
    right = [r for r in rows if r[0]] if rows[0][1] > 1 else left
    if not left or not right:
        return []
    n, root = np.array([r[3] for r in left]), np.array([r[4] for r in left])
    by_size: dict[int, np.ndarray] = {}
    out = []
    for _, _, sid, m, own, bits, _ in right:
        ok = (root != own) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
        near = np.flatnonzero(ok)
        if not len(near):
            continue
        mine = np.frombuffer(bits, np.uint8)
        size = min(min(len(left[i][5]) for i in near), len(mine))
        if size not in by_size:
            by_size[size] = np.stack([fold(np.frombuffer(r[5], np.uint8), size) if len(r[5]) >= size else np.zeros(size, np.uint8) for r in left])
        far = np.bitwise_count(by_size[size][near] ^ fold(mine, size)).sum(axis=1, dtype=np.int64)
        allowed = may_link(n[near], np.full(len(near), m), far, percent)
        near, far = near[allowed], far[allowed]
        if nearest and len(near) > 1:
            near = near[[far.argmin()]]
        for i in near:
            a, b = sorted(((left[i][2], int(n[i])), (sid, m)))
            out.append((*a, *b))
    return out


def link_classes(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (``doc_id, k, h, n, sid, node``), links between classes (``a, b``) and their components (``node, root``).

    The links span the components: a pair inside a component that other links already join
    need not be among them.
    A class is known by the number of its first row, its ``node`` (null: no shingles).
    """
    docs = id_and_text(df, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"), "text")
    order = _order(docs, words)
    # Row numbers are given where the rows are written, so they stay.
    every = materialize(_sets(docs, order, words, percent).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    narrow = every.select("doc_id", "k", "h", "n", "sid", "row")
    first = narrow.filter("n > 0").groupBy("sid").agg(F.min(F.struct("k", "h", "row")).alias("first"), F.count("*").alias("times"))
    copies = (narrow.select("sid", "row").join(first.filter("times > 1"), "sid").filter(F.col("row") != F.col("first.row")).select("row"))
    copies = materialize(copies, "jaccard-copies")
    sets = every.filter("n > 0").join(_small(copies), "row", "left_anti").withColumnRenamed("row", "node")
    zipped = sets.select("node", "n", F.explode(F.arrays_zip("tokens", "salts")).alias("t"))
    postings = zipped.select(F.col("t.tokens").alias("token"), F.col("t.salts").alias("salts"), "n", "node").withColumn(
        "salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    lists = materialize(_lists(postings), "jaccard-lists")
    pairs = materialize(_checked(_stars(lists, percent), sets, percent), "jaccard-pairs")
    links = materialize(_linked(_overlaps(pairs, sets, docs, order, words), percent), "jaccard-links")
    roots = connected(links, "jaccard-components")
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    mixed = materialize(_mixed(lists, roots, sets), "jaccard-mixed")
    # First the nearest pairs alone: they join most of what belongs together, and few pairs are left.
    for nearest in (True, False):
        others = _across(mixed, roots, percent, nearest).join(done, ["a", "b"], "left_anti")
        others = materialize(_checked(others, sets, percent), "jaccard-pairs")
        further = materialize(_linked(_overlaps(others, sets, docs, order, words), percent), "jaccard-links")
        done = done.union(others.select("a", "b"))
        if not further.isEmpty():
            links = links.union(further)
            roots = connected(links, "jaccard-components")
    member = narrow.join(first.select("sid", F.col("first.row").alias("node")), "sid", "left")
    return member, links, roots


def components(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, root, k, h`` - root tells components apart also where ids are null (null: no shingles)."""
    member, _, roots = link_classes(df, words, percent, id_col, text_col)
    # Sets without shingles have no class: their node is null and meets nothing.
    rooted = member.join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (rooted.join(least, "root", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root", "k", "h"))


#: DuckDB SQL of the query (ids unique and not null, as in the given tables).
ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON s.doc_id = r.doc_id
"""
