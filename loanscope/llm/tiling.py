"""Operator 2: benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered. A document
and a benchmark item that share a run of ``MIN_MATCH`` tokens (a seed) are a
candidate pair when the item's tokens under shared seeds reach the threshold - no
tiling can cover more. For those, tiles are marked greedily: running Karp-Rabin
hashes of all unmarked windows find the longest common run, its non-overlapping
occurrences are marked (by item position, then document position), and so on down to
``MIN_MATCH``. A document is contaminated by an item whose tokens are covered to
``THRESHOLD`` or more, in whatever order the passages stand.

The benchmark's seeds go to every task in slices of at most ``SLICE_BYTES`` of its
text, one pass over the documents per slice, so nothing unbounded is broadcast.

Defined cases: null or empty documents are clean; items with fewer than ``MIN_MATCH``
tokens have no tile and never contaminate; equal items are each reported; items with a
null id report null; repeated documents come back repeated; empty tables give an empty
table, or no contamination; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.session import materialize

from .common import LOWER, byte_texts, id_and_text, lean, mix64, pieces, span_hashes, spans

MIN_MATCH, THRESHOLD = 5, 0.6
SLICE_BYTES = 16 << 20
#: Bytes of text handled together.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each text's first token (and the end), and byte offsets within the texts."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = spans(_TOKEN[data])
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    first = np.searchsorted(starts, at)
    offset = np.repeat(at[:-1], np.diff(first))
    return span_hashes(data, starts, ends), first, starts - offset, ends - offset


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Running Karp-Rabin hash of every window of ``size`` tokens."""
    if len(tokens) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(tokens) + 1, _BASE)) * np.uint64(pow(int(_BASE), -1, 1 << 64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * powers[:-1], dtype=np.uint64)))
        # Each window's sum is scaled to the same power before it is compared.
        return mix64((sums[size:] - sums[:-size]) * powers[:len(tokens) - size + 1][::-1])


class Seeds:
    """The items of a slice, laid end to end, and where each seed stands in them."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        self.ids = ids
        self.tokens, self.first, _, _ = tokens_of(texts)
        hashes, place = [], []
        for a, b in zip(self.first, self.first[1:]):
            h = seed_hashes(self.tokens[a:b])
            hashes.append(h)
            place.append(np.arange(a, a + len(h)))
        hashes, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (hashes, place))
        order = np.argsort(hashes, kind="stable")
        self.hashes, start = np.unique(hashes[order], return_index=True)
        self.place, self.bounds = place[order], np.append(start, len(order))

    def candidates(self, hits: np.ndarray, threshold: float) -> np.ndarray:
        """Items whose tokens under the seeds ``hits`` (numbers) reach the threshold."""
        places = np.concatenate([self.place[self.bounds[h]:self.bounds[h + 1]] for h in hits])
        covered = np.unique((places[:, None] + np.arange(MIN_MATCH)).ravel())
        item = np.searchsorted(self.first, covered, side="right") - 1
        numbers, counts = np.unique(item, return_counts=True)
        return numbers[counts >= threshold * (self.first[numbers + 1] - self.first[numbers])]


def seed_hashes(tokens: np.ndarray) -> np.ndarray:
    """A position-free hash of every run of ``MIN_MATCH`` tokens."""
    n = len(tokens) - MIN_MATCH + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = tokens[:n].copy()
        for k in range(1, MIN_MATCH):
            out = mix64(out * _BASE + tokens[k:n + k])
    return out


def common_windows(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, size: int):
    """Unmarked windows of both sides whose hashes occur on the other: positions and hashes."""
    both = windows(np.concatenate((item, doc)), size)
    out = []
    for at, free in ((0, free_item), (len(item), free_doc)):
        n = len(free) - size + 1
        if n <= 0:
            return None
        taken = np.concatenate(([0], np.cumsum(~free)))
        place = np.flatnonzero(taken[size:] == taken[:-size])
        out.append((place, both[at + place]))
    (p, hp), (d, hd) = out
    p_in, d_in = np.isin(hp, hd), np.isin(hd, hp)
    return (p[p_in], hp[p_in], d[d_in], hd[d_in]) if p_in.any() else None


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item position, document position, length)`` in the order of marking."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    top = min(len(item), len(doc))
    while top >= least:
        low, high, found = least, top, None
        while low <= high:  # a common window of some size holds one of every smaller size
            size = (low + high) // 2
            if (now := common_windows(item, doc, free_item, free_doc, size)) is not None:
                found, low = (size, now), size + 1
            else:
                high = size - 1
        if found is None:
            break
        top, (places, hashes, doc_places, doc_hashes) = found
        where = defaultdict(list)
        for d, h in zip(doc_places.tolist(), doc_hashes.tolist()):
            where[h].append(d)
        marked = False
        for p, h in zip(places.tolist(), hashes.tolist()):
            if not free_item[p:p + top].all():
                continue
            for d in where[h]:
                if free_doc[d:d + top].all() and np.array_equal(item[p:p + top], doc[d:d + top]):
                    free_item[p:p + top] = free_doc[d:d + top] = False
                    out.append((p, d, top))
                    marked = True
                    break
        if not marked:  # only hashes agreed
            top -= 1
    return out


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    items = id_and_text(benchmark, id_col, text_col)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == k).orderBy("doc_id", "text").collect()
        yield [r.doc_id for r in rows], [r.text.encode() for r in rows]


def matches(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every input row with its contaminating items.

    ``doc_id, items``: an array of ``(item_id, coverage, tiles)`` by item id, empty for a clean
    document; a tile is ``(item_token, n_tokens, start, end)`` with byte offsets in the text.
    """
    return _passes(id_and_text(df, id_col, text_col), ["doc_id"], benchmark, threshold, item_col, item_text_col)


_TILES = pa.list_(pa.struct([("item_token", pa.int64()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_ITEMS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", _TILES)]))
_ITEMS_DDL = "array<struct<item_id: bigint, coverage: double, tiles: array<struct<item_token: bigint, n_tokens: bigint, start: bigint, end: bigint>>>>"


def _passes(source: DataFrame, kept: list[str], benchmark: DataFrame, threshold: float, item_col: str, item_text_col: str,
            keep_text: bool = False) -> DataFrame:
    """One pass over ``source`` (columns ``kept`` and ``text``) per slice; each adds its items.

    A pass is written before the next begins, so that one slice and one worker per task are in memory at a time.
    """
    spark = source.sparkSession
    out = source.select(*kept, "text", F.expr(f"CAST(array() AS {_ITEMS_DDL})").alias("items"))
    shared = None
    for ids, texts in _slices(benchmark, item_col, item_text_col):
        if shared is not None:
            out = materialize(out, "tiling-slice")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(Seeds(ids, texts))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = shared.value
            for batch in pieces(batches):
                found = _scan(seeds, byte_texts(batch), threshold)
                # Every batch gets the column anew: all batches of a task have one schema.
                at = batch.schema.get_field_index("items")
                joined = [sorted(old + new, key=lambda x: (x["item_id"] is not None, x["item_id"] or 0, -x["coverage"]))
                          for old, new in zip(batch.column(at).to_pylist(), found)]
                batch = batch.set_column(at, "items", pa.array(joined, _ITEMS))
                yield batch

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]]
        out = out.mapInArrow(lean(scan), ", ".join([*fields, f"items {_ITEMS_DDL}"]))
    return out if keep_text else out.drop("text")


def _scan(seeds: Seeds, texts: list[bytes], threshold: float) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        tokens, first, starts, ends = tokens_of(texts[at:end])
        hashes = seed_hashes(tokens)
        if len(hashes) and len(seeds.hashes):
            number = np.minimum(np.searchsorted(seeds.hashes, hashes), len(seeds.hashes) - 1)
            place = np.flatnonzero(seeds.hashes[number] == hashes)
            owner = np.searchsorted(first, place, side="right") - 1
            inside = place + MIN_MATCH <= first[owner + 1]
            place, owner = place[inside], owner[inside]
            docs, begin = np.unique(owner, return_index=True)
            for doc, hits in zip(docs, np.split(number[place], begin[1:])):
                a, b = first[doc], first[doc + 1]
                for item in seeds.candidates(np.unique(hits), threshold):
                    mine = seeds.tokens[seeds.first[item]:seeds.first[item + 1]]
                    tiles = tile(mine, tokens[a:b])
                    coverage = sum(t[2] for t in tiles) / len(mine)
                    if coverage >= threshold:
                        out[at + doc].append({"item_id": seeds.ids[item], "coverage": coverage, "tiles": [
                            {"item_token": p, "n_tokens": n, "start": int(starts[a + d]), "end": int(ends[a + d + n - 1])} for p, d, n in sorted(tiles)]})
        at = end
    return out


def contaminated(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, contaminated, coverage`` (of the best covered item) and ``item_ids`` per input row."""
    items = F.col("items")
    return matches(df, benchmark, threshold, id_col, text_col, item_col, item_text_col).select(
        "doc_id", (F.size(items) > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(items, lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.transform(items, lambda x: x["item_id"]).alias("item_ids"))


def clean_rows(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that no item contaminates."""
    # The text is sent to the workers once, under its name here; a null one stays null.
    names = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(df.columns)}
    source = df.select(*[F.col(f"`{c}`").cast("string").alias(n) if c == text_col else F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = _passes(source, [n for n in names.values() if n != "text"], benchmark, threshold, item_col, item_text_col, keep_text=True)
    return out.filter(F.size("items") == 0).select(*[F.col(n).cast(df.schema[c].dataType).alias(c) for c, n in names.items()])
