"""URL filter: rules first, a ratio of two character language models for all other URLs.

Rules name a host, with all its subdomains, and a beginning of the path; the longest that fits
decides. The URLs that a rule accepts or rejects train one model each, and the rest is judged by
the difference of the two log-likelihoods per character.

* Model: bytes of the URL after ``://`` between a begin and an end mark, in contexts of up to
  ``ORDER`` bytes. A context is kept where it holds at least ``SHARE`` of its model's training
  positions (a context's own suffixes are then kept too), so the order varies with what was
  seen, and at most ``1 / SHARE`` contexts of each order are kept at any size of the
  corpus. Kept contexts are mixed with the next shorter one by Witten and Bell's weights, down to
  256 equal bytes.
* Spark counts all bytes in all contexts, summed within tasks before the shuffle; only the
  entries of kept contexts reach the driver: at most ``(ORDER + 1) * 256 / SHARE`` a model, each of 16 bytes.
* Calibration: a fifth of the URLs with a rule, by the crc32 of the URL, trains nothing. The counts of their
  scores on a grid of a thousandth give the threshold with the least sum of both error rates
  (of equal ones the one nearest to zero). Without both kinds of URLs it is zero.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
judged as the empty text. Repeated rows count as often as they occur. An empty table has no
rows. A model without training text gives every byte 1/256. Long URLs are handled in windows of
positions. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
SHARE = 2.0 ** -13
HELD_OUT = 5
GRID, LIMIT = 1000, 20
BEGIN, END = 1, 2
#: Bytes of URLs handled at a time.
WINDOW = 1 << 18


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

ALLOW, BLOCK = "allow", "block"
MODELS = (ALLOW, BLOCK)


# --- parts of a URL and rules ---------------------------------------------------

def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    """Query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*[^?#]*(.*)", 1), F.lit(""))


def _longest(rules: Iterable[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits the columns host and path, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        host = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        out = F.when(host & F.startswith(F.col("path"), F.lit(r.path)), F.lit(value(r))).otherwise(out)
    return out


def with_parts(pages: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, the rule's verdict as ``told``, and ``shown``: what the models read."""
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), rest_of(url).alias("rest"))
    return parts.select(id_col, "host", "path", _longest(rules, lambda r: r.text).alias("rule"),
                        _longest(rules, lambda r: r.verdict).alias("told"), F.concat("host", "path", "rest").alias("shown"))


# --- bytes in contexts -------------------------------------------------------------

def _slices(column: pa.ChunkedArray | pa.Array) -> Iterator[list[bytes]]:
    """Texts as bytes, some at a time."""
    held, size = [], 0
    for text in column.cast(pa.large_binary()):
        held.append(text.as_py())
        size += len(held[-1]) + 2
        if size >= WINDOW:
            yield held
            held, size = [], 0
    if held:
        yield held


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Runs of positions: the text of each, its byte, and per order k the packed context (-1: none).

    A packed context is its bytes, the nearest lowest, below its length.
    """
    data = np.frombuffer(b"".join(bytes([BEGIN]) + t + bytes([END]) for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    for at in range(0, len(data), WINDOW):
        index = np.arange(at, min(at + WINDOW, len(data)))
        owner = np.searchsorted(starts, index, side="right") - 1
        depth = index - starts[owner]
        index, owner, depth = index[depth > 0], owner[depth > 0], depth[depth > 0]
        contexts, packed = [np.zeros(len(index), dtype=np.int64)], np.zeros(len(index), dtype=np.int64)
        for k in range(1, ORDER + 1):
            packed = packed | (data[np.maximum(index - k, 0)].astype(np.int64) << (8 * (k - 1)))
            contexts.append(np.where(depth >= k, packed | (k << (8 * ORDER)), -1))
        yield owner, data[index].astype(np.int64), contexts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(told, shown) to (told, code, n): a code is a packed context and the byte after it."""
    for batch in batches:
        told = np.array(batch.column("told").to_pylist(), dtype=object)
        for name in MODELS:
            texts = batch.column("shown").filter(pa.array(told == name))
            for some in _slices(texts):
                for _, byte, contexts in windows(some):
                    codes = np.concatenate([(c[c >= 0] << 8) | byte[c >= 0] for c in contexts])
                    code, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(code), pa.array(n.astype(np.int64))], names=["told", "code", "n"])


class Markov:
    """Counts of bytes in kept contexts, in sorted arrays."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order]
        self.contexts, first = np.unique(self.codes >> 8, return_index=True)
        self.totals = np.add.reduceat(self.counts, first) if len(first) else np.zeros(0, dtype=np.int64)
        self.kinds = np.diff(np.append(first, len(self.codes)))

    @staticmethod
    def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, asked)
        at[at == len(keys)] = 0
        return at, keys[at] == asked

    def probability(self, byte: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(byte), 1 / 256)
        if not len(self.codes):
            return p
        for context in contexts:
            at, known = self._found(self.contexts, context)
            entry, seen = self._found(self.codes, (context << 8) | byte)
            n, kinds = np.where(seen & known, self.counts[entry], 0), self.kinds[at]
            p = np.where(known, (n + kinds * p) / (self.totals[at] + kinds), p)
        return p


class UrlModel(NamedTuple):
    allow: Markov
    block: Markov

    def scores(self, column: pa.Array) -> np.ndarray:
        """(log P under allow - log P under block) per character, the end mark included."""
        out = []
        for some in _slices(column):
            total, size = np.zeros(len(some)), np.array([len(t) + 1 for t in some])
            for owner, byte, contexts in windows(some):
                ratio = np.log(self.allow.probability(byte, contexts)) - np.log(self.block.probability(byte, contexts))
                total += np.bincount(owner, weights=ratio, minlength=len(some))
            out.append(total / size)
        return np.concatenate(out) if out else np.zeros(0)


def train(parts: DataFrame, share: float = SHARE) -> UrlModel:
    """The two models of the rows with a verdict in ``told``, from ``shown``."""
    counts = parts.select("told", "shown").filter("told IS NOT NULL").mapInArrow(_counted, "told string, code long, n long")
    counts = counts.groupBy("told", "code").agg(F.sum("n").alias("n"))
    # The code keeps the context's length above its bytes; of length 0 there is one context, which holds all positions.
    by_context = counts.groupBy("told", F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("code", "n")).alias("entries"))
    positions = by_context.filter("context = 0").select(F.col("told").alias("_told"), F.col("total").alias("_all"))
    kept = (by_context.join(positions, F.col("told") == F.col("_told")).filter(F.col("total") >= F.col("_all") * share)
            .select("told", F.explode("entries").alias("e")).select("told", "e.code", "e.n").toPandas())
    models = []
    for name in MODELS:
        mine = kept[kept["told"] == name]
        models.append(Markov(mine["code"].to_numpy(dtype=np.int64), mine["n"].to_numpy(dtype=np.int64)))
    return UrlModel(*models)


def scored(parts: DataFrame, model: UrlModel) -> DataFrame:
    """``parts`` with ``score``; ``shown`` goes."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in parts.columns if c != "shown"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "shown")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column("shown"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(score)], names=[*kept, "score"])

    return parts.mapInArrow(judge, f"{fields}, score double")


def threshold_of(cells: list[tuple[str, int, int]]) -> float:
    """The grid value with the least sum of error rates, of (verdict, cell, count) rows: a score below it is rejected."""
    total = {name: sum(n for v, _, n in cells if v == name) for name in MODELS}
    if not all(total.values()):
        return 0.0
    by_cell: dict[int, dict[str, int]] = {}
    for v, cell, n in cells:
        by_cell.setdefault(cell, dict.fromkeys(MODELS, 0))[v] += n
    at = sorted(by_cell)
    lost = list(itertools.accumulate((by_cell[c][ALLOW] for c in at), initial=0))
    caught = list(itertools.accumulate((by_cell[c][BLOCK] for c in at), initial=0))
    errors = []
    for i, cell in enumerate([*at, at[-1] + 1]):
        # anything above the cell before gives the same errors: zero, if it lies there
        low = at[i - 1] + 1 if i else -LIMIT * GRID
        value = min(max(0, low), cell)
        errors.append((lost[i] / total[ALLOW] + (total[BLOCK] - caught[i]) / total[BLOCK], abs(value), value))
    return min(errors)[2] / GRID


def calibrate(parts: DataFrame, model: UrlModel) -> float:
    """The threshold for rows with a verdict in ``told``."""
    cell = F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.col("score"))) * GRID)
    rows = scored(parts.filter("told IS NOT NULL").select("told", "shown"), model).groupBy("told", cell.alias("cell")).count().collect()
    return threshold_of([(r["told"], r["cell"], r["count"]) for r in rows])


def held_out() -> Column:
    return F.crc32(F.col("shown").cast("binary")) % HELD_OUT == 0


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and score of every page."""
    parts = with_parts(pages, rules, id_col, url_col)
    model = train(parts.filter(~held_out()))
    threshold = calibrate(parts.filter(held_out()), model)
    verdict = F.coalesce("told", F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK))
    return scored(parts, model).select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
