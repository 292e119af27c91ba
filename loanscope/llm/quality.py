"""Operator 7: quality rules with n-gram perplexity.

A modified Kneser-Ney model of order 4 over bytes is counted and worked out by Spark
from all documents; every byte value is a symbol of its own and no n-gram is left out.
The more frequent n-grams, ``COMMON`` at most, go to every task as two arrays sorted by
n-gram hash: hashes and log10 probabilities. The n-grams of a document that are not
among them are listed with it and meet the rest of the model in a join, so the sum over
a document is exact at any size of the model.

A document's perplexity is held against a band of its language (column ``lang``;
null is a language of its own) around the median log perplexity of the language's
documents that pass the base rules. As the mean over n words scatters with 1/sqrt(n),
the band reaches ``WIDTH`` times the spread over sqrt(n) to either side, ``LEAST`` at
least; the spread is half the interquartile range of the deviations times sqrt(n).
All quartiles come from exact histograms in steps of ``STEP``.

Base rules: fewer than 50 words, or more than half of the words inside repeated
3-word windows, fail.

Defined cases: a null or empty text has no words and fails the base rules;
repeated rows come back repeated and count in the statistics each time; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanscope.session import materialize

from .common import byte_texts, id_and_text, lean, mix64, pieces

ORDER, BYTES = 4, 256
#: The most n-grams that go to every task; the others are joined.
COMMON = 1 << 20
#: N-grams a counting task holds before it passes them on.
HELD = 1 << 21
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
WIDTH, LEAST, STEP = 7.0, 0.03, 0.001
#: Bytes of text turned into n-gram codes at a time.
BLOCK = 4 << 20
_SYMBOLS = b"#*$%&|<>"
#: Symbols of the coarse alphabet (:data:`CLASSES`), which :func:`judge` does not use.
ALPHABET = 40
_START = 27


def _classes() -> np.ndarray:
    """A coarse alphabet: letters without case, space, line end, digit, kinds of marks, other bytes by residue."""
    out = np.full(256, 32, dtype=np.int32)
    for k in range(26):
        out[97 + k] = out[65 + k] = k
    out[[32, 9, 11, 12]] = 26
    out[[10, 13]] = _START
    out[48:58] = 28
    out[list(b".,;:!?")] = 29
    out[list(b"'\"-()/")] = 30
    out[list(_SYMBOLS)] = 31
    out[128:] = 33 + np.arange(128) % 7
    return out


CLASSES = _classes()
EVERY_BYTE = np.arange(BYTES, dtype=np.uint32)


def codes_of(texts: list[bytes], classes: np.ndarray = CLASSES, alphabet: int = ALPHABET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-gram codes of the texts in blocks, and each code's text; every text begins after line ends and closes with one."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        lengths = np.array([len(t) + 1 for t in part])
        data = classes[np.frombuffer(b"\n\n\n" + b"\n\n\n\n".join(part) + b"\n", dtype=np.uint8)]
        codes = ((data[:-3] * alphabet + data[1:-2]) * alphabet + data[2:-1]) * alphabet + data[3:]
        owner = np.repeat(np.arange(len(part)), lengths)
        # Between two texts stand three padding symbols: no n-gram ends on them.
        yield codes[np.arange(len(owner)) + 3 * owner], owner + at
        at = end


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of codes and their summed counts."""
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] + 1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def counted_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``code, n`` of the byte n-grams of the column ``text``.

    At most some ``HELD`` n-grams are held; where there are more, what is counted so far is passed on.
    """
    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _summed(parts)], names=["code", "n"])

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in pieces(batches):
        for codes, _ in codes_of(byte_texts(batch), EVERY_BYTE, BYTES):
            parts.append(np.unique(codes, return_counts=True))
            if sum(len(c) for c, _ in parts) > HELD:
                parts = [_summed(parts)]
                if len(parts[0][0]) > HELD // 2:
                    yield told()
                    parts = []
    if parts:
        yield told()


def count_ngrams(df: DataFrame) -> DataFrame:
    """``code, n`` of the byte n-grams of the column ``text``, summed per task before the shuffle."""
    counted = df.select("text").mapInArrow(lean(counted_batches), "code long, n long")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(times: list[int]) -> list[float]:
    """What is taken off counts of 0, 1, 2, and 3 or more, from how many n-grams occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(1, int(n)) for n in times)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [1, 0.95, 1.9, 2.85]).tolist()


def model_of(counted: DataFrame, alphabet: int = BYTES) -> DataFrame:
    """``code, n, p``: the interpolated modified Kneser-Ney probability of each n-gram of the highest order, from its ``code, n``."""
    grams = {ORDER: counted}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct left extensions
        shorter = (F.col("code") % alphabet ** n).alias("code")
        grams[n] = materialize(grams[n + 1].groupBy(shorter).agg(F.count("*").alias("n")), "quality-ngrams")
    context, model = Window.partitionBy("context"), None  # a context has ``alphabet`` n-grams at most
    for n in range(1, ORDER + 1):
        _, d1, d2, d3 = _discounts(grams[n].agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ones, twos = (F.count_if(F.col("n") == k).over(context) for k in (1, 2))
        some = grams[n].withColumn("context", F.expr(f"code div {alphabet}")).withColumns({
            "total": F.sum("n").over(context), "ones": ones, "twos": twos, "all": F.count("*").over(context)})
        mass = (F.col("ones") * d1 + F.col("twos") * d2 + (F.col("all") - F.col("ones") - F.col("twos")) * d3) / F.col("total")
        if model is None:
            back = F.lit(1.0 / alphabet)
        else:
            lower = model.select(F.col("code").alias("_ending"), F.col("p").alias("_lower"))
            some, back = some.join(lower, F.col("code") % alphabet ** (n - 1) == F.col("_ending")), F.col("_lower")
        model = some.select("code", "n", ((F.col("n") - off) / F.col("total") + mass * back).alias("p"))
    return model


def kneser_ney(codes: np.ndarray, counts: np.ndarray, alphabet: int = ALPHABET) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram hashes and log10 probabilities of :func:`model_of` for a few n-grams, in arrays."""
    grams = {ORDER: (codes.astype(np.int64), counts.astype(np.int64))}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct left extensions
        grams[n] = np.unique(grams[n + 1][0] % alphabet ** n, return_counts=True)
    lower = np.full(alphabet, 1.0 / alphabet)
    lower_codes = np.arange(alphabet)
    for n in range(1, ORDER + 1):
        code, count = grams[n]
        order = np.argsort(code)
        code, count = code[order], count[order]
        off = np.array(_discounts([(count == k).sum() for k in (1, 2, 3, 4)]))[np.minimum(count, 3)]
        _, context = np.unique(code // alphabet, return_inverse=True)
        total = np.bincount(context, weights=count)
        mass = np.bincount(context, weights=off) / total
        back = lower[np.searchsorted(lower_codes, code % alphabet ** (n - 1) if n > 1 else code)]
        lower, lower_codes = (count - off) / total[context] + mass[context] * back, code
    keys = mix64(lower_codes.astype(np.uint64))
    order = np.argsort(keys)
    return keys[order], np.log10(lower[order])


def look_up(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Log10 probability by n-gram code of the coarse alphabet, from the sorted hash arrays; never seen n-grams cost the least seen."""
    wanted = mix64(np.arange(ALPHABET ** ORDER, dtype=np.uint64))
    if not len(keys):
        return np.full(len(wanted), -np.log10(ALPHABET))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.min())


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        if len(number) < n:
            pairs = ids[:-1] * len(number) + ids[1:]
            if len(number) < 1 << 20:
                windows = pairs[:-1] * len(number) + ids[2:]
            else:
                windows = np.unique(pairs[:-1], return_inverse=True)[1] * len(number) + ids[2:]
            _, kind, times = np.unique(windows, return_inverse=True, return_counts=True)
            hit = times[kind] > 1
            marked = np.zeros(n, dtype=bool)
            for k in range(3):
                marked[k:n - 2 + k] |= hit
            repeated = int(marked.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


class Common:
    """Log10 probabilities of n-grams, sorted by hash; the hash's first bits tell where a search begins."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        keys = mix64(codes.astype(np.uint64))
        order = np.argsort(keys)
        # behind the last key stands one that is never smaller
        self.keys, self.values = np.append(keys[order], ~np.uint64(0)), np.append(values[order], 0.0)
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code, zero where it is not held, and the places of those."""
        wanted = mix64(codes.astype(np.uint64))
        at = self.starts[wanted >> self.shift]
        left = np.flatnonzero(self.keys[at] < wanted)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < wanted[left]]
        missing = np.flatnonzero((self.keys[at] != wanted) | (at == len(self.keys) - 1))
        values = self.values[at]
        values[missing] = 0.0
        return values, missing


def _figures(docs: DataFrame, common: Common) -> DataFrame:
    """Per row the base figures, ``n_bytes``, ``log`` (the sum over its common n-grams) and ``rest`` (its other n-grams)."""
    model = docs.sparkSession.sparkContext.broadcast(common)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = byte_texts(batch)
            log, others, owners = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for codes, owner in codes_of(texts, EVERY_BYTE, BYTES):
                values, missing = model.value.find(codes)
                log += np.bincount(owner, weights=values, minlength=len(texts))
                others.append(codes[missing].astype(np.int64))
                owners.append(owner[missing])
            ends = np.searchsorted(np.concatenate(owners), np.arange(len(texts) + 1)).astype(np.int32)
            figures = [base_figures(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *(pa.array([f[k] for f in figures], pa.int64()) for k in range(5)),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(log), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(others)))],
                names=["doc_id", "lang", *names, "n_bytes", "log", "rest"])

    return docs.mapInArrow(lean(measure), f"doc_id long, lang string, {', '.join(f'{n} long' for n in names)}, n_bytes long, log double, rest array<long>")


def measured_rows(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """The base figures and ``level``, the negative mean log10 probability per byte, of each row of ``doc_id, text, lang``."""
    model = materialize(model_of(materialize(count_ngrams(docs), "quality-ngrams")), "quality-model")
    size = F.length(F.bin("n"))  # binary digits of the count
    taken, least = 0, 65
    sizes = {r["size"]: r["many"] for r in model.groupBy(size.alias("size")).agg(F.count("*").alias("many")).collect()}
    for digits in sorted(sizes, reverse=True):
        if taken + sizes[digits] > common:
            break
        taken, least = taken + sizes[digits], digits
    held = model.filter(size >= least).select("code", "p").toPandas()  # ``common`` rows at most
    rows = _figures(docs, Common(held["code"].to_numpy(dtype=np.int64), np.log10(held["p"].to_numpy(dtype=np.float64))))
    level = lambda log: (-log / (F.col("n_bytes") + 1)).alias("level")
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if taken == sum(sizes.values()):
        return materialize(rows.select(*names, level(F.col("log"))), "quality")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "quality-rows")
    rest = model.filter(size < least).select("code", F.log10("p").alias("value"))
    found = rows.select("row", F.explode("rest").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times")).join(rest, "code")
    found = found.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("rest_log"))
    return materialize(rows.join(found, "row", "left").select(*names, level(F.col("log") + F.coalesce("rest_log", F.lit(0.0)))), "quality")


def _quartiles(values: DataFrame) -> DataFrame:
    """``of, q25, q50, q75`` of the column ``x`` per ``lang``, from an exact histogram in steps of ``STEP``."""
    histogram = values.groupBy("lang", F.round(F.col("x") / STEP).cast("long").alias("step")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    at = [F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("step") * STEP)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return ranked.groupBy("lang").agg(*at).withColumnRenamed("lang", "of")


def bands(measured: DataFrame) -> DataFrame:
    """``of`` (language), ``middle`` and ``spread``: a document of n words may lie
    ``max(LEAST, WIDTH * spread / sqrt(n))`` below or above the middle."""
    middle = _quartiles(measured.select("lang", F.col("level").alias("x"))).select("of", F.col("q50").alias("middle"))
    scaled = (F.col("level") - F.col("middle")) * F.sqrt("n_words")
    spread = _quartiles(measured.join(middle, F.col("lang").eqNullSafe(F.col("of"))).select("lang", scaled.alias("x")))
    spread = spread.select(F.col("of").alias("of2"), ((F.col("q75") - F.col("q25")) / 2).alias("spread"))
    return middle.join(spread, F.col("of").eqNullSafe(F.col("of2"))).drop("of2")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> DataFrame:
    """Per row: the base figures, ``base_failed``, ``kept`` and ``perplexity`` (per byte); at most ``common`` n-grams go to every task."""
    docs = id_and_text(df, id_col, text_col, F.col(lang_col).cast("string").alias("lang"))
    measured = measured_rows(docs, common)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    band = materialize(bands(measured.filter(~F.col("base_failed"))), "quality-bands")
    reach = F.greatest(F.lit(LEAST), WIDTH * F.col("spread") / F.sqrt("n_words"))
    inside = F.coalesce(F.abs(F.col("level") - F.col("middle")) <= reach, F.lit(False))
    return (measured.join(band, F.col("lang").eqNullSafe(F.col("of")), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & inside).alias("kept"), F.pow(F.lit(10.0), F.col("level")).alias("perplexity")))
