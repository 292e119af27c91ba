"""Operator 4: language identification with a bidirectional gated recurrent network over bytes.

The network reads a text word by word (a word longer than ``WINDOW`` bytes in
windows of that length), forwards and backwards from a fresh state with a space
on either side, and gives every byte position a distribution over the learned
languages. A document's probabilities are the mean over its letter positions
(ASCII letters and bytes of non-ASCII characters). As a word's labels do not depend
on its neighbours, a task works each distinct word out once.

It is trained in numpy by backpropagation through time on words of a bounded
sample: at most ``TRAIN_DOCUMENTS`` documents and ``TRAIN_WORDS`` distinct words of
each language. Only the text of a document enters its prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text when there is nothing to learn from. Repeated rows come back repeated, an
empty table gives an empty table, other columns are ignored (``keep`` passes named
ones through).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, lean, pieces

TRAIN_DOCUMENTS, TRAIN_WORDS = 400, 3000
WINDOW, EMBED, HIDDEN = 32, 12, 16
EPOCHS, BATCH, RATE = 12, 128, 0.01
#: Bytes of text whose words are looked up together.
BLOCK = 2 << 20
#: Distinct words that a worker remembers.
CACHE_ENTRIES = 150_000
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def windows(word: bytes) -> list[bytes]:
    return [word[i:i + WINDOW] for i in range(0, len(word), WINDOW)]


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with a space before and spaces after each word, as rows; and the row lengths with one space after."""
    lengths = np.array([len(w) + 2 for w in words])
    width = int(lengths.max())
    return np.frombuffer(b"".join([(b" " + w).ljust(width) for w in words]), np.uint8).reshape(len(words), width), lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _mirrored(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Index that turns each row around within its own length (what is beyond stays)."""
    t = np.arange(rows.shape[1])
    return np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)


class ByteGRU:
    """Bidirectional GRU with a softmax on every position."""

    def __init__(self, languages: list[str], seed: int = 7):
        self.languages = languages
        rng = np.random.default_rng(seed)
        shape = {"embed": (256, EMBED), "out": (2 * HIDDEN, len(languages)), "out_b": (len(languages),)}
        for d in "fb":
            shape |= {f"w{d}": (EMBED, 3 * HIDDEN), f"u{d}": (HIDDEN, 3 * HIDDEN), f"b{d}": (3 * HIDDEN,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 and k != "embed" else rng.normal(0, 0.5, s) if k == "embed" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def _run(self, rows: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        p, h = self.p, np.zeros((len(rows), HIDDEN), np.float32)
        inputs, u = p["embed"] @ p[f"w{d}"] + p[f"b{d}"], p[f"u{d}"]
        states, trace = np.empty((rows.shape[1], len(rows), HIDDEN), np.float32), []
        for t in range(rows.shape[1]):
            x, a = inputs[rows[:, t]], h @ u
            gate = _sigmoid(x[:, :2 * HIDDEN] + a[:, :2 * HIDDEN])
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN:] + r * a[:, 2 * HIDDEN:])
            if keep:
                trace.append((h, z, r, n, a[:, 2 * HIDDEN:]))
            h = n + z * (h - n)
            states[t] = h
        return states.transpose(1, 0, 2), trace

    def _forward(self, rows: np.ndarray, lengths: np.ndarray, keep: bool = False):
        turn = _mirrored(rows, lengths)
        ahead, trace_f = self._run(rows, "f", keep)
        back, trace_b = self._run(np.take_along_axis(rows, turn, 1), "b", keep)
        both = np.concatenate((ahead, np.take_along_axis(back, turn[:, :, None], 1)), axis=2)
        logits = both @ self.p["out"] + self.p["out_b"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), both, turn, trace_f, trace_b

    def _in_batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Indices, rows and distributions of words of like length (at most ``WINDOW`` bytes each)."""
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(order), 1024):
            part = order[at:at + 1024]
            rows, lengths = _padded([words[i] for i in part])
            yield part, rows, self._forward(rows, lengths)[0]

    def pooled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the letter positions' distributions and the number of such positions, per word."""
        sums, counts = np.zeros((len(words), len(self.languages))), np.zeros(len(words), dtype=np.int64)
        for part, rows, probs in self._in_batches(words):
            letters = _LETTER[rows]
            sums[part] = np.einsum("bt,btk->bk", letters.astype(np.float32), probs)
            counts[part] = letters.sum(axis=1)
        return sums, counts

    def label_positions(self, text: str) -> list[tuple[int, int, str]]:
        """``(byte offset, byte length, language)`` of the runs of equally labelled positions, word by word."""
        out, at, raw = [], 0, text.encode()
        for word in raw.split():
            at = raw.index(word, at)
            for part in windows(word):
                (_, _, probs), = self._in_batches([part])
                for k, c in enumerate(probs[0, 1:len(part) + 1].argmax(axis=1)):
                    if out and out[-1][2] == self.languages[c] and sum(out[-1][:2]) == at + k:
                        out[-1] = (out[-1][0], out[-1][1] + 1, out[-1][2])
                    else:
                        out.append((at + k, 1, self.languages[c]))
                at += len(part)
        return out

    def _gradients(self, rows: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        probs, both, turn, trace_f, trace_b = self._forward(rows, lengths, keep=True)
        share = (np.arange(rows.shape[1]) < lengths[:, None]) * weight[:, None]
        d_logit = probs
        d_logit[np.arange(len(rows)), :, target] -= 1
        d_logit *= (share / share.sum()).astype(np.float32)[:, :, None]
        flat = both.reshape(-1, 2 * HIDDEN)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["out_b"] = flat.T @ d_logit.reshape(-1, len(self.languages)), d_logit.sum(axis=(0, 1))
        d_both = d_logit @ self.p["out"].T
        for d, trace, rows_d, d_state in (("f", trace_f, rows, d_both[:, :, :HIDDEN]),
                                          ("b", trace_b, np.take_along_axis(rows, turn, 1), np.take_along_axis(d_both[:, :, HIDDEN:], turn[:, :, None], 1))):
            u, d_input = self.p[f"u{d}"], np.zeros((256, 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(rows), HIDDEN), np.float32)
            for t in range(len(trace) - 1, -1, -1):
                h, z, r, n, a = trace[t]
                d_h = d_h + d_state[:, t]
                d_n = d_h * (1 - z) * (1 - n * n)
                d_gate = np.concatenate((d_h * (h - n) * z * (1 - z), d_n * a * r * (1 - r)), axis=1)
                d_a = np.concatenate((d_gate, d_n * r), axis=1)
                np.add.at(d_input, rows_d[:, t], np.concatenate((d_gate, d_n), axis=1))
                g[f"u{d}"] += h.T @ d_a
                d_h = d_h * z + d_a @ u.T
            g[f"w{d}"], g[f"b{d}"] = self.p["embed"].T @ d_input, d_input.sum(axis=0)
            g["embed"] += d_input @ self.p[f"w{d}"].T
        return g

    def fit(self, words: list[bytes], target: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> "ByteGRU":
        """Adam on the mean cross-entropy of all positions; batches hold words of like length."""
        rng = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        sizes = np.array([len(w) for w in words])
        for epoch in range(epochs):
            order = np.lexsort((rng.random(len(words)), sizes))
            starts = np.arange(0, len(words), BATCH)
            rng.shuffle(starts)
            for at in starts:
                part = order[at:at + BATCH]
                rows, lengths = _padded([words[i] for i in part])
                grads = self._gradients(rows, lengths, target[part], weight[part])
                norm = float(np.sqrt(sum(float((v * v).sum()) for v in grads.values())))
                step += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for k, v in grads.items():
                    v = v * min(1.0, 1.0 / max(norm, 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self


def training_words(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes, int]]:
    """``(language, word, times)``: the most frequent words of the sampled documents of each language."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(F.col(id_col)).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return []
    # Twice the wanted share by hash, then exactly the bound: the rank sees a bounded number of rows.
    limit = reduce(lambda c, kv: c.when(F.col("lang") == kv[0], int(min(1.0, 2 * TRAIN_DOCUMENTS / kv[1]) * (1 << 20)) + 1),
                   sorted(totals.items()), F.when(F.lit(False), 0))
    picked = (rows.filter(F.pmod("h", F.lit(1 << 20)) < limit)
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= TRAIN_DOCUMENTS))
    words = (picked.select("lang", F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word"))
             .select("lang", F.expr(f"left(word, {WINDOW})").alias("word")).filter("word <> ''")
             .groupBy("lang", "word").agg(F.count("*").alias("n")))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    found = words.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= TRAIN_WORDS).orderBy("lang", "rank").collect()
    return [(r.lang, r.word.encode()[:WINDOW], r.n) for r in found]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteGRU | None:
    """The model of the labelled rows given, or None without any."""
    found = training_words(labelled, id_col, text_col, lang_col)
    found = [f for f in found if _LETTER[np.frombuffer(f[1], np.uint8)].any()]
    if not found:
        return None
    languages = sorted({f[0] for f in found})
    number = {k: i for i, k in enumerate(languages)}
    target = np.array([number[f[0]] for f in found])
    weight = np.sqrt(np.array([f[2] for f in found], dtype=np.float64))
    weight /= np.bincount(target, weights=weight)[target]  # every language weighs the same
    return ByteGRU(languages).fit([f[1] for f in found], target, weight)


class Pool:
    """Sums of letter positions' probabilities by word, worked out once for each distinct word."""

    def __init__(self, model: ByteGRU):
        self.model, self.index, self.sums, self.counts = model, {}, [], []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        missing = list({w for w in words if w not in index})
        if missing:
            sums, counts = np.zeros((len(missing), len(self.model.languages))), np.zeros(len(missing), dtype=np.int64)
            cuts = [(i, w) for i, w in enumerate(missing) if len(w) <= WINDOW]
            cuts += [(i, part) for i, w in enumerate(missing) if len(w) > WINDOW for part in windows(w)]
            owner = np.array([i for i, _ in cuts])
            for at in range(0, len(cuts), 1 << 16):
                some, n = self.model.pooled([w for _, w in cuts[at:at + (1 << 16)]])
                np.add.at(sums, owner[at:at + (1 << 16)], some)
                np.add.at(counts, owner[at:at + (1 << 16)], n)
            index.update(zip(missing, range(len(index), len(index) + len(missing))))
            self.sums = np.concatenate((self.sums, sums)) if len(self.sums) else sums
            self.counts = np.concatenate((self.counts, counts)) if len(self.counts) else counts
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text (rows of zeros without letters)."""
        out, at = np.zeros((len(texts), len(self.model.languages))), 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                size += len(texts[end])
                end += 1
            if len(self.index) > CACHE_ENTRIES:
                self.index, self.sums, self.counts = {}, [], []
            split = [t.split() for t in texts[at:end]]
            numbers = self.numbers([w for words in split for w in words])
            if len(numbers):
                owner = np.repeat(np.arange(len(split)), [len(w) for w in split])
                letters = np.bincount(owner, weights=self.counts[numbers], minlength=len(split))
                for c in range(out.shape[1]):
                    out[at:end, c] = np.bincount(owner, weights=self.sums[numbers, c], minlength=len(split)) / np.maximum(letters, 1)
            at = end
        return out


def predict(df: DataFrame, model: ByteGRU | None, text_col: str = "text", keep: list[str] | None = None,
            lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` (default: all but those called as the results) with ``lang_pred`` and ``score`` added, row by row."""
    keep = [c for c in df.columns if c.lower() not in (lang_pred.lower(), score.lower())] if keep is None else keep
    kept = [F.col(f"`{c}`") for c in keep]
    # A text that is kept anyway is sent to the workers once.
    read = text_col if text_col in keep and df.schema[text_col].dataType.simpleString() == "string" else "__text"
    source = df.select(*kept, *([F.col(text_col).cast("string").alias(read)] if read == "__text" else []))
    n = len(keep)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(model) if model is not None else None
        for batch in pieces(batches):
            texts = byte_texts(batch, read)
            letters = [has_letter(t) for t in texts]
            if pool is None:
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            else:
                probs = pool.documents(texts)
                best = probs.argmax(axis=1)
                names = [pool.model.languages[b] if x else UNDETERMINED for b, x in zip(best, letters)]
                scores = np.where(letters, np.clip(probs.max(axis=1), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names[:n], lang_pred, score])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n]]
    return source.mapInArrow(lean(label), ", ".join([*fields, f"`{lang_pred}` string", f"`{score}` double"]))

