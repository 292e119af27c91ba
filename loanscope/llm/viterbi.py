"""Operator 3: token counts by a count-only Viterbi pass.

An Aho-Corasick automaton over the unigram vocabulary lists every piece that
ends at a position; dynamic programming carries the best score and the number of
pieces of that best path, never the path itself.

The tokenizer counted is the tokenizers library's Unigram model over the pieces
and scores of a sentencepiece file, with byte fallback and the Metaspace
pre-tokenizer (a piece never spans a space). Its tie rule: a position keeps the
path found first, and paths are found by ascending start, so of equal scores the
longer last piece wins. A character without a piece of its own costs the lowest
score less 10 and counts one token per byte.

Defined cases: a null or empty text has no tokens and score 0; repeated rows come
back repeated; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, byte_texts, id_and_text, pieces

#: Fixed value of the counted tokenizer: what an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Fixed value: the mark that stands for a space.
MARK = "▁"


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class CountingViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                scores[piece] = score
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.single = {p for p in scores if len(p) == 1}
        self.chunks = Memo(lambda c: self.best(MARK + c.decode()))

    def best(self, word: str) -> tuple[int, float]:
        """Tokens and score of the best segmentation of ``word``."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, found in self.automaton.iter(word):
            ends[last].append(found)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best, pieces = None, 0
            for length, value in sorted(ends[end - 1], reverse=True):
                total = score[end - length] + value
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
            char = word[end - 1]
            if char not in self.single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[end - 1] + len(char.encode())
            score[end], count[end] = best, pieces
        return count[n], score[n]

    def count(self, text: bytes) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(MARK.encode(), b" ")
        words = (text[1:] if text[:1] == b" " else text).split(b" ")
        found = [self.chunks[w] for w in words]
        return sum([f[0] for f in found]), float(sum([f[1] for f in found]))


@lru_cache(maxsize=4)
def load(path: str) -> CountingViterbi:
    return CountingViterbi(read_vocabulary(path))


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, n_bytes, score``; score is the sum of the best path's piece scores."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("score", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = load(model_path)
        for batch in pieces(batches):
            texts = byte_texts(batch)
            found = [viterbi.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([f[1] for f in found], pa.float64()),
            ], schema=schema)
        viterbi.chunks.forget()

    return id_and_text(df, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long, n_bytes long, score double")
