"""Operator 6: BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so
every such pair is a certain cut. A word is cut there, the fragments are merged
independently, and their ids are concatenated (equal words once per worker).
Normalisation and pre-tokenisation are the tokenizer file's own.

White space ends a word in these tokenizers, so a text's ids are those of its
white-space separated chunks in a row.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows come back repeated; an empty table gives an empty table; other
columns are ignored. Special tokens written out in a text are their own ids, as
the tokenizers library has it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkWords
from .common import Memo, byte_texts, id_and_text, lean, pieces

#: Below this length a fragment is merged by scanning, above it with a heap.
SCAN_LENGTH = 24
#: Entries in each of the two generations of the lookups of words and of chunks.
CACHE_ENTRIES = 180_000
#: Ends a list within a looked up value; this byte is in no UTF-8 text.
END = b"\xff"


def parted(found: list[bytes]) -> tuple[bytes, bytes]:
    """The ids and the token texts of looked up values in a row."""
    lists = b"".join(found).split(END)
    return b"".join(lists[::2]), b"".join(lists[1::2])


class ForcedBoundaryBPE:
    """BPE with an end-of-word suffix, as given by a tokenizers JSON file."""

    def __init__(self, path: str):
        self.split = ChunkWords(path)
        model = self.split.spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.tokens = {i: t for t, i in (self.ids | self.split.added).items()}
        bare = [t.removesuffix(self.suffix) for t in self.ids]
        self.inside = {t[i:i + 2] for t in bare for i in range(len(t) - 1)}
        self.words = Memo(self._word, CACHE_ENTRIES)
        self.chunks = Memo(self._chunk, CACHE_ENTRIES)

    def cut(self, word: str) -> list[str]:
        """The fragments of a word of byte symbols; the last one carries the word-end suffix."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in inside:
                out.append(word[start:i])
                start = i
        out.append(word[start:] + self.suffix)
        return out

    def _merge(self, fragment: str) -> tuple[int, ...]:
        """Merge the lowest ranked pair, leftmost first, until none is left."""
        if (whole := self.ids.get(fragment)) is not None and len(fragment.removesuffix(self.suffix)) == 1:
            return (whole,)
        symbols = list(fragment.removesuffix(self.suffix))
        if fragment.endswith(self.suffix):
            symbols[-1] += self.suffix
        if len(symbols) > SCAN_LENGTH:
            symbols = self._merge_long(symbols)
        else:
            ranks, never = self.ranks, len(self.ranks)
            order = [ranks.get(p, never) for p in zip(symbols, symbols[1:])]
            while order and (best := min(order)) < never:
                i = order.index(best)
                symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
                del order[i]
                if i:
                    order[i - 1] = ranks.get((symbols[i - 1], symbols[i]), never)
                if i < len(order):
                    order[i] = ranks.get((symbols[i], symbols[i + 1]), never)
        return tuple(self.ids[s] for s in symbols)

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a linked list and a heap: O(n log n) for long fragments."""
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        live: list[str | None] = list(symbols)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) >= 0 and (r := ranks.get((live[k], live[m]))) is not None:
                    heapq.heappush(heap, (r, k, live[k], live[m]))
        return [s for s in live if s is not None]

    def _word(self, word: str) -> bytes:
        """Decimal ids and token texts of a word, each followed by a space, and ``END`` after either list."""
        if word in self.split.added:
            ids = [self.split.added[word]]
        else:
            ids = [i for fragment in self.cut(word) for i in self._merge(fragment)]
        return b"".join([b"%d " % i for i in ids]) + END + "".join([self.tokens[i] + " " for i in ids]).encode() + END

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # letters A-Z alone are one word
            low = chunk.lower()
            return self._word(low.decode()) if low == chunk else self.chunks[low]
        # such a word within a chunk is looked up as the chunk that it is elsewhere
        found = [self.chunks[w.encode()] if w.isascii() and w.isalpha() and w.islower() else self.words[w]
                 for w in self.split.words(chunk.decode())]
        return found[0] if len(found) == 1 else END.join([*parted(found), b""])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in parted([self.chunks[c] for c in text.encode().split()])[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file names no decoder, and special tokens stay."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=4)
def load(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with ``with_ids`` also ``ids`` and ``decoded``."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        ddl += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in pieces(batches):
            cols: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                ids, tokens = parted([bpe.chunks[c] for c in text.split()])
                decoded = tokens[:-1]
                row = [doc_id, ids.count(b" "), sha256(ids[:-1]).hexdigest(), sha256(decoded).hexdigest()]
                if with_ids:
                    row += [[int(i) for i in ids.split()], decoded.decode()]
                for col, value in zip(cols, row):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        bpe.words.forget()
        bpe.chunks.forget()

    return id_and_text(df, id_col, text_col).mapInArrow(lean(encode), ddl)
