"""White-space separated chunks to the words of a tokenizers file's BPE model.

In these files white space ends a word and is dropped, so a text's words are those of its
chunks in a row, and a chunk's words are worked out once for all its occurrences.
"""

from __future__ import annotations

import json
import re

#: What the file's split pattern (a fixed value) comes to on lower-case printable ASCII and Latin-1 letters.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level BPE: itself if visible in Latin-1, else from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


_SYMBOLS = byte_symbols()
_LATIN = {c: "".join(_SYMBOLS[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


#: Chunks that a file must split as above.
_PROBES = ("don't", "AB12cd", "x_y-z", "ÀÉßé", "it's9!?", "1,234.5")


class ChunkWords:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.added: dict[str, int] = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        if self.lib.normalizer is None or self.lib.pre_tokenizer is None:
            raise ValueError(f"{path}: words are split at white space and lower-cased here, but the file has no such rules")
        self._normalize, self._split = self.lib.normalizer.normalize_str, self.lib.pre_tokenizer.pre_tokenize_str

        for probe in _PROBES:
            if self.words(probe) != [w for w, _ in self._split(self._normalize(probe))]:
                raise ValueError(f"{path}: its words are not split as this module splits them ({probe})")

    def words(self, chunk: str) -> list[str]:
        """Words in byte symbols, and special tokens as they stand (they are keys of ``added``)."""
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:  # no character that normalisation would change but for case
            low = chunk.lower()
            return _WORDS.findall(low) if low.isascii() else [w.translate(_LATIN) for w in _WORDS.findall(low)]
        out: list[str] = []
        for piece in self._special.split(chunk):
            if piece in self.added:
                out.append(piece)
            elif piece:
                out += [w for w, _ in self._split(self._normalize(piece))]
        return out
