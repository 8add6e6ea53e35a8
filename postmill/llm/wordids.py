"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

The library costs microseconds a word, and texts repeat their words. A text is therefore cut at ASCII white space,
which no token of such a tokenizer crosses, and the ids of every piece are kept in a bounded
table of the task. Words of letters only, with or without signs after them, go straight to the tokenizer's merges, all others
through its whole chain; both give what encoding the text as one gives. The library's defaults hold: a special token's
string in a text is that token.
"""

from __future__ import annotations

import os
import string
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from postmill.llm.words import spread, words

KEPT = 250_000
#: Capitals whose lower case depends on their neighbours or is longer than one character.
ODD_CAPITALS = frozenset("Σİİ")
#: Neither letters nor digits: after a word, a run of them is a piece of its own.
SIGNS = string.punctuation


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Little-endian 32-bit ids by piece of text, worked out when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        # Two generations of words: a full one becomes the old one, from which words in use come back.
        self.cores: dict[str, bytes] = {}
        self.old_cores: dict[str, bytes] = {}

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters_only(self, low: str) -> bytes:
        """Ids of one run of letters that is in normal form and in lower case."""
        found = self.old_cores.get(low)
        if found is None:
            spelled = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
            tokens = self.model.tokenize(spelled)
            found = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        self.cores[low] = found
        return found

    def __missing__(self, piece: str) -> bytes:
        core = piece.rstrip(SIGNS)
        if core.isalpha() and (core.isascii() or unicodedata.is_normalized("NFC", core) and ODD_CAPITALS.isdisjoint(core)):
            low = core.lower()
            found = self.cores.get(low)
            if found is None:
                found = self._letters_only(low)
            if len(core) < len(piece):
                found += self[piece[len(core):]]
        else:
            found = self._whole(piece)
        self[piece] = found
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and the offset of each text's; a null or empty text has none."""
        if len(self) > KEPT:
            self.clear()
        if len(self.cores) > KEPT:
            self.old_cores, self.cores = self.cores, {}
        found = words(texts)
        pool = [self[p] for p in found.distinct.to_pylist()]
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        picked, ends = spread(size, found.index)
        return np.frombuffer(b"".join(pool), "<u4")[picked], np.concatenate([[0], ends])[found.offsets]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The process's table for a tokenizer file."""
    return WordIds(path)
