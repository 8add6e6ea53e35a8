"""Ids of words with signs after them."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from postmill.llm.wordids import WordIds

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def test_signs_after_words_are_encoded_once():
    """The whole chain runs once for each run of signs, not for each word before it."""
    table = WordIds(WORD_FILE)
    whole, asked = table._whole, []
    table._whole = lambda piece: asked.append(piece) or whole(piece)
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiounrst") for _ in range(9)) + rng.choice(["###", "%%%", ",!!", ".***"]) for _ in range(400)]
    ids, _ = table.batch(pa.array([" ".join(words)]))
    assert ids.tolist() == Tokenizer.from_file(WORD_FILE).encode(" ".join(words), add_special_tokens=False).ids
    assert len(asked) <= 4


def test_words_with_signs_are_those_of_the_library():
    rng = random.Random(4)
    parts = ["a", "É", "é", "Σ", "ς", "İ", "ß", "'s", "'", "'t", ",", ".!", "#$", "_", "<|endoftext|>", "<|", "|>", "1", "中", "́", "“", "~", "नि", "\U0001f600"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(20)) for _ in range(300)]
    ids, offsets = WordIds(WORD_FILE).batch(pa.array(texts))
    tokenizer = Tokenizer.from_file(WORD_FILE)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts
    ]
