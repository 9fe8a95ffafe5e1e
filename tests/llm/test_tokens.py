import random

import numpy as np

from voxmill.llm import tokens
from voxmill.llm.tokens import Encoder, vocabulary


def _library(enc, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_new_words_are_encoded_together(monkeypatch):
    """Words that the cache has not seen go to the library in one text, not one by one."""
    enc, rng = Encoder(vocabulary("byte_bpe_50k.json"), True), random.Random(4)
    words = ["".join(rng.choices("abcXYZéß", k=rng.randint(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    monkeypatch.setattr(enc, "_unit", None)
    assert enc.encode(texts) == _library(enc, texts)


def test_ids_are_the_librarys_when_the_cache_overflows(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 7)
    rng = random.Random(5)
    parts = ["a", "word", "Word,", "café;", "x.\ny", "Über.\n\nNext", "don't", "3.5", "中文", "...", "", "<|endoftext|>", "end\n", "\nstart", "Ġodd", "naïve--"]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc = Encoder(vocabulary(name), spaces)
        for _ in range(40):
            texts = [" ".join(rng.choices([*parts, *(p + rng.choice("abc") for p in parts)], k=rng.randint(0, 30))) for _ in range(8)]
            assert enc.encode(texts) == _library(enc, texts)
