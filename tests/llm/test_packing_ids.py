"""Ids of the packer against the tokenizers library."""

import random

import numpy as np
import public_tokenizers

from sluice.llm.packing import Encoder

SPACES = [" ", "\t", "\n", "\r", " ", " ", "\r\n", "\v", "\f", "\x1c", "\x1f", "\x85", " ", "᠎", "​", "　", "﻿"]
OTHERS = ["a", "the", "x1", "9", "'s", "'S", "'ll", "!", "..", "é", "Ü", "文", "\U0001f642", "é", "٠", "²", "_", "-", "don't", "‍", "\x00", "İ"]


def test_ids_match_the_library_on_mixed_white_space():
    r, e = random.Random(11), Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" \xa0 \xa0", "a\n ", " ", "  a", "<|endoftext|> a"]
    texts += ["".join(r.choice(SPACES if r.random() < 0.6 else OTHERS) for _ in range(r.randrange(1, 13))) for _ in range(100_000)]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want, strict=True) if e.encode(t) != np.array(w.ids, dtype="<u4").tobytes()] == []


def test_runs_on_which_the_pattern_gives_up():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a" + " " * 1_500_000 + "b", "y" * 200_000, "! " * 100_000):
        assert e.encode(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
