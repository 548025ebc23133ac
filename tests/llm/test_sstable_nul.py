"""Texts that hold U+0000 have the tokenizers library's ids."""

import random

import numpy as np

from wavecrate.llm import sstable


def test_word_encoder_on_nul():
    own, rng = sstable.WordEncoder(sstable.tokenizer_path(sstable.TOKENIZER)), random.Random(8)
    texts = ["thing a", "a \0thing", "\0thing", *("".join(rng.choice("ab e\0\n 12.'s") for _ in range(rng.randint(1, 25))) for _ in range(2000))]
    want = [own.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, own.kind).tolist() for b in own.encode(texts)] == want
