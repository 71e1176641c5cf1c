import random

import numpy as np

from palaver.llm import words as W


def test_equal_words_have_equal_hashes_and_others_do_not(monkeypatch):
    rng = random.Random(1)
    alphabet = "aAbBzZ é🙂ßÉ\t\n\x0b\x0c\r\x1c\x85  "
    text = "".join(rng.choice(alphabet) for _ in range(20_000)) + " " + "long" * 900 + " x"
    want = text.encode().lower().split()
    got = W.word_hashes(text)
    assert len(got) == len(want)
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))
    monkeypatch.setattr(W, "PIECE", 777)
    assert (W.word_hashes(text) == got).all()
    assert len(W.word_hashes(None)) == len(W.word_hashes(" \n")) == 0
    assert (W.word_hashes("Ab") == W.word_hashes("aB")).all() and W.word_hashes("É")[0] != W.word_hashes("é")[0]


def test_no_collisions_among_many():
    assert len(np.unique(W.word_hashes(" ".join(f"w{i}" for i in range(400_000))))) == 400_000
