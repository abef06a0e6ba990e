from __future__ import annotations

import random
import re

import numpy as np
import pytest

from keelson.llm import words as W


def thue_morse(n, a="a", b="b"):
    """Two words (or lists) on which every polynomial hash modulo 2**64 agrees, once n is about 1024."""
    one, two = [a], [b]
    while len(one) < n:
        one, two = one + two, two + one
    return one, two


@pytest.mark.parametrize("block", [W.BLOCK, 7, 1])
def test_words_of_bytes(monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    rng, words, seen = random.Random(block), W.Words(), {}
    for _ in range(200):
        texts = ["".join(rng.choice("ab \n\té\xa0") for _ in range(rng.randint(0, 40))) for _ in range(3)]
        want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
        ids, ends = words.number(t.encode() for t in texts)
        hashes, again = W.hash_words(texts)
        assert ends.tolist() == again.tolist() == [0, *np.cumsum([len(w) for w in want])]
        for word, i, h in zip([w for ws in want for w in ws], ids.tolist(), hashes.tolist(), strict=True):
            assert seen.setdefault(word, (i, *h)) == (i, *h)
            assert W.digests([word]).tolist() == [h]
        for t, w in zip(texts, want, strict=True):
            start, end = W.runs_of(np.frombuffer(t.encode(), np.uint8))
            assert [t.encode()[a:b] for a, b in zip(start, end, strict=True)] == w
    assert len(words.numbers) == len(seen) and all(len({x[k] for x in seen.values()}) == len(seen) for k in range(3))


def test_words_of_every_length_are_told_apart():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcd") for _ in range(90))
    words = [base[:n] for n in range(1, 90)]
    words += [base[:n][:i] + b"z" + base[:n][i + 1 :] for n in (7, 8, 9, 16, 17, 63, 64, 65, 80) for i in range(n)]
    words += [a * n for a in (b"a", b"\0", b"ab") for n in range(1, 40)]
    words = list(dict.fromkeys(words))
    table = W.digests(words)
    assert len(set(table[:, 0].tolist())) == len(set(table[:, 1].tolist())) == len(words)


def test_words_of_texts():
    hashes, ends = W.hash_words(["A b", None, "", " É a\x0b", "é"], lower=True)
    hashes = hashes[:, 0]
    assert ends.tolist() == [0, 2, 2, 2, 4, 5]
    assert hashes[0] == hashes[3] and hashes[2] != hashes[4]


@pytest.mark.parametrize("n", [1024, 2048])
def test_no_polynomial(n):
    one, two = ("".join(x) for x in thue_morse(n))
    table = W.digests([one.encode(), two.encode()])
    assert (table[0] != table[1]).all()
    hashes, ends = W.hash_words([" ".join(x) for x in thue_morse(n)])
    hashes = hashes[:, 0]
    assert W.every_run(hashes[:n], n) != W.every_run(hashes[n:], n)


def test_runs_and_minima():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 5, 60).astype(np.uint64)
    for size in (1, 2, 3, 4, 5, 7, 8):
        every = W.every_run(h, size)
        assert len(every) == 61 - size
        for i in range(len(every)):
            for j in range(len(every)):
                assert (every[i] == every[j]) == (h[i : i + size] == h[j : j + size]).all()
    assert len(W.every_run(h, 61)) == 0
    x = rng.integers(0, 99, 50)
    for width in (1, 2, 5, 28):
        assert W.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(51 - width)]
    assert len(W.sliding_min(x, 51)) == 0
