"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from keelson.llm import variants

DOCS = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def paired(rows, drop=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    of = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(of[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def corpus(seed, letters="abé", n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(stems[: rng.randint(1, 60)]) for _ in range(rng.randint(0, 30))]
        words = [w.capitalize() if rng.random() < 0.2 else w for w in words]
        rows.append((i, rng.choice([" ", ", ", "\n1", "Ā", "一"]).join(words)))
    rows += [(1, rows[1][1]), (None, "hello hello hello hellp hellp hellp"), (9000, None), (9001, ""), (9002, "×÷ÀÿÆ ×÷Àÿæ ×÷ÀÿÆ " * 4), (9003, "Hello HELLO hellO helo helllo")]
    return rows


@pytest.mark.parametrize(("seed", "drop"), [(1, 97), (2, 5)])
def test_brute_force(frame, seed, drop):
    rows = corpus(seed)
    df = variants.group_variants(frame(DOCS, rows).repartition(4), drop=drop)
    assert got(df) == paired(rows, drop)


def test_long_words_by_hash(frame, monkeypatch):
    monkeypatch.setattr(variants, "LONG", 6)
    rows = corpus(3)
    assert got(variants.group_variants(frame(DOCS, rows))) == paired(rows)


def test_chain_of_forms(frame):
    # aaaaa <- aaaab <- aaabb <- aabbb, each twice as common
    rows = [(i, " ".join(w for k, w in enumerate(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb"]) for _ in range(3 * 2 ** (4 - k)))) for i in range(2)]
    assert got(variants.group_variants(frame(DOCS, rows), drop=1 << 40)) == paired(rows, 1 << 40)
    assert {r[-1] for r in paired(rows, 1 << 40)} == {"aaaaa"}


def test_very_long_word(frame):
    word = "ab" * 10_000
    rows = [(1, f"{word} " * 7 + f"{word}c " * 3 + f"{'b' + word[1:]} " * 3)]
    out = {len(r.word) * (1 if r.word[0] == "a" else -1): r for r in variants.group_variants(frame(DOCS, rows), drop=1 << 40).collect()}
    assert (out[20_000].n_near, out[20_001].n_near, out[-20_000].n_near) == (2, 1, 1)
    assert out[20_001].form == out[-20_000].root == word


def test_flushes_and_clashing_names(frame, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 8)
    rows = corpus(4)
    wide = frame("doc_id long, text string, id string, word string, n long, key string", [(*r, "a", "b", 1, "c") for r in rows])
    assert got(variants.group_variants(wide)) == paired(rows)


def test_empty(frame):
    assert variants.group_variants(frame(DOCS, [])).collect() == []
    assert variants.group_variants(frame(DOCS, [(1, "two few"), (2, None)])).collect() == []
