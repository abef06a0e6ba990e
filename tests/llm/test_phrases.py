"""Prefix-free parsing against a count of all byte strings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from keelson.llm import phrases

DOCS = "doc_id long, text string"


def counted(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for (doc, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if seen[raw[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(raw, gone.tolist(), strict=True) if not g)
        out.append((doc, len(raw), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect()), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefgh é\n") for _ in range(k))
    docs = [text(rng.randint(0, 400)) for _ in range(n)]
    passage, long = text(90), text(900)
    docs += [text(rng.randint(0, 90)) + passage[rng.randint(0, 30) : 90 - rng.randint(0, 30)] + text(rng.randint(0, 90)) for _ in range(40)]
    docs += [text(20) + long[rng.randint(0, 300) :] for _ in range(5)] + [docs[0], docs[1], docs[1], long]
    docs += ["a" * 300, "a" * 77, "ab" * 120, text(50) * 4, "", "\x00" * 130, "\x00" * 20 + text(40), "é" * 100]
    rows = [(i, d) for i, d in enumerate(docs)] + [(None, docs[3]), (3, docs[3]), (7000, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "window", "phrase"), [(1, 40, None), (2, 60, 32), (3, 100, 4)])
def test_brute_force(frame, seed, window, phrase):
    rows = corpus(seed)
    assert got(phrases.dedup_bytes(frame(DOCS, rows).repartition(4), window, phrase=phrase)) == counted(rows, window)


def test_hot_anchors_in_blocks(frame, monkeypatch):
    # a passage that all texts share, with other bytes around it, dealt into blocks of 4 units
    monkeypatch.setattr(phrases, "BLOCK", 4)
    monkeypatch.setattr(phrases, "UNITS", 8)
    rng = random.Random(5)
    text = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    passage = text(130)
    rows = [(i, text(rng.randint(0, 60)) + passage + text(rng.randint(0, 60))) for i in range(120)]
    assert got(phrases.dedup_bytes(frame(DOCS, rows).repartition(3), 60)) == counted(rows, 60)


def test_units_hold_every_string_once(monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 64)
    monkeypatch.setattr(phrases, "AT_ONCE", 16)
    for window, phrase in ((40, 8), (55, 64), (80, 4)):
        raws = [(t or "").encode() for _, t in corpus(9)]
        seen = Counter()
        for text, start, lead, wins, *_ in phrases.Parser(window, phrase)(raws):
            for t, s, d, w in zip(text.tolist(), start.tolist(), lead.tolist(), wins.tolist(), strict=True):
                assert w >= 1 and d - w + 1 >= 0 and d <= window - phrases.TRIGGER
                seen.update((t, s + i) for i in range(w))
        assert seen == Counter((t, i) for t, r in enumerate(raws) for i in range(len(r) - window + 1))


def test_equal_strings_have_one_anchor_and_split(monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 128)
    raws, window = [(t or "").encode() for _, t in corpus(11)], 40
    told = {}
    for text, start, lead, wins, anchor, *_ in phrases.Parser(window)(raws):
        for t, s, d, w, a in zip(text.tolist(), start.tolist(), lead.tolist(), wins.tolist(), anchor.tolist(), strict=True):
            for i in range(w):
                assert told.setdefault(raws[t][s + i : s + i + window], (a, d - i)) == (a, d - i)


def test_content_keep_and_clashing_names(frame):
    rows = corpus(4)
    wide = frame("doc_id long, text string, key string, anchor int, spans string", [(*r, "k", 1, "s") for r in rows])
    df = phrases.dedup_bytes(wide, 40, keep=("anchor", "spans"))
    assert {(r.anchor, r.spans) for r in df.collect()} == {(1, "s")}
    assert got(df) == counted(rows, 40)
    for r in df.collect():
        text = next((t or "").encode() for d, t in rows if d == r.doc_id and len((t or "").encode()) == r.n_bytes)
        assert r.n_removed == sum(x.hi - x.lo for x in r.removed) and len(r.kept) + r.n_removed == len(text)


def test_empty_and_narrow(frame):
    assert phrases.dedup_bytes(frame(DOCS, []), 40).collect() == []
    with pytest.raises(ValueError, match="40 bytes"):
        phrases.Parser(39)


def test_very_long_texts(frame):
    rng = np.random.default_rng(3)
    one = bytes(rng.integers(97, 123, 1_500_000, dtype=np.uint8)).decode()
    rows = [(1, one), (2, "x" * 2000 + one[700_000:700_900] + "y"), (3, "z" * 100_000)]
    out = {r.doc_id: r for r in phrases.dedup_bytes(frame(DOCS, rows), 400).collect()}
    assert [(x.lo, x.hi) for x in out[1].removed] == [(700_000, 700_900)]
    assert [(x.lo, x.hi) for x in out[2].removed] == [(0, 2900)] or [(x.lo, x.hi) for x in out[2].removed] == [(0, 2000), (2000, 2900)]
    assert out[3].n_removed == 100_000
