"""The prefix trie against a walked one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from keelson.llm import prefixtrie

TURNS = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def walked(rows, group=20, heads=4):
    """(conv_id, depth) -> the other columns, by sets of members."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    told = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = told.get(c - int(abs(c) % group) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
    out = {}
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        has = {n[:-1] for n in members if n}
        ends = ",".join(str(c) for c in sorted(c for c in ids if tuple(paths[c]) == node))
        saved = sum((len(members[n]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", n[-1][1])) for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        children = sum(len(n) == len(node) + 1 for n in below)
        out[min(ids), len(node)] = (parent, len(ids), children, sum(n not in has for n in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), 1005, 1007, 1020, 1033, -3, -25, 4000, 4001]:
        shared = rng.random() < 0.5
        for t in range(rng.randint(1, 6)):
            text = f"common {t} words" if shared and t < 4 else " ".join(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 3)))
            rows.append((c, t, rng.choice(["user", "assistant"]) if not shared else "user", text))
    # copies of one conversation, null turns, roles and texts, ties and repeats
    rows += [(c, t, "user", f"copy {t}") for c in range(5000, 5400, 7) for t in range(3)]
    rows += [(6000, None, None, None), (6000, None, "user", "b"), (6000, 0, "user", ""), (6001, 1, "user", "x"), (6001, 1, "user", "x"), (6002, 1, "b", "tie"), (6002, 1, "a", "tie")]
    rows += [(None, 0, "user", "nobody's"), (6003, 0, "user", "a\x0bb  c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(frame, seed):
    rows = corpus(seed)
    df = prefixtrie.prefix_trie(frame(TURNS, rows).repartition(5))
    assert ", ".join(f"{c} {k}" for c, k in df.dtypes) == "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    assert got(df) == walked(rows)


def test_long_conversation_in_several_blocks(frame, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 4)
    rows = [(c, t, "user", f"turn {t if t < 9 or c == 40 else (c, t)}") for c in (40, 41, 42) for t in range(30)] + [(43, 0, "user", "turn 0")]
    assert got(prefixtrie.prefix_trie(frame(TURNS, rows).repartition(7))) == walked(rows)


def test_texts_of_nodes(frame):
    rows = [(20, 0, "user", "a"), (20, 1, "bot", "b"), (20, 2, "user", "c"), (20, 3, "bot", "d"), (21, 0, "user", "z"), (21, 1, "bot", "y"), (21, 2, "user", "x"), (21, 3, "bot", "w")]
    said = {(r.conv_id, r.depth): (r.role, r.text) for r in prefixtrie.prefix_trie(frame(TURNS, rows), texts=True).collect()}
    assert said[20, 0] == (None, None)
    assert [said[20, d] for d in (1, 2, 3, 4)] == [("user", "a"), ("bot", "b"), ("user", "c"), ("bot", "d")]
    h = zlib.crc32(b"21") % 4
    assert said[21, h + 1] == rows[4 + h][2:]


def test_empty_turnless_and_extra_columns(frame):
    assert prefixtrie.prefix_trie(frame(TURNS, [])).collect() == []
    # an id whose head takes all its own turns and whose base is absent is turnless
    c = next(c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "gone")]
    assert got(prefixtrie.prefix_trie(frame(TURNS, rows))) == walked(rows) == {(c, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}
    wide = frame(TURNS + ", depth string, p1 string, len string, words string, owner string, digest string", [(*r, "a", "b", "c", "d", "e", "f") for r in corpus(3)])
    assert got(prefixtrie.prefix_trie(wide)) == walked(corpus(3))
