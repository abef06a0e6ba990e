"""Hashes of words and of runs of words, for many texts at a time, and exact numbers of words.

Words are the longest runs of anything but ASCII white space. A word's 128 bits
come from eight bytes at a time, each of which goes through two chains that mix
and feed each other (words beyond ``LONG`` bytes: BLAKE2b); runs of words are
joined by mixing at every step. Nothing here is a polynomial.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of one text that are split into words at a time.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word from which on BLAKE2b hashes it.
LONG = 64
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two unsigned 64-bit integers of each run of bytes."""
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = end - start
    a = mix(size.astype(np.uint64) + STEP)
    b = mix(a ^ np.uint64(0xC2B2AE3D27D4EB4F))
    left = np.flatnonzero((size > 0) & (size <= LONG))
    for at in range(0, LONG, 8):
        if not len(left):
            break
        lane = lanes[start[left] + at] & _LOW_BYTES[np.minimum(size[left] - at, 8)]
        x = mix(a[left] ^ lane)
        y = mix((b[left] + lane) * STEP)
        a[left], b[left] = x + (y << np.uint64(1)), y ^ (x << np.uint64(32) | x >> np.uint64(32))
        left = left[size[left] > at + 8]
    out = np.stack([mix(a ^ mix(b)), mix(b + mix(a ^ np.uint64(0x165667B19E3779F9)))], axis=1)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
    return out


def hash_words(texts: list[str | None], lower: bool = False, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of all texts' words, and where each text's begin (one entry more than texts).

    ``lower`` lowers A-Z; ``inside`` marks the bytes of words, if others than white space part them.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    whole = b" ".join([*raws, b""])
    # of bytes, only A-Z have a lower case
    data = np.frombuffer(whole.lower() if lower else whole, np.uint8)
    start, end = runs_of(data, IN_WORD if inside is None else inside)
    return hash_runs(data, start, end), np.searchsorted(start, np.append(0, np.cumsum([len(r) + 1 for r in raws])))


def digests(words: list[bytes]) -> np.ndarray:
    """The two hashes of each word."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return hash_runs(np.frombuffer(b"".join(words), np.uint8), ends - np.array([len(w) for w in words], np.int64), ends)


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Words:
    """Numbers words as they come, each word apart.

    Numbers hold as long as the object; callers start anew when it holds many.
    """

    def __init__(self) -> None:
        self.numbers = _Numbers()

    def number(self, raws: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of these bytes, and where each one's begin (one entry more than there are)."""
        known, parts, counts = self.numbers.__getitem__, [np.zeros(0, np.int32)], []
        for raw in raws:
            n = 0
            for words in split(raw):
                n += len(words)
                parts.append(np.fromiter(map(known, words), np.int32, len(words)))
            counts.append(n)
        return np.concatenate(parts), np.append(0, np.cumsum(counts, dtype=np.int64))

    def unseen(self, known: int) -> list[bytes]:
        """The words whose numbers begin at ``known``."""
        return list(islice(self.numbers, known, None)) if len(self.numbers) > known else []


def split(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block if it is very long."""
    at = 0
    while len(raw) - at > BLOCK:
        gap = GAP.search(raw, at + BLOCK)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end
    yield raw[at:].split() if at else raw.split()


#: Bytes other than ASCII white space.
IN_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])


def runs_of(data: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that ``inside`` (of 256) marks."""
    starts, ends, before = [], [], False
    for at in range(0, len(data), BLOCK):
        marked = inside[data[at : at + BLOCK]]
        edges = np.flatnonzero(np.diff(marked.view(np.int8), prepend=np.int8(before))) + at
        opens = ~np.bool_(before)
        starts.append(edges[0 if opens else 1 :: 2])
        ends.append(edges[1 if opens else 0 :: 2])
        before = bool(marked[-1])
    if before:
        ends.append(np.array([len(data)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * STEP + (right ^ np.uint64(0xD6E8FEB86659FD93)))


def every_run(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbours, by start: joins of runs of powers of two."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width, out, done = mix(hashes + np.uint64(size)), 1, None, 0
    while True:
        if size & width:
            part = power[done : done + n]
            out = part if out is None else _join(out, part)
            done += width
        if done == size:
            return out
        power = _join(power[:-width], power[width:])
        width *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def chunks(texts: list[str | None], chars: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Slices of about ``chars`` characters, of one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
