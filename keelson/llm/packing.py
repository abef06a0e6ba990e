"""Best-fit packing of token pieces by exact-complement hashing.

Only the histogram of piece lengths decides how sequences are filled, and it
has at most ``capacity`` entries whatever the number of documents. The planner
takes the longest length left, looks for a single length, a pair or a triple
that fills the gap exactly, and consumes that combination as often as the
counts allow at once; where no exact filling exists, the best-fitting single
piece goes in and the search continues with the smaller gap.

A plan is a list of patterns with multiplicities. Pieces are numbered within
their length (per-partition counts, then a prefix sum over partitions), and
the number alone tells a piece its sequence and offset, so placing is a
lookup with no group of pieces in one place.

Defined results: null text counts as empty; an empty text is one piece of one
end token; an empty table gives no piece; repeated rows are packed each; of
combinations that fill a gap alike the one with the largest length comes
first; a text of any length is cut into as many pieces as it needs; further
columns, also named like those of the result, do not matter.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, table
from .words import chunks, hash_runs, runs_of

#: Characters on which the tokenizer's normaliser and Python's lower() agree and
#: that either is white space to both or to neither; texts with others go through it whole.
UNLIKE = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Token ids of whole texts, as ``Tokenizer.encode`` gives them without special tokens.

    No token crosses white space, so ids are remembered by what stands between
    white space, in a direct-mapped table under the word's 128 bits (see
    ``words``), which numpy reads for all words of a chunk at once. Words not met
    before are encoded together with a mark after each that no such word contains.
    """

    MARK = "\u2014"
    _open: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, slots: int = 1 << 19, room: int = 1 << 22) -> None:
        from tokenizers import Tokenizer, normalizers

        self.inner = Tokenizer.from_file(path)
        mark = self.inner.encode(self.MARK, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("the mark is not one token of this vocabulary")
        self.mark = mark[0]
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.slots, self.room = slots, room
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.count = np.zeros((self.slots, 2), np.uint64), np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @classmethod
    def at_path(cls, path: str) -> WordTokenizer:
        """The process's own, which stays for the tasks to come."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.used > self.room:
            self._forget()
        # the characters of plain texts that are white space to the tokenizer part words here, and no others
        plain = [not UNLIKE.search(t) and "<|" not in t for t in texts]
        raws = [t.encode() for t, p in zip(texts, plain, strict=True) if p]
        data = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
        start, end = runs_of(data)
        hashes = hash_runs(data, start, end)
        slot = (hashes[:, 0] & np.uint64(self.slots - 1)).astype(np.int64)
        at, count = self.at[slot], self.count[slot]
        missing = np.flatnonzero((self.keys[slot] != hashes).any(1))
        if len(missing):
            _, first, which = np.unique(hashes[missing].view("V16").ravel(), return_index=True, return_inverse=True)
            place = missing[first]
            new_at, new_count = self._learn([data[a:b].tobytes().decode() for a, b in zip(start[place].tolist(), end[place].tolist(), strict=True)])
            at[missing], count[missing] = new_at[which], new_count[which]
            self.keys[slot[place]], self.at[slot[place]], self.count[slot[place]] = hashes[place], new_at, new_count
        ends = np.searchsorted(start, np.append(0, np.cumsum([len(r) + 1 for r in raws])))
        before = np.append(0, np.cumsum(count))
        flat = self.ids[np.repeat(at - before[:-1], count) + np.arange(before[-1])].astype("<u4").tobytes()
        cuts = (4 * before[ends]).tolist()
        out, i = [], 0
        for t, p in zip(texts, plain, strict=True):
            out.append(flat[cuts[i] : cuts[i + 1]] if p else self.whole(t))
            i += p
        return out

    def _learn(self, words: list[str], at_once: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Where the words' ids are kept from now on, and how many they are."""
        after = f" {self.MARK} "
        groups = [after.join(words[i : i + at_once]).lower() + after for i in range(0, len(words), at_once)]
        ids = np.concatenate([np.asarray(x.ids, np.uint32) for x in self.bare.encode_batch_fast(groups, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark)
        count = np.diff(marks, prepend=-1) - 1
        ids = np.delete(ids, marks)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), 2 * len(ids)), np.uint32)])
        at = self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return at, count


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; ``part`` and ``nth`` number them within their length."""
    source = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    fields = [*source.schema.fields[:-1], *(T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("nth", T.LongType())))]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)

    def run(batches):
        encoder = WordTokenizer.at_path(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tail = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in chunks(texts):
                rows: list[tuple] = []
                for i, raw in zip(range(lo, hi), encoder.encode([t or "" for t in texts[lo:hi]]), strict=True):
                    raw += tail
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        ids = raw[at : at + 4 * capacity]
                        n = len(ids) // 4
                        rows.append((i, piece, at // 4, n, zlib.crc32(ids), int(seen[n]), ids))
                        seen[n] += 1
                at, piece, start, length, crc, nth, ids = (list(x) for x in zip(*rows, strict=True))
                columns = [c.take(pa.array(at)) for c in batch.columns[:-1]]
                columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), [f.name for f in fields])

    return source.mapInArrow(run, schema)


class Sums:
    """Which lengths are left, and which sums of two of them exist."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.copy()
        self.pairs: np.ndarray | None = None

    def pair(self, gap: int, most: int) -> tuple[int, ...] | None:
        """Two lengths that sum to ``gap``, the larger as large as possible but at most ``most``."""
        lo, hi = (gap + 1) // 2, min(gap - 1, most)
        if hi < lo:
            return None
        larger = np.arange(hi, lo - 1, -1)
        need = np.where(2 * larger == gap, 2, 1)
        fits = np.flatnonzero((self.left[larger] >= need) & (self.left[gap - larger] >= 1))
        return (int(larger[fits[0]]), gap - int(larger[fits[0]])) if len(fits) else None

    def _pair_sums(self) -> np.ndarray:
        if self.pairs is None:
            n = 1 << (2 * len(self.left) - 1).bit_length()
            spectrum = np.fft.rfft((self.left > 0).astype(float), n)
            self.pairs = np.fft.irfft(spectrum * spectrum, n)[: len(self.left)] > 0.5
        return self.pairs

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that sum to ``gap``."""
        if self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap, gap):
            return found
        first = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        if len(first):
            for a in first[(self.left[first] > 0) & self._pair_sums()[gap - first]].tolist():
                self.left[a] -= 1
                found = self.pair(gap - a, a)
                self.left[a] += 1
                if found:
                    return (a, *found)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, [(length, copies), ...]) of each pattern of a sequence."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    while (rest := np.flatnonzero(left)).size:
        sums = Sums(left)
        used = [int(rest[-1])]
        sums.left[used[0]] -= 1
        gap = capacity - used[0]
        while gap:
            if found := sums.fill(gap):
                used += found
                break
            fits = np.flatnonzero(sums.left[: gap + 1])
            if not fits.size:
                break
            used.append(int(fits[-1]))
            sums.left[used[-1]] -= 1
            gap -= used[-1]
        lengths, copies = np.unique(used, return_counts=True)
        times = int((left[lengths] // copies).min())
        left[lengths] -= times * copies
        patterns.append((times, [(int(a), int(b)) for a, b in zip(lengths[::-1], copies[::-1], strict=True)]))
    return patterns


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first number, copies, first sequence, offset), by length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces that is read from storage.

    ``pieces`` has ``length``, ``part`` and ``nth`` from :func:`tokenize`.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # at most capacity patterns of few lengths each, whatever the input
    places = slots(plan(histogram, capacity))
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = pieces.join(before, ["part", "length"])
    names = [c for c in pieces.columns if c not in ("part", "nth")]
    source = joined.select(*names, (F.col("nth") + F.col("_before")).alias("_number"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    span = max(histogram.values(), default=0) + 1

    def run(batches):
        keys = places[:, 0] * span + places[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            number = batch.column(batch.num_columns - 1).to_numpy()
            row = places[np.searchsorted(keys, length * span + number, side="right") - 1]
            nth = number - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return source.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs whole documents."""
    pieces = tokenize(docs, tokenizer or public_tokenizer(), capacity, end, id_col, text_col, with_ids)
    return pack(Workspace(docs.sparkSession, "packing").keep(pieces, "pieces"), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
