"""Long repeated byte strings by prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes cuts each text into phrases where its value
is a multiple of the mean phrase length, so equal stretches are cut alike
wherever they stand. A string of ``window`` bytes is split by the first trigger
in it into a suffix of a phrase (what stands before) and a prefix of the rest of
the parse (what follows). Sorting phrases from their end, as in the suffix array
of a dictionary, and rests of the parse from their start, with the common
lengths of neighbours, ranks both halves at every length at once; the pair of
ranks is the string's place in corpus order, and strings with one place are
equal, byte by byte. A string without a trigger is split at the first least
value of the rolling hash instead, which depends on its own bytes as well.

Strings with one trigger are a unit, about one phrase of them. Units meet where
it can matter only:

* a unit's anchor is the hash of the ``2/5 window`` bytes that follow its
  trigger, which all its strings hold (of strings that start far before it, the
  bytes that precede it); an anchor that occurs once has no repeated string;
* units with the same bytes are one row with a count, and are repeated whole if
  it is above one. They are told apart by 128 bits;
* what is left meets by anchor and is ranked exactly, many anchors at a time; a
  hot anchor's units (the edges of a passage that a third of all texts share)
  are dealt into blocks. A block settles the strings that occur twice in it. Of
  the others it first tells 128-bit hashes of what ``CELL`` neighbouring strings
  have in common; only where that comes from several rows are the strings' own
  hashes counted over all blocks.

Texts are told apart by their MD5, so copies are worked on once, and missing or
repeated ids do no harm.

Defined results: null text is empty; a text shorter than a window loses nothing;
repeated rows count as copies of each other, whatever their ids; texts of any
length are parsed whole, block by block; an empty table gives an empty table;
further columns, also named like those of the result, do not matter. Bytes are
cut without regard to characters, so what is kept is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, table
from .substrings import covered, text_key
from .words import chunks, mix, signed, sliding_min

TRIGGER = 16
#: Bytes hashed at a time, units of one text at a time, and units ranked together.
PIECE, AT_ONCE, UNITS = 1 << 18, 1 << 15, 1024
#: Units of a hot anchor in one block, and splits of a unit's strings that share a core.
BLOCK, CELL = 256, 16
UNIT = ["anchor", "lead", "wins", "fp", "fp2"]
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a view."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def rolling(lanes: np.ndarray) -> np.ndarray:
    """The hash of the ``TRIGGER`` bytes at each place; ``lanes`` reaches eight places further."""
    h = lanes[:-8] * K1
    h ^= (lanes[8:] + K3) * K2
    h ^= h >> np.uint64(32)
    h *= K2
    h ^= h >> np.uint64(29)
    h *= K1
    return h


def hash_spans(lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two unsigned 64-bit integers of the bytes of each span."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    a = mix(left.astype(np.uint64) + K1)
    b = mix(a ^ K3)
    lows = np.arange(0, int(left[0]) if len(left) else 0, 8)
    # how many spans go beyond a lane's start, and how many fill it
    some, whole = (np.searchsorted(-left, -lows - k).tolist() for k in (0, 7))
    for j, n, full in zip(lows.tolist(), some, whole, strict=True):
        x = lanes[at[:n] + j]
        x[full:] &= _LOW_BYTES[left[full:n] - j]
        u = (a[:n] ^ x) * K1
        u ^= u >> np.uint64(32)
        v = (b[:n] + x) * K2
        v ^= v >> np.uint64(29)
        a[:n], b[:n] = u, v + (u >> np.uint64(17))
    out = np.empty((len(start), 2), np.uint64)
    out[order, 0], out[order, 1] = mix(a ^ mix(b)), mix(b + mix(a ^ K3))
    return out


class Parser:
    """Units of the strings of ``window`` bytes of many texts."""

    def __init__(self, window: int, phrase: int | None = None) -> None:
        if window < 40:
            raise ValueError("windows have 40 bytes at least")
        self.window = window
        self.key = 2 * window // 5
        bits = (window // 3).bit_length() - 1 if phrase is None else phrase.bit_length() - 1
        self.rare = np.uint64(64 - bits)

    def triggers(self, data: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(data) - TRIGGER + 1, PIECE):
            end = min(at + PIECE, len(data) - TRIGGER + 1)
            found.append(np.flatnonzero(rolling(lanes[at : end + 8]) >> self.rare == 0) + at)
        return np.concatenate(found)

    def __call__(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Columns text number, start in the text, lead (bytes before the trigger), strings, anchor and two fingerprints."""
        window, reach = self.window, self.window - TRIGGER
        data = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws], dtype=np.int64)
        begins = ends - np.array([len(r) for r in raws], np.int64)
        lanes = lanes_of(data)
        at = self.triggers(data, lanes)
        text = np.searchsorted(ends, at, "right")
        inside = at + TRIGGER <= ends[text]
        at, text = at[inside], text[inside]
        # a text's last stretch has no trigger at its end: far is one that no string reaches
        far = np.searchsorted(at, ends)
        stop = np.insert(at, far, ends + window)
        owner = np.insert(text, far, np.arange(len(raws)))
        begin, last = begins[owner], ends[owner] - window
        before = np.concatenate([[-1], stop[:-1]]) + 1
        before[np.concatenate([[True], owner[1:] != owner[:-1]])] = 0
        first = np.maximum(begin, before)
        low, high = np.maximum(first, stop - reach), np.minimum(stop, last)
        for lo in range(0, len(stop), AT_ONCE):
            yield from self._units(lanes, begins, *(x[lo : lo + AT_ONCE] for x in (owner, low, high, stop)), 0)
        bare = np.minimum(stop - reach - 1, last)
        parts, held = [], 0
        for i in np.flatnonzero(bare >= first).tolist():
            for part in self._bare(lanes, int(owner[i]), int(first[i]), int(bare[i])):
                parts.append(part)
                held += len(part[0])
                if held >= AT_ONCE:
                    yield from self._units(lanes, begins, *(np.concatenate(c) for c in zip(*parts, strict=True)), 1)
                    parts, held = [], 0
        if parts:
            yield from self._units(lanes, begins, *(np.concatenate(c) for c in zip(*parts, strict=True)), 1)

    def _units(self, lanes, begins, owner, low, high, anchor, kind):
        """Units of strings from ``low`` to ``high``, in two classes by how far the anchor is."""
        near = self.window - self.key
        for back in (False, True):
            a, b = (low, np.minimum(high, anchor - near - 1)) if back else (np.maximum(low, anchor - near), high)
            some = np.flatnonzero(b >= a)
            if not len(some):
                continue
            a, wins, at, text = a[some], (b - a + 1)[some], anchor[some], owner[some]
            keys = hash_spans(lanes, at - self.key if back else at, np.full(len(at), self.key))[:, 0]
            prints = hash_spans(lanes, a, wins + self.window - 1)
            yield text, a - begins[text], at - a, wins, signed(mix(keys + np.uint64(2 * kind + back))), signed(prints[:, 0]), signed(prints[:, 1])

    def _bare(self, lanes, text, first, last):
        """(text, first string, last, anchor) of units without a trigger, by the first least value in each."""
        reach = self.window - TRIGGER
        for lo in range(first, last + 1, PIECE):
            hi = min(lo + PIECE - 1, last)
            values = rolling(lanes[lo : hi + reach + 9])
            places = np.arange(len(values), dtype=np.uint64)
            least = sliding_min((values >> np.uint64(24) << np.uint64(24)) | places, reach + 1) & np.uint64((1 << 24) - 1)
            head = np.flatnonzero(np.diff(least, prepend=least[:1] + np.uint64(1)))
            yield np.full(len(head), text), head + lo, np.append(head[1:], len(least)) - 1 + lo, least[head].astype(np.int64) + lo


def units(docs: DataFrame, window: int, phrase: int | None) -> DataFrame:
    """(anchor, lead, wins, fp, fp2, key, start, copies) of every text (key, text); copies in one batch are counted together."""

    def run(batches):
        parse = Parser(window, phrase)
        for batch in batches:
            copies: dict[bytes, list] = {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copies.setdefault(key, [text, 0])[1] += 1
            keys, texts, n = list(copies), [t for t, _ in copies.values()], np.array([c for _, c in copies.values()], np.int64)
            for lo, hi in chunks(texts):
                own = pa.array(keys[lo:hi], pa.binary())
                for text, start, lead, wins, anchor, fp, fp2 in parse([(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(lead, pa.int32()), pa.array(wins, pa.int32()), pa.array(fp), pa.array(fp2), own.take(pa.array(text)), pa.array(start, pa.int32()), pa.array(n[lo:hi][text])], [*UNIT, "key", "start", "copies"])

    return docs.mapInArrow(run, "anchor long, lead int, wins int, fp long, fp2 long, key binary, start int, copies long")


def _packed(joined: DataFrame, window: int) -> DataFrame:
    """(anchor, block, lead, wins, fp, fp2, n, hot, packed) of the wanted units of (key, text, wanted) rows."""
    names = ["anchor", "block", "lead", "wins", "fp", "fp2", "n", "hot", "packed"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches):
        done, rows, size = set(), [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key in done:
                    continue
                done.add(key)
                raw = (text or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    piece = raw[w["start"] : w["start"] + w["wins"] + window - 1]
                    rows.append((w["anchor"], w["fp"] % w["blocks"], w["lead"], w["wins"], w["fp"], w["fp2"], w["n"], w["blocks"] > 1, piece))
                    size += len(piece)
                    if size > 1 << 22:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return joined.mapInArrow(run, "anchor long, block long, lead int, wins int, fp long, fp2 long, n long, hot boolean, packed binary")


def _classes(rows: list[bytes], deepest: int) -> np.ndarray:
    """For each row and length up to ``deepest``, the class of rows that begin alike for that length; all begin with a bucket's four bytes."""
    order = sorted(range(len(rows)), key=rows.__getitem__)
    sorted_rows = np.frombuffer(b"".join([rows[i] for i in order]), np.uint8).reshape(len(rows), -1)
    other = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(other.any(1), other.argmax(1), sorted_rows.shape[1]) - 4
    out = np.zeros((len(rows), deepest + 1), np.int32)
    ranked = np.concatenate([np.zeros((1, deepest + 1), np.int32), np.cumsum(common[:, None] < np.arange(deepest + 1), 0, dtype=np.int32)])
    out[order] = ranked
    return out


def rank_units(buckets: list[int], leads: np.ndarray, wins: np.ndarray, weights: np.ndarray, strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each unit, one after another, whether it occurs again in its bucket, and whether it is the first of its kind.

    Phrases are sorted from the trigger backwards, rests of the parse from it
    on; a string's two classes, at the lengths at which the trigger splits it,
    and its split are its place in the order of all.
    """
    deepest = int(leads.max())
    marks = [b.to_bytes(4, "big") for b in buckets]
    before = _classes([m + s[:d][::-1].ljust(deepest, b"\0") for m, s, d in zip(marks, strings, leads.tolist(), strict=True)], deepest)
    after = _classes([m + s[d:].ljust(window, b"\0") for m, s, d in zip(marks, strings, leads.tolist(), strict=True)], window)
    unit = np.repeat(np.arange(len(strings)), wins)
    split = leads[unit] - (np.arange(len(unit)) - np.repeat(np.cumsum(wins) - wins, wins))
    place = (before[unit, split].astype(np.int64) * (len(strings) + 1) + after[unit, window - split]) * (window + 1) + split
    _, one, kind = np.unique(place, return_index=True, return_inverse=True)
    again = np.bincount(kind, weights[unit])[kind] > 1
    first = np.zeros(len(unit), bool)
    first[one] = True
    return again, first


def _ranges(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": a, "hi": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _settled(packed: DataFrame, window: int) -> DataFrame:
    """Rows (unit, spans) of units with strings repeated in their block.

    Of hot anchors also rows (unit, cell, c1, c2, firsts, agains): the strings
    of a unit whose splits fall into one cell of ``CELL`` share their core, the
    bytes that all such strings have, of which c1 and c2 are the hashes. The
    bits of ``firsts`` mark strings that are the first of their kind in the
    block, those of ``agains`` which of them are repeated in it.
    """
    names = [*UNIT, "spans", "cell", "c1", "c2", "firsts", "agains"]
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    own = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    core = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def answer(rows, bucket):
        leads, wins, weights = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 6))
        again, first = rank_units(bucket, leads, wins, weights, [r[8] for r in rows], window)
        ends = np.cumsum(wins)
        hits = [((r[0], *r[2:6]), _ranges(x)) for r, x in zip(rows, np.split(again, ends[:-1]), strict=True) if x.any()]
        if hits:
            yield pa.RecordBatch.from_arrays([*(pa.array([h[i] for h, _ in hits], t) for i, t in enumerate(own)), pa.array([s for _, s in hits], span), *(pa.nulls(len(hits), t) for t in core)], names)
        at = np.flatnonzero(first & np.repeat([r[7] for r in rows], wins))
        if len(at):
            unit = np.searchsorted(ends, at, "right")
            split = leads[unit] - (at - (ends - wins)[unit])
            cells, of = np.unique(unit * (window // CELL + 1) + split // CELL, return_inverse=True)
            bit = np.int64(1) << split % CELL
            firsts, agains = (np.bincount(of, w).astype(np.int64) for w in (bit, bit * again[at]))
            unit, cell = np.divmod(cells, window // CELL + 1)
            sizes = np.array([len(r[8]) for r in rows], np.int64)
            prints = hash_spans(lanes_of(np.frombuffer(b"".join([r[8] for r in rows]), np.uint8)), (np.cumsum(sizes) - sizes)[unit] + leads[unit] - cell * CELL, np.full(len(unit), window - CELL + 1))
            told = (cell, signed(prints[:, 0]), signed(prints[:, 1]), firsts, agains)
            yield pa.RecordBatch.from_arrays([*(pa.array([r[j] for r in rows], t).take(pa.array(unit)) for j, t in zip((0, 2, 3, 4, 5), own, strict=True)), pa.nulls(len(unit), span), *(pa.array(c, t) for c, t in zip(told, core, strict=True))], names)

    def run(batches):
        rows: list[tuple] = []
        bucket: list[int] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh = not rows or rows[-1][:2] != row[:2]
                if fresh and len(rows) >= UNITS:
                    yield from answer(rows, bucket)
                    rows, bucket = [], []
                bucket.append((bucket[-1] if bucket else 0) + fresh)
                rows.append(row)
        if rows:
            yield from answer(rows, bucket)

    ordered = packed.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    return ordered.mapInArrow(run, "anchor long, lead int, wins int, fp long, fp2 long, spans array<struct<lo:int,hi:int>>, cell int, c1 long, c2 long, firsts int, agains int")


def _strings(joined: DataFrame, window: int) -> DataFrame:
    """(unit, w1, w2, n, nth) of the marked strings of (unit, packed, cells); n is 2 for what is repeated in its block."""
    own = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            row, place, base, n, data = [], [], [], [], []
            size = 0
            for i, (lead, raw, cells) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 5, 6)), strict=True)):
                for c in cells:
                    for k in range(CELL):
                        if c["firsts"] >> k & 1:
                            row.append(i)
                            place.append(lead - c["cell"] * CELL - k)
                            base.append(size)
                            n.append(1 + (c["agains"] >> k & 1))
                data.append(raw)
                size += len(raw)
            if row:
                prints = hash_spans(lanes_of(np.frombuffer(b"".join(data), np.uint8)), np.array(base) + place, np.full(len(row), window))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(row)).cast(t) for j, t in enumerate(own)), pa.array(signed(prints[:, 0])), pa.array(signed(prints[:, 1])), pa.array(n, pa.int64()), pa.array(place, pa.int32())], [*UNIT, "w1", "w2", "n", "nth"])

    return joined.select(*UNIT, "packed", "cells").mapInArrow(run, "anchor long, lead int, wins int, fp long, fp2 long, w1 long, w2 long, n long, nth int")


def repeated_strings(docs: DataFrame, space: Workspace, window: int, phrase: int | None = None) -> DataFrame:
    """(key, spans): the ranges of starts of strings that occur again, of each distinct text (key, text) that has any."""
    found = space.keep(units(docs, window, phrase), "found")
    often = space.keep(found.groupBy("anchor").agg(F.sum("copies").alias("_n")).filter("_n > 1").select("anchor"), "often")
    could = space.keep(found.join(often, "anchor", "left_semi"), "could")
    space.drop("found", "often")
    # one row for each different unit
    kinds = space.keep(could.groupBy(*UNIT).agg(F.sum("copies").alias("n"), F.min(F.struct("key", "start")).alias("at")), "kinds")
    several = space.keep(kinds.groupBy("anchor").agg(F.count("*").alias("_kinds"), F.min("n").alias("_least")).filter("_least = 1 and _kinds > 1").select("anchor", F.ceil(F.col("_kinds") / BLOCK).alias("blocks")), "several")
    wanted = space.keep(kinds.join(several, "anchor").select("at.key", F.struct(*UNIT, "n", "blocks", "at.start").alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted")), "wanted")
    packed = space.keep(_packed(docs.join(wanted, "key").select("key", "text", "wanted"), window), "packed")
    space.drop("wanted")
    settled = space.keep(_settled(packed, window), "settled")
    # of hot anchors, strings whose core is in one row alone have no match in another block
    cores = settled.filter("cell is not null")
    shared = space.keep(cores.groupBy("c1", "c2").agg(F.count("*").alias("_n")).filter("_n > 1").select("c1", "c2"), "shared")
    cells = cores.join(shared, ["c1", "c2"], "left_semi").groupBy(*UNIT).agg(F.collect_list(F.struct("cell", "firsts", "agains")).alias("cells"))
    open_strings = space.keep(_strings(packed.filter("hot").join(cells, UNIT), window), "strings")
    space.drop("packed", "shared")
    twice = space.keep(open_strings.groupBy("w1", "w2").agg(F.sum("n").alias("_n")).filter("_n > 1").select("w1", "w2"), "twice")
    across = open_strings.filter("n = 1").join(twice, ["w1", "w2"], "left_semi").select(*UNIT, F.array(F.struct(F.col("nth").alias("lo"), (F.col("nth") + 1).alias("hi"))).alias("spans"))
    whole = kinds.filter("n > 1").select(*UNIT, F.array(F.struct(F.lit(0).alias("lo"), F.col("wins").alias("hi"))).alias("spans"))
    partly = settled.filter("cell is null").select(*UNIT, "spans").unionByName(across).groupBy(*UNIT).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    marks = space.keep(whole.unionByName(partly.join(kinds.filter("n > 1").select(*UNIT), UNIT, "left_anti")), "marks")
    space.drop("settled", "strings", "twice")
    hit = could.join(marks, UNIT).groupBy("key", "start").agg(F.first("spans").alias("spans"))
    shifted = hit.select("key", F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi"))).alias("spans"))
    out = space.keep(shifted.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
    space.drop("could", "kinds", "several", "marks")
    return out


def dedup_bytes(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), content: bool = True, phrase: int | None = None) -> DataFrame:
    """``id_col``, the columns ``keep``, n_bytes, n_removed, n_spans and kept_sha256 of each document, and with ``content`` the removed byte ranges and what is kept."""
    space = Workspace(docs.sparkSession, "phrases")
    spans = repeated_strings(docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")), space, window, phrase)
    # names of the source's own can't clash with those of spans
    own = [id_col, *keep]
    width = len(own)
    source = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(own)), F.col(text_col).alias("_text"), text_key(F.col(text_col)).alias("key"))
    joined = source.join(spans, "key", "left").drop("key")
    ranges = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
    told = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), *((("removed", ranges), ("kept", T.BinaryType())) if content else ())]
    schema = T.StructType([*(docs.select(f"`{c}`").schema[0] for c in own), *(T.StructField(n, k) for n, k in told)])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary()][: len(told)]

    def run(batches):
        for batch in batches:
            rows = []
            for text, marked in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone, parts, at = covered(marked, window), [], 0
                for lo, hi in gone:
                    parts.append(raw[at:lo])
                    at = hi
                kept = b"".join([*parts, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"lo": a, "hi": b} for a, b in gone], kept)[: len(told)])
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), window=400, content=False)


OP12_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(coalesce(text, '')) AS x FROM documents),
p AS (SELECT rid, a, substr(x, 2 * a + 1, 1598) AS piece FROM (SELECT rid, x, unnest(range(0, length(x) // 2 - 399, 400)) AS a FROM d)),
w AS (SELECT rid, a + j AS i, md5(substr(piece, 2 * j + 1, 800)) AS w FROM (SELECT rid, a, piece, unnest(range(0, length(piece) // 2 - 399)) AS j FROM p)),
r AS (SELECT rid, i FROM w SEMI JOIN (SELECT w FROM w GROUP BY 1 HAVING count(*) > 1) USING (w)),
s AS (SELECT rid, i, sum(CASE WHEN i - prev <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS g FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM r)),
m AS (SELECT rid, min(i) AS lo, max(i) + 400 AS hi FROM s GROUP BY rid, g),
c AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS prev FROM m),
k AS (SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS kept, max(hi) AS hi FROM c JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(hi, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
