"""Substring deduplication by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the least hash of
the runs of ``mmer`` words in it. Consecutive windows with the same minimiser
form a super-k-mer, which goes to the minimiser's bucket as one packed string
of its words; there its windows are sorted and counted exactly, word by word.
Equal windows have equal minimisers, so no other bucket can hold a copy.

What is packed and sent is only what can matter:

* a minimiser that occurs once in the corpus has no repeated window;
* of equal super-k-mers one is sent, with their number; if there are several,
  all their windows are repeated. They are told apart by 128 bits that are
  made from 128-bit hashes of their words;
* the many different super-k-mers of a hot minimiser (the edges of a passage
  that a third of all documents share) are dealt into blocks. A block settles
  the windows that occur twice in it; of each other window it tells a 128-bit
  hash, and these are counted over all blocks.

Texts are told apart by their MD5, so copies are worked on once, and missing
or repeated ids do no harm.

Defined results: null text has no words and stays null; a text shorter than a
window loses nothing; repeated rows count as copies of each other, whatever
their ids; very long texts are cut into super-k-mers piece by piece, with the
same result; an empty table gives an empty table; further columns, also named
like those of the result, do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Workspace, table
from .words import Words, chunks, every_run, hash_words, mix, runs_of, signed, sliding_min

BLOCK = 256
#: Windows of one text that are cut into super-k-mers at a time.
PIECE = 1 << 16
SKM = ["mini", "fp", "fp2", "wins"]
STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each run of ``size`` words, from the words' two."""
    return every_run(hashes[:, 0], size), every_run(hashes[:, 1], size)


class Cutter:
    """Super-k-mers of many texts."""

    def __init__(self, window: int, mmer: int) -> None:
        self.window, self.mmer = window, mmer

    def __call__(self, texts: list[str | None]):
        """Columns text number, start in the text, windows, minimiser, its occurrences, and two fingerprints, piece by piece."""
        hashes, ends = hash_words(texts)
        if len(hashes) <= PIECE:
            yield from self._cut(0, 0, hashes, ends)
            return
        for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            for at in range(lo, hi - self.window + 1, PIECE):
                end = min(hi, at + PIECE + self.window - 1)
                yield from self._cut(i, at - lo, hashes[at:end], np.array([0, end - at]))

    def _cut(self, text_before: int, words_before: int, hashes: np.ndarray, ends: np.ndarray):
        counts = np.maximum(np.diff(ends) - self.window + 1, 0)
        if not counts.sum():
            return
        grams = mix(every_run(hashes[:, 0], self.mmer) ^ np.uint64(0xD6E8FEB86659FD93))
        least = sliding_min(grams, self.window - self.mmer + 1)
        text = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        at = np.arange(len(text)) - first[text] + ends[:-1][text]
        mini = least[at]
        new = np.ones(len(text), bool)
        new[1:] = (mini[1:] != mini[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        wins = np.diff(np.append(head, len(text)))
        start = at[head]
        value = mini[head]
        # how often the minimiser itself occurs in the super-k-mer
        spans = wins + self.window - self.mmer
        owner = np.repeat(np.arange(len(head)), spans)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans) + start[owner]
        times = np.bincount(owner, grams[place] == value[owner], minlength=len(head)).astype(np.int64)
        # a fingerprint sums mixed hashes of the windows and their places
        nth = (np.arange(len(text)) - np.repeat(head, wins)).astype(np.uint64) * STEP
        prints = [signed(np.add.reduceat(mix(h[at] + nth), head)) for h in window_hashes(hashes, self.window)]
        yield [text[head] + text_before, start - ends[:-1][text[head]] + words_before, wins, signed(value), times, *prints]


def text_key(col) -> F.Column:
    return F.unhex(F.md5(F.coalesce(col, F.lit(""))))


def super_kmers(docs: DataFrame, cutter: Cutter) -> DataFrame:
    """(mini, fp, fp2, wins, key, start, times, copies) of every text; copies in one batch are counted together."""
    window, mmer = cutter.window, cutter.mmer

    def run(batches):
        cut = Cutter(window, mmer)
        for batch in batches:
            copies: dict[bytes, list] = {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copies.setdefault(key, [text, 0])[1] += 1
            keys, texts, n = list(copies), [t for t, _ in copies.values()], np.array([c for _, c in copies.values()], np.int64)
            for lo, hi in chunks(texts):
                own = pa.array(keys[lo:hi], pa.binary())
                for text, start, wins, mini, times, fp, fp2 in cut(texts[lo:hi]):
                    yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array(fp), pa.array(fp2), pa.array(wins, pa.int32()), own.take(pa.array(text)), pa.array(start, pa.int32()), pa.array(times * n[lo:hi][text]), pa.array(n[lo:hi][text])], ["mini", "fp", "fp2", "wins", "key", "start", "times", "copies"])

    return docs.mapInArrow(run, "mini long, fp long, fp2 long, wins int, key binary, start int, times long, copies long")


def _packed(joined: DataFrame, window: int) -> DataFrame:
    """(mini, block, fp, fp2, wins, n, hot, packed) of the wanted super-k-mers of (key, text, wanted) rows."""

    def run(batches):
        done = set()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key in done:
                    continue
                done.add(key)
                raw = (text or "").encode("utf-8", "surrogatepass")
                starts, ends = runs_of(np.frombuffer(raw, np.uint8))
                for w in wanted:
                    at = w["start"]
                    words = raw[starts[at] : ends[at + w["wins"] + window - 2]]
                    rows.append((w["mini"], w["fp"] % w["blocks"], w["fp"], w["fp2"], w["wins"], w["n"], w["blocks"] > 1, b" ".join(words.split())))
                    size += len(words)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["mini", "block", "fp", "fp2", "wins", "n", "hot", "packed"])
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["mini", "block", "fp", "fp2", "wins", "n", "hot", "packed"])

    return joined.mapInArrow(run, "mini long, block long, fp long, fp2 long, wins int, n long, hot boolean, packed binary")


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def count_bucket(packed: list[bytes], weights: list[int], window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each super-k-mer which of its windows occur again in the bucket, and which are the first of their kind.

    Words are numbered in the bucket, so windows are equal if all their words are.
    """
    ids, ends = Words().number(packed)
    views = [np.lib.stride_tricks.sliding_window_view(ids[a:b], window) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    sizes = np.cumsum([len(v) for v in views])
    rows = np.ascontiguousarray(np.concatenate(views)).view(f"V{4 * window}").ravel()
    order = np.argsort(rows, kind="stable")
    same = np.concatenate([[False], rows[order[1:]] == rows[order[:-1]]])
    group = np.cumsum(~same) - 1
    total = np.bincount(group, np.repeat(weights, np.diff(sizes, prepend=0))[order])
    again, first = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    again[order] = total[group] > 1
    first[order] = ~same
    return np.split(again, sizes[:-1]), np.split(first, sizes[:-1])


def _bucketed(packed: DataFrame, window: int) -> DataFrame:
    """Rows (mini, fp, fp2, wins, spans) of super-k-mers with windows repeated in their block.

    Of hot minimisers also rows (w1, w2, n, nth): each kind of window of the
    block, with n = 2 if it is repeated in it, else with its place. A block's
    rows come one after another.
    """

    def run(batches):
        names = [*SKM, "spans", "w1", "w2", "n", "nth"]
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        ids = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]

        def answer(bucket):
            again, first = count_bucket([r[7] for r in bucket], [r[5] for r in bucket], window)
            hits = [((r[0], *r[2:5]), _ranges(a)) for r, a in zip(bucket, again, strict=True) if a.any()]
            if hits:
                k = len(hits)
                spans = pa.array([[{"lo": a, "hi": b} for a, b in h] for _, h in hits], span)
                yield pa.RecordBatch.from_arrays([*(pa.array([h[i] for h, _ in hits], t) for i, t in enumerate(ids)), spans, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], names)
            if bucket[0][6]:
                for r, a, f in zip(bucket, again, first, strict=True):
                    at = np.flatnonzero(f)
                    if len(at):
                        k = len(at)
                        one, two = (h[at] for h in window_hashes(hash_words([r[7].decode("utf-8", "surrogatepass")])[0], window))
                        yield pa.RecordBatch.from_arrays([*(pa.array([v] * k, t) for v, t in zip((r[0], *r[2:5]), ids, strict=True)), pa.nulls(k, span), pa.array(signed(one)), pa.array(signed(two)), pa.array(np.where(a[at], 2, 1)), pa.array(at, pa.int32())], names)

        bucket: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket and bucket[0][:2] != row[:2]:
                    yield from answer(bucket)
                    bucket = []
                bucket.append(row)
        if bucket:
            yield from answer(bucket)

    rows = packed.repartition("mini", "block").sortWithinPartitions("mini", "block")
    return rows.mapInArrow(run, "mini long, fp long, fp2 long, wins int, spans array<struct<lo:int,hi:int>>, w1 long, w2 long, n long, nth int")


def repeated_spans(docs: DataFrame, space: Workspace, window: int, mmer: int = 8) -> DataFrame:
    """(key, spans): the ranges of window starts whose windows occur again, of each distinct text that has any.

    ``docs`` has key and text.
    """
    cutter = Cutter(window, mmer)
    found = space.keep(super_kmers(docs, cutter), "found")
    often = space.keep(found.groupBy("mini").agg(F.sum("times").alias("_n")).filter("_n > 1").select("mini"), "often")
    could = space.keep(found.join(often, "mini", "left_semi"), "could")
    space.drop("found", "often")
    # one row for each different super-k-mer
    kinds = space.keep(could.groupBy(*SKM).agg(F.sum("copies").alias("n"), F.max(F.col("times") > F.col("copies")).alias("inner"), F.min(F.struct("key", "start")).alias("at")), "kinds")
    several = space.keep(kinds.groupBy("mini").agg(F.count("*").alias("_kinds"), F.max(F.col("inner") & (F.col("n") == 1)).alias("_inner"), F.min("n").alias("_least")).filter("_least = 1 and (_kinds > 1 or _inner)").select("mini", F.ceil(F.col("_kinds") / BLOCK).alias("blocks")), "several")
    wanted = kinds.join(several, "mini").select("at.key", F.struct("mini", "fp", "fp2", "wins", "n", "blocks", "at.start").alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted"))
    wanted = space.keep(wanted, "wanted")
    packed = space.keep(_packed(docs.join(wanted, "key").select("key", "text", "wanted"), window), "packed")
    space.drop("wanted")
    settled = space.keep(_bucketed(packed, window), "settled")
    space.drop("packed")
    open_windows = settled.filter("w1 is not null")
    twice = space.keep(open_windows.groupBy("w1", "w2").agg(F.sum("n").alias("_n")).filter("_n > 1").select("w1", "w2"), "twice")
    across = open_windows.filter("n = 1").join(twice, ["w1", "w2"], "left_semi").select(*SKM, F.array(F.struct(F.col("nth").alias("lo"), (F.col("nth") + 1).alias("hi"))).alias("spans"))
    whole = kinds.filter("n > 1").select(*SKM, F.array(F.struct(F.lit(0).alias("lo"), F.col("wins").alias("hi"))).alias("spans"))
    partly = settled.filter("w1 is null").select(*SKM, "spans").unionByName(across).groupBy(*SKM).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    marks = space.keep(whole.unionByName(partly.join(kinds.filter("n > 1").select(*SKM), SKM, "left_anti")), "marks")
    space.drop("settled", "twice")
    hit = could.join(marks, SKM).groupBy("key", "start").agg(F.first("spans").alias("spans"))
    shifted = hit.select("key", F.transform("spans", lambda s: F.struct((s["lo"] + F.col("start")).alias("lo"), (s["hi"] + F.col("start")).alias("hi"))).alias("spans"))
    out = space.keep(shifted.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
    space.drop("could", "kinds", "several", "marks")
    return out


def covered(spans: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Word ranges under sorted ranges of window starts, merged."""
    out: list[list[int]] = []
    for s in spans or ():
        lo, hi = s["lo"], s["hi"] + window - 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def cut_words(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without those words and without the white space before each removed run."""
    places = [m.span() for m in WORD.finditer(text)]
    parts, at = [], 0
    for lo, hi in gone:
        parts.append(text[at : places[lo - 1][1] if lo else 0])
        at = places[hi - 1][1]
    parts.append(text[at:])
    return "".join(parts).lstrip() if gone and gone[0][0] == 0 else "".join(parts)


def dedup_substrings(docs: DataFrame, window: int = 50, mmer: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, the cut ``text``, and n_words, n_removed, kept_sha256 of each document."""
    space = Workspace(docs.sparkSession, "substrings")
    spans = repeated_spans(docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")), space, window, mmer)
    source = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"), text_key(F.col(text_col)).alias("key"))
    joined = source.join(spans, "key", "left").drop("key")
    width = len(keep) + 1
    schema = T.StructType([*source.schema.fields[:width], *(T.StructField(n, k) for n, k in (("text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())))])

    def run(batches):
        for batch in batches:
            rows = []
            for text, marked in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                words = WORD.findall(text or "")
                gone = covered(marked, window)
                kept, at = [], 0
                for lo, hi in gone:
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                rows.append((cut_words(text, gone) if gone else text, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.name for f in schema.fields])

    return joined.mapInArrow(run, schema)


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, w, string_agg(w, ' ') OVER f AS win, count(*) OVER f AS n FROM w
      WINDOW f AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT rid, i, w, CASE WHEN n = 35 AND count(*) OVER (PARTITION BY n, win) > 1 THEN i END AS hit FROM g),
c AS (SELECT rid, i, w, coalesce(i - max(hit) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) < 35, false) AS gone FROM r),
s AS (SELECT rid, count(*) AS n_words, sum(gone::INT)::BIGINT AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (rid)
"""
