"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words, and so are the benchmark items. Both become
TF-IDF vectors over the benchmark's words and hashed buckets for all others,
with document frequencies of the whole corpus. A distributed randomised SVD
(Halko et al. 2011) of all passages of the corpus and all item windows gives a
latent space, in which every passage of every text looks for items by cosine. A candidate is confirmed by the longest common subsequence of
the item's words and the text around the passage, for the whole item and for
its answer (its last sentence, or the last quarter of its words), so that
reworded copies count and texts that merely share a topic don't.

The SVD reads the corpus as a linear sketch: each partition deals its passages
in turn to ``sketch`` rows and adds them up there under random signs. Every
passage counts, and the sums of products of terms, which alone make the SVD,
are right on average; up to ``sketch`` passages a partition they are exact. All
passages together weigh as much as those of ``corpus_docs`` average documents,
so that the items are not drowned in a large corpus.

Words are the runs of ASCII letters, digits and all characters beyond ASCII in
the lower-cased text.

Defined results: null or empty text, and items without words, match nothing;
an empty benchmark or an empty table gives no match; repeated rows match each,
and repeated items are matched each; of passages that tie for an item the first
counts. Very long texts are worked on window by window. Further columns, also
named like those of the result, do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, table
from .words import chunks, digests, hash_words

#: Item windows that passages are compared with at a time, and bytes of term vectors that are sent to tasks at most.
TILE, MODEL_BYTES = 4096, 1 << 30
#: Bytes of a partition's sketch and of a batch of dense rows at most, and tasks of a pass of the SVD.
DENSE_BYTES, SUMS = 1 << 26, 16
#: Bytes that belong to words; all others become spaces.
IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
SPACED = bytes(b if IN_WORD[b] else 32 for b in range(256))
SENTENCE = re.compile(r"[.!?]+(?=\s|\Z)")


@dataclass(frozen=True)
class Settings:
    window: int = 32
    rank: int = 128
    oversample: int = 16
    power: int = 2
    buckets: int = 4096
    corpus_docs: int = 500
    sketch: int = 256
    item_weight: float = 8.0
    cosine: float = 0.65
    lcs: float = 0.6
    answer: float = 0.5
    #: Items of at most so many words are looked for in windows of as many, the largest that holds them.
    short: tuple[int, ...] = (4, 12)


@dataclass
class Item:
    item_id: object
    words: list[str]
    answer: list[str]
    counts: Counter = field(init=False)

    def __post_init__(self) -> None:
        self.counts = Counter(self.words)


def split_words(text: str | None) -> list[str]:
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    return [w.decode("utf-8", "replace") for w in raw.translate(SPACED).split()]


def item_of(item_id, text: str | None) -> Item:
    words = split_words(text)
    sentences = [w for s in SENTENCE.split(text or "") if (w := split_words(s))]
    last = sentences[-1] if len(sentences) > 1 else []
    quarter = words[-max(1, len(words) // 4) :] if words else []
    return Item(item_id, words, last if 3 <= len(last) < len(words) else quarter)


class Terms:
    """Numbers of words: the benchmark's own, then hashed buckets."""

    def __init__(self, vocabulary: dict[str, int], buckets: int) -> None:
        self.base, self.buckets = len(vocabulary), buckets
        self.size = self.base + buckets
        own = digests([w.encode("utf-8", "surrogatepass") for w in vocabulary])[:, 0]
        order = np.argsort(own)
        self.own, self.number = own[order], np.array(list(vocabulary.values()), np.int64)[order]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words, and where each text's begin (one entry more than texts)."""
        hashes, ends = hash_words([(t or "").lower() for t in texts], inside=IN_WORD)
        hashes = hashes[:, 0]
        ids = (hashes % np.uint64(self.buckets)).astype(np.int64) + self.base
        if self.base:
            at = np.minimum(np.searchsorted(self.own, hashes), self.base - 1)
            known = self.own[at] == hashes
            ids[known] = self.number[at[known]]
        return ids, ends


def padded(ids: np.ndarray, ends: np.ndarray, width: int, filler: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and words of consecutive stretches of ``width`` words, the last one filled up."""
    counts = -(-np.diff(ends) // width)
    text = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = ends[:-1][text] + nth * width
    place = start[:, None] + np.arange(width)
    words = np.where(place < ends[1:][text][:, None], np.append(ids, filler)[np.minimum(place, len(ids))], filler)
    return text, nth * width, words


def lcs(pattern: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    state = full
    for w in words:
        if m := masks.get(w):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(pattern) - state.bit_count()


class Latent:
    """A fitted model: finds items in texts."""

    def __init__(self, items: list[Item], vocabulary: dict[str, int], rows: np.ndarray, settings: Settings) -> None:
        """``rows`` are the terms' latent vectors, weighted, with a row of zeros at the end."""
        self.items, self.vocabulary, self.rows, self.settings = items, vocabulary, rows, settings
        self.terms = Terms(vocabulary, settings.buckets)
        #: By window: the items' numbers and unit vectors.
        self.queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in sorted({self._window(i) for i in items}):
            pieces, owner = [], []
            for i, item in enumerate(items):
                if self._window(item) == w:
                    ids, _ = self.terms([" ".join(item.words)])
                    for at in range(0, max(1, len(ids) - w // 2), w // 2):
                        pieces.append(rows[ids[at : at + w]].sum(0))
                        owner.append(i)
            queries = np.array(pieces, np.float32).reshape(-1, rows.shape[1])
            self.queries[w] = np.array(owner, np.int64), queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)

    def _window(self, item: Item) -> int:
        return next((w for w in self.settings.short if len(item.words) <= w), self.settings.window)

    def candidates(self, ids: np.ndarray, ends: np.ndarray):
        """(text, first word, words, item, cosine) of passages near an item."""
        for window, (owner, queries) in self.queries.items():
            yield from self._near(ids, ends, window, owner, queries)

    def _near(self, ids: np.ndarray, ends: np.ndarray, window: int, owner: np.ndarray, queries: np.ndarray):
        text, start, words = padded(ids, ends, window // 2, len(self.rows) - 1)
        if not len(start):
            return
        vectors = self.rows[words[:, 0]]
        for j in range(1, words.shape[1]):
            vectors += self.rows[words[:, j]]
        joined = np.append(text[1:] == text[:-1], False)
        # a window is two halves; the last half of a longer text belongs to the window before it
        whole = np.flatnonzero(~(~joined & np.append(False, joined[:-1])))
        both = vectors[whole]
        both[joined[whole]] += vectors[whole[joined[whole]] + 1]
        both /= np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-12)
        # tiles of items, so that a large benchmark takes no more memory
        for lo in range(0, len(queries), TILE):
            found = both @ queries[lo : lo + TILE].T
            near = np.flatnonzero(found.max(1) >= self.settings.cosine)
            x, y = np.nonzero(found[near] >= self.settings.cosine)
            x = near[x]
            for p, item, cosine in zip(whole[x].tolist(), owner[lo + y].tolist(), found[x, y].tolist(), strict=True):
                yield int(text[p]), int(start[p]), window, item, cosine

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its (item_id, cosine, lcs, answer, word)."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        words: dict[int, list[str]] = {}
        for t, at, window, i, cosine in self.candidates(*self.terms(texts)):
            if t not in words:
                words[t] = split_words(texts[t])
            item, known = self.items[i], best[t].get(i)
            n = len(item.words)
            region = words[t][max(0, at - n) : at + window + n]
            # words in common, repeats counted, bound the subsequence from above
            if (item.counts & Counter(w for w in region if w in item.counts)).total() < self.settings.lcs * n:
                continue
            share = lcs(item.words, region) / n
            if share < self.settings.lcs or known is not None and (share, cosine) <= (known[2], known[1]):
                continue
            answer = lcs(item.answer, region) / len(item.answer)
            if answer >= self.settings.answer:
                best[t][i] = (item.item_id, cosine, share, answer, at)
        return [[b[i] for i in sorted(b)] for b in best]


def _sum_blocks(partial: DataFrame, shape: tuple[int, int], block: int) -> np.ndarray:
    """Sums (block, bytes) rows of float32 blocks on the executors; the shape is that of the model."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.float32).astype(np.float64)
                total[b] = total[b] + x if b in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "raw"])

    out = np.zeros(shape)
    for r in partial.repartition(-(-shape[0] // block), "block").mapInArrow(run, "block int, raw binary").collect():
        out[r["block"] * block : (r["block"] + 1) * block] += np.frombuffer(r["raw"]).reshape(-1, shape[1])
    return out


def randomized_basis(rows: DataFrame, terms: int, rank: int, oversample: int, power: int, seed: int = 7, block: int = 1024) -> np.ndarray:
    """The leading right singular vectors of the matrix whose sparse rows are (ids, weights).

    Each pass sums ``A'(A Q)`` over the partitions; only terms x rank numbers leave them.
    """
    width = min(rank + oversample, terms)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    product = q
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    known = conf.get(key)
    conf.set(key, str(max(1, DENSE_BYTES // (8 * terms))))
    try:
        for _ in range(power + 1):
            q = np.linalg.qr(product)[0]
            product = _sum_blocks(_gram(rows, q, block), (terms, width), block)
    finally:
        conf.set(key, known)
    values, vectors = np.linalg.eigh(q.T @ product)
    order = np.argsort(-values)[:rank]
    return q @ vectors[:, order[values[order] > 1e-9 * max(values.max(), 1e-30)]]


def _gram(rows: DataFrame, q: np.ndarray, block: int) -> DataFrame:
    def run(batches):
        total = np.zeros_like(q)
        for batch in batches:
            ids, weights, n = batch.column(0), batch.column(1), batch.num_rows
            dense = np.zeros((n, len(q)))
            dense[np.repeat(np.arange(n), ids.value_lengths().to_numpy()), ids.flatten().to_numpy()] = weights.flatten().to_numpy()
            total += dense.T @ (dense @ q)
        for b, lo in enumerate(range(0, len(q), block)):
            if total[lo : lo + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([total[lo : lo + block].astype(np.float32).tobytes()], pa.binary())], ["block", "raw"])

    # a few tasks, each of whose sums has the model's size
    return rows.coalesce(SUMS).mapInArrow(run, "block int, raw binary")


def weighted_terms(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the unit TF-IDF vectors of rows of words; numbers beyond ``idf`` fill up."""
    flat = np.sort(words, axis=1)
    fresh = np.ones(flat.shape, bool)
    fresh[:, 1:] = flat[:, 1:] != flat[:, :-1]
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, flat.size))
    row, term = start // words.shape[1], flat.ravel()[start]
    real = term < len(idf)
    row, term = row[real], term[real]
    weight = count[real] * idf[term]
    return row, term, weight / np.sqrt(np.bincount(row, weight * weight, minlength=len(words)))[row]


def fit(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Latent:
    """Statistics of all documents, and the latent space. The benchmark is the query set and is held whole."""
    spark = docs.sparkSession
    items = [i for r in benchmark.select(item_col, item_text_col).collect() if (i := item_of(r[0], r[1])).words]
    items.sort(key=lambda i: (str(i.item_id), i.words))
    vocabulary = {w: n for n, w in enumerate(sorted({w for i in items for w in i.words}))}
    buckets, window = settings.buckets, settings.window
    size = len(vocabulary) + buckets
    texts = docs.select(F.col(text_col).alias("text"))

    def frequencies(batches):
        own, total, n, read = Terms(vocabulary, buckets), np.zeros(size + 1, np.int64), 0, 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            read += len(column)
            for lo, hi in chunks(column, 1 << 18):
                _, _, words = padded(*own(column[lo:hi]), window, size)
                words.sort(axis=1)
                fresh = np.ones(words.shape, bool)
                fresh[:, 1:] = words[:, 1:] != words[:, :-1]
                total += np.bincount(words[fresh], minlength=size + 1)
                n += len(words)
        some = np.flatnonzero(total[:size])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]), pa.int32()), pa.array(np.append(total[some], [n, read]), pa.int64())], ["term", "n"])

    df = np.zeros(size)
    passages = rows_read = 0
    # one row for each term
    for r in texts.mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] == -1:
            passages = r["n"]
        elif r["term"] == -2:
            rows_read = r["n"]
        else:
            df[r["term"]] = r["n"]
    idf = np.log((passages + 1) / (df + 1)) + 0.1

    if not items:
        return Latent([], {}, np.zeros((buckets + 1, 1), np.float32), settings)
    if (size + 1) * settings.rank * 4 > MODEL_BYTES:
        raise ValueError(f"{len(vocabulary)} words of the benchmark; with rank {settings.rank}, {MODEL_BYTES // settings.rank // 4} terms are held at most: split the benchmark")
    weight = min(1.0, settings.corpus_docs / max(1, rows_read)) ** 0.5
    held = max(1, min(settings.sketch, DENSE_BYTES // (4 * size)))

    def sketched(batches):
        own, total, n = Terms(vocabulary, buckets), np.zeros((held, size), np.float32), 0
        rng = np.random.default_rng([7, TaskContext.get().partitionId()])
        for batch in batches:
            column = batch.column(0).to_pylist()
            for lo, hi in chunks(column, 1 << 18):
                _, _, words = padded(*own(column[lo:hi]), window, size)
                row, term, w = weighted_terms(words, idf)
                signs = rng.choice([-weight, weight], len(words))
                np.add.at(total.reshape(-1), (n + row) % held * size + term, (w * signs[row]).astype(np.float32))
                n += len(words)
        for r in range(min(held, n)):
            some = np.flatnonzero(total[r])
            yield vectors([some], [total[r, some]])

    def windows(batches):
        own = Terms(vocabulary, buckets)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                _, _, words = padded(*own([text]), window, size)
                row, term, w = weighted_terms(words, idf)
                cuts = np.flatnonzero(np.diff(row)) + 1
                yield vectors(np.split(term, cuts), np.split(settings.item_weight * w, cuts))

    def vectors(ids, weights):
        return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for x in weights], pa.list_(pa.float32()))], ["ids", "weights"])

    kind = "ids array<int>, weights array<float>"
    queries = benchmark.select(F.col(item_text_col).alias("text")).mapInArrow(windows, kind)
    rows = Workspace(spark, "decontam").keep(texts.mapInArrow(sketched, kind).unionByName(queries), "sketch")
    basis = randomized_basis(rows, size, settings.rank, settings.oversample, settings.power)
    weighted = np.zeros((size + 1, basis.shape[1]), np.float32)
    weighted[:size] = basis * idf[:, None]
    return Latent(items, vocabulary, weighted, settings)


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``leaks`` (item, cosine, lcs, answer, word) of every document."""
    model = fit(docs, benchmark, settings, text_col, item_col, item_text_col)
    # terms x rank numbers and the benchmark itself, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((model.items, model.vocabulary, model.rows))
    item_type = benchmark.schema[item_col].dataType
    leak = T.StructType([T.StructField("item_id", item_type), *(T.StructField(n, T.DoubleType()) for n in ("cosine", "lcs", "answer")), T.StructField("word", T.IntegerType())])
    source = docs.select(F.col(id_col), *keep, F.col(text_col).alias("_text"))
    width = len(keep) + 1
    schema = T.StructType([*source.schema.fields[:width], T.StructField("leaks", T.ArrayType(leak))])

    def run(batches):
        found = Latent(*shared.value, settings)
        for batch in batches:
            texts = batch.column(width).to_pylist()
            out = []
            for lo, hi in chunks(texts, 1 << 18):
                out += found.matches(texts[lo:hi])
            rows = [[dict(zip(leak.names, m, strict=True)) for m in ms] for ms in out]
            kind = pa.list_(pa.struct([("item_id", _arrow(item_type)), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("word", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(rows, kind)], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op3_decontam(spark, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", F.round("l.cosine", 4).alias("cosine"), F.round("l.lcs", 4).alias("lcs"), F.round("l.answer", 4).alias("answer"), F.col("l.word").alias("word"))
