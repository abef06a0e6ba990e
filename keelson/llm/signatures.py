"""Jaccard join of shingle sets by signature trees.

A signature tree holds sets as leaves; every node has the OR of the bitmaps
below it, the range of set sizes, and the largest excess (set size less bits
set). Two nodes can only hold a similar pair if

    popcount(OR_a & OR_b) + min(excess_a, excess_b)

reaches the overlap that the smallest sizes need, if their size ranges are
compatible and if they are not all one component already. A dual traversal
descends from pairs of nodes that pass.

At scale, no tree holds the corpus. The join is split so that every similar
pair meets in some tree:

1. Sets are reduced to distinct sets; copies share a node of the graph.
2. Prefix filter: ordered by a corpus-wide count sketch (rare first), two
   similar sets share one of their first ``n - ceil(t n) + 1`` shingles. Only
   shingles that different sets share in their prefixes are kept.
3. Blocks: every set of which a good part of the prefix is shared goes to a few
   buckets by its least shingle hashes, large buckets dealt into blocks by
   chance; a tree with exact checks links what is similar there. That joins
   nearly all classes, large groups of near copies included, at one visit per
   set and bucket.
4. The exact rest: a prefix shingle matters now only if its sets lie in
   different components. Trees over the bitmaps of the shared prefixes give
   the pairs between components that could still be similar (buckets with
   many sets as pairs of blocks). Pairs that share as many prefix shingles as
   similar sets must are checked exactly.

No link between different classes is lost: step 4 looks at every prefix
shingle that sets of two components share.

Defined results: null or empty text, or text without words, has the empty set
and links with nothing; a null id gets its set's size and, if linked, its
component, which links through it hold together, but never names one; a
component whose ids are all null has a null id; rows that repeat an id stay
apart if their texts differ, and copies are linked; a similarity of exactly
``percent`` links; an empty table gives an empty table; a very long text is one
set like any other; further columns, also named like those of the result, do
not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, table
from .components import connected_components
from .words import chunks, every_run, hash_words, mix, signed

SKETCH_BITS, CHUNK_BITS = 18, 14
ROUNDS = 3
NEAR = 20
SMALL = 6
BLOCK_ROWS, BLOCK_WORDS = 128, 1 << 18
PAIR_ROWS = 2048
PREFIX_WORDS64 = 4


# ---- sets ------------------------------------------------------------------


class Shingler:
    def __init__(self, size: int) -> None:
        self.size = size

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        hashes, ends = hash_words(texts, lower=True)
        hashes = hashes[:, 0]
        every = every_run(hashes, self.size)
        out = []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if hi - lo >= self.size:
                out.append(np.unique(every[lo : hi - self.size + 1]))
            else:
                out.append(every_run(hashes[lo:hi], hi - lo) if hi > lo else every[:0])
        return out


def node_of(shingles: np.ndarray) -> int | None:
    """A 64-bit name of a set; none for the empty set."""
    if not len(shingles):
        return None
    return int(signed(mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64)))[0])


def at_least(n, percent: int):
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def overlap_needed(a, b, percent: int):
    """The least intersection of sets of sizes a and b with Jaccard similarity percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_needed(a, b, percent: int):
    """How many shingles the prefixes of two such sets share at least."""
    return np.maximum(1, overlap_needed(a, b, percent) - np.maximum(at_least(a, percent), at_least(b, percent)) + 1)


# ---- the tree --------------------------------------------------------------


class SignatureTree:
    """Levels of nodes over rows sorted by size; level 0 are single rows."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, excess: np.ndarray, groups: np.ndarray, fanout: int = 8, leaf: int = 32) -> None:
        order = np.lexsort((*bits.T[:1], sizes))
        self.order = order
        self.rows = (sizes[order], sizes[order], bits[order], excess[order], groups[order], groups[order])
        self.leaf, self.fanout = leaf, fanout
        self.levels = []
        least, most, bit, exc, g0, g1 = self.rows
        step = leaf
        while True:
            cuts = np.arange(0, len(least), step)
            least, most = np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            bit, exc = np.bitwise_or.reduceat(bit, cuts, axis=0), np.maximum.reduceat(exc, cuts)
            g0, g1 = np.minimum.reduceat(g0, cuts), np.maximum.reduceat(g1, cuts)
            self.levels.append((least, most, bit, exc, g0, g1))
            if len(cuts) == 1:
                return
            step = fanout

    def pairs(self, percent: int, need, one_group):
        """Arrays (i, j) of rows that may be similar, leaf pair by leaf pair.

        ``need(least_a, least_b, most_a, most_b)`` is the overlap that the bitmaps
        must be able to show; ``one_group(level arrays, i, j)`` tells pairs that need no look.
        """
        top = len(self.levels) - 1
        todo = [(top, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            below = self.levels[level - 1] if level else self.rows
            width = self.fanout if level else self.leaf
            a = np.arange(i * width, min((i + 1) * width, len(below[0])))
            b = np.arange(j * width, min((j + 1) * width, len(below[0])))
            least, most, bits, excess, g0, g1 = below
            la, lb, ma, mb = least[a][:, None], least[b][None], most[a][:, None], most[b][None]
            ok = (100 * mb >= percent * la) & (100 * ma >= percent * lb)
            if i == j:
                ok &= a[:, None] <= b[None] if level else a[:, None] < b[None]
            ok &= ~((g0[a] == g1[a])[:, None] & (g0[b] == g1[b])[None] & (g0[a][:, None] == g0[b][None]))
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            shown = np.bitwise_count(bits[a[x]] & bits[b[y]]).sum(1, dtype=np.int64) + np.minimum(excess[a[x]], excess[b[y]])
            fits = shown >= need(least[a[x]], least[b[y]], most[a[x]], most[b[y]])
            x, y = a[x[fits]], b[y[fits]]
            if level:
                todo += [(level - 1, p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True) if not one_group(level - 1, p, q)]
            elif len(x):
                yield self.order[x], self.order[y]


class Forest:
    """Union-find."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def bitmaps(sets: list[np.ndarray], words64: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap and excess of each set."""
    bits = np.zeros((len(sets), words64), np.uint64)
    for i, s in enumerate(sets):
        place = s & np.uint64(64 * words64 - 1)
        np.bitwise_or.at(bits[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    lengths = np.array([len(s) for s in sets], np.int64)
    return bits, lengths - np.bitwise_count(bits).sum(1, dtype=np.int64)


def link_block(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A star (row, root) for every class of rows that exact links connect in this block."""
    sizes = np.array([len(s) for s in sets], np.int64)
    words64 = 1 << max(0, min(10, int(4 * np.median(sizes)).bit_length() - 6))
    bits, excess = bitmaps(sets, words64)
    tree = SignatureTree(sizes, bits, excess, np.arange(len(sets)))
    forest = Forest(len(sets))
    rank = np.empty(len(sets), np.int64)
    rank[tree.order] = np.arange(len(sets))

    def one_group(level, p, q):
        width = tree.leaf * tree.fanout**level
        rows = tree.order[p * width : (p + 1) * width].tolist() + tree.order[q * width : (q + 1) * width].tolist()
        first = forest.root(rows[0])
        return all(forest.root(r) == first for r in rows)

    for i, j in tree.pairs(percent, lambda la, lb, ma, mb: overlap_needed(la, lb, percent), one_group):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.root(x) != forest.root(y):
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                    forest.join(x, y)
    return [(x, r) for x in range(len(sets)) if (r := forest.root(x)) != x]


# ---- the distributed join --------------------------------------------------


def _sets_and_sketch(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, node, keys) of every document, and rows (part, counts) of the count sketch."""

    def run(batches):
        shingle, sketch = Shingler(size), np.zeros(1 << SKETCH_BITS, np.uint32)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        names = ["id", "n", "node", "keys", "part", "counts"]
        salts = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64))
        id_type = None
        for batch in batches:
            id_type = batch.schema.types[0]
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sets = shingle(texts[lo:hi])
                sketch += np.bincount((np.concatenate(sets) & mask).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
                n = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([[int(signed(np.array([mix(s ^ x).min()]))[0]) for x in salts] if len(s) else None for s in sets], pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if id_type is not None:
            parts = sketch.reshape(-1, 1 << CHUNK_BITS)
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array(range(k), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names)

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, n long, node long, keys array<long>, part int, counts binary")


def _merged_sketch(rows: DataFrame) -> np.ndarray:
    """Sum of all tasks' sketches: 2**SKETCH_BITS counts, whatever the input."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
                total[part] = total[part] + counts if part in total else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in rows.repartition(1 << (SKETCH_BITS - CHUNK_BITS), "part").mapInArrow(run, "part int, counts binary").collect():
        sketch[r["part"] << CHUNK_BITS : (r["part"] + 1) << CHUNK_BITS] = np.frombuffer(r["counts"], np.uint64)
    return sketch


def _prefixes(docs: DataFrame, size: int, percent: int, sketch) -> DataFrame:
    """(token, node, n): the prefix of every set, once for a set and task."""

    def run(batches):
        shingle, counts, seen = Shingler(size), sketch.value, set()
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                tokens, nodes, sizes = [], [], []
                for s in shingle(texts[lo:hi]):
                    node = node_of(s)
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    keep = len(s) - at_least(len(s), percent) + 1
                    first = np.lexsort((s, counts[(s & mask).astype(np.int64)]))[:keep]
                    tokens.append(s[first])
                    nodes.append(np.full(keep, node))
                    sizes.append(np.full(keep, len(s)))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes), pa.int64())], ["token", "node", "n"])

    return docs.select("text").mapInArrow(run, "token long, node long, n long")


def _full_sets(joined: DataFrame, size: int) -> DataFrame:
    """(node, places, set) of (text, node, places) rows whose text has that node."""

    def run(batches):
        shingle, seen = Shingler(size), set()
        for batch in batches:
            texts, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sets = shingle(texts[lo:hi])
                # rows that repeat id and text come along; one is enough
                at = [i for i, s in zip(range(lo, hi), sets, strict=True) if nodes[i] not in seen and node_of(s) == nodes[i] and not seen.add(nodes[i])]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), batch.column(2).take(pa.array(at, pa.int64())), pa.array([sets[i - lo].astype("<u8").tobytes() for i in at], pa.binary())], ["node", "places", "set"])

    return joined.mapInArrow(run, f"node long, places {joined.schema['places'].dataType.simpleString()}, set binary")


def _grouped(batches, width: int):
    """Rows of consecutive equal first ``width`` columns."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][:width] != row[:width]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block_links(full: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for group in _grouped(batches, 3):
            rows = {r[3]: r[4] for r in group}
            if len(rows) > 1:
                nodes = list(rows)
                stars = link_block([np.frombuffer(x, np.uint64) for x in rows.values()], percent)
                if stars:
                    yield _edges([nodes[x] for x, _ in stars], [nodes[r] for _, r in stars])

    placed = full.select("node", "set", F.explode("places").alias("p")).select("p.round", "p.key", "p.block", "node", "set")
    return placed.repartition("round", "key", "block").sortWithinPartitions("round", "key", "block").mapInArrow(run, "a long, b long")


def _with_bits(nodes: DataFrame) -> DataFrame:
    """(node, n, comp, ntoks, bits, toks): the bitmap of each set's shared prefix."""

    def run(batches):
        for batch in batches:
            toks = batch.column(3)
            sets = [np.array(t, np.int64).view(np.uint64) for t in toks.to_pylist()]
            bits, _ = bitmaps(sets, PREFIX_WORDS64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t) for t in sets], pa.int64()), pa.array([b.astype("<u8").tobytes() for b in bits], pa.binary()), toks], ["node", "n", "comp", "ntoks", "bits", "toks"])

    return nodes.select("node", "n", "comp", "toks").mapInArrow(run, "node long, n long, comp long, ntoks long, bits binary, toks array<long>")


def _few_pairs(own: list[tuple], percent: int):
    """The tree's tests on a bucket that is one small leaf."""
    marks = [(r[3], r[4], r[5], int.from_bytes(r[7], "little"), r[6], r[8]) for r in own]
    for k, (x, nx, cx, bx, tx, sx) in enumerate(marks):
        for y, ny, cy, by, ty, sy in marks[:k]:
            if cx != cy and 100 * nx >= percent * ny and 100 * ny >= percent * nx:
                shown = (bx & by).bit_count() + min(tx - bx.bit_count(), ty - by.bit_count())
                if shown >= -(-percent * (nx + ny) // (100 + percent)) - max(at_least(nx, percent), at_least(ny, percent)) + 1:
                    yield (x, y, nx, ny, sx != sy) if x < y else (y, x, ny, nx, sx != sy)


def _rest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of sets in different components that the prefix bitmaps cannot rule out, for every shared shingle."""

    def run(batches):
        out: list[tuple] = []
        for group in _grouped(batches, 3):
            across = group[0][1] != group[0][2]
            own = list({r[3]: r for r in group}.values())
            if len(own) <= SMALL:
                out += [p[:4] for p in _few_pairs(own, percent) if p[4] or not across]
            else:
                nodes = np.array([r[3] for r in own])
                sizes = np.array([r[4] for r in own], np.int64)
                comps = np.array([r[5] for r in own], np.int64)
                bits = np.frombuffer(b"".join(r[7] for r in own), "<u8").astype(np.uint64).reshape(-1, PREFIX_WORDS64)
                excess = np.array([r[6] for r in own], np.int64) - np.bitwise_count(bits).sum(1, dtype=np.int64)
                side = np.array([r[8] for r in own])
                tree = SignatureTree(sizes, bits, excess, comps)
                for i, j in tree.pairs(percent, lambda la, lb, ma, mb: prefix_needed_least(la, lb, ma, mb, percent), lambda *_: False):
                    # two different blocks: only pairs across them
                    keep = side[i] != side[j] if across else slice(None)
                    i, j = i[keep], j[keep]
                    swap = nodes[i] > nodes[j]
                    a, b = np.where(swap, j, i), np.where(swap, i, j)
                    if len(a):
                        yield _pairs(nodes[a], nodes[b], sizes[a], sizes[b])
            if len(out) > 1 << 14:
                yield _pairs(*zip(*out, strict=True))
                out = []
        if out:
            yield _pairs(*zip(*out, strict=True))

    return rows.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2").mapInArrow(run, "a long, b long, na long, nb long")


def _pairs(a, b, na, nb) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, na, nb)], ["a", "b", "na", "nb"])


def _prefix_needed_sql(percent: int) -> str:
    both = f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"
    return f"greatest(1, {both} - greatest(({percent} * na + 99) div 100, ({percent} * nb + 99) div 100) + 1)"


def prefix_needed_least(la, lb, ma, mb, percent: int):
    """A lower bound of prefix_needed over ranges of sizes."""
    return np.maximum(1, overlap_needed(la, lb, percent) - np.maximum(at_least(ma, percent), at_least(mb, percent)) + 1)


def _checked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    one, two = full.select(F.col("node").alias("a"), F.col("set").alias("sa")), full.select(F.col("node").alias("b"), F.col("set").alias("sb"))

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, sx, sy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * shared >= percent * (len(p) + len(q) - shared):
                    a.append(x)
                    b.append(y)
            yield _edges(a, b)

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar_classes(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each document.

    ``component_id`` is the smallest id that links of Jaccard similarity
    ``percent`` / 100 or more reach.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "signatures")
    # rows are told apart by id and content; missing ids come last in that order
    key = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("md5"))
    source = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    first = space.keep(_sets_and_sketch(source, shingle_words), "sets")
    sketch = spark.sparkContext.broadcast(_merged_sketch(first.filter("part is not null").select("part", "counts")))
    sets = first.filter("part is null").select("id", "n", "node", "keys")
    lead = sets.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))

    prefixes = space.keep(_prefixes(source, shingle_words, percent, sketch), "prefixes")
    common = space.keep(prefixes.groupBy("token").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).filter("_lo < _hi").select("token"), "common")
    nodes = space.keep(prefixes.join(common, "token", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.collect_set("token").alias("toks")), "nodes")
    space.drop("prefixes", "common")

    keyed = space.keep(nodes.filter(F.size("toks") * NEAR >= F.col("n")).select("node", "n").join(lead, "node").select("node", "n", "id", F.posexplode("keys").alias("round", "key")), "keyed")
    sizes = space.keep(keyed.groupBy("round", "key").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).filter("rows > 1").select("round", "key", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("words") / BLOCK_WORDS)).alias("blocks")), "sizes")
    placed = keyed.join(sizes, ["round", "key"]).select("node", "id", F.struct("round", "key", F.pmod(F.xxhash64("node", "round"), "blocks").alias("block")).alias("p"))
    wanted = space.keep(placed.groupBy("id", "node").agg(F.collect_list("p").alias("places")), "wanted")
    full = space.keep(_full_sets(source.hint("merge").join(wanted, "id").select("text", "node", "places"), shingle_words), "full")
    space.drop("keyed", "sizes", "wanted")
    near = space.keep(_block_links(full, percent), "near")
    space.drop("full")
    classes = connected_components(near, space, "near")

    inside = space.keep(_with_bits(nodes.join(classes, "node", "left").select("node", "n", "toks", F.coalesce("label", "node").alias("comp"))), "inside")
    mixed = inside.select("comp", F.explode("toks").alias("token")).groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n")).filter("_lo < _hi")
    mixed = space.keep(mixed.select("token", F.ceil(F.col("_n") / PAIR_ROWS).cast("int").alias("blocks")), "mixed")
    rows = inside.select("node", "n", "comp", "ntoks", "bits", F.explode("toks").alias("token")).join(mixed, "token")
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = rows.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"), "node", "n", "comp", "ntoks", "bits", "side")
    pairs = space.keep(_rest_pairs(dealt, percent).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("_shared")).filter(f"_shared >= {_prefix_needed_sql(percent)}").select("a", "b"), "pairs")
    ends = space.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(lead.select("node", "id"), "node").withColumn("places", F.lit(0)), "ends")
    space.drop("inside", "mixed", "nodes")
    others = space.keep(_full_sets(source.hint("merge").join(ends, "id").select("text", "node", "places"), shingle_words).dropDuplicates(["node"]).select("node", "set"), "others")
    rest = space.keep(_checked(pairs, others, percent), "rest")
    space.drop("pairs", "ends", "others")
    final = connected_components(near.unionByName(rest), space, "all")
    named = space.keep(sets.filter("node is not null").groupBy("node").agg(F.min("id").alias("id")).join(final, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    least = space.keep(named.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    answer = space.keep(named.join(least, "label").select("node", "component_id"), "answer")
    joined = sets.join(answer, "node", "left")
    sketch.unpersist()
    return joined.select(F.col("id.id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id.id", "id.id").alias("component_id"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), shingle_words=4, percent=85)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM c LEFT JOIN n USING (doc_id)
"""
