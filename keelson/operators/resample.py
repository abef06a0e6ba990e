"""Permutation tests and the pair bootstrap without moving, copying or collecting rows.

Each statistic needs less than a draw's rows, and that is what is drawn:

* shuffles within a group change a table of quartiles only through its margins,
  so a draw is a chain of hypergeometric counts for each group;
* ranks are known from their place, but for ties, so a draw of a rank
  correlation is a sum over places under keyed permutations (a Feistel network
  on a grid that walks until it lands inside the group), place by place. Both
  columns are permuted, ``DRAWS`` times each, and every pair of theirs is a draw;
* a bootstrap draw is a multinomial count of each row. Counts are split over
  buckets of rows by a tree of binomials that every task walks by itself, then
  over the rows of its bucket, block by block, and only sums come back.

A task keeps a vector of the draws' sums, whatever the rows; the vectors are
added up in two steps. Random numbers are seeded by what is drawn (a group, a
bucket, a node of the tree, a block), so results depend neither on partitions
nor on the order of rows, and one path serves every size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import scratch_dir
from .panel import quartiles
from .ranks import cumulated

#: Places, permutations of a column and numbers that a task holds at a time; draws of one row of work, and its blocks of places.
PLACES, DRAWS, HELD, SHARE, STRETCH = 1 << 16, 16, 1 << 17, 16 * 16, 16
#: Entries of a table of ranks at most, and places that are shuffled as they are.
CELLS, FEW = 1 << 21, 256
#: Buckets of the bootstrap, and rows of a block; neither grows with the rows.
BUCKETS, BLOCK = 256, 512
#: Tied values of a group at most: 16 bytes each in every row of work that has the group.
TIES = 1 << 18
ROUNDS = 6


def generator(*key) -> np.random.Generator:
    """A generator of its own for each key."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b("|".join(map(str, key)).encode(), digest_size=16).digest(), "big"))


def added_up(sums: DataFrame, width: int) -> DataFrame:
    """One row of the sums of all rows' vectors; tasks add what they read, row by row."""

    def add(batches):
        total = np.zeros(width)
        for pdf in batches:
            for vector in pdf["sums"]:
                total += vector
        yield pd.DataFrame({"sums": [total]})

    return sums.repartition(16).mapInPandas(add, "sums array<double>").repartition(1).mapInPandas(add, "sums array<double>")


# ---- transitions -----------------------------------------------------------


def diagonal_draws(rng: np.random.Generator, prev: np.ndarray, now: np.ndarray, n: int) -> np.ndarray:
    """Agreements of n random matchings of rows with the margins ``prev`` and ``now``."""
    left = np.tile(np.asarray(now, np.int64), (n, 1))
    agreed = np.zeros(n, np.int64)
    for i, size in enumerate(prev):
        need, rest = np.full(n, size, np.int64), left.sum(1)
        for j in range(left.shape[1]):
            rest = rest - left[:, j]
            drawn = rng.hypergeometric(left[:, j], rest, need)
            left[:, j] -= drawn
            need -= drawn
            if i == j:
                agreed += drawn
    return agreed


def transition_permutation(sample: DataFrame, n: int = 9999, seed: int = 20240813, group: str = "vintage") -> DataFrame:
    """Share of funds in their predecessor's quartile, its mean under shuffling within groups, and the one-sided p; null below four rows.

    A group has less than 10^9 rows in a quartile, numpy's limit.
    """
    both = quartiles(sample.select(group, "y_lag", "y"), {"q_prev": "y_lag", "q_now": "y"}, group).filter("q_prev is not null and q_now is not null")
    count = lambda c: F.array(*(F.sum((F.col(c) == q).cast("long")) for q in range(1, 5)))
    margins = both.groupBy(group).agg(count("q_prev").alias("prev"), count("q_now").alias("now"), F.sum((F.col("q_prev") == F.col("q_now")).cast("long")).alias("agreed"), F.count("*").alias("rows")).select(F.col(group).cast("string").alias("g"), "prev", "now", "agreed", "rows")

    def run(batches):
        total = np.zeros(n + 2)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                total += np.append(diagonal_draws(generator(seed, "transitions", r.g), r.prev, r.now, n), (r.agreed, r.rows))
        yield pd.DataFrame({"sums": [total]})

    def finish(batches):
        for pdf in batches:
            for sums in pdf["sums"]:
                null, (agreed, rows) = sums[:n], sums[n:]
                enough = rows >= 4
                yield pd.DataFrame([(agreed / rows, null.mean() / rows, (1 + (null >= agreed).sum()) / (n + 1), int(rows)) if enough else (None, None, None, int(rows))], columns=["diagonal", "null_diagonal", "p", "n"])

    return added_up(margins.mapInPandas(run, "sums array<double>"), n + 2).mapInPandas(finish, "diagonal double, null_diagonal double, p double, n long")


# ---- rank correlation ------------------------------------------------------


class Permutations:
    """Permutations of 0 .. size-1, one for each of ``many`` draws.

    A place is a cell of a grid just large enough. ``ROUNDS`` times its row moves
    by a keyed hash of its column, then its column by one of its row, modulo the
    grid's sides; what falls beyond the last place is permuted again until it
    lands inside. Up to ``FEW`` numbers, of which a network would have too few
    permutations, are shuffled.
    """

    def __init__(self, rng: np.random.Generator, size: int, many: int) -> None:
        self.size, self.many = size, many
        self.shuffled = rng.permuted(np.tile(np.arange(size), (many, 1)), axis=1) if size <= FEW else None
        self.rows = math.isqrt(max(0, size - 1)) + 1
        self.columns = -(-size // self.rows)
        # halves of a number hold a side of the grid, the whole a place
        self.kind = np.uint32 if self.rows < 1 << 15 else np.uint64
        self.half = self.kind(np.iinfo(self.kind).bits // 2)
        self.keys = rng.integers(0, np.iinfo(self.kind).max, (many, ROUNDS, 3), self.kind, endpoint=True)
        self.keys[..., ::2] |= self.kind(1)

    def _once(self, row: np.ndarray, column: np.ndarray, draw: int, held: np.ndarray, spare: np.ndarray) -> np.ndarray:
        for i, (factor, add, again) in enumerate(self.keys[draw]):
            source, moved, side = (column, row, self.kind(self.rows)) if i % 2 == 0 else (row, column, self.kind(self.columns))
            np.multiply(source, factor, out=held)
            np.add(held, add, out=held)
            np.right_shift(held, self.half, out=spare)
            np.bitwise_xor(held, spare, out=held)
            np.multiply(held, again, out=held)
            np.right_shift(held, self.half, out=held)
            np.multiply(held, side, out=held)
            np.right_shift(held, self.half, out=held)
            np.add(moved, held, out=moved)
            # below zero numbers wrap, so the least is the remainder
            np.subtract(moved, side, out=held)
            np.minimum(moved, held, out=moved)
        np.multiply(row, self.kind(self.columns), out=held)
        np.add(held, column, out=held)
        return held

    def at(self, places: np.ndarray):
        """A function of the draw: where it sends these places, until the next call."""
        if self.shuffled is not None:
            return lambda draw: self.shuffled[draw, places]
        cells = [v.astype(self.kind) for v in np.divmod(places, self.columns)]
        held, spare, row, column = (np.empty(len(places), self.kind) for _ in range(4))
        sent = np.empty(len(places), np.int64)

        def of(draw: int) -> np.ndarray:
            row[:], column[:] = cells
            np.copyto(sent, self._once(row, column, draw, held, spare), casting="unsafe")
            out = np.flatnonzero(sent >= self.size)
            while len(out):
                x = [v.astype(self.kind) for v in np.divmod(sent[out], self.columns)]
                sent[out] = again = self._once(*x, draw, np.empty_like(x[0]), np.empty_like(x[0])).astype(np.int64)
                out = out[again >= self.size]
            return sent

        return of

    def __call__(self, places: np.ndarray) -> np.ndarray:
        """Where each draw sends these places: draws x places."""
        of = self.at(places)
        return np.array([of(draw).copy() for draw in range(self.many)])


def rank_at(places: np.ndarray, size: int, below: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Percentile ranks of places in order; ``tied`` values begin after ``below`` others and share their average."""
    rank = places + 1.0
    if len(below):
        run = np.searchsorted(below, places, "right") - 1
        inside = (run >= 0) & (places < below[run] + tied[run])
        rank[inside] = (below + (tied + 1) / 2)[run[inside]]
    return rank / size


class Ranks:
    """Twice the ranks of places in any order, as :func:`rank_at` has them.

    A table of at most ``CELLS`` numbers: of places while they are so few, else
    of the stretch (tied values or untied ones between) that each cell of places begins in.
    """

    def __init__(self, size: int, below: np.ndarray, tied: np.ndarray) -> None:
        start = np.unique(np.concatenate([[0], below, below + tied])).astype(np.int64)
        start = start[start < max(1, size)]
        run = np.searchsorted(below, start, "right") - 1
        inside = (run >= 0) & (start < (below + tied)[run]) if len(below) else np.zeros(len(start), bool)
        level, slope = np.full(len(start), 2), np.full(len(start), 2)
        level[inside], slope[inside] = (2 * below + tied + 1)[run[inside]], 0
        self.shift = max(0, (max(1, size - 1) // CELLS).bit_length())
        first = np.arange(((size - 1) >> self.shift) + 1, dtype=np.int64) << self.shift
        cell = np.searchsorted(start, first, "right") - 1
        if not self.shift:
            self.ranks = (level[cell] + slope[cell] * first).astype(np.int32 if size < 1 << 30 else np.int64)
            return
        self.cell, self.after, self.level, self.slope = cell, np.append(start[1:], size), level, slope
        last = np.searchsorted(start, np.minimum(first + (1 << self.shift), size) - 1, "right") - 1
        self.steps = int((last - cell).max())

    def __call__(self, places: np.ndarray) -> np.ndarray:
        if not self.shift:
            return self.ranks.take(places, mode="clip")
        at = self.cell.take(places >> self.shift, mode="clip")
        for _ in range(self.steps):
            at += places >= self.after.take(at, mode="clip")
        return self.level.take(at, mode="clip") + self.slope.take(at, mode="clip") * places


def crossed(left: Permutations, right: Permutations, x: Ranks, y: Ranks, first: int, last: int) -> np.ndarray:
    """Sums over the places from ``first`` to before ``last`` of x at a left permutation times y at a right one: left x right.

    Over all places, x under one permutation and y under another are y shuffled
    against x by a uniform permutation, as either is. Any three such pairs are
    independent, as one of them has a permutation that the others have not; four
    from two permutations of each side are not. So a share over all pairs has the
    mean and the variance of a share over as many independent shuffles.
    """
    out = np.zeros((left.many, right.many))
    for at in range(first, last, PLACES):
        places = np.arange(at, min(at + PLACES, last))
        values = []
        for dealt, ranks in ((left, x), (right, y)):
            sent, held = dealt.at(places), np.empty((dealt.many, len(places)))
            for i in range(dealt.many):
                held[i] = ranks(sent(i))
            values.append(held)
        out += values[0] @ values[1].T
    return out


def spearman_within(sample: DataFrame, n: int = 9999, seed: int = 20240813, group: str = "vintage") -> DataFrame:
    """Correlation of within-group percentile ranks and its one-sided permutation p; null below eight rows.

    Draws come in shares of ``SHARE``, all pairs of as many permutations of
    either column (see :func:`crossed`); shares are independent. The rows and
    their ranks are written once. Each group's tied values come to the tasks
    that have it, ``TIES`` at most; more are an error.
    """
    spark = sample.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    rows = kept(sample.filter("y is not null and y_lag is not null").select(group, "y_lag", "y"), "rows")
    stacked = rows.select(group, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("y_lag").alias("v")), F.struct(F.lit(1).alias("which"), F.col("y").alias("v")))).alias("e")).select(group, "e.which", "e.v")
    ranks = kept(cumulated(stacked, "v", (group, "which")), "ranks")
    share = (F.col("_below") + (F.col("_c") + 1) / 2) / F.col("_n")
    of = lambda which: ranks.filter(F.col("_g1") == which).select(F.col("_g0").alias(f"_g{which}x"), F.col("_v").alias(f"_v{which}x"), share.alias(f"_r{which}"))
    own = lambda which, c: F.col(group).eqNullSafe(F.col(f"_g{which}x")) & (F.col(c) == F.col(f"_v{which}x"))
    ranked = rows.join(of(0), own(0, "y_lag")).join(of(1), own(1, "y"))
    # one row
    seen = ranked.agg(F.covar_pop("_r0", "_r1").alias("cov"), F.count("*").alias("n"), *(f(c).alias(f"{k}{c}") for c in ("_r0", "_r1") for k, f in (("mean", F.avg), ("sd", F.stddev_pop)))).first()

    ties = ranks.filter("_c > 1").groupBy("_g0", "_g1").agg(F.count("*").alias("k"))
    # one row
    most = ties.agg(F.max("k")).first()[0] or 0
    if most > TIES:
        raise ValueError(f"{most} tied values in a group; {TIES} are held at most")
    runs = lambda which: F.array_sort(F.collect_list(F.when((F.col("_c") > 1) & (F.col("_g1") == which), F.struct(F.col("_below").alias("below"), F.col("_c").alias("tied"))))).alias(f"t{which}")
    groups = ranks.groupBy("_g0").agg(F.max("_n").alias("size"), runs(0), runs(1))
    part = lambda i, c: F.transform(F.col(f"t{i}"), lambda t: t[c])
    work = groups.select(F.col("_g0").cast("string").alias("g"), "size", *(part(i, c).alias(f"{c}{i}") for i in (0, 1) for c in ("below", "tied")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PLACES * STRETCH).cast("long"))).alias("at")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(SHARE))))

    def run(batches):
        total = np.zeros(n)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                (x_below, x_tied), (y_below, y_tied) = ((np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in ((r.below0, r.tied0), (r.below1, r.tied1)))
                size, many = int(r.size), min(SHARE, n - r.draw)
                left, right = (Permutations(generator(seed, "ranks", r.g, r.draw, side), size, k) for side, k in (("x", -(-many // DRAWS)), ("y", min(DRAWS, many))))
                sums = crossed(left, right, Ranks(size, x_below, x_tied), Ranks(size, y_below, y_tied), r.at, min(r.at + PLACES * STRETCH, size))
                # ranks are doubled numbers of rows
                total[r.draw : r.draw + many] += sums.ravel()[:many] / (2 * size) ** 2
        yield pd.DataFrame({"sums": [total]})

    spread = (seen["sd_r0"] or 0) * (seen["sd_r1"] or 0)
    rho = seen["cov"] / spread if seen["n"] >= 8 and spread > 1e-12 else None

    def finish(batches):
        for pdf in batches:
            for sums in pdf["sums"]:
                # equal correlations are sums in another order
                p = (1 + int(((sums / seen["n"] - seen["mean_r0"] * seen["mean_r1"]) / spread >= rho - 1e-12).sum())) / (n + 1) if rho is not None else None
                yield pd.DataFrame({"rho": [rho], "p": [p], "n": [seen["n"]]}).astype({"rho": float, "p": float})

    dealt = work.repartition(4 * spark.sparkContext.defaultParallelism)
    return added_up(dealt.mapInPandas(run, "sums array<double>"), n).mapInPandas(finish, "rho double, p double, n long").select(*(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("rho", "p")), "n")


# ---- pair bootstrap --------------------------------------------------------


def bucket_counts(seed: int, sizes: np.ndarray, bucket: int, n: int) -> np.ndarray:
    """How many of each draw's rows fall into a bucket: a walk down a tree of binomials that all buckets share."""
    lo, hi, count = 0, len(sizes), np.full(n, sizes.sum(), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        all_, left = int(sizes[lo:hi].sum()), int(sizes[lo:mid].sum())
        drawn = generator(seed, "split", lo, hi).binomial(count, left / all_ if all_ else 0.0)
        lo, hi, count = (lo, mid, drawn) if bucket < mid else (mid, hi, count - drawn)
    return count


def picked_sums(rng: np.random.Generator, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each draw the sums over its ``counts`` rows picked from ``values`` with replacement."""
    rows, out = len(values), np.zeros((len(counts), values.shape[1]))
    step = max(1, HELD // max(rows, int(counts.max(initial=1))))
    for lo in range(0, len(counts), step):
        some = counts[lo : lo + step]
        n, at = int(some.sum()), np.repeat(np.arange(len(some)) * rows, some)
        if rows <= 1 << 16 and rows & (rows - 1) == 0:
            # the low bits of 16 are uniform, and one number has four of them
            at += rng.integers(1 << 64, size=-(-n // 4), dtype=np.uint64).view(np.uint16)[:n] & np.uint16(rows - 1)
        else:
            at += rng.integers(rows, size=n)
        out[lo : lo + step] = np.bincount(at, minlength=len(some) * rows).reshape(-1, rows) @ values
    return out


def bootstrap_lambda(pairs: DataFrame, n: int = 9999, seed: int = 20240813, key: str = "fund_id") -> DataFrame:
    """Pair-bootstrap percentile interval of the reliability; nulls below two pairs."""
    rows = pairs.filter("a is not null and b is not null").select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(key).alias("key"), (F.col("a") - F.col("b")).alias("d"), ((F.col("a") + F.col("b")) / 2).alias("m"))
    # a row for each bucket
    told = {r["bucket"]: r for r in rows.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("d").alias("d"), F.sum("m").alias("m")).collect()}
    sizes = np.array([told[i]["k"] if i in told else 0 for i in range(BUCKETS)], np.int64)
    total = int(sizes.sum())
    # sums about the means lose no digits
    centre = [sum(r[c] for _, r in sorted(told.items())) / max(1, total) for c in ("d", "m")]

    def run(batches):
        sums, now, rest, counts, rng, held = np.zeros((n, 4)), None, 0, None, None, []

        def settle(block: np.ndarray) -> None:
            nonlocal rest, counts, sums
            drawn = counts if len(block) == rest else rng.binomial(counts, len(block) / rest)
            sums += picked_sums(rng, np.column_stack([block, block**2]), drawn)
            rest, counts = rest - len(block), counts - drawn

        for pdf in batches:
            for bucket, part in pdf.groupby("bucket", sort=False):
                if bucket != now:
                    if held:
                        settle(np.concatenate(held))
                    now, rest, held = bucket, int(sizes[bucket]), []
                    counts, rng = bucket_counts(seed, sizes, int(bucket), n), generator(seed, "bucket", bucket)
                values = part[["d", "m"]].to_numpy() - centre
                held.append(values)
                while sum(map(len, held)) >= BLOCK:
                    joined = np.concatenate(held)
                    settle(joined[:BLOCK])
                    held = [joined[BLOCK:]] if len(joined) > BLOCK else []
        if held:
            settle(np.concatenate(held))
        yield pd.DataFrame({"sums": [sums.ravel()]})

    def finish(batches):
        for pdf in batches:
            for sums in pdf["sums"]:
                d, m, dd, mm = np.asarray(sums).reshape(n, 4).T
                if total < 2:
                    yield pd.DataFrame({"low": [None], "high": [None], "n_boot": [n]}).astype({"low": float, "high": float})
                    continue
                error = (dd - d * d / total) / (total - 1) / 2
                true = np.maximum((mm - m * m / total) / (total - 1) - error / 2, 0.0)
                with np.errstate(all="ignore"):
                    lam = true / (true + error)
                lam = lam[np.isfinite(lam)]
                low, high = np.quantile(lam, [0.025, 0.975]) if len(lam) else (None, None)
                yield pd.DataFrame({"low": [low], "high": [high], "n_boot": [n]}).astype({"low": float, "high": float})

    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "key", "d", "m")
    out = added_up(ordered.select("bucket", "d", "m").mapInPandas(run, "sums array<double>"), 4 * n).mapInPandas(finish, "low double, high double, n_boot long")
    return out.select(*(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("low", "high")), "n_boot")
