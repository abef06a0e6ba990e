"""Fixed-effects regressions, cluster-robust errors and resampling.

No design matrix is built. By the Frisch-Waugh-Lovell theorem the slope of
``y`` on ``y_lag`` with group effects is that of the demeaned columns, and the
clustered variance of one coefficient needs only the sums of h * e over
clusters, where h is the demeaned regressor over its sum of squares. Both follow
from sums over (effect, cluster) cells, so every step is a grouped sum, keyed by
specification or replicate, and hundreds of fits are one query.

Random signs come from md5 of (seed, draw, key), so results do not depend on
partitioning or row order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import normal_two_sided
from ..sources.readers import scratch_dir
from .resample import added_up

ONE = "_one"
#: Clusters whose cells one task holds at a time in the power study, simulations it goes through, and tasks that share the clusters.
CLUSTERS, SIMULATIONS, PARTS = 20_000, 10, 8
#: Clusters of a task of the wild bootstrap, and of one product with their signs; chunks whose sums are added up at once.
TASK, STEP, FAN_IN = 4_000, 500, 32
#: Fixed effects of a bootstrap at most: a task holds 16 bytes for each and draw, and 8 for each pair.
EFFECTS = 2_000


def _sums(columns: tuple[str, ...]) -> dict[str, Column]:
    """n, sums and sums of products of the columns."""
    out = {"_n": F.count("*")} | {f"_s_{u}": F.sum(u) for u in columns}
    return out | {f"_s_{u}_{v}": F.sum(F.col(u) * F.col(v)) for i, u in enumerate(columns) for v in columns[i:]}


def _added(columns: tuple[str, ...]) -> list[Column]:
    return [F.sum(c).alias(c) for c in _sums(columns)]


def cells(sample: DataFrame, by: list[str], columns: tuple[str, ...] = ("y", "y_lag")) -> DataFrame:
    """The sums of every cell of ``by``: all that fits and clustered variances need."""
    return sample.groupBy(*by).agg(*(e.alias(c) for c, e in _sums(columns).items()))


def demeaned_cells(cell: DataFrame, keys: list[str], fixed: str, columns: tuple[str, ...] = ("y", "y_lag")) -> DataFrame:
    """Adds to cells the products ``_d_u_v`` and sums ``_d_u`` of columns less their means in (keys, fixed)."""
    groups = cell.groupBy(*keys, fixed).agg(*_added(columns)).select(*keys, fixed, F.col("_n").alias("_nf"), *((F.col(f"_s_{u}") / F.col("_n")).alias(f"_m_{u}") for u in columns))
    # keys x fixed effects rows, the model's parameters; few hold most cells, so cells stay where they are
    rows = cell.join(F.broadcast(groups), [*keys, fixed])
    n = F.col("_n")
    product = {f"_d_{u}_{v}": F.col(f"_s_{u}_{v}") - F.col(f"_m_{u}") * F.col(f"_s_{v}") - F.col(f"_m_{v}") * F.col(f"_s_{u}") + n * F.col(f"_m_{u}") * F.col(f"_m_{v}") for i, u in enumerate(columns) for v in columns[i:]}
    return rows.withColumns(product | {f"_d_{u}": F.col(f"_s_{u}") - n * F.col(f"_m_{u}") for u in columns})


def _div(a, b) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.nullif(F.col(b) if isinstance(b, str) else b, F.lit(0.0)))


def swept(moments: DataFrame, names: Sequence[str], pivots: int, entry, scale) -> DataFrame:
    """Adds ``_g_i_u`` and ``_a_u_v``: the coefficient of each of the first ``pivots`` names in the others' regressions on them, and what is left of the products; ``_rank`` is that of the pivots.

    Gauss-Jordan steps on the symmetric matrix of products, one for each pivot,
    so every key's small system is solved where its row is. A pivot of which no
    more than rounding is left hangs on earlier ones and gets no coefficient.
    ``entry(u, v)`` is a product's column and ``scale(u)`` the sum of squares
    that rounding follows.
    """
    at = {(i, j): f"_a_{i}_{j}" for i in range(len(names)) for j in range(len(names))}
    own = {c: entry(names[i], names[j]) for (i, j), c in at.items()}
    rows = moments.withColumns({**own, "_rank": F.lit(0), **{f"_least_{k}": F.greatest(1e-9 * entry(names[k], names[k]), 1e-12 * scale(names[k])) for k in range(pivots)}})
    for k in range(pivots):
        live = F.col(at[k, k]) > F.col(f"_least_{k}")
        factor = {i: F.when(live, F.col(at[i, k]) / F.col(at[k, k])).otherwise(0.0) for i in range(len(names)) if i != k}
        rows = rows.withColumns({f"_f_{i}": f for i, f in factor.items()} | {"_live": live})
        rows = rows.withColumns({at[i, j]: F.col(at[i, j]) - F.col(f"_f_{i}") * F.col(at[k, j]) for i in factor for j in range(len(names))} | {"_rank": F.col("_rank") + F.col("_live").cast("int"), f"_live_{k}": F.col("_live")})
    coefficient = {f"_g_{k}_{u}": F.when(F.col(f"_live_{k}"), F.col(at[k, u]) / F.col(at[k, k])).otherwise(0.0) for k in range(pivots) for u in range(pivots, len(names))}
    return rows.withColumns(coefficient)


def ols_fe(sample: DataFrame, keys: tuple[str, ...] = (), fixed: str | None = "vintage", clusters: tuple[str, ...] = ("firm_id",), controls: tuple[str, ...] = ()) -> DataFrame:
    """beta, se, t, p, r2, n, n_firms and clusters used, one row per key.

    The sample is read once, into sums over (keys, fixed effect, clusters)
    cells that are combined before any shuffle; no task ever holds a key's or
    an effect's rows. Controls are partialled out of the sums; one that hangs on
    the effects and on earlier controls takes no part. With two clusters the
    variance is V1 + V2 - V12; where that is not positive, the first cluster
    alone counts and ``fallback`` is true.
    """
    rows = sample.withColumn(ONE, F.lit(1))
    keys_, effect = list(keys) or [ONE], fixed or ONE
    # equal names would be one column twice
    controls = tuple(dict.fromkeys(controls))
    columns = ("y", "y_lag", *controls)
    finest = list(dict.fromkeys([*keys_, effect, *clusters, "firm_id"]))
    cell = demeaned_cells(cells(rows, finest, columns), keys_, effect, columns)
    d = lambda u, v: f"_d_{u}_{v}" if columns.index(u) <= columns.index(v) else f"_d_{v}_{u}"
    pairs = sorted({d(u, v) for u in columns for v in columns})
    total = cell.groupBy(*keys_).agg(*(F.sum(c).alias(f"_t{c}") for c in pairs), *(F.sum(f"_s_{c}_{c}").alias(f"_raw_{c}") for c in controls), F.sum("_n").alias("n"), F.sum("_s_y").alias("_sy"), F.sum("_s_y_y").alias("_syy"), F.countDistinct("firm_id").alias("n_firms"), F.countDistinct(effect).alias("_levels"))
    m, names = len(controls), [*controls, "y_lag", "y"]
    total = swept(total, names, m, lambda u, v: F.col(f"_t{d(u, v)}"), lambda u: F.col(f"_raw_{u}"))
    left = lambda u, v: F.col(f"_a_{names.index(u)}_{names.index(v)}")
    total = total.withColumns({"_xx": left("y_lag", "y_lag"), "_xy": left("y_lag", "y"), "_yy": left("y", "y")}).withColumn("beta", _div("_xy", "_xx"))
    shares = [f"_g_{k}_{u}" for k in range(m) for u in (m, m + 1)]
    total = total.select(*keys_, "n", "n_firms", "_levels", "_rank", "_xx", "beta", (F.col("_yy") - F.col("beta") * F.col("_xy")).alias("_sse"), (F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("n")).alias("_sst"), *shares)
    # one row for each fit
    own = cell.join(F.broadcast(total.select(*keys_, "_xx", "beta", *shares)), keys_)

    def product(u: int, v: int) -> Column:
        """Of a cell's y_lag (m) or y (m + 1), each less its controls' share."""
        a, b = ([(names[w], F.lit(1.0)), *((c, -F.col(f"_g_{k}_{w}")) for k, c in enumerate(controls))] for w in (u, v))
        return sum((x * y * F.col(d(p, q)) for p, x in a for q, y in b), F.lit(0.0))

    scored = own.withColumn("_score", _div(product(m, m + 1) - F.col("beta") * product(m, m), "_xx"))
    k = F.col("_levels") + 1 + F.col("_rank")
    dims = [(clusters[0],), *([(clusters[1],), clusters] if len(clusters) > 1 else [])]
    out = total
    for i, dim in enumerate(dims):
        sums = scored.groupBy(*keys_, *dim).agg(F.sum("_score").alias("_s")).groupBy(*keys_).agg(F.sum(F.col("_s") * F.col("_s")).alias(f"_v{i}"), F.count("*").alias(f"_g{i}"))
        out = out.join(sums, keys_)

    def variance(i: int) -> Column:
        g = F.col(f"_g{i}")
        return F.when((g > 1) & (F.col("n") > k), F.col(f"_v{i}") * g / (g - 1) * (F.col("n") - 1) / (F.col("n") - k))

    both = variance(0) + variance(1) - variance(2) if len(dims) == 3 else variance(0)
    fallback = F.coalesce(both <= 0, F.lit(True)) if len(dims) == 3 else F.lit(False)
    out = out.withColumn("fallback", fallback).withColumn("se", F.sqrt(F.when(fallback, variance(0)).otherwise(both))).withColumn("t", _div("beta", "se"))
    return out.select(*keys, "beta", "se", "t", normal_two_sided(F.col("t")).alias("p"), (1 - _div("_sse", "_sst")).alias("r2"), "n", "n_firms", F.col("_g0").alias("n_clusters"), "fallback")


def leave_one_out(sample: DataFrame, by: str, fixed: str | None = "vintage", cluster: str = "firm_id") -> DataFrame:
    """One refit without each level of ``by``.

    Dropping one level changes only what it held, so each refit comes from sums
    over (by, fixed) groups less that level's; nothing is replicated but the
    group sums: levels x fixed effects rows, whatever the sample.
    """
    f = fixed or "_one"
    rows = sample if fixed else sample.withColumn("_one", F.lit(1))
    sums = {"n": F.count("*"), "sx": F.sum("y_lag"), "sy": F.sum("y"), "sxx": F.sum(F.col("y_lag") * F.col("y_lag")), "sxy": F.sum(F.col("y_lag") * F.col("y"))}
    total = rows.groupBy(f).agg(*(e.alias(c) for c, e in sums.items()))
    own = rows.groupBy(F.col(by).alias("dropped"), F.col(f).alias("_f")).agg(*(e.alias(f"_{c}") for c, e in sums.items()))
    # what all effects sum to, and the change in the effects that the level touches
    def between(n, a, b):
        return F.when(n > 0, a * b / n).otherwise(0.0)

    everything = total.agg(F.sum("n").alias("N"), F.sum(F.col("sxx") - between(F.col("n"), F.col("sx"), F.col("sx"))).alias("XX"), F.sum(F.col("sxy") - between(F.col("n"), F.col("sx"), F.col("sy"))).alias("XY"))
    touched = own.join(total, F.col("_f") == F.col(f))
    n2, sx2, sy2 = F.col("n") - F.col("_n"), F.col("sx") - F.col("_sx"), F.col("sy") - F.col("_sy")
    change_xx = (F.col("sxx") - F.col("_sxx") - between(n2, sx2, sx2)) - (F.col("sxx") - between(F.col("n"), F.col("sx"), F.col("sx")))
    change_xy = (F.col("sxy") - F.col("_sxy") - between(n2, sx2, sy2)) - (F.col("sxy") - between(F.col("n"), F.col("sx"), F.col("sy")))
    moved = touched.groupBy("dropped").agg(F.sum("_n").alias("_dn"), F.sum(change_xx).alias("_dxx"), F.sum(change_xy).alias("_dxy"))
    # one row
    joined = moved.crossJoin(F.broadcast(everything))
    return joined.select("dropped", F.try_divide(F.col("XY") + F.col("_dxy"), F.nullif(F.col("XX") + F.col("_dxx"), F.lit(0.0))).alias("beta"), (F.col("N") - F.col("_dn")).alias("n"))


def _few(effects: list[str]) -> list[str]:
    if len(effects) > EFFECTS:
        raise ValueError(f"more than {EFFECTS} fixed effects; the bootstrap holds all of them for each draw")
    return effects


def wild_cluster_bootstrap(sample: DataFrame, n_boot: int = 9999, seed: int = 20240813, fixed: str = "vintage", cluster: str = "firm_id") -> DataFrame:
    """beta, t, p of H0: no persistence, with Rademacher signs by cluster.

    The restricted fit is the mean in each fixed effect. A draw's slope and
    variance follow from sums over clusters that are linear in the draw's signs,
    so the sample is summed to (cluster, effect) cells, and chunks of clusters
    are multiplied with their signs and added up. Draws whose t is not finite
    are left out of p; without any finite draw p is null.
    """
    rows = demeaned_cells(cells(sample.withColumn(ONE, F.lit(1)), [ONE, fixed, cluster]), [ONE], fixed)
    cell = rows.select(F.col(cluster).cast("string").alias("c"), F.col(fixed).cast("string").alias("f"), F.col("_n").cast("double").alias("n"), F.col("_d_y_lag").alias("x"), F.col("_d_y").alias("y"), F.col("_d_y_y_lag").alias("xy"), F.col("_d_y_lag_y_lag").alias("xx"))
    # fixed effects are few: the operator estimates one parameter for each
    effects = _few(sorted(r["f"] for r in cell.select("f").distinct().limit(EFFECTS + 1).collect()))
    k = len(effects)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums over some clusters, for the sample itself and all draws."""
        at, keys = pd.factorize(pdf["c"])
        effect = pdf["f"].map({f: i for i, f in enumerate(effects)}).to_numpy()
        total = np.zeros(3 + 2 * k + k * k)
        drawn = np.zeros((n_boot + 1, 2 + 2 * k))

        def dense(column: str, lo: int, hi: int) -> np.ndarray:
            inside = (at >= lo) & (at < hi)
            out = np.zeros((hi - lo, k))
            out[at[inside] - lo, effect[inside]] = pdf[column].to_numpy()[inside]
            return out

        for lo in range(0, len(keys), STEP):
            hi = min(len(keys), lo + STEP)
            n, x, y, xy, xx = (dense(c, lo, hi) for c in ("n", "x", "y", "xy", "xx"))
            xy, xx = xy.sum(1), xx.sum(1)
            total += np.concatenate([[xx.sum(), xx @ xx, xy @ xy], n.sum(0), xx @ x, (x.T @ x).ravel()])
            columns = np.hstack([xy[:, None], (xy * xx)[:, None], y, xy[:, None] * x])
            drawn[0] += columns.sum(0)
            drawn[1:] += draw_signs(seed, 0, keys[lo:hi], n_boot).T @ columns
        return pd.DataFrame({"clusters": [len(keys)], "total": [total], "drawn": [drawn.ravel()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        total, drawn = np.sum(np.stack(pdf["total"].to_list()), axis=0), np.sum(np.stack(pdf["drawn"].to_list()), axis=0).reshape(n_boot + 1, -1)
        (xx, xx2, aa), nf, xxx, gram = np.split(total, np.cumsum([3, k, k]))
        clusters, gram = int(pdf["clusters"].sum()), gram.reshape(k, k)
        beta, r, m, q = drawn[:, 0] / xx if xx else np.full(n_boot + 1, np.nan), drawn[:, 1], drawn[:, 2 : 2 + k] / nf, drawn[:, 2 + k :]
        squares = aa + np.einsum("bf,fg,bg->b", m, gram, m) + beta**2 * xx2 - 2 * (m * q).sum(1) - 2 * beta * r + 2 * beta * (m @ xxx)
        with np.errstate(all="ignore"):
            t = beta / np.sqrt(squares / xx**2 * clusters / (clusters - 1) * (nf.sum() - 1) / (nf.sum() - k - 1)) if clusters > 1 and nf.sum() > k + 1 else np.full(n_boot + 1, np.nan)
        null = np.abs(t[1:][np.isfinite(t[1:])])
        # draws with all signs equal give the observed t but for rounding
        p = (1 + (null >= abs(t[0]) * (1 - 1e-9)).sum()) / (len(null) + 1) if len(null) and np.isfinite(t[0]) else None
        number = lambda v: float(v) if np.isfinite(v) else None
        return pd.DataFrame([(number(beta[0]), number(t[0]), p, len(null))], columns=["beta", "t", "p", "n_boot"])

    # clusters are dealt so that a task holds TASK of them
    chunks = cell.select("c").distinct().count() // TASK + 1
    added = cell.withColumn("chunk", F.pmod(F.xxhash64("c"), F.lit(chunks))).groupBy("chunk").applyInPandas(lambda p: partial(p), "clusters long, total array<double>, drawn array<double>")
    while chunks > FAN_IN:
        # sums of many chunks are added up by and by
        chunks = -(-chunks // FAN_IN)
        added = added.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), F.lit(chunks))).groupBy("chunk").applyInPandas(lambda p: pd.DataFrame({"clusters": [p["clusters"].sum()], "total": [np.sum(np.stack(p["total"].to_list()), axis=0)], "drawn": [np.sum(np.stack(p["drawn"].to_list()), axis=0)]}), "clusters long, total array<double>, drawn array<double>")
    return added.groupBy().applyInPandas(lambda p: finish(p), "beta double, t double, p double, n_boot long")


def _digests(heads: Sequence[str], keys: Sequence[str]) -> np.ndarray:
    """The md5 digests of each head followed by each key: keys x bytes."""
    starts, md5 = [h.encode() for h in heads], functools.partial(hashlib.md5, usedforsecurity=False)
    raw = b"".join([md5(start + key).digest() for key in [k.encode() for k in keys] for start in starts])
    return np.frombuffer(raw, np.uint8).reshape(len(keys), -1)


def draw_signs(seed: int, simulation: int, keys: Sequence[str], n: int) -> np.ndarray:
    """n signs of each cluster: the bits of the md5 digests of (seed, simulation, block, key)."""
    raw = _digests([f"{seed}|{simulation}|{block}|" for block in range(-(-n // 128))], keys)
    signs = np.unpackbits(raw, axis=1, count=n).astype(float)
    signs *= 2.0
    signs -= 1.0
    return signs


def power_at(sample: DataFrame, betas: Sequence[float], n_sims: int = 300, n_boot: int = 499, seed: int = 20240813, fixed: str = "vintage", cluster: str = "firm_id") -> DataFrame:
    """(true_beta, power, n): share of n simulations that the wild cluster bootstrap rejects at 5 %.

    Outcomes are beta * y_lag plus the restricted fit (the mean in each fixed
    effect) plus its residuals with one sign for a whole cluster, so dependence
    within clusters stays. All betas share the signs, as all of them start from
    one seed. The fits and variances of all draws follow from sums over clusters
    that are linear in the draws' signs. The clusters are written once, a row
    for each, and every block of simulations reads them there: nothing is
    shuffled for it but the sums of ``PARTS`` tasks. The means of the simulated
    outcomes, one for each simulation and effect, come to the driver.
    """
    spark = sample.sparkSession
    rows = demeaned_cells(cells(sample.withColumn(ONE, F.lit(1)), [ONE, fixed, cluster]), [ONE], fixed)
    values = {"n": F.col("_n").cast("double"), "nf": F.col("_nf").cast("double"), "x": F.col("_d_y_lag"), "y": F.col("_d_y"), "xy": F.col("_d_y_y_lag"), "xx": F.col("_d_y_lag_y_lag")}
    cell = F.struct(F.col(fixed).cast("string").alias("f"), *(v.alias(c) for c, v in values.items()))
    path = scratch_dir(spark, "clusters")
    # a cluster has a cell for each fixed effect at most
    rows.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.array_sort(F.collect_list(cell)).alias("cells")).write.parquet(path)
    clusters = spark.read.parquet(path)
    # fixed effects are few: the operator estimates one parameter for each
    each = clusters.select(F.explode("cells").alias("cell")).select("cell.f", "cell.nf")
    told = {r["f"]: r["nf"] for r in each.groupBy("f").agg(F.first("nf").alias("nf")).limit(EFFECTS + 1).collect()}
    effects, nf = _few(sorted(told)), np.array([told[f] for f in sorted(told)])
    k = len(effects)

    def cluster_signs(b: int, keys: Sequence[str]) -> np.ndarray:
        # even first hexadecimal digits are positive
        return 1.0 - 2.0 * (_digests([f"{seed}|{b}|"], keys)[:, 0] >> 4 & 1)

    def dense(batch: pa.RecordBatch, *names: str):
        """Some clusters at a time: their keys, and a value of each effect for every name."""
        for lo in range(0, batch.num_rows, CLUSTERS):
            some = batch.slice(lo, CLUSTERS)
            held = some.column("cells")
            at, flat = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy()), held.flatten()
            effect = pc.index_in(flat.field("f"), pa.array(effects, pa.string())).to_numpy()
            out = np.zeros((len(names), len(held), k))
            for i, name in enumerate(names):
                out[i, at, effect] = flat.field(name).to_numpy()
            yield some.column("c").to_pylist(), *out

    def by_effect(batches):
        """Sums of signed outcomes by simulation and effect."""
        total = np.zeros((n_sims, k))
        for batch in batches:
            for keys, y in dense(batch, "y"):
                total += [cluster_signs(b, keys) @ y for b in range(1, n_sims + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    # one row
    sums = added_up(clusters.mapInArrow(by_effect, "sums array<double>"), n_sims * k).first()["sums"]
    of = dict(zip(range(1, n_sims + 1), np.array(sums).reshape(n_sims, k) / nf, strict=True))

    def partial(batches):
        """Sums over some clusters for a block of simulations."""
        added = {}
        for batch, block in ((batch, block) for batch in batches for block in batch.column("block").unique()):
            first = block.as_py() * SIMULATIONS + 1
            for keys, n, x, y, xy, xx in dense(batch.filter(pc.equal(batch.column("block"), block)), "n", "x", "y", "xy", "xx"):
                xx = xx.sum(1)
                # a simulated outcome is beta * (x, xx) + (own, cross)
                slope = [xx[:, None], (xx * xx)[:, None], x, xx[:, None] * x]
                fixed_sums = np.concatenate([[xx.sum(), xx @ xx, len(keys)], n.sum(0), xx @ x, (x.T @ x).ravel()])
                for b in range(first, min(first + SIMULATIONS, n_sims + 1)):
                    v = cluster_signs(b, keys)
                    own, cross = v[:, None] * y - n * of[b], v * xy.sum(1) - x @ of[b]
                    columns = np.hstack([*slope, cross[:, None], (cross * xx)[:, None], own, cross[:, None] * x])
                    total, drawn = added.setdefault(b, (np.zeros(len(fixed_sums) + 2), np.zeros((n_boot + 1, columns.shape[1]))))
                    total += np.concatenate([fixed_sums, [xx @ cross, cross @ cross]])
                    drawn[0] += columns.sum(0)
                    # some clusters at a time, so that their signs stay in the cache
                    for lo in range(0, len(keys), STEP):
                        drawn[1:] += draw_signs(seed, b, keys[lo : lo + STEP], n_boot).T @ columns[lo : lo + STEP]
        for b, (total, drawn) in added.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.concatenate([total, drawn.ravel()])], pa.list_(pa.float64()))], ["b", "sums"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whether each beta is rejected in a simulation."""
        sums = np.sum(np.stack(pdf["sums"].to_list()), axis=0)
        (xx, xx2, clusters), nf, xxx, gram, (xc, cc), drawn = np.split(sums, np.cumsum([3, k, k, k * k, 2]))
        gram, (by_slope, by_own) = gram.reshape(k, k), np.split(drawn.reshape(n_boot + 1, -1), 2, axis=1)
        out = []
        for beta in betas:
            drawn = beta * by_slope + by_own
            estimate, r, m, q = drawn[:, 0] / xx, drawn[:, 1], drawn[:, 2 : 2 + k] / nf, drawn[:, 2 + k :]
            squares = beta * beta * xx2 + 2 * beta * xc + cc + np.einsum("bf,fg,bg->b", m, gram, m) + estimate**2 * xx2 - 2 * (m * q).sum(1) - 2 * estimate * r + 2 * estimate * (m @ xxx)
            with np.errstate(all="ignore"):
                t = np.abs(estimate) / np.sqrt(squares / xx**2 * clusters / (clusters - 1) * (nf.sum() - 1) / (nf.sum() - k - 1))
            null = t[1:][np.isfinite(t[1:])]
            # draws with all signs equal give the observed t but for rounding
            p = (1 + (null >= t[0] * (1 - 1e-9)).sum()) / (len(null) + 1)
            out.append((beta, float(p < 0.05)))
        return pd.DataFrame(out, columns=["true_beta", "rejected"])

    # a task for each part of the clusters and each block, which read their rows where they are written
    blocks = spark.range(0, -(-n_sims // SIMULATIONS), 1, -(-n_sims // SIMULATIONS)).withColumnRenamed("id", "block")
    many = clusters.coalesce(PARTS).hint("shuffle_replicate_nl").crossJoin(blocks)
    added = many.mapInArrow(partial, "b int, sums array<double>")
    return added.groupBy("b").applyInPandas(lambda p: finish(p), "true_beta double, rejected double").groupBy("true_beta").agg(F.avg("rejected").alias("power"), F.count("*").alias("n"))


def attenuation(pairs: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = ()) -> DataFrame:
    """Reliability of two noisy reports of the same value."""
    from .ranks import quantiles

    d, mean = F.col(a) - F.col(b), (F.col(a) + F.col(b)) / 2
    error = F.var_samp(d) / 2
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), error.alias("var_error"), F.greatest(F.var_samp(mean) - error / 2, F.lit(0.0)).alias("var_true"), F.sqrt(error).alias("sd_error"), F.avg(F.abs(d)).alias("mean_abs_diff"))
    if not keys:
        # one row each
        sums = sums.crossJoin(F.broadcast(quantiles(pairs.select(F.abs(F.expm1(d)).alias("_x")), "_x", (0.5,)).select(F.col("q0").alias("median_pct_diff"))))
    return sums.withColumn("lambda", F.try_divide(F.col("var_true"), F.nullif(F.col("var_true") + F.col("var_error"), F.lit(0.0))))


def numbered_rows(df: DataFrame, key: str, ranges: int = 1024, out: str = "_i") -> DataFrame:
    """Numbers rows from 0 in the order of a numeric key, without one task for all.

    Rows are numbered within ranges of the key; the ranges' counts, of which
    there are ``ranges`` at most, give the offsets.
    """
    ends = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    # one row
    part = F.floor((F.col(key) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * ranges)
    split = df.crossJoin(F.broadcast(ends)).withColumn("_part", part).drop("_lo", "_hi")
    counts = split.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    # at most `ranges` rows
    return split.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def interpolate_crossing(grid: DataFrame, x: str = "beta", y: str = "power", at: float = 0.8) -> DataFrame:
    """Where y first reaches ``at``, by linear interpolation; null if it never does."""
    w = Window.orderBy(x)
    steps = grid.select(F.col(x).alias("x1"), F.col(y).alias("y1"), F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"))
    hit = F.when(F.col("y0").isNull() | (F.col("y1") == F.col("y0")), F.col("x1")).otherwise(F.col("x0") + (at - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    return steps.agg(F.min_by(hit, F.when(F.col("y1") >= at, F.col("x1"))).alias("crossing"))
