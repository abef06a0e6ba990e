"""Queries without SQL over whole tables, against brute force on a few families."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import inference, ranks, simulate
from keelson.plans import catalog, regimes, statistics  # noqa: F401
from keelson.plans import views as V

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
DRAWS = 9999


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest tables with the funds of a few families."""
    to = str(tmp_path_factory.mktemp("sf"))
    orders = spark.read.parquet(f"{SF}/orders.parquet").filter("o_custkey < 12")
    orders.write.parquet(f"{to}/orders.parquet")
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    spark.read.parquet(f"{SF}/lineitem.parquet").join(keys, "l_orderkey", "left_semi").write.parquet(f"{to}/lineitem.parquet")
    return to


@pytest.fixture(scope="module")
def sample(spark, small):
    return statistics._sample(spark, small).toPandas().sort_values("fund_id").reset_index(drop=True)


def digest(*parts) -> str:
    return hashlib.md5("|".join(map(str, (statistics.SEED, *parts))).encode()).hexdigest()


def clustered(y, x, vintage, firm):
    """beta and clustered t of y on x with vintage effects, y in columns."""
    dummies = (vintage[:, None] == np.unique(vintage)).astype(float)
    demean = lambda v: v - dummies @ ((dummies.T @ v) / dummies.sum(0).reshape(-1, *[1] * (v.ndim - 1)))
    tx, ty = demean(x), demean(y)
    beta = tx @ ty / (tx @ tx)
    scores = (firm[:, None] == np.unique(firm)).T.astype(float) @ (tx[:, None] * (ty - beta * tx[:, None])) / (tx @ tx)
    g, n, k = len(scores), len(x), dummies.shape[1] + 1
    return beta, beta / np.sqrt((scores**2).sum(0) * g / (g - 1) * (n - 1) / (n - k)), demean(y)


def test_wild_cluster_bootstrap_draws_over_every_family(spark, small, sample):
    y, x, vintage, firm = (sample[c].to_numpy() for c in ("y", "y_lag", "vintage", "firm_id"))
    beta, t, residual = clustered(y[:, None], x, vintage, firm)
    bits = {f: "".join(f"{int(digest(0, block, f), 16):0128b}" for block in range(79))[:DRAWS] for f in np.unique(firm)}
    signs = {f: np.array([1.0 if bit == "1" else -1.0 for bit in b]) for f, b in bits.items()}
    _, null, _ = clustered(residual * np.array([signs[f] for f in firm]), x, vintage, firm)
    got = catalog.QUERIES["wild_cluster_bootstrap"](spark, small).collect()[0]
    assert got.n_boot == DRAWS
    assert (got.beta, got.t) == (pytest.approx(beta[0], abs=2e-6), pytest.approx(t[0], abs=2e-6))
    # all signs equal, of which few families have many draws, give the same t, and that may round either way
    p = [(1 + (abs(null) >= abs(t[0]) + e).sum()) / (DRAWS + 1) for e in (1e-9, -1e-9)]
    assert p[0] - 1e-6 <= got.p <= p[1] + 1e-6


def test_wild_cluster_bootstrap_adds_up_chunks(spark, small, monkeypatch):
    s = statistics._sample(spark, small)
    run = lambda: [round(x, 9) for x in inference.wild_cluster_bootstrap(s, 199).collect()[0]]
    whole = run()
    for name, n in (("TASK", 2), ("STEP", 1), ("FAN_IN", 2)):
        monkeypatch.setattr(inference, name, n)
    assert run() == whole


def test_draws_without_a_finite_t_do_not_count(spark):
    rows = [(i, i % 2, 2000, 1.0, float(i % 2)) for i in range(8)]
    got = inference.wild_cluster_bootstrap(spark.createDataFrame(rows, "fund_id int, firm_id int, vintage int, y double, y_lag double"), 19).collect()[0]
    # a constant outcome has no slope and no variance in any draw
    assert got.n_boot == 0 and got.p is None


def test_many_effects_are_an_error(spark, small, monkeypatch):
    monkeypatch.setattr(inference, "EFFECTS", 3)
    for run in (lambda s: inference.wild_cluster_bootstrap(s, 9), lambda s: inference.power_at(s, [0.0], 2, 9)):
        with pytest.raises(ValueError, match="3 fixed effects"):
            run(statistics._sample(spark, small))


def dealt(sample, values):
    """Values dealt anew within each vintage, a row for each draw."""
    out = np.empty((DRAWS, len(sample)))
    rng = np.random.default_rng(1)
    for at in [rows.index.to_numpy() for _, rows in sample.groupby("vintage")]:
        out[:, at] = rng.permuted(np.tile(values[at], (DRAWS, 1)), axis=1)
    return out


def near(p, draws=DRAWS):
    """Two estimates of a share from so many draws each: four of their difference's errors."""
    return pytest.approx(p, abs=4 * np.sqrt(2 * max(p * (1 - p), 1 / draws) / draws))


def test_spearman_within_ranks_every_family(spark, small, sample):
    rank = lambda c: sample.groupby("vintage")[c].rank(pct=True).to_numpy()
    rx, ry = rank("y_lag"), rank("y")
    rho, null = np.corrcoef(rx, ry)[0, 1], dealt(sample, ry)
    r = (null - null.mean(1, keepdims=True)) @ (rx - rx.mean()) / (rx.std() * null.std(1) * len(rx))
    got = catalog.QUERIES["spearman_within"](spark, small).collect()[0]
    assert (got.rho, got.n) == (pytest.approx(rho, abs=2e-6), len(sample))
    assert got.p == near((1 + (r > rho - 1e-9).sum()) / (DRAWS + 1))


def test_transitions_permute_every_family(spark, small, sample):
    def quartile(c):
        cuts = sample.groupby("vintage")[c].quantile([0.25, 0.5, 0.75]).unstack().loc[sample.vintage].to_numpy()
        return 1 + (sample[c].to_numpy()[:, None] > cuts).sum(1)

    assert (sample.groupby("vintage")[["y", "y_lag"]].nunique() >= 4).all(axis=None)
    prev, now = quartile("y_lag"), quartile("y")
    diagonal, null = (prev == now).mean(), (dealt(sample, now) == prev).mean(1)
    got = catalog.QUERIES["transition_permutation_test"](spark, small).collect()[0]
    assert (got.diagonal, got.n) == (pytest.approx(diagonal, abs=2e-6), len(sample))
    assert got.null_diagonal == pytest.approx(null.mean(), abs=4 * null.std() * np.sqrt(2 / DRAWS))
    assert got.p == near((1 + (null >= diagonal - 1e-12).sum()) / (DRAWS + 1))


def test_bootstrap_lambda_draws_from_every_pair(spark, small):
    pairs = V.reports(spark, small).toPandas().sort_values("fund_id")
    a, b, n = pairs.a.to_numpy(), pairs.b.to_numpy(), len(pairs)
    picks = np.random.default_rng(2).integers(n, size=(DRAWS, n))
    error = (a - b)[picks].var(1, ddof=1) / 2
    true = np.maximum(((a + b) / 2)[picks].var(1, ddof=1) - error / 2, 0)
    lam = true / (true + error)
    got = catalog.QUERIES["bootstrap_lambda"](spark, small).collect()[0]
    # between neighbouring quantiles of as many draws
    for value, at in ((got.low, 0.025), (got.high, 0.975)):
        e = 4 * np.sqrt(2 * at * (1 - at) / DRAWS)
        assert np.quantile(lam, max(0, at - e)) - 1e-6 <= value <= np.quantile(lam, min(1, at + e)) + 1e-6
    assert got.n_boot == DRAWS


def test_power_is_the_rejection_rate_of_the_bootstrap(spark, small, sample):
    y, x, vintage = (sample[c].to_numpy() for c in ("y", "y_lag", "vintage"))
    rows = catalog.QUERIES["power_at"](spark, small).collect()
    assert len(rows) == 18 and {r.n for r in rows} == {300}
    got = {(r.clustered_on, r.true_beta): r.power for r in rows}
    for cluster in ("firm_id", "sponsor_id"):
        firm = sample[cluster].to_numpy()
        residual = clustered(y[:, None], x, vintage, firm)[2][:, 0]
        rejected = dict.fromkeys((i / 10 for i in range(9)), 0)
        for s in range(1, 301):
            v = np.array([1.0 if digest(s, f)[0] in "02468ace" else -1.0 for f in firm])
            bits = {f: "".join(f"{int(digest(s, block, f), 16):0128b}" for block in range(4))[:499] for f in np.unique(firm)}
            w = np.array([[1.0 if bit == "1" else -1.0 for bit in bits[f]] for f in firm])
            for beta in rejected:
                _, t, null = clustered((beta * x + (y - residual) + v * residual)[:, None], x, vintage, firm)
                _, drawn, _ = clustered(null * w, x, vintage, firm)
                rejected[beta] += (1 + (abs(drawn) >= abs(t[0]) * (1 - 1e-9)).sum()) / 500 < 0.05
        assert {b: got[cluster, b] for b in rejected} == {b: pytest.approx(n / 300, abs=2e-6) for b, n in rejected.items()}


def test_power_adds_up_chunks_of_clusters(spark, small, monkeypatch):
    s = statistics._sample(spark, small)
    run = lambda: {r.true_beta: r.power for r in inference.power_at(s, [0.0, 0.5], 30, 99).collect()}
    whole = run()
    monkeypatch.setattr(inference, "CLUSTERS", 3)
    assert run() == whole


def test_power_shuffles_no_copies_of_the_cells_for_its_simulations(spark):
    rows = [(i, i // 4, 2000 + i % 4, float(i % 7) + i % 3, float(i % 5)) for i in range(24_000)]
    s = spark.createDataFrame(rows, "fund_id int, firm_id int, vintage int, y double, y_lag double").cache()
    assert s.count() == 24_000
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    def run(n_sims):
        before = shuffled()
        assert inference.power_at(s, [0.0], n_sims, 2).collect()[0].n == n_sims
        return shuffled() - before

    few, many = run(10), run(300)
    # the sums of 300 simulations are 3 * 20 numbers each and part, but the cells went 30 times
    assert many - few < 300 * 60 * 8 * 8 * 1.5
    s.unpersist()


@pytest.mark.parametrize("ranges", [2, 256])
def test_ranks_and_quantiles_of_ties(spark, monkeypatch, ranges):
    monkeypatch.setattr(ranks, "RANGES", ranges)
    rng = np.random.default_rng(1)
    rows = [(int(g), None if v == 9 else float(v)) for g, v in zip(rng.integers(0, 3, 300), rng.integers(0, 10, 300), strict=True)] + [(None, 1.0), (None, 2.0), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    pdf = df.toPandas()
    want = pdf.groupby("g", dropna=False)["v"].quantile([0.1, 0.5, 0.9]).unstack()
    got = {r.g: (r.q0, r.q1, r.q2) for r in ranks.quantiles(df, "v", (0.1, 0.5, 0.9), ("g",)).collect()}
    assert got == {None if np.isnan(g) else int(g): tuple(map(pytest.approx, row)) for g, row in zip(want.index, want.to_numpy(), strict=True) if not np.isnan(row).any()}
    assert ranks.quantiles(df, "v", (0.25,)).collect()[0].q0 == pytest.approx(pdf.v.quantile(0.25))
    assert ranks.quantiles(df.limit(0), "v", (0.25,)).collect()[0].q0 is None
    pdf["r"] = pdf.groupby("g", dropna=False)["v"].rank(pct=True)
    ranked = sorted((repr(r.g), repr(r.v), round(r.r, 9) if r.r is not None else None) for r in ranks.average_rank(df, "v", "g", "r").collect())
    assert ranked == sorted((repr(None if np.isnan(g) else int(g)), repr(None if np.isnan(v) else v), None if np.isnan(r) else round(r, 9)) for g, v, r in pdf.itertuples(index=False))


@pytest.fixture
def parts(spark, tmp_path):
    """300 parts with keys beyond those of the smallest tables; the last alone has size 1000."""
    rows = [(k, f"part {k}", 1000 if k == 449 else k % 50) for k in range(150, 450)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path), rows


def test_every_part_is_scanned(spark, parts):
    to, rows = parts
    got = {(r.path, r.row, r["name"], r.size) for r in catalog.QUERIES["html_table_scan"](spark, to).collect()}
    assert got == {(k, 1, name, str(size)) for k, name, size in rows}


def test_faults_of_every_override(spark, parts):
    to, rows = parts
    got = sorted(tuple(r) for r in catalog.QUERIES["override_faults"](spark, to).collect())
    sizes, merged = [size for *_, size in rows], {size for k, _, size in rows if k % 50}
    want = [("repeated", s) for s in set(sizes) if sizes.count(s) > 1] + [("decision", size) for k, _, size in rows if k % 50 == 0] + [("chained", c) for c in {s % 7 + 40 for s in merged} & merged]
    assert got == sorted(want)


def test_vintage_error_study_has_all_replications(spark):
    got = {r.true_beta: r for r in catalog.QUERIES["vintage_error_study"](spark, SF).collect()}
    assert {b: r.n for b, r in got.items()} == {0.0: 400, 0.25: 400, 0.5: 400}
    # wrong vintages attenuate: for the largest slope by more than the study's own error
    assert got[0.5].bias + 3 * got[0.5].bias_se < 0 and got[0.5].inflated < 0.5
    assert all(r.bias == pytest.approx(r.beta_displaced - r.beta_true, abs=3e-6) for r in got.values())


def test_vintage_panels_hold_their_slope_and_shifts(spark):
    rows = simulate.vintage_panels(spark, (0.5,), 20).toPandas()
    both = rows[rows.labels == "true"].merge(rows[rows.labels == "displaced"], on=["rep", "sequence", "tvpi"])
    assert len(both) * 2 == len(rows) and set(rows.groupby(["rep", "labels"]).firm_id.nunique()) == {39}
    shares = (both.vintage_y - both.vintage_x).value_counts(normalize=True)
    assert [shares[i] for i in (0, 1, 2)] == pytest.approx([25 / 43, 14 / 43, 4 / 43], abs=0.04)


def test_sim_validation_lands_on_six_true_slopes(spark):
    got = catalog.QUERIES["sim_validation"](spark, SF).collect()
    assert sorted(r.skill_sd for r in got) == [0.0, 0.08, 0.14, 0.18, 0.24, 0.30]
    assert all(abs(r.beta - r.true_beta) < 4 * r.se for r in got)
    # without a threshold every firm goes on to the last vintage or its sixth fund
    assert len({r.n for r in got}) == 1 and got[0].n > 260 * 2


def test_a_universe_follows_its_rules(spark):
    u = simulate.Universe(firms=40)
    level = {r.date: r.level for r in simulate.index_path(spark, u).collect()}
    rows = simulate.simulate(spark, u).collect()
    last = {}
    for r in rows:
        calls, pays = -sum(f.amount for f in r.flows if f.amount < 0), sum(f.amount for f in r.flows if f.amount > 0)
        assert 0.05 <= r.tvpi <= 12 and 1995 <= r.vintage <= 2016 and r.nav_date.year == r.vintage + 11
        # flows are net of a quarter's call and payout, the last value is reported with noise
        assert calls <= r.commitment and (pays + r.nav) / calls == pytest.approx(r.tvpi, rel=0.3)
        dates = sorted(level)
        market = np.log(level[dates[min(4 * (r.vintage - 1995 + 12) - 1, len(dates) - 1)]] / level[dates[4 * (r.vintage - 1995)]])
        assert simulate.market_return(u, r.vintage) == pytest.approx(market, abs=1e-9)
        last[r.firm_id] = max(last.get(r.firm_id, r), r, key=lambda x: x.sequence)
    # a firm stops below the threshold, after six funds, or when time is up
    assert all(r.interim >= 1.05 or r is last[r.firm_id] for r in rows)
    assert all(r.interim < 1.05 or r.sequence == 6 or r.vintage + 4 > 2016 for r in last.values())
