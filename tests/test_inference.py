from __future__ import annotations

import math
import random

import numpy as np
import pytest

from keelson.operators import inference as I
from keelson.operators import panel as P
from keelson.operators import resample as R


@pytest.fixture(scope="module")
def ar1(spark):
    """Firms of four funds with y_k = 0.35 y_(k-1) + noise."""
    rng, rows = random.Random(5), []
    for firm in range(300):
        y = rng.gauss(0, 0.3)
        for k in range(1, 5):
            rows.append((firm * 10 + k, firm, k, 1995 + firm % 10 + 4 * (k - 1), 100.0, math.exp(y)))
            y = 0.35 * y + rng.gauss(0, 0.3)
    return spark.createDataFrame(rows, "fund_id long, firm_id long, sequence int, vintage int, commitment double, tvpi double")


def dense(sample, fixed=True):
    rows = sample.select("y", "y_lag", "vintage", "firm_id").toPandas()
    dummies = [(rows.vintage == v).to_numpy(float) for v in sorted(rows.vintage.unique())] if fixed else [np.ones(len(rows))]
    x = np.column_stack([rows.y_lag, *dummies])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ rows.y.to_numpy()
    e = rows.y.to_numpy() - x @ beta
    meat = sum(np.outer(s, s) for g in rows.firm_id.unique() for s in [x[rows.firm_id == g].T @ e[rows.firm_id == g]])
    n, k, groups = len(rows), x.shape[1], rows.firm_id.nunique()
    v = inverse @ meat @ inverse * groups / (groups - 1) * (n - 1) / (n - k)
    return beta[0], math.sqrt(v[0, 0])


def test_planted_slope_and_dense_fit(ar1):
    sample = P.estimation_sample(P.build_panel(ar1))
    fit = I.ols_fe(sample).collect()[0]
    beta, se = dense(sample)
    assert fit.beta == pytest.approx(beta, abs=1e-10)
    # the dense fit has one column for each vintage, as the closed form counts one more
    assert fit.se == pytest.approx(se, rel=2e-3)
    assert abs(fit.beta - 0.35) < 3 * fit.se and fit.n == 900


def test_row_order_and_partitions_do_not_matter(spark, ar1):
    a = I.ols_fe(P.estimation_sample(P.build_panel(ar1))).collect()[0]
    b = I.ols_fe(P.estimation_sample(P.build_panel(ar1.orderBy("tvpi").repartition(3)))).collect()[0]
    assert a.beta == pytest.approx(b.beta, abs=1e-10) and a.se == pytest.approx(b.se, abs=1e-10)


def test_bootstrap_statistic_is_the_clustered_t(ar1):
    sample = P.estimation_sample(P.build_panel(ar1.filter("firm_id < 80")))
    fit, boot = I.ols_fe(sample).collect()[0], I.wild_cluster_bootstrap(sample, 39).collect()[0]
    assert boot.t == pytest.approx(fit.t, abs=1e-8) and boot.beta == pytest.approx(fit.beta, abs=1e-10)
    assert boot.p == pytest.approx(1 / 40)


def test_leave_one_out_equals_refits(ar1):
    sample = P.estimation_sample(P.build_panel(ar1.filter("firm_id < 40")))
    got = {r.dropped: (r.beta, r.n) for r in I.leave_one_out(sample, "vintage").collect()}
    for v in list(got)[:3]:
        want = I.ols_fe(sample.filter(f"vintage <> {v}")).collect()[0]
        assert got[v] == (pytest.approx(want.beta, abs=1e-9), want.n)


def test_two_way_falls_back(spark):
    rows = [(1, 1, 2000, 1.0, 0.0), (2, 1, 2001, 2.0, 1.0), (3, 2, 2000, 1.5, 0.5), (4, 2, 2001, 2.1, 1.2), (5, 3, 2000, 0.5, 0.1), (6, 3, 2001, 2.6, 1.0)]
    fit = I.ols_fe(spark.createDataFrame(rows, "fund_id int, firm_id int, vintage int, y double, y_lag double"), clusters=("firm_id", "vintage")).collect()[0]
    assert fit.se is not None and fit.se > 0


def test_small_samples_have_no_p(spark):
    tiny = spark.createDataFrame([(1, 1, 2000, 1.0, 0.5), (2, 2, 2000, 2.0, 0.1)], "fund_id int, firm_id int, vintage int, y double, y_lag double")
    assert R.spearman_within(tiny, 9).collect()[0].rho is None


def test_monotone_pairs_rank_high(spark):
    rng = random.Random(1)
    rows = [(i, i, 2000, math.exp(3 * x), x) for i in range(200) for x in [rng.gauss(0, 1)]]
    out = R.spearman_within(spark.createDataFrame(rows, "fund_id int, firm_id int, vintage int, y double, y_lag double"), 19).collect()[0]
    assert out.rho == pytest.approx(1.0) and out.p == pytest.approx(1 / 20)


def test_reliability(spark):
    rng = random.Random(2)
    rows = [(i, t + rng.gauss(0, 0.1), t + rng.gauss(0, 0.1)) for i in range(4000) for t in [rng.gauss(0, 0.3)]]
    out = I.attenuation(spark.createDataFrame(rows, "fund_id int, a double, b double")).collect()[0]
    # the mean of two reports has half the error variance
    assert out["lambda"] == pytest.approx(0.9, abs=0.03)


def test_crossing(spark):
    grid = lambda ys: spark.createDataFrame([(i / 10, y) for i, y in enumerate(ys)], "beta double, power double")
    assert I.interpolate_crossing(grid([0.05, 0.1, 0.4, 0.7, 0.9])).collect()[0][0] == pytest.approx(0.35)
    assert I.interpolate_crossing(grid([0.05, 0.1])).collect()[0][0] is None
    assert I.interpolate_crossing(grid([0.1, 0.8, 0.9])).collect()[0][0] == pytest.approx(0.1)


def test_gaps(spark):
    rows = []
    for firm in range(20):
        numbers, step = ((5, 6), 3) if firm % 2 == 0 else ((3, 7), 14)
        rows += [(firm * 2 + i, firm, i + 1, 2000 + step * i, 1.0, 1.0 + 0.1 * firm, n) for i, n in enumerate(numbers)]
    p = P.build_panel(spark.createDataFrame(rows, "fund_id int, firm_id int, sequence int, vintage int, commitment double, tvpi double, fund_number int"))
    assert P.estimation_sample(p, fixed=None).count() == 20
    assert P.estimation_sample(p, fixed=None, max_gap=1).count() == 10
    assert {(r.fund_number_gap, r.vintage_gap) for r in p.filter("y_lag is not null").collect()} == {(1, 3), (4, 14)}


# ---- several controls ------------------------------------------------------


@pytest.fixture(scope="module")
def controlled(spark):
    rng, rows = random.Random(8), []
    for i in range(400):
        firm, vintage = rng.randint(0, 39), 2000 + rng.randint(0, 5)
        a, b = rng.gauss(10, 1), rng.gauss(0, 2)
        x = 0.2 * a + rng.gauss(0, 1)
        y = 0.4 * x + 0.5 * a - 0.3 * b + 0.1 * vintage + rng.gauss(0, 1)
        rows.append((i, firm, vintage, y, x, a, b, a - 2 * b, float(vintage), rng.choice([1, 2, 3])))
    return spark.createDataFrame(rows, "fund_id long, firm_id long, vintage int, y double, y_lag double, a double, b double, ab double, v double, k long")


def dense_controls(sample, controls):
    rows = sample.toPandas()
    dummies = [(rows.vintage == v).to_numpy(float) for v in sorted(rows.vintage.unique())]
    x = np.column_stack([rows.y_lag, *(rows[c] for c in controls), *dummies])
    inverse, rank = np.linalg.pinv(x.T @ x, rcond=1e-10), np.linalg.matrix_rank(x, tol=1e-6)
    beta = inverse @ x.T @ rows.y.to_numpy()
    e = rows.y.to_numpy() - x @ beta
    meat = sum(np.outer(s, s) for g in rows.firm_id.unique() for s in [x[rows.firm_id == g].T @ e[rows.firm_id == g]])
    n, groups = len(rows), rows.firm_id.nunique()
    v = inverse @ meat @ inverse * groups / (groups - 1) * (n - 1) / (n - rank)
    return beta[0], math.sqrt(v[0, 0]), 1 - (e @ e) / ((rows.y - rows.y.mean()) ** 2).sum()


@pytest.mark.parametrize("controls", [("a",), ("a", "b"), ("b", "a", "k"), ("a", "b", "ab"), ("ab", "v", "b", "a"), ("v",), ("a", "a", "b")])
def test_several_controls_against_a_dense_fit(controlled, controls):
    fit = I.ols_fe(controlled, controls=controls).collect()[0]
    beta, se, r2 = dense_controls(controlled, tuple(dict.fromkeys(controls)))
    assert fit.beta == pytest.approx(beta, abs=1e-8)
    # the closed form counts one parameter for each effect and one more
    assert fit.se == pytest.approx(se, rel=3e-3) and fit.r2 == pytest.approx(r2, abs=1e-8)


def test_controls_by_key_and_in_both_clusterings(controlled):
    keyed = controlled.withColumn("spec", controlled.firm_id % 2)
    two = {r.spec: r for r in I.ols_fe(keyed, keys=("spec",), controls=("a", "b")).collect()}
    for spec, r in two.items():
        beta, se, _ = dense_controls(keyed.filter(keyed.spec == spec), ("a", "b"))
        assert (r.beta, r.se) == (pytest.approx(beta, abs=1e-8), pytest.approx(se, rel=6e-3))
    both = I.ols_fe(controlled, clusters=("firm_id", "vintage"), controls=("a", "b")).collect()[0]
    assert both.beta == pytest.approx(dense_controls(controlled, ("a", "b"))[0], abs=1e-8)


def test_cells_are_not_dealt_by_specification_or_effect(controlled, spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # no table passes for small of itself
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fit = I.ols_fe(controlled.withColumn("spec", controlled.vintage % 2), keys=("spec",), clusters=("firm_id", "vintage"), controls=("a",))
        plan = fit._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # the three variances meet the fits, one row each; a shuffle of cells by two specifications would fill two tasks
    assert plan.count("SortMergeJoin") == 3


def test_signs_of_many_clusters_are_those_of_each():
    import hashlib
    import time

    keys = [str(k) for k in range(0, 4000)]
    signs = I.draw_signs(7, 3, keys, 499)
    for key in ("0", "17", "3999"):
        bits = "".join(f"{int(hashlib.md5(f'7|3|{block}|{key}'.encode()).hexdigest(), 16):0128b}" for block in range(4))[:499]
        assert signs[int(key)].tolist() == [1.0 if b == "1" else -1.0 for b in bits]
    columns, took = np.ones((500, 32)), []
    for lo in range(0, 4000, 500):
        start = time.process_time()
        I.draw_signs(7, 3, keys[lo : lo + 500], 499).T @ columns
        took.append(time.process_time() - start)
    assert min(took) / 500 < 30e-6
