"""Draws of the resampling tests against enumeration and brute force."""

from __future__ import annotations

import itertools
import math
import time
from collections import Counter

import numpy as np
import pytest

from keelson.operators import resample as R

SAMPLE = "fund_id long, vintage int, y_lag double, y double"


def panel(seed, sizes, ties=False):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(sizes):
        x = rng.normal(size=n)
        y = 0.3 * x + rng.normal(size=n)
        if ties:
            x, y = np.round(x), np.round(y * 2)
        rows += [(1000 * g + i, 2000 + g, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return rows


# ---- transitions -----------------------------------------------------------


def test_diagonal_draws_follow_the_enumerated_distribution():
    prev, now = [0, 0, 1, 1, 2, 3], [0, 1, 1, 2, 2, 3]
    exact = Counter(sum(a == b for a, b in zip(prev, p, strict=True)) for p in itertools.permutations(now))
    draws = R.diagonal_draws(np.random.default_rng(1), np.bincount(prev, minlength=4), np.bincount(now, minlength=4), 40_000)
    for k, n in exact.items():
        share = n / math.factorial(6)
        assert (draws == k).mean() == pytest.approx(share, abs=4 * math.sqrt(share * (1 - share) / 40_000) + 1e-9)
    assert set(draws.tolist()) <= set(exact)


def test_diagonal_draws_keep_margins_that_leave_one_matching():
    assert (R.diagonal_draws(np.random.default_rng(1), np.array([3, 0, 0, 0]), np.array([3, 0, 0, 0]), 5) == 3).all()
    assert (R.diagonal_draws(np.random.default_rng(1), np.array([2, 0, 0, 0]), np.array([0, 0, 0, 2]), 5) == 0).all()
    assert (R.diagonal_draws(np.random.default_rng(1), np.zeros(4, int), np.zeros(4, int), 5) == 0).all()


def test_transition_permutation_of_several_groups(frame):
    rows = panel(2, (9, 12, 20))
    got = R.transition_permutation(frame(SAMPLE, rows), 4000).collect()[0]
    groups = [(np.array([r[2] for r in rows if r[1] == v]), np.array([r[3] for r in rows if r[1] == v])) for v in (2000, 2001, 2002)]
    q = lambda v: (v[:, None] > np.quantile(v, [0.25, 0.5, 0.75])).sum(1)
    agreed = sum((q(x) == q(y)).sum() for x, y in groups)
    rng = np.random.default_rng(3)
    null = np.array([sum((rng.permutation(q(y)) == q(x)).sum() for x, y in groups) for _ in range(20_000)])
    assert (got.n, got.diagonal) == (41, pytest.approx(agreed / 41))
    assert got.null_diagonal == pytest.approx(null.mean() / 41, abs=0.01)
    assert got.p == pytest.approx((null >= agreed).mean(), abs=0.035)
    again = R.transition_permutation(frame(SAMPLE, rows[::-1]).repartition(5), 4000).collect()[0]
    assert again == got
    assert R.transition_permutation(frame(SAMPLE, rows[:2]), 9).collect()[0] == (None, None, None, 0)


# ---- rank correlation ------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 5, 100, 256, 257, 5000])
def test_permutations_are_permutations(size):
    sent = R.Permutations(np.random.default_rng(4), size, 7)(np.arange(size))
    assert sent.shape == (7, size)
    assert (np.sort(sent, 1) == np.arange(size)).all()
    # blocks of places are dealt as the whole is
    parts = [R.Permutations(np.random.default_rng(4), size, 7)(np.arange(lo, min(lo + 64, size))) for lo in range(0, size, 64)]
    assert (np.concatenate(parts, 1) == sent).all()


def test_permutations_are_uniform():
    draws = R.Permutations(np.random.default_rng(5), 4, 24_000)(np.arange(4))
    seen = Counter(map(tuple, draws.tolist()))
    assert len(seen) == 24
    chi = sum((n - 1000) ** 2 / 1000 for n in seen.values())
    # 23 degrees of freedom: one in ten thousand is above 59
    assert chi < 59
    # each place goes everywhere alike, and neighbours part
    many = R.Permutations(np.random.default_rng(6), 300, 6000)(np.arange(300))
    for place in (0, 1, 150, 299):
        counts = np.bincount(many[:, place], minlength=300)
        assert ((counts - 20) ** 2 / 20).sum() < 299 + 5 * math.sqrt(2 * 299)
    gaps = np.bincount((many[:, 1].astype(int) - many[:, 0]) % 300, minlength=300)[1:]
    assert ((gaps - 6000 / 299) ** 2 / (6000 / 299)).sum() < 298 + 5 * math.sqrt(2 * 298)


@pytest.mark.parametrize("ties", [False, True])
def test_spearman_within_against_shuffles(frame, ties, monkeypatch):
    monkeypatch.setattr(R, "PLACES", 8)
    sizes = (7, 10, 17)
    rows = panel(7, sizes, ties)
    rank = lambda v: np.array([((v < a).sum() + ((v == a).sum() + 1) / 2) / len(v) for a in v])
    groups = [(rank(np.array([r[2] for r in rows if r[1] == 2000 + g])), rank(np.array([r[3] for r in rows if r[1] == 2000 + g]))) for g in range(3)]
    x, y = (np.concatenate([g[i] for g in groups]) for i in (0, 1))
    rho = np.corrcoef(x, y)[0, 1]
    rng = np.random.default_rng(8)
    null = np.array([np.corrcoef(x, np.concatenate([rng.permutation(b) for _, b in groups]))[0, 1] for _ in range(20_000)])
    got = R.spearman_within(frame(SAMPLE, rows), 3000).collect()[0]
    assert (got.n, got.rho) == (34, pytest.approx(rho))
    want = (null >= rho - 1e-12).mean()
    assert got.p == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / 3000) + 0.003)
    assert R.spearman_within(frame(SAMPLE, rows[::-1]).repartition(3), 3000).collect()[0].p == got.p


def test_ranks_of_places_with_ties():
    values = np.array([1, 1, 2, 3, 3, 3, 9])
    want = np.array([1.5, 1.5, 3, 5, 5, 5, 7]) / 7
    assert R.rank_at(np.arange(7), 7, np.array([0, 3]), np.array([2, 3])) == pytest.approx(want)
    assert R.rank_at(np.array([4, 0, 6]), 7, np.array([0, 3]), np.array([2, 3])) == pytest.approx(want[[4, 0, 6]])
    assert len(values) == 7


@pytest.mark.parametrize("cells", [1, 7, 64, 1 << 21])
def test_ranks_of_places_in_any_order(cells, monkeypatch):
    monkeypatch.setattr(R, "CELLS", cells)
    rng = np.random.default_rng(11)
    for below, tied in (([], []), ([0], [300]), ([0, 2, 7, 40, 290], [2, 3, 2, 200, 10])):
        below, tied = np.array(below, np.int64), np.array(tied, np.int64)
        places = rng.permutation(300)
        assert R.Ranks(300, below, tied)(places) / 600 == pytest.approx(R.rank_at(places, 300, below, tied))


def test_a_draw_of_a_place_costs_tens_of_nanoseconds():
    size, places = 1_200_000, np.arange(R.PLACES)
    below = np.arange(0, size, 60)
    ranks, sent = R.Ranks(size, below, np.full(len(below), 60)), R.Permutations(np.random.default_rng(1), size, 16).at(places)
    took = []
    for i in range(16):
        start = time.process_time()
        ranks(sent(i)).astype(float).sum()
        took.append(time.process_time() - start)
    # 326 ns when tied ranks were searched and the network walked on a power of four
    assert min(took) / len(places) < 150e-9


def pairs(seed, size, left, right):
    """Sums of all pairs of permutations of 1 to size, as one share of draws."""
    none = np.array([], np.int64)
    ranks = R.Ranks(size, none, none)
    dealt = [R.Permutations(R.generator(seed, side), size, many) for side, many in (("x", left), ("y", right))]
    return R.crossed(*dealt, ranks, ranks, 0, size) / 4


def test_pairs_of_permutations_are_uniform_and_independent_by_two():
    runs = 6000
    seen = np.array([pairs(seed, 3, 2, 2) for seed in range(runs)])
    # 1*1 + 2*2 + 3*3 and the five other orders
    chance = {10: 1 / 6, 11: 2 / 6, 13: 2 / 6, 14: 1 / 6}
    for i, j in ((0, 1), (1, 0), (1, 1)):
        together = Counter(zip(seen[:, 0, 0], seen[:, i, j], strict=True))
        chi = sum((together[a, b] - runs * p * q) ** 2 / (runs * p * q) for a, p in chance.items() for b, q in chance.items())
        # 15 degrees of freedom: one in ten thousand is above 44
        assert chi < 44


@pytest.mark.parametrize("size", [12, 700])
def test_a_share_of_all_pairs_spreads_like_independent_draws(size, monkeypatch):
    monkeypatch.setattr(R, "PLACES", 256)
    rng, at = np.random.default_rng(12), np.arange(1.0, size + 1)
    sums = np.array([rng.permutation(at) @ at for _ in range(20_000)])
    cut = np.quantile(sums, 0.9)
    want, runs = (sums >= cut).mean(), 400
    counts = np.array([(pairs(seed, size, 16, 16) >= cut).sum() for seed in range(runs)])
    spread = 256 * want * (1 - want)
    assert counts.mean() == pytest.approx(256 * want, abs=4 * math.sqrt(spread / runs) + 256 * 4 * math.sqrt(want * (1 - want) / 20_000))
    assert counts.var() == pytest.approx(spread, rel=0.4)


def test_a_draw_of_a_place_costs_a_few_nanoseconds():
    size = 1_200_000
    below = np.arange(0, size, 60)
    ranks, took = R.Ranks(size, below, np.full(len(below), 60)), []
    left, right = (R.Permutations(np.random.default_rng(i), size, 16) for i in (1, 2))
    for _ in range(4):
        start = time.process_time()
        R.crossed(left, right, ranks, ranks, 0, R.PLACES)
        took.append(time.process_time() - start)
    # 13 ns when every draw had a permutation of its own
    assert min(took) / R.PLACES / 256 < 8e-9


def test_small_and_constant_samples(frame):
    assert R.spearman_within(frame(SAMPLE, panel(1, (5,))), 9).collect()[0] == (None, None, 5)
    constant = R.spearman_within(frame(SAMPLE, [(i, 2000, 1.0, float(i)) for i in range(12)]), 9).collect()[0]
    assert (constant.rho, constant.p, constant.n) == (None, None, 12)
    assert R.spearman_within(frame(SAMPLE, []), 9).collect()[0] == (None, None, 0)


def test_too_many_ties_are_an_error(frame, monkeypatch):
    monkeypatch.setattr(R, "TIES", 1)
    with pytest.raises(ValueError, match="tied values"):
        R.spearman_within(frame(SAMPLE, panel(7, (40,), ties=True)), 9)


# ---- pair bootstrap --------------------------------------------------------


def test_bucket_counts_are_a_multinomial():
    sizes = np.array([3, 0, 5, 2, 7, 1])
    counts = np.array([R.bucket_counts(9, sizes, k, 20_000) for k in range(6)])
    assert (counts.sum(0) == 18).all() and (counts[1] == 0).all()
    assert counts.mean(1) == pytest.approx(sizes, abs=0.1)
    cov = np.cov(counts)
    assert cov == pytest.approx(np.diag(sizes) - np.outer(sizes, sizes) / 18, abs=0.2)


def test_picked_sums_are_of_that_many_rows():
    values = np.column_stack([np.ones(6), np.arange(6.0)])
    counts = np.random.default_rng(1).integers(0, 9, 4000)
    sums = R.picked_sums(np.random.default_rng(2), values, counts)
    assert (sums[:, 0] == counts).all()
    assert sums[:, 1].sum() / counts.sum() == pytest.approx(2.5, abs=0.05)


@pytest.mark.parametrize("rows", [1, 8, 511, 512])
def test_picks_are_uniform_and_cheap(rows):
    values, counts = np.eye(rows), np.random.default_rng(3).binomial(1024, 0.5, 400)
    sums = R.picked_sums(np.random.default_rng(4), values, counts)
    want = counts.sum() / rows
    assert (sums.sum(1) == counts).all()
    assert ((sums.sum(0) - want) ** 2 / want).sum() < rows + 5 * math.sqrt(2 * rows)
    # draws are not each other's copies, nor are a number's four picks
    assert rows == 1 or len(np.unique(sums, axis=0)) > 390
    if rows == 512:
        narrow, took = np.ones((512, 4)), []
        for _ in range(5):
            start = time.process_time()
            R.picked_sums(np.random.default_rng(4), narrow, counts)
            took.append(time.process_time() - start)
        # 21 ns with numbers of 64 bits, a million at a time
        assert min(took) / counts.sum() < 14e-9


@pytest.mark.parametrize("block", [3, 512])
def test_bootstrap_lambda_against_picks(frame, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = np.random.default_rng(10)
    true = rng.normal(size=60)
    a, b = true + 0.3 * rng.normal(size=60), true + 0.3 * rng.normal(size=60)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    picks = rng.integers(60, size=(40_000, 60))
    error = (a - b)[picks].var(1, ddof=1) / 2
    spread = np.maximum(((a + b) / 2)[picks].var(1, ddof=1) - error / 2, 0)
    low, high = np.quantile(spread / (spread + error), [0.025, 0.975])
    schema = "fund_id long, a double, b double"
    got = R.bootstrap_lambda(frame(schema, rows), 8000).collect()[0]
    assert (got.low, got.high, got.n_boot) == (pytest.approx(low, abs=0.006), pytest.approx(high, abs=0.004), 8000)
    again = R.bootstrap_lambda(frame(schema, rows[::-1]).repartition(7), 8000).collect()[0]
    assert (again.low, again.high) == (pytest.approx(got.low, abs=1e-12), pytest.approx(got.high, abs=1e-12))
    assert R.bootstrap_lambda(frame(schema, rows[:1]), 9).collect()[0] == (None, None, 9)
