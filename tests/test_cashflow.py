from __future__ import annotations

from datetime import date

import pytest

from keelson.operators import cashflow as C
from keelson.schemas import assert_unique, require_columns

FLOWS = "fund_id long, date date, amount double"
NAVS = "fund_id long, nav double, nav_date date"
INDEX = "date date, level double"


def one(df, column):
    return df.collect()[0][column]


def test_irr_of_two_dates(frame):
    flows = frame(FLOWS, [(1, date(2010, 1, 1), -100.0), (1, date(2012, 1, 1), 200.0)])
    years = (date(2012, 1, 1) - date(2010, 1, 1)).days / 365.25
    from pyspark.sql import functions as F

    assert one(C.gathered(flows).select(C.xirr(F.col("flows")).alias("v")), "v") == pytest.approx(2 ** (1 / years) - 1, abs=1e-9)


def test_no_sign_change_has_no_irr(frame):
    flows = frame(FLOWS, [(1, date(2010, 1, 1), -100.0), (1, date(2011, 1, 1), -50.0)])
    assert one(C.fund_irr(flows, frame(NAVS, [(1, 0.0, date(2011, 1, 1))])), "irr") is None


def test_multiples(frame):
    flows = frame(FLOWS, [(1, date(2010, 1, 1), -100.0), (1, date(2011, 1, 1), 60.0)])
    row = C.multiples(flows, frame(NAVS, [(1, 90.0, date(2012, 1, 1))])).collect()[0]
    assert (row.dpi, row.rvpi, row.tvpi) == pytest.approx((0.6, 0.9, 1.5))


def test_nothing_paid_in_has_no_multiple(frame):
    flows = frame(FLOWS, [(1, date(2010, 1, 1), 5.0)])
    assert one(C.multiples(flows, frame(NAVS, [(1, 1.0, date(2012, 1, 1))])), "tvpi") is None


def test_fund_that_tracks_the_index(frame):
    flows = frame(FLOWS, [(1, date(2010, 1, 1), -100.0)])
    navs = frame(NAVS, [(1, 200.0, date(2015, 1, 1))])
    index = frame(INDEX, [(date(2010, 1, 1), 100.0), (date(2015, 1, 1), 200.0)])
    row = C.pme(flows, navs, index).collect()[0]
    irr = one(C.fund_irr(flows, navs), "irr")
    assert (row.ks_pme, row.direct_alpha, row.ln_pme) == pytest.approx((1.0, 0.0, irr), abs=1e-8)


def test_level_is_carried_forward(frame):
    flows = frame(FLOWS, [(1, date(2010, 6, 15), -110.0), (1, date(2012, 3, 1), 121.0)])
    index = frame(INDEX, [(date(2010, 1, 1), 100.0), (date(2011, 1, 1), 110.0), (date(2012, 1, 1), 121.0)])
    assert [r.level for r in C.asof_level(flows, index).orderBy("date").collect()] == [100.0, 121.0]


def test_index_that_starts_late_is_an_error(frame):
    flows = frame(FLOWS, [(1, date(2010, 6, 15), -110.0)])
    with pytest.raises(Exception, match="index starts after"):
        C.asof_level(flows, frame(INDEX, [(date(2011, 1, 1), 110.0)])).collect()


def test_differencing(frame):
    rows = [(1, date(2020, 3, 31), 50.0, 0.0), (1, date(2020, 6, 30), 80.0, 10.0), (1, date(2020, 9, 30), 80.0, 45.0), (1, date(2020, 12, 31), 70.0, 45.0)]
    flows = C.flows_from_snapshots(frame("fund_id long, as_of date, contributions double, distributions double", rows))
    assert [r.amount for r in flows.orderBy("date").collect()] == [-50.0, -20.0, 35.0]


def test_eligibility(frame):
    rows = [("new", date(2020, 1, 1), 0.0), ("new", date(2020, 4, 1), 40.0), ("old", date(2020, 1, 1), 500.0), ("old", date(2020, 4, 1), 560.0), ("once", date(2020, 1, 1), 0.0)]
    got = C.observed_from_inception(frame("fund_id string, as_of date, contributions double", rows)).collect()
    assert [r.fund_id for r in got] == ["new"]


def test_compounding(frame):
    got = C.compound_index(frame("date date, r double", [(date(2020, 1, 31), 0.1), (date(2020, 2, 29), 0.1)])).orderBy("date").collect()
    assert [r.level for r in got] == pytest.approx([110.0, 121.0])
    with pytest.raises(Exception, match="no return"):
        C.compound_index(frame("date date, r double", [(date(2020, 1, 31), None)])).collect()


def test_guards(frame):
    df = frame("a int", [(1,), (1,)])
    with pytest.raises(ValueError, match="b"):
        require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="repeats"):
        assert_unique(df, ["a"])


def test_stream_gives_the_flows_of_the_batch(spark, frame, tmp_path):
    from keelson.streaming.differencing import stream_flows

    schema = "fund_id long, as_of date, contributions double, distributions double"
    rows = [(f, date(2020, m, 1), 10.0 * m + f, 5.0 * (m - 1)) for f in (1, 2) for m in range(1, 5)]
    batch = frame(schema, rows)
    for m in range(1, 5):
        batch.filter(f"month(as_of) = {m}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_flows(stream).writeStream.format("memory").queryName("flows_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.fund_id, str(r.date), round(r.amount, 6)) for r in df.collect())
    got, want = key(spark.table("flows_out")), key(C.flows_from_snapshots(batch))
    assert got == want and len(want) == 8


def test_stream_replaces_only_the_default_store(spark):
    from keelson.streaming import differencing as D

    before = spark.conf.get(D.STORE_KEY, None)
    arriving = spark.readStream.format("rate").load().selectExpr("value AS fund_id", "date(timestamp) AS as_of", "1.0D AS contributions", "0.0D AS distributions")
    try:
        for own, then in ((None, D.STORE), (D.PLAIN, D.STORE), ("own.Provider", "own.Provider")):
            spark.conf.set(D.STORE_KEY, own) if own else spark.conf.unset(D.STORE_KEY)
            D.stream_flows(arriving)
            assert spark.conf.get(D.STORE_KEY) == then
        spark.conf.set(D.STORE_KEY, D.PLAIN)
        with D.with_state(spark):
            D.stream_flows(arriving)
        assert spark.conf.get(D.STORE_KEY) == D.PLAIN
    finally:
        spark.conf.set(D.STORE_KEY, before) if before else spark.conf.unset(D.STORE_KEY)


def test_an_index_with_a_hole_is_refused(frame):
    import datetime

    from keelson.operators.cashflow import market_total_return

    days = [datetime.date(2020, m, 28) for m in (1, 2, 3)]
    schema = "date date, mkt_rf double, rf double"
    whole = frame(schema, [(d, 0.01 * i, 0.001) for i, d in enumerate(days)])
    assert [round(r.r, 6) for r in market_total_return(whole).orderBy("date").collect()] == [0.001, 0.011, 0.021]
    with pytest.raises(ValueError, match="2020-02-28"):
        market_total_return(frame(schema, [(days[2], None, 0.1), (days[1], 0.1, None), (days[0], 0.1, 0.1)]))
    assert market_total_return(frame(schema, [])).collect() == []


def test_funds_are_halved_together_as_alone(frame, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    funds = [(np.sort(rng.uniform(0, 12, n)), rng.normal(size=n) * 100) for n in (2, 3, 40, 1, 0, 7, 300)]
    funds += [(np.array([0.0, 1.0]), np.array([-1.0, 1.0])), (np.array([0.0, 1.0]), np.array([1.0, 2.0])), (np.array([0.0, 1.0]), np.array([-1.0, np.nan]))]

    def plain(t, a):
        value = lambda r: np.sign(sum(x / (1 + r) ** y for x, y in zip(a, t, strict=True)))
        lo, hi, low = C.LOW, C.HIGH, value(C.LOW)
        if len(t) < 2 or not (a > 0).any() or not (a < 0).any() or not low * value(hi) <= 0:
            return None
        for _ in range(C.STEPS):
            lo, hi = ((lo + hi) / 2, hi) if value((lo + hi) / 2) == low else (lo, (lo + hi) / 2)
        return (lo + hi) / 2

    want = [plain(*f) for f in funds]
    assert sum(w is not None for w in want) >= 3
    assert C.roots([t for t, _ in funds], [a for _, a in funds]) == pytest.approx([np.nan if w is None else w for w in want], abs=1e-9, nan_ok=True)
    monkeypatch.setattr(C, "FLOWS", 50)
    rows = frame("i int, flows array<struct<t: double, a: double>>", [(i, [(float(x), float(y)) for x, y in zip(t, a, strict=True)]) for i, (t, a) in enumerate(funds)] + [(99, None)])
    got = {r.i: r.v for r in rows.select("i", C.xirr(rows.flows).alias("v")).collect()}
    assert got[99] is None and [got[i] for i in range(len(funds))] == [w if w is None else pytest.approx(w, abs=1e-9) for w in want]
