"""Dated cash flows: differencing, as-of index levels, IRR and public-market equivalents.

Amounts are signed from the investor's side: calls negative, distributions
positive. Years are days / 365.25 from the first flow.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio

LOW, HIGH, STEPS = -0.9999, 100.0, 100
#: Flows whose funds are halved together.
FLOWS = 1 << 15


def flows_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """(fund_id, date, amount) by differencing cumulative totals.

    The first snapshot's level is a flow of its date; restated decreases count
    as no flow; unknown totals give an unknown amount, which is kept.
    """
    w = Window.partitionBy("fund_id").orderBy("as_of")

    def step(c: str) -> Column:
        moved = F.coalesce(F.col(c) - F.lag(c).over(w), F.col(c))
        return F.when(moved.isNotNull(), F.greatest(moved, F.lit(0.0)))

    flows = snapshots.select("fund_id", F.col("as_of").alias("date"), (step("distributions") - step("contributions")).alias("amount"))
    return flows.filter("amount is null or amount <> 0")


def observed_from_inception(snapshots: DataFrame) -> DataFrame:
    """Funds first seen before any call, with two dates or more."""
    first = F.min_by(F.col("contributions"), F.when(F.col("contributions").isNotNull(), F.col("as_of")))
    return snapshots.groupBy("fund_id").agg(first.alias("_first"), F.countDistinct("as_of").alias("_dates")).filter("_first <= 0 and _dates >= 2").select("fund_id")


def terminal_flows(flows: DataFrame, navs: DataFrame) -> DataFrame:
    """Flows with the remaining value as a last flow, on the later of its date and the last flow's.

    ``navs`` has fund_id, nav and nav_date.
    """
    last = flows.groupBy("fund_id").agg(F.max("date").alias("_last"))
    residual = navs.join(last, "fund_id").select("fund_id", F.greatest("nav_date", "_last").alias("date"), F.col("nav").alias("amount"))
    return flows.select("fund_id", "date", "amount").unionByName(residual).groupBy("fund_id", "date").agg(F.sum("amount").alias("amount"))


def asof_level(flows: DataFrame, index: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``level``: the last index level on or before each flow's date.

    Index levels become validity intervals, cut at month ends, so the join is
    on the month and touches one or few rows; no fund's flows are shuffled by
    anything but month. With ``strict`` a date before the index is an error.
    """
    w = Window.orderBy("date")
    span = flows.agg(F.max("date").alias("_max"))
    ends = index.select(F.col("date").alias("_from"), F.col("level"), F.lead("date").over(w).alias("_to"))
    # one row
    ends = ends.crossJoin(F.broadcast(span)).withColumn("_until", F.coalesce(F.date_sub("_to", 1), F.greatest("_max", "_from")))
    months = ends.select("_from", "_until", "level", F.explode(F.sequence(F.trunc("_from", "month"), F.trunc("_until", "month"), F.expr("interval 1 month"))).alias("_month"))
    keyed = flows.withColumn("_month", F.trunc("date", "month"))
    on = (keyed["_month"] == months["_month"]) & (keyed["date"] >= months["_from"]) & (keyed["date"] <= months["_until"])
    joined = keyed.join(months, on, "left").drop("_from", "_until", "_month")
    if strict:
        message = F.concat(F.lit("index starts after flow of "), F.col("date").cast("string"))
        joined = joined.withColumn("level", F.coalesce("level", F.raise_error(message).cast("double")))
    return joined


def npv(flows: Column, rate: Column) -> Column:
    """Present value of an array of structs (t in years, a)."""
    return F.aggregate(flows, F.lit(0.0), lambda acc, f: acc + f["a"] / F.pow(1 + rate, f["t"]))


def roots(times: Sequence[np.ndarray], amounts: Sequence[np.ndarray]) -> np.ndarray:
    """The bisections of some funds side by side, until no interval moves; NaN without a root."""
    out, sizes = np.full(len(times), np.nan), np.array([len(t) for t in times], np.int64)
    some = np.flatnonzero(sizes >= 2)
    if not len(some):
        return out
    sizes, t, a = sizes[some], np.concatenate([times[i] for i in some]), np.concatenate([amounts[i] for i in some])
    begin = np.cumsum(sizes) - sizes

    def sign(rate: np.ndarray) -> np.ndarray:
        return np.sign(np.add.reduceat(a * np.exp(np.repeat(-np.log1p(rate), sizes) * t), begin))

    with np.errstate(all="ignore"):
        lo, hi = np.full(len(some), LOW), np.full(len(some), HIGH)
        low = sign(lo)
        found = (np.maximum.reduceat(a, begin) > 0) & (np.minimum.reduceat(a, begin) < 0) & (low * sign(hi) <= 0)
        for _ in range(STEPS):
            middle = (lo + hi) / 2
            below = sign(middle) == low
            moved = np.where(below, middle, lo), np.where(below, hi, middle)
            if (moved[0] == lo).all() and (moved[1] == hi).all():
                break
            lo, hi = moved
    out[some] = np.where(found, (lo + hi) / 2, np.nan)
    return out


def xirr(timed: Column) -> Column:
    """Root of the present value on (-0.9999, 100) by bisection; null without a sign change.

    ``timed`` is a column of arrays of structs (t, a). Funds come to tasks in
    batches and are halved together, ``FLOWS`` flows or one fund at a time.
    """

    @F.pandas_udf("double")
    def solve(times: pd.Series, amounts: pd.Series) -> pd.Series:
        out = np.full(len(times), np.nan)
        # None for an unknown array or value
        t, a = ([np.zeros(0) if x is None else np.asarray(x, float) for x in column] for column in (times, amounts))
        ends = np.cumsum([len(x) for x in t]) // FLOWS
        for part in np.split(np.arange(len(out)), np.flatnonzero(np.diff(ends)) + 1):
            out[part] = roots([t[i] for i in part], [a[i] for i in part])
        return pd.Series(out)

    found = solve(F.transform(timed, lambda f: f["t"].cast("double")), F.transform(timed, lambda f: f["a"].cast("double")))
    return F.nanvl(found, F.lit(None).cast("double"))


def timed_flows(flows: DataFrame) -> DataFrame:
    """Adds ``t``: years since the fund's first flow."""
    return flows.withColumn("t", F.datediff("date", F.min("date").over(Window.partitionBy("fund_id"))) / F.lit(365.25))


def gathered(flows: DataFrame, amount: str = "amount", out: str = "flows") -> DataFrame:
    """One array of (t, a) per fund."""
    return timed_flows(flows).groupBy("fund_id").agg(F.collect_list(F.struct("t", F.col(amount).alias("a"))).alias(out))


def multiples(flows: DataFrame, navs: DataFrame) -> DataFrame:
    """paid_in, distributed, nav, dpi, rvpi, tvpi of every fund with flows and a value."""
    sums = flows.groupBy("fund_id").agg(F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0.0)).alias("paid_in"), F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0.0)).alias("distributed"))
    both = sums.join(navs.select("fund_id", "nav"), "fund_id")
    paid = F.col("paid_in")
    return both.select("fund_id", "paid_in", "distributed", "nav", ratio(F.col("distributed"), paid).alias("dpi"), ratio(F.col("nav"), paid).alias("rvpi"), ratio(F.col("distributed") + F.col("nav"), paid).alias("tvpi"))


def fund_irr(flows: DataFrame, navs: DataFrame) -> DataFrame:
    return gathered(terminal_flows(flows, navs)).select("fund_id", xirr(F.col("flows")).alias("irr"))


def pme(flows: DataFrame, navs: DataFrame, index: DataFrame) -> DataFrame:
    """irr, ks_pme, direct_alpha and ln_pme of every fund, from one gathering of its flows."""
    w = Window.partitionBy("fund_id")
    dated = timed_flows(asof_level(terminal_flows(flows, navs), index))
    dated = dated.withColumn("_end", F.max_by("level", "date").over(w)).withColumn("_last", F.max("date").over(w))
    dated = dated.withColumn("_grown", F.col("amount") * F.col("_end") / F.col("level"))
    before = F.sum(F.when(F.col("date") < F.col("_last"), F.col("_grown")).otherwise(0.0)).over(w)
    dated = dated.withColumn("_ln", F.when(F.col("date") < F.col("_last"), F.col("amount")).otherwise(-before))
    a, level = F.col("amount"), F.col("level")
    both = dated.groupBy("fund_id").agg(
        ratio(F.sum(F.when(a > 0, a / level).otherwise(0.0)), F.sum(F.when(a < 0, -a / level).otherwise(0.0))).alias("ks_pme"),
        F.collect_list(F.struct("t", a.alias("a"))).alias("_flows"),
        F.collect_list(F.struct("t", F.col("_grown").alias("a"))).alias("_direct"),
        F.collect_list(F.struct("t", F.col("_ln").alias("a"))).alias("_long"),
        F.max_by("_ln", "date").alias("_residual"),
    )
    return both.select("fund_id", xirr(F.col("_flows")).alias("irr"), "ks_pme", xirr(F.col("_direct")).alias("direct_alpha"), F.when(F.col("_residual") > 0, xirr(F.col("_long"))).alias("ln_pme"))


def summarise(flows: DataFrame, navs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The metrics table: multiples, IRR and, given an index, the market equivalents."""
    return multiples(flows, navs).join(fund_irr(flows, navs) if index is None else pme(flows, navs, index), "fund_id", "left")


def compound_index(returns: DataFrame, base: float = 100.0, date: str = "date", value: str = "r") -> DataFrame:
    """(date, level): base times the running product of 1 + r; a null return is an error."""
    checked = F.coalesce(F.col(value), F.raise_error(F.concat(F.lit("no return for "), F.col(date).cast("string"))).cast("double"))
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return returns.select(F.col(date).alias("date"), checked.alias("_r")).select("date", (base * F.exp(F.sum(F.ln(1 + F.col("_r"))).over(w))).alias("level"))


def first_missing(rows: DataFrame, values: tuple[str, ...], date: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, missing, first): rows, those that lack a value, and the first such date."""
    lacks = F.lit(False)
    for v in values:
        lacks |= F.col(v).isNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(lacks).alias("missing"), F.min(F.when(lacks, F.col(date))).alias("first"))


def market_total_return(factors: DataFrame) -> DataFrame:
    """(date, r): excess return plus the risk-free; a month without either is an error, as an index must not have a hole."""
    # one row
    bad = first_missing(factors, ("mkt_rf", "rf")).first()["first"]
    if bad is not None:
        raise ValueError(f"no factors at {bad}; cannot compound")
    return factors.select("date", (F.col("mkt_rf") + F.col("rf")).alias("r"))


def index_guard(index: DataFrame) -> DataFrame:
    """Levels that are not positive, or move by more than half in one step."""
    step = F.abs(F.col("level") / F.lag("level").over(Window.orderBy("date")) - 1)
    return index.withColumn("step", step).filter("level <= 0 or step > 0.5")
