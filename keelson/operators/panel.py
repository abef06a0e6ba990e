"""Persistence panels: performance, lags, samples, ranks and quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, flag, log_performance
from ..schemas import require_columns
from .ranks import quantiles


def build_panel(funds: DataFrame, metrics: DataFrame | None = None, perf: str = "tvpi", log: bool = True, predecessor: str | None = None) -> DataFrame:
    """One row per fund with its predecessor's performance and gaps.

    Lags follow ``sequence`` in the family and are taken before any filter, so
    a fund that a later filter removes can still be a predecessor.
    """
    require_columns(funds, ["fund_id", "firm_id", "sequence", "vintage"], "panel funds")
    df = (funds if metrics is None else funds.join(metrics, "fund_id")).filter("firm_id is not null")
    w = Window.partitionBy("firm_id").orderBy("sequence", "fund_id")
    value = (lambda c: log_performance(F.col(c))) if log else F.col
    df = df.withColumn("y", value(perf))
    lagged = F.lag("y").over(w) if predecessor is None else F.lag(value(predecessor)).over(w)
    columns = {"y_lag": lagged, "lag_source": F.lit("final" if predecessor is None else "interim"), "prior_sequence": F.lag("sequence").over(w), "prior_vintage": F.lag("vintage").over(w)}
    columns["log_commitment"] = F.ln(F.when(F.col("commitment") > 0, F.col("commitment"))) if "commitment" in df.columns else F.lit(None).cast("double")
    if "fund_number" in df.columns:
        columns["prior_fund_number"] = F.lag("fund_number").over(w)
    if "vintage_anomaly" in df.columns:
        columns["prior_vintage_anomaly"] = F.lag("vintage_anomaly").over(w)
    df = df.withColumns(columns)
    gaps = {"vintage_gap": F.col("vintage") - F.col("prior_vintage")}
    if "fund_number" in df.columns:
        gaps["fund_number_gap"] = F.col("fund_number") - F.col("prior_fund_number")
    return df.withColumns(gaps)


def irr_panel(funds: DataFrame, irr: str = "net_irr") -> DataFrame:
    """A panel of returns in levels; a fund without one is nobody's predecessor either."""
    return build_panel(funds.filter(F.col(irr).isNotNull()), perf=irr, log=False)


def estimation_sample(panel: DataFrame, controls: tuple[str, ...] = (), clusters: tuple[str, ...] = ("firm_id",), fixed: str | None = "vintage", max_gap: int | None = None, drop_anomalies: bool = False) -> DataFrame:
    """Rows complete in all the model uses; unknown gaps fail a ``max_gap``."""
    needed = ["y", "y_lag", *controls, *clusters, *([fixed] if fixed else [])]
    rows = panel.na.drop(subset=list(dict.fromkeys(needed)))
    if max_gap is not None:
        rows = rows.filter(F.col("fund_number_gap") <= max_gap)
    if drop_anomalies:
        rows = rows.filter(~flag(F.col("vintage_anomaly")) & ~flag(F.col("prior_vintage_anomaly")))
    return rows


def adjacent_pairs(panel: DataFrame) -> DataFrame:
    return panel.filter("fund_number_gap = 1 and y is not null and y_lag is not null")


def mature_only(panel: DataFrame) -> DataFrame:
    return panel.filter(~flag(F.col("not_meaningful")))


def families_min_size(panel: DataFrame, least: int = 3, family: str = "firm_id") -> DataFrame:
    return panel.withColumn("_n", F.count("*").over(Window.partitionBy(family))).filter(F.col("_n") >= least).drop("_n")


def winsorise(sample: DataFrame, low: float, high: float) -> DataFrame:
    """Clips y and y_lag to common quantiles of both together."""
    both = quantiles(sample.select(F.explode(F.array("y", "y_lag")).alias("v")), "v", (low, high))
    # one row
    clipped = sample.crossJoin(F.broadcast(both))
    return clipped.withColumns({c: clamp(F.col(c), F.col("q0"), F.col("q1")) for c in ("y", "y_lag")}).drop("q0", "q1")


def quartiles(df: DataFrame, columns: dict[str, str], group: str) -> DataFrame:
    """Each value's quartile 1 to 4 by linearly interpolated cuts within the group; null below four different values.

    ``columns`` maps names to values, which are ranked together in one pass.
    """
    values = F.array(*(F.struct(F.lit(i).alias("which"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns.values())))
    stacked = df.select(group, F.explode(values).alias("e")).select(group, "e.which", "e.v")
    cuts = quantiles(stacked, "v", (0.25, 0.5, 0.75), (group, "which"), kinds="kinds")
    own = cuts.groupBy(F.col(group).alias("_group")).agg(*(F.max(F.when(F.col("which") == i, F.struct("q0", "q1", "q2", "kinds"))).alias(f"_cut{i}") for i in range(len(columns))))
    marked = df.join(own, F.col(group).eqNullSafe(F.col("_group")), "left")
    above = lambda i, c: sum(((F.col(c) > F.col(f"_cut{i}.q{k}")).cast("int") for k in range(3)), F.lit(1))
    named = {out: F.when((F.col(f"_cut{i}.kinds") >= 4) & F.col(c).isNotNull(), above(i, c)) for i, (out, c) in enumerate(columns.items())}
    return marked.withColumns(named).drop("_group", *(f"_cut{i}" for i in range(len(columns))))


def quartile(df: DataFrame, value: str, group: str, out: str) -> DataFrame:
    return quartiles(df, {out: value}, group)


def transitions(sample: DataFrame, group: str = "vintage") -> DataFrame:
    """(q_prev, q_now, n, share of the row) of the quartile transition table."""
    both = quartiles(sample, {"q_prev": "y_lag", "q_now": "y"}, group).filter("q_prev is not null and q_now is not null")
    counts = both.groupBy("q_prev", "q_now").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("q_prev")))
