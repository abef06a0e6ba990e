"""Exact ranks and interpolated quantiles, also of groups that hold most rows.

Rows are first counted by (group, value), so ties and copies are one row. The
different values are then dealt into ranges between approximate quantiles;
running counts are taken within (group, range) and offset by the ranges before,
of which a group has ``RANGES`` at most. No task holds a group, and no
aggregate's state grows with its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def cumulated(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(_g0 .., _v, _c, _below, _n): each different value of a group, its rows, the rows below it and the group's rows; nulls are left out."""
    own = [f"_g{i}" for i in range(len(groups))]
    counted = df.filter(F.col(value).isNotNull()).groupBy(*(F.col(g).alias(o) for g, o in zip(groups, own, strict=True)), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = counted.agg(F.coalesce(F.percentile_approx(F.col("_v").cast("double"), F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 10 * RANGES), F.array().cast("array<double>")).alias("_cuts"))
    # one row
    ranged = counted.crossJoin(F.broadcast(cuts)).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_v").cast("double")))).drop("_cuts")
    before = Window.partitionBy(*own).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*own, "_r").agg(F.sum("_c").alias("_size"))
    sizes = sizes.select(*own, "_r", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*own)).alias("_n"))
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*own, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.withColumn("_inside", inside).alias("a")
    same = F.col("a._r") == F.col("b._r")
    for o in own:
        same &= F.col(f"a.{o}").eqNullSafe(F.col(f"b.{o}"))
    return rows.join(sizes.alias("b"), same).select(*(F.col(f"a.{o}") for o in own), "_v", "_c", (F.col("_inside") + F.col("_before")).alias("_below"), "_n")


def quantiles(df: DataFrame, value: str, at: Sequence[float], groups: Sequence[str] = (), kinds: str | None = None) -> DataFrame:
    """(group columns, q0, q1, ...): linearly interpolated quantiles of each group; one row without groups, of nulls if there are no values. ``kinds`` names a count of different values."""
    rows, out = cumulated(df, value, groups), [F.count("*").alias("_kinds")]
    reached = F.col("_below") + F.col("_c")
    for i, p in enumerate(at):
        place = (F.col("_n") - 1) * F.lit(float(p))
        out += [F.min(F.when(reached > F.floor(place), F.col("_v"))).alias(f"_lo{i}"), F.min(F.when(reached > F.ceil(place), F.col("_v"))).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    own = [f"_g{i}" for i in range(len(groups))]
    found = rows.groupBy(*own).agg(*out)
    return found.select(*(F.col(o).alias(g) for o, g in zip(own, groups, strict=True)), *((F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}") for i in range(len(at))), *([F.col("_kinds").alias(kinds)] if kinds else []))


def average_rank(df: DataFrame, value: str, group: str, out: str) -> DataFrame:
    """Percentile rank within the group, ties sharing their average; null for a null value."""
    ranks = cumulated(df, value, (group,)).select("_g0", "_v", ((F.col("_below") + (F.col("_c") + 1) / 2) / F.col("_n")).alias(out))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("_g0")) & (F.col(value) == F.col("_v")), "left").drop("_g0", "_v")
