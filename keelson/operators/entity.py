"""Entity resolution: lookups, pooling of plans, share classes, sequence, anomalies."""

from __future__ import annotations

from math import fma

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import flag, ratio
from ..schemas import require_columns

PRIORITY = ("CalPERS PEP", "Oregon PERS OPERF")
TREND_YEARS = 3.0


def lookup(df: DataFrame, key: str, mapping: DataFrame, map_key: str, map_value: str, out: str, default: Column | None = None) -> DataFrame:
    """Left lookup with a fall-through value (the key itself if none is given)."""
    m = mapping.select(F.col(map_key).alias("_k"), F.col(map_value).alias("_v"))
    joined = df.join(m, df[key] == m["_k"], "left")
    return joined.withColumn(out, F.coalesce("_v", default if default is not None else F.col(key))).drop("_k", "_v")


def apply_overrides(df: DataFrame, overrides: DataFrame, raw: str = "firm_id_raw", out: str = "firm_id") -> DataFrame:
    """Family of each raw stem after the hand-checked merges."""
    return lookup(df, raw, overrides.filter("decision = 'merge'"), "firm_id_raw", "firm_id_canonical", out)


def stale_overrides(df: DataFrame, overrides: DataFrame, raw: str = "firm_id_raw") -> DataFrame:
    """Override stems that match no fund and are no merge target."""
    targets = overrides.filter("decision = 'merge'").select(F.col("firm_id_canonical").alias("firm_id_raw"))
    stems = overrides.select("firm_id_raw").distinct()
    return stems.join(df.select(F.col(raw).alias("firm_id_raw")), "firm_id_raw", "left_anti").join(targets, "firm_id_raw", "left_anti")


def override_faults(overrides: DataFrame, key: str = "firm_id_raw", target: str | None = "firm_id_canonical") -> DataFrame:
    """(fault, key) of unknown decisions, repeated keys and chained merges."""
    repeated = overrides.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.lit("repeated").alias("fault"), F.col(key).alias("key"))
    if target is None:
        return repeated
    unknown = overrides.filter(~F.col("decision").isin("merge", "keep_separate")).select(F.lit("decision").alias("fault"), F.col(key).alias("key"))
    merges = overrides.filter("decision = 'merge'")
    chained = merges.select(F.col(target).alias("key")).join(merges.select(F.col(key).alias("key")), "key", "left_semi").distinct().select(F.lit("chained").alias("fault"), "key")
    return repeated.unionByName(unknown).unionByName(chained)


def pool_plans(stacked: DataFrame, priority: tuple[str, ...] = PRIORITY, check: bool = True) -> DataFrame:
    """All rows of the best plan for each (firm, number); rows without the key pass through."""
    require_columns(stacked, ["firm_id", "fund_number", "source"], "pool_plans input")
    if check:
        unlisted = stacked.filter(F.col("source").isNotNull() & ~F.col("source").isin(*priority)).select("source").distinct().limit(5).collect()
        if unlisted:
            raise ValueError(f"sources without a priority: {sorted(r[0] for r in unlisted)}")
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    keyed = F.col("firm_id").isNotNull() & F.col("fund_number").isNotNull()
    ranked = stacked.withColumn("_rank", rank)
    best = ranked.filter(keyed).withColumn("_best", F.min("_rank").over(Window.partitionBy("firm_id", "fund_number"))).filter("_rank = _best").drop("_best")
    return best.unionByName(ranked.filter(~keyed)).drop("_rank")


def overlap_report(stacked: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """The (firm, number) keys that more than one plan reports."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    keyed = stacked.filter("firm_id is not null and fund_number is not null").withColumn("_rank", rank)
    named = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "fund_id", F.col("fund_name").alias("name")))), lambda s: s["name"])
    grouped = keyed.groupBy("firm_id", "fund_number").agg(F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("plans"), F.array_join(named, " | ").alias("fund_names"), F.min_by("source", "_rank").alias("kept"), F.countDistinct("source").alias("n_plans"))
    return grouped.filter("n_plans > 1")


def share_class_rollup(funds: DataFrame) -> DataFrame:
    """One row per (firm, number): cash summed, vintage the least, IRR dropped, the largest commitment names it.

    Unnumbered funds are never collapsed.
    """
    w = Window.partitionBy("firm_id", "fund_number")
    counted = funds.withColumn("n_share_classes", F.when(F.col("fund_number").isNotNull(), F.count("*").over(w)).otherwise(F.lit(1)))
    single, several = counted.filter("n_share_classes = 1"), counted.filter("n_share_classes > 1")
    rest = [c for c in funds.columns if c not in ("firm_id", "fund_number")]
    lead = F.max_by(F.struct(*rest), F.struct(F.col("commitment"), -F.col("fund_id")))
    sums = {c: F.coalesce(F.sum(c), F.lit(0.0)) for c in ("commitment", "contributions", "distributions", "nav") if c in rest}
    extra = {"vintage": F.min("vintage"), "as_of": F.max("as_of"), "not_meaningful": F.coalesce(F.bool_or("not_meaningful"), F.lit(False))}
    sums |= {c: e for c, e in extra.items() if c in rest}
    rolled = several.groupBy("firm_id", "fund_number").agg(lead.alias("_lead"), F.count("*").alias("n_share_classes"), *(e.alias(c) for c, e in sums.items()))
    columns = {c: F.col(c) if c in sums else F.col(f"_lead.{c}") for c in rest}
    if "total_value" in rest:
        columns["total_value"] = F.col("distributions") + F.col("nav")
    if "net_irr" in rest:
        columns["net_irr"] = F.lit(None).cast("double")
    if "tvpi_reported" in rest:
        columns["tvpi_reported"] = F.when(F.col("contributions") > 0, (F.col("distributions") + F.col("nav")) / F.col("contributions"))
    return single.unionByName(rolled.select("firm_id", "fund_number", *(e.alias(c) for c, e in columns.items()), "n_share_classes"))


def share_class_report(funds: DataFrame) -> DataFrame:
    """Which rows were collapsed."""
    keyed = funds.filter("fund_number is not null")
    by_id = F.array_sort(F.collect_list(F.struct("fund_id", F.col("fund_name").alias("name"))))
    out = keyed.groupBy("firm_id", "fund_number").agg(F.count("*").alias("n_share_classes"), F.array_join(F.transform(by_id, lambda s: s["name"]), " | ").alias("fund_names"), F.array_join(F.transform(F.array_sort(F.collect_list("vintage")), lambda v: v.cast("string")), ";").alias("vintages"), F.min("vintage").alias("vintage_kept"), F.sum("commitment").alias("commitment_total"))
    return out.filter("n_share_classes > 1")


def add_sequence(funds: DataFrame) -> DataFrame:
    """``sequence`` in the family by vintage, commitment and id, and ``parallel_vintage``."""
    order = Window.partitionBy("firm_id").orderBy(F.col("vintage").asc_nulls_last(), F.col("commitment").asc_nulls_last(), "fund_id")
    return funds.withColumn("sequence", F.row_number().over(order)).withColumn("parallel_vintage", F.count("*").over(Window.partitionBy("firm_id", "vintage")) > 1)


def trends(rows: DataFrame, key: str, x: str, y: str, order: tuple[str, ...]) -> DataFrame:
    """(``_key``, ``_slope``, ``_level``): the least-squares line of each key, by running sums in the given order.

    A residual may lie on a threshold exactly; the last bits of the sums then
    decide. They are those of DuckDB's ``regr_slope`` and ``regr_intercept``
    over rows in that order (its covariance step and its intercept are fused
    multiply-adds).
    Only sums are held, however many rows a key has.
    """
    source = rows.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    schema = T.StructType([source.schema["_key"], T.StructField("_slope", T.DoubleType()), T.StructField("_level", T.DoubleType())])

    def run(batches):
        key, kind, n = None, None, 0

        def line():
            slope = (common / n) / (square / n) if square else None
            return key, slope, None if slope is None else fma(-slope, total_x / n, total_y / n)

        def rows_of(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), *(pa.array([d[i] for d in done], pa.float64()) for i in (1, 2))], schema.names)

        for batch in batches:
            kind, done = batch.schema.types[0], []
            for k, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not n or k != key:
                    if n:
                        done.append(line())
                    key, n = k, 0
                    mean_x = mean_y = common = square = total_x = total_y = 0.0
                n += 1
                dx, dy = x - mean_x, y - mean_y
                mean_x += dx / n
                mean_y += dy / n
                common = fma(dx, y - mean_y, common)
                square += (x - mean_x) * dx
                total_x += x
                total_y += y
            yield rows_of(done)
        if n:
            yield rows_of([line()])

    dealt = source.repartition("_key").sortWithinPartitions("_key", *(f"_o{i}" for i in range(len(order))))
    return dealt.select("_key", "_x", "_y").mapInArrow(run, schema)


def vintage_anomalies(funds: DataFrame, years: float = TREND_YEARS) -> DataFrame:
    """Flags vintages out of order with the fund numbers, or more than ``years`` off the family's trend. Nothing is corrected.

    The trend's sums run by fund number and id (see ``trends``).
    """
    known = F.col("fund_number").isNotNull() & F.col("vintage").isNotNull()
    keyed = funds.filter(known)
    by_number = Window.partitionBy("firm_id").orderBy("fund_number", "fund_id")
    family = Window.partitionBy("firm_id")
    fitted = keyed.withColumn("_before", F.lag("vintage").over(by_number)).withColumn("_after", F.lead("vintage").over(by_number))
    fitted = fitted.withColumn("_n", F.count("*").over(family)).withColumn("_spread", F.max("fund_number").over(family) - F.min("fund_number").over(family))
    fits = trends(keyed, "firm_id", "fund_number", "vintage", ("fund_number", "fund_id"))
    fitted = fitted.join(fits, F.col("firm_id").eqNullSafe(F.col("_key")), "left")
    residual = F.when((F.col("_n") >= 3) & (F.col("_spread") > 0), F.col("vintage") - (F.col("_level") + F.col("_slope") * F.col("fund_number")))
    out_of_order = flag(F.col("vintage") < F.col("_before")) | flag(F.col("_after") < F.col("vintage"))
    marked = fitted.withColumn("trend_residual", residual).withColumn("out_of_order", out_of_order).withColumn("vintage_anomaly", F.col("out_of_order") | flag(F.abs("trend_residual") > years))
    plain = funds.filter(~known).withColumn("trend_residual", F.lit(None).cast("double")).withColumn("out_of_order", F.lit(False)).withColumn("vintage_anomaly", F.lit(False))
    return marked.drop("_before", "_after", "_n", "_spread", "_key", "_slope", "_level").unionByName(plain)


def validity_flags(funds: DataFrame, mature_years: int = 5) -> DataFrame:
    """Zero paid-in, negative NAV, barely funded, and too young against the latest report."""
    latest = funds.agg(F.year(F.max("as_of")).alias("_latest"))
    called = ratio(F.col("contributions"), F.col("commitment"))
    # one row
    return funds.crossJoin(F.broadcast(latest)).select(*funds.columns, (F.col("contributions") <= 0).alias("zero_paid_in"), (F.col("nav") < 0).alias("negative_nav"), flag(called < 0.1).alias("unfunded"), (F.col("vintage") > F.col("_latest") - mature_years).alias("young"))


def prefix_pairs(stems: DataFrame, col: str = "stem") -> DataFrame:
    """(stem, longer): stems of which another stem is a longer version by whole tokens; an equi-join on exploded prefixes."""
    from ..functions.names import proper_prefixes

    one = stems.select(col).distinct()
    longer = one.select(F.col(col).alias("longer"), F.explode(proper_prefixes(F.col(col))).alias(col))
    return longer.join(one, col, "left_semi").select(col, "longer")
