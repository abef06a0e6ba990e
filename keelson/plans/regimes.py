"""Registered queries: scans and sinks, mapping regimes, result and figure tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as M
from ..operators import cashflow, entity, inference, panel, simulate
from ..schemas import FAMILY_OVERRIDES, SPONSOR_OVERRIDES
from ..sources import archive, manifest, readers
from . import views as V
from .catalog import _OVERRIDES, _overrides, query, r6
from .statistics import _fit, _ols_sql, _sample

# ---- scans and sinks -------------------------------------------------------

_FLAT = T.StructType([T.StructField("fund_id", T.LongType()), T.StructField("vintage", T.IntegerType()), T.StructField("commitment", T.DoubleType()), T.StructField("name", T.StringType())])


@query("csv_scan", """SELECT fund_id, vintage, commitment, 'Fund "' || fund_id || '", L.P.' AS name FROM funds""")
def csv_scan(spark, sf):
    """Written as CSV and read again, quotes and commas included."""
    path = readers.scratch_dir(spark, "csv")
    named = V.funds(spark, sf).select("fund_id", "vintage", "commitment", F.concat(F.lit('Fund "'), F.col("fund_id").cast("string"), F.lit('", L.P.')).alias("name"))
    named.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return readers.csv_scan(spark, path, _FLAT)


@query("append_only_sink", "SELECT as_of, count(*) AS n, round(sum(nav), 4) AS nav FROM snapshots GROUP BY 1")
def append_only_sink(spark, sf):
    """Every other date first; then all dates, the known ones with other values, which the archive does not take."""
    path = readers.scratch_dir(spark, "archive")
    dated = V.snapshots(spark, sf).withColumn("source", F.lit("plan"))
    known = F.floor(F.date_diff("as_of", F.lit("1970-01-01").cast("date")) / 7) % 2 == 0
    archive.append_only_sink(dated.filter(known), path)
    archive.append_only_sink(dated.withColumn("nav", F.when(known, -1.0).otherwise(F.col("nav"))), path)
    return archive.read_archive(spark, path, dated.schema).groupBy("as_of").agg(F.count("*").alias("n"), F.round(F.sum("nav"), 4).alias("nav"))


@query("override_scan", "SELECT c_custkey::VARCHAR AS firm_id_raw, (c_custkey % 7 - 10)::VARCHAR AS firm_id_canonical, CASE WHEN c_custkey % 3 = 0 THEN 'keep_separate' ELSE 'merge' END AS decision, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE '' END AS confidence, 'of \"' || c_custkey || '\", by hand' AS reason FROM customer")
def override_scan(spark, sf):
    """A mapping of every customer is written with comments and quotes, and checked as it is read."""
    path = readers.scratch_dir(spark, "overrides")
    k = F.col("c_custkey")
    rows = V.table(spark, sf, "customer").select(k.cast("string").alias("firm_id_raw"), (k % 7 - 10).cast("string").alias("firm_id_canonical"), F.when(k % 3 == 0, "keep_separate").otherwise("merge").alias("decision"), F.when(k % 2 == 0, "high").alias("confidence"), F.concat(F.lit('of "'), k.cast("string"), F.lit('", by hand')).alias("reason"))
    said = rows.limit(1).select(F.lit("# reviewed").alias("firm_id_raw"), *(F.lit("x").alias(c) for c in rows.columns[1:]))
    # a writer that takes another sign for comments leaves this one unquoted
    rows.unionByName(said).write.option("header", True).option("escape", '"').option("comment", "%").csv(path)
    return readers.override_scan(spark, path, FAMILY_OVERRIDES)


@query("override_scan_sponsors", "SELECT s_suppkey::VARCHAR AS firm_id, 'S' || s_nationkey AS sponsor_id, '' AS confidence, s_name AS reason FROM supplier")
def override_scan_sponsors(spark, sf):
    path = readers.scratch_dir(spark, "sponsors")
    rows = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("firm_id"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("sponsor_id"), F.lit(None).cast("string").alias("confidence"), F.col("s_name").alias("reason"))
    readers.csv_sink(rows, path)
    return readers.override_scan(spark, path, SPONSOR_OVERRIDES)


@query("archive_scan", "SELECT as_of, count(*) AS n, round(sum(nav), 4) AS nav FROM snapshots GROUP BY 1")
def archive_scan(spark, sf):
    path = readers.scratch_dir(spark, "snaps")
    s = V.snapshots(spark, sf)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in readers.SNAPSHOT if f.name not in s.columns]
    rows = s.withColumn("fund_id", F.col("fund_id").cast("string")).select("*", *empty).select(*readers.SNAPSHOT.fieldNames())
    rows.repartition(2, "as_of").write.option("header", True).csv(path)
    return readers.archive_scan(spark, f"{path}/*.csv").groupBy("as_of").agg(F.count("*").alias("n"), F.round(F.sum("nav"), 4).alias("nav"))


#: Funds of one archived file.
_FILE = 4096


def _archived(spark, sf):
    """Files of funds, one for each range of ids, named by Spark."""
    path = readers.scratch_dir(spark, "files")
    part = F.floor(F.col("fund_id") / _FILE).alias("part")
    V.funds(spark, sf).select("fund_id", part).repartition("part").sortWithinPartitions("part", "fund_id").write.partitionBy("part").option("header", True).csv(path)
    return path


# a file's name holds a random number, so its folder stands for it
_FILES = f"SELECT 'part=' || (fund_id // {_FILE}) AS folder, 'snapshot' AS kind, '' AS source, '' AS as_of, sha256('fund_id' || chr(10) || string_agg(fund_id || chr(10), '' ORDER BY fund_id)) AS sha256, count(*)::VARCHAR AS rows FROM funds GROUP BY fund_id // {_FILE}"


def _told(files):
    return files.select(F.split("file", "/")[0].alias("folder"), "kind", "source", "as_of", "sha256", "rows")


@query("manifest_build", _FILES)
def manifest_build(spark, sf):
    return _told(manifest.build(spark, f"{_archived(spark, sf)}/*/*.csv", "snapshot"))


@query("manifest_sink", f"SELECT *, false AS changed FROM ({V.with_views(_FILES)})")
def manifest_sink(spark, sf):
    """The manifest is written twice; the second writing changes nothing."""
    path = _archived(spark, sf)
    # as many rows as files
    before = [tuple(r) for r in manifest.write(spark, f"{path}/*/*.csv", f"{path}-manifest").orderBy("file").collect()]
    again = manifest.write(spark, f"{path}/*/*.csv", f"{path}-manifest")
    changed = before != [tuple(r) for r in again.orderBy("file").collect()]
    return _told(again).withColumn("changed", F.lit(changed))


@query("benchmark_scan", "SELECT date, level FROM idx WHERE level > 0 ORDER BY date")
def benchmark_scan(spark, sf):
    return V.index(spark, sf).filter("level > 0").orderBy("date")


@query("load_index", "SELECT date, round(100 * exp(sum(ln(1 + level / 10000)) OVER (ORDER BY date)), 6) AS level FROM idx WHERE date >= DATE '1997-01-01'")
def load_index(spark, sf):
    sliced = V.index(spark, sf).filter("date >= date'1997-01-01'").select("date", (F.col("level") / 10000).alias("r"))
    return cashflow.compound_index(sliced).select("date", r6("level").alias("level"))


@query("raw_table", "SELECT source, count(*) AS n, count(sold_secondary) AS flagged FROM plans GROUP BY 1")
def raw_table(spark, sf):
    p = V.plans(spark, sf)
    a = p.filter(F.col("source") == V.A).drop("sold_secondary")
    both = a.unionByName(p.filter(F.col("source") == V.B), allowMissingColumns=True)
    restored = both.join(V.funds(spark, sf).select("fund_id", F.col("sold_secondary").alias("_s")), "fund_id").withColumn("sold_secondary", F.coalesce("sold_secondary", "_s"))
    return restored.groupBy("source").agg(F.count("*").alias("n"), F.count("sold_secondary").alias("flagged"))


@query("stream_flows", "SELECT fund_id, as_of AS date, round(d - c, 6) AS amount FROM (SELECT fund_id, as_of, greatest(coalesce(contributions - lag(contributions) OVER w, contributions), 0) AS c, greatest(coalesce(distributions - lag(distributions) OVER w, distributions), 0) AS d FROM snapshots WINDOW w AS (PARTITION BY fund_id ORDER BY as_of)) WHERE d - c <> 0")
def stream_flows(spark, sf):
    """Snapshots arrive in three parts, and the query stops and starts again between them; the flows are those of the batch."""
    from ..streaming import differencing

    path = readers.scratch_dir(spark, "stream")
    rows = V.snapshots(spark, sf).select("fund_id", "as_of", "contributions", "distributions")
    # a row for each date
    days = sorted(r[0] for r in rows.select("as_of").distinct().collect())
    cuts = [days[len(days) * i // 3] for i in (1, 2)] if days else []
    part = F.lit(0) + sum(((F.col("as_of") >= c).cast("int") for c in cuts), F.lit(0))
    rows.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{path}/all")
    jvm = spark._jvm.org.apache.hadoop.fs
    store = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(jvm.Path(f"{path}/in"))
    with differencing.with_state(spark, spark.sparkContext.defaultParallelism):
        for i in range(3):
            if not store.exists(jvm.Path(f"{path}/all/part={i}")):
                continue
            store.rename(jvm.Path(f"{path}/all/part={i}"), jvm.Path(f"{path}/in/{i}"))
            arriving = spark.readStream.schema(rows.schema).parquet(f"{path}/in/*")
            running = differencing.stream_flows(arriving).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            running.awaitTermination()
    return spark.read.schema(differencing.OUT).parquet(f"{path}/out").select("fund_id", "date", r6("amount").alias("amount"))

# ---- filters and projections of the overlap study --------------------------


@query("select_keep", "SELECT fund_id, firm_id, vintage FROM funds")
def select_keep(spark, sf):
    return V.funds(spark, sf).select("fund_id", "firm_id", "vintage")


@query("drop_null_or_nonpos", "SELECT fund_id, as_of FROM snapshots WHERE contributions > 0")
def drop_null_or_nonpos(spark, sf):
    return V.snapshots(spark, sf).na.drop(subset=["contributions"]).filter("contributions > 0").select("fund_id", "as_of")


@query("usable_multiple", f"SELECT a.fund_id FROM plans a JOIN plans b USING (fund_id) WHERE a.source = '{V.A}' AND b.source = '{V.B}' AND a.distributions > 0 AND b.nav > 0")
def usable_multiple(spark, sf):
    p = V.plans(spark, sf)
    a = p.filter((F.col("source") == V.A) & (F.col("distributions") > 0)).select("fund_id")
    return a.join(p.filter((F.col("source") == V.B) & (F.col("nav") > 0)).select("fund_id"), "fund_id")


@query("override_confidence", f"WITH {_OVERRIDES} SELECT firm_id_raw FROM ov WHERE decision = 'keep_separate' OR firm_id_raw % 3 = 0")
def override_confidence(spark, sf):
    o = _overrides(spark, sf).withColumn("confidence", F.when(F.col("firm_id_raw") % 3 == 0, "high").otherwise("low"))
    return o.filter("decision = 'keep_separate' or confidence = 'high'").select("firm_id_raw")


# ---- regimes ---------------------------------------------------------------

_REGIMES = f"""(SELECT *, lag(y) OVER (PARTITION BY regime, firm_id ORDER BY vintage, commitment, fund_id) AS y_lag FROM (
  SELECT s.fund_id, s.vintage, s.commitment, ln(greatest(tvpi, 0.01)) AS y, r.regime, CASE WHEN r.regime = '3 all' OR r.regime = '2 high' AND o.firm_id_raw % 3 = 0 THEN coalesce(o.firm_id_canonical, s.firm_id) ELSE s.firm_id END AS firm_id
  FROM snap s LEFT JOIN (SELECT c_custkey AS firm_id_raw, c_custkey - 3 AS firm_id_canonical FROM customer WHERE c_custkey % 20 = 3) o ON s.firm_id = o.firm_id_raw, (SELECT unnest(['1 none', '2 high', '3 all']) AS regime) r)
  QUALIFY lag(y) OVER (PARTITION BY regime, firm_id ORDER BY vintage, commitment, fund_id) IS NOT NULL)"""


def regime_panel(spark, sf):
    """The panel under three override sets at once, keyed by regime."""
    merges = _overrides(spark, sf).filter("decision = 'merge'")
    s = V.snap(spark, sf).join(merges, F.col("firm_id") == F.col("firm_id_raw"), "left")
    merged = F.coalesce("firm_id_canonical", "firm_id")
    families = F.array(F.struct(F.lit("1 none").alias("regime"), F.col("firm_id").alias("family")), F.struct(F.lit("2 high").alias("regime"), F.when(F.col("firm_id_raw") % 3 == 0, merged).otherwise(F.col("firm_id")).alias("family")), F.struct(F.lit("3 all").alias("regime"), merged.alias("family")))
    e = s.withColumn("r", F.explode(families)).select("fund_id", "vintage", "commitment", M.log_performance(F.col("tvpi")).alias("y"), "r.regime", F.col("r.family").alias("firm_id"))
    w = Window.partitionBy("regime", "firm_id").orderBy("vintage", "commitment", "fund_id")
    return e.withColumn("y_lag", F.lag("y").over(w)).filter("y_lag is not null")


@query("mapping_regimes", _ols_sql(sample=_REGIMES, key="regime"))
def mapping_regimes(spark, sf):
    return _fit(inference.ols_fe(regime_panel(spark, sf), keys=("regime",)), "regime")


@query("build_regime", f"SELECT regime, count(*) AS pairs, count(DISTINCT firm_id) AS families FROM {_REGIMES} GROUP BY 1")
def build_regime(spark, sf):
    return regime_panel(spark, sf).groupBy("regime").agg(F.count("*").alias("pairs"), F.countDistinct("firm_id").alias("families"))


@query("irr_panel", _ols_sql(sample="(SELECT *, lag(y) OVER w AS y_lag FROM (SELECT *, nav / contributions - 0.5 AS y FROM snap WHERE fund_id % 6 > 0) WINDOW w AS (PARTITION BY firm_id ORDER BY sequence, fund_id) QUALIFY lag(y) OVER w IS NOT NULL)"))
def irr_panel(spark, sf):
    """A return in levels instead of a log multiple."""
    s = V.snap(spark, sf).withColumn("net_irr", F.when(F.col("fund_id") % 6 > 0, F.col("nav") / F.col("contributions") - 0.5))
    return _fit(inference.ols_fe(panel.estimation_sample(panel.irr_panel(s))))


@query("resolution_pipeline", "SELECT count(*) AS funds, count(DISTINCT firm_id) AS families FROM (SELECT firm_id, fund_number, 1 AS n FROM (SELECT *, min(source) OVER (PARTITION BY firm_id, fund_number) AS best FROM plans WHERE fund_number IS NOT NULL) WHERE source = best GROUP BY ALL UNION ALL SELECT firm_id, NULL, fund_id FROM plans WHERE fund_number IS NULL)")
def resolution_pipeline(spark, sf):
    """Pool, roll up, number and flag: the order matters."""
    pooled = entity.pool_plans(V.plans(spark, sf), (V.A, V.B))
    one = entity.add_sequence(entity.share_class_rollup(pooled).drop("sequence"))
    return entity.vintage_anomalies(one).agg(F.count("*").alias("funds"), F.countDistinct("firm_id").alias("families"))


# ---- result and figure tables ----------------------------------------------


def _labelled(label: str, sql: str) -> str:
    return f"SELECT '{label}' AS spec, beta, se, n, n_firms FROM ({V.with_views(sql)})"


@query("results_table", " UNION ALL ".join(_labelled(a, b) for a, b in (("fe", _ols_sql()), ("plain", _ols_sql(fixed="")), ("sponsor", _ols_sql(clusters=("sponsor_id",))))))
def results_table(spark, sf):
    s = _sample(spark, sf)
    fits = (("fe", inference.ols_fe(s)), ("plain", inference.ols_fe(s, fixed=None)), ("sponsor", inference.ols_fe(s, clusters=("sponsor_id",))))
    tables = [_fit(f).select(F.lit(name).alias("spec"), "beta", "se", "n", "n_firms") for name, f in fits]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("transition_heatmap", "SELECT q_prev, q_now, round(n / sum(n) OVER (PARTITION BY q_prev), 4) AS share FROM (SELECT q_prev, q_now, count(*) AS n FROM (SELECT 1 + (y > quantile_cont(y, 0.25) OVER v)::INT + (y > quantile_cont(y, 0.5) OVER v)::INT + (y > quantile_cont(y, 0.75) OVER v)::INT AS q_now, 1 + (y_lag > quantile_cont(y_lag, 0.25) OVER v)::INT + (y_lag > quantile_cont(y_lag, 0.5) OVER v)::INT + (y_lag > quantile_cont(y_lag, 0.75) OVER v)::INT AS q_prev FROM sample WINDOW v AS (PARTITION BY vintage)) GROUP BY 1, 2)")
def transition_heatmap(spark, sf):
    return panel.transitions(_sample(spark, sf)).select("q_prev", "q_now", F.round("share", 4).alias("share"))


def _row_sql(places):
    """The published row: every number by half-even rounding of its binary value, which C's %f does."""
    return ", ".join(f"printf('%.{d}f', {c})::DOUBLE AS {c}" for c, d in places.items())


@query("round_row", f"SELECT spec, {_row_sql({'beta': 4, 'se': 4})}, n FROM ({_ols_sql(sample='(SELECT *, CASE WHEN vintage < 1998 THEN 1 ELSE 2 END AS spec FROM sample)', key='spec')})")
def round_row(spark, sf):
    s = _sample(spark, sf).withColumn("spec", F.when(F.col("vintage") < 1998, 1).otherwise(2))
    return inference.ols_fe(s, keys=("spec",)).select("spec", M.round_half_even(r6("beta"), 4).alias("beta"), M.round_half_even(r6("se"), 4).alias("se"), "n")


@query("round_half_even", f"SELECT k, x, {_row_sql({'two': 2, 'three': 3})} FROM (SELECT k, x, x AS two, x AS three FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_quantity * l_tax / 8 AS x FROM lineitem))")
def round_half_even(spark, sf):
    """Many products lie on a half of the second or third place, or look as if they did."""
    x = F.col("l_quantity") * F.col("l_tax") / 8
    rows = V.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), x.alias("x"))
    return rows.select("k", "x", M.round_half_even(F.col("x"), 2).alias("two"), M.round_half_even(F.col("x"), 3).alias("three"))


@query("vintage_error_study")
def vintage_error_study(spark, sf):
    """Slopes on true and on displaced vintages, their gap and how often it is positive, over 400 replications a slope."""
    sample = panel.estimation_sample(panel.build_panel(simulate.vintage_panels(spark)))
    fits = inference.ols_fe(sample, keys=("true_beta", "rep", "labels"))
    beta = lambda labels: F.max(F.when(F.col("labels") == labels, F.col("beta")))
    both = fits.groupBy("true_beta", "rep").agg(beta("true").alias("true"), beta("displaced").alias("displaced")).withColumn("bias", F.col("displaced") - F.col("true")).filter("bias is not null")
    means = {"beta_true": F.avg("true"), "beta_displaced": F.avg("displaced"), "bias": F.avg("bias"), "bias_se": F.stddev_samp("bias") / F.sqrt(F.count("*")), "inflated": F.avg((F.col("bias") > 0).cast("double"))}
    return both.groupBy("true_beta").agg(*(r6(e).alias(c) for c, e in means.items()), F.count("*").alias("n"))
