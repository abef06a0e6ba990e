"""Registered queries: cash-flow metrics, regressions, resampling, reviews and parsers, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import parsing as P
from ..operators import cashflow, entity, inference, panel, resample, review, simulate
from ..sources import disclosures, manifest, readers
from . import views as V
from .catalog import ORACLES, query, r6

SEED = 20240813


def _sample(spark, sf, **options):
    return panel.estimation_sample(panel.build_panel(V.snap(spark, sf)), **options)


# ---- cash flows ------------------------------------------------------------


@query("flows_from_snapshots", "SELECT fund_id, as_of AS date, round(d - c, 6) AS amount FROM (SELECT fund_id, as_of, greatest(coalesce(contributions - lag(contributions) OVER w, contributions), 0) AS c, greatest(coalesce(distributions - lag(distributions) OVER w, distributions), 0) AS d FROM snapshots WINDOW w AS (PARTITION BY fund_id ORDER BY as_of)) WHERE d - c <> 0")
def flows_from_snapshots(spark, sf):
    return cashflow.flows_from_snapshots(V.snapshots(spark, sf)).select("fund_id", "date", r6("amount").alias("amount"))


@query("observed_from_inception", "SELECT fund_id FROM snapshots GROUP BY 1 HAVING arg_min(contributions, as_of) <= 0 AND count(DISTINCT as_of) >= 2")
def observed_from_inception(spark, sf):
    return cashflow.observed_from_inception(V.snapshots(spark, sf))


@query("terminal_flows", "SELECT fund_id, date, round(amount, 6) AS amount FROM tflows")
def terminal_flows(spark, sf):
    return cashflow.terminal_flows(V.flows(spark, sf), V.navs(spark, sf)).select("fund_id", "date", r6("amount").alias("amount"))


@query("multiples", "SELECT fund_id, round(d / nullif(p, 0), 6) AS dpi, round(nav / nullif(p, 0), 6) AS rvpi, round((d + nav) / nullif(p, 0), 6) AS tvpi FROM (SELECT fund_id, sum(greatest(-amount, 0)) AS p, sum(greatest(amount, 0)) AS d FROM flows GROUP BY 1) JOIN navs USING (fund_id)")
def multiples(spark, sf):
    return cashflow.multiples(V.flows(spark, sf), V.navs(spark, sf)).select("fund_id", r6("dpi").alias("dpi"), r6("rvpi").alias("rvpi"), r6("tvpi").alias("tvpi"))


@query("xnpv", "SELECT fund_id, round(sum(amount / pow(1.1, date_diff('day', d0, date) / 365.25)), 4) AS npv FROM (SELECT *, min(date) OVER (PARTITION BY fund_id) AS d0 FROM flows) GROUP BY 1")
def xnpv(spark, sf):
    return cashflow.gathered(V.flows(spark, sf)).select("fund_id", F.round(cashflow.npv(F.col("flows"), F.lit(0.1)), 4).alias("npv"))


def _irr_sql(source: str, amount: str, out: str, digits: int = 6, only: str = "") -> str:
    return f"""WITH RECURSIVE fl AS (SELECT fund_id, date_diff('day', min(date) OVER (PARTITION BY fund_id), date) / 365.25 AS t, {amount} AS a FROM {source}),
lo0 AS (SELECT fund_id, sign(sum(a / pow(1 - 0.9999, t))) AS s, sign(sum(a / pow(101, t))) AS h, count(*) AS n, max(a) AS top, min(a) AS low FROM fl GROUP BY 1),
ok AS (SELECT fund_id, s FROM lo0 WHERE n >= 2 AND top > 0 AND low < 0 AND s * h <= 0{only}),
it AS (SELECT fund_id, s, -0.9999::DOUBLE AS lo, 100::DOUBLE AS hi, 0 AS k FROM ok UNION ALL
  SELECT fund_id, s, CASE WHEN sign(sum(a / pow(1 + (lo + hi) / 2, t))) = s THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sign(sum(a / pow(1 + (lo + hi) / 2, t))) = s THEN hi ELSE (lo + hi) / 2 END, k + 1
  FROM it JOIN fl USING (fund_id) WHERE k < 60 GROUP BY fund_id, s, lo, hi, k)
SELECT l.fund_id, round((lo + hi) / 2, {digits}) AS {out} FROM lo0 l LEFT JOIN (SELECT * FROM it WHERE k = 60) USING (fund_id)"""


@query("xirr", _irr_sql("flows", "amount", "irr"))
def xirr(spark, sf):
    return cashflow.gathered(V.flows(spark, sf)).select("fund_id", r6(cashflow.xirr(F.col("flows"))).alias("irr"))


@query("fund_irr", _irr_sql("tflows", "amount", "irr"))
def fund_irr(spark, sf):
    return cashflow.fund_irr(V.flows(spark, sf), V.navs(spark, sf)).select("fund_id", r6("irr").alias("irr"))


@query("ks_pme", "SELECT fund_id, round(sum(greatest(amount, 0) / level) / nullif(sum(greatest(-amount, 0) / level), 0), 6) AS ks_pme FROM leveled GROUP BY 1")
def ks_pme(spark, sf):
    return cashflow.pme(V.flows(spark, sf), V.navs(spark, sf), V.index(spark, sf)).select("fund_id", r6("ks_pme").alias("ks_pme"))


@query("direct_alpha", _irr_sql("leveled", "amount * lend / level", "direct_alpha"))
def direct_alpha(spark, sf):
    return cashflow.pme(V.flows(spark, sf), V.navs(spark, sf), V.index(spark, sf)).select("fund_id", r6("direct_alpha").alias("direct_alpha"))


_LN = "(SELECT fund_id, date, last, CASE WHEN date < last THEN amount ELSE -sum(CASE WHEN date < last THEN amount * lend / level ELSE 0 END) OVER (PARTITION BY fund_id) END AS amount FROM leveled)"


@query("ln_pme", _irr_sql(_LN, "amount", "ln_pme", only=f" AND fund_id IN (SELECT fund_id FROM {_LN} WHERE date = last AND amount > 0)"))
def ln_pme(spark, sf):
    return cashflow.pme(V.flows(spark, sf), V.navs(spark, sf), V.index(spark, sf)).select("fund_id", r6("ln_pme").alias("ln_pme"))


_PARTS = [f"({ORACLES[name]})" for name in ("multiples", "fund_irr", "ks_pme", "direct_alpha", "ln_pme")]


@query("summarise_panel", f"SELECT * FROM {_PARTS[0]} m " + " ".join(f"LEFT JOIN {part} p{i} USING (fund_id)" for i, part in enumerate([*_PARTS[1:], "(" + V.with_views("SELECT fund_id, round(sum(greatest(-amount, 0)), 6) AS paid_in, round(sum(greatest(amount, 0)), 6) AS distributed, round(any_value(nav), 6) AS nav FROM flows JOIN navs USING (fund_id) GROUP BY 1") + ")"])))
def summarise_panel(spark, sf):
    out = cashflow.summarise(V.flows(spark, sf), V.navs(spark, sf), V.index(spark, sf))
    return out.select("fund_id", *(r6(c).alias(c) for c in out.columns if c != "fund_id"))


@query("pme_report", """WITH e AS (SELECT fund_id FROM snapshots GROUP BY 1 HAVING arg_min(contributions, as_of) <= 0 AND count(DISTINCT as_of) >= 2),
l AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY as_of DESC) = 1)
SELECT CASE WHEN distributions / nullif(contributions, 0) >= 0.5 THEN 'realised' ELSE 'unrealised' END AS half, count(*) AS n, count(e.fund_id) AS eligible, round(sum(nav) FILTER (e.fund_id IS NOT NULL), 6) AS nav FROM l LEFT JOIN e USING (fund_id) GROUP BY 1""")
def pme_report(spark, sf):
    s = V.snapshots(spark, sf)
    last = s.groupBy("fund_id").agg(F.max_by(F.struct("contributions", "distributions", "nav"), "as_of").alias("l")).select("fund_id", "l.*")
    joined = last.join(cashflow.observed_from_inception(s).withColumn("e", F.lit(1)), "fund_id", "left")
    half = F.when(F.try_divide("distributions", F.nullif("contributions", F.lit(0.0))) >= 0.5, "realised").otherwise("unrealised")
    return joined.groupBy(half.alias("half")).agg(F.count("*").alias("n"), F.count("e").alias("eligible"), r6(F.sum(F.when(F.col("e") == 1, F.col("nav")))).alias("nav"))


@query("flow_invariants", "SELECT count(*) AS n, sum((nav_date < last)::INT) AS early FROM (SELECT fund_id, max(date) AS last FROM flows GROUP BY 1) JOIN navs USING (fund_id)")
def flow_invariants(spark, sf):
    last = V.flows(spark, sf).groupBy("fund_id").agg(F.max("date").alias("last"))
    return last.join(V.navs(spark, sf), "fund_id").agg(F.count("*").alias("n"), F.sum((F.col("nav_date") < F.col("last")).cast("int")).alias("early"))


# ---- regressions -----------------------------------------------------------


def _ols_sql(sample: str = "sample", where: str = "", fixed: str = "vintage", extra_k: int = 1, clusters: tuple[str, ...] = ("firm_id",), key: str = "", controls: tuple[str, ...] = ()) -> str:
    part = ", ".join(x for x in (key, fixed) if x)
    over = f"OVER (PARTITION BY {part})" if part else "OVER ()"
    by = f"OVER (PARTITION BY {key})" if key else "OVER ()"
    lead = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    using = f"USING ({key})" if key else "ON true"
    columns = ["y", "y_lag", *controls]
    dm = ", ".join(f"{c} - avg({c}) {over} AS d_{c}" for c in columns)
    # one control after another leaves the columns that are left
    steps, source = [], "m"
    for i, z in enumerate(controls):
        later = [c for c in columns if c not in controls[: i + 1]]
        steps.append(f"z{i} AS (SELECT * REPLACE ({', '.join(f'd_{c} - sum(d_{z} * d_{c}) {by} / sum(d_{z} * d_{z}) {by} * d_{z} AS d_{c}' for c in later)}) FROM {source}), ")
        source = f"z{i}"
    dims = [(clusters[0],)] + ([(clusters[1],), clusters] if len(clusters) > 1 else [])
    ctes, joins, terms = [], "", []
    for i, dim in enumerate(dims):
        ctes.append(f"c{i} AS (SELECT {lead}sum(s * s) AS v{i}, count(*) AS g{i} FROM (SELECT {lead}{', '.join(dim)}, sum(tx * e / xx) AS s FROM e GROUP BY {lead}{', '.join(dim)}) {group})")
        joins += f" JOIN c{i} {using}"
        terms.append(f"v{i} * g{i} / (g{i} - 1) * (n - 1) / (n - k)")
    var = f"CASE WHEN {terms[0]} + {terms[1]} - {terms[2]} > 0 THEN {terms[0]} + {terms[1]} - {terms[2]} ELSE {terms[0]} END" if len(dims) == 3 else terms[0]
    levels = f"count(DISTINCT {fixed})" if fixed else "1"
    return f"""WITH m AS (SELECT *, {dm} FROM {sample} {where}), {"".join(steps)}t AS (SELECT *, d_y AS ty, d_y_lag AS tx FROM {source}), x AS (SELECT *, sum(tx * tx) {by} AS xx, sum(tx * ty) {by} / sum(tx * tx) {by} AS beta FROM t), e AS (SELECT *, ty - beta * tx AS e FROM x),
b AS (SELECT {lead}any_value(beta) AS beta, count(*) AS n, count(DISTINCT firm_id) AS n_firms, {levels} + {extra_k + len(controls)} AS k FROM e {group}),
{", ".join(ctes)}
SELECT {lead}round(beta, 6) AS beta, round(sqrt({var}), 6) AS se, n, n_firms FROM b{joins}"""


def _fit(df, *keys):
    return df.select(*keys, r6("beta").alias("beta"), r6("se").alias("se"), "n", "n_firms")


@query("ols_fe", _ols_sql())
def ols_fe(spark, sf):
    return _fit(inference.ols_fe(_sample(spark, sf)))


@query("ols_plain", _ols_sql(fixed=""))
def ols_plain(spark, sf):
    return _fit(inference.ols_fe(_sample(spark, sf), fixed=None))


@query("ols_control", _ols_sql(controls=("log_commitment",)))
def ols_control(spark, sf):
    return _fit(inference.ols_fe(_sample(spark, sf, controls=("log_commitment",)), controls=("log_commitment",)))


_CONTROLS = ("log_commitment", "sequence", "vintage_gap")


@query("ols_controls", _ols_sql(controls=_CONTROLS[:2]))
def ols_controls(spark, sf):
    """Fund size and place in the series together."""
    return _fit(inference.ols_fe(_sample(spark, sf, controls=_CONTROLS[:2]), controls=_CONTROLS[:2]))


@query("specification_rows_controls", _ols_sql(sample="(SELECT *, CASE WHEN vintage < 1995 THEN 'early' ELSE 'late' END AS spec FROM sample)", key="spec", clusters=("firm_id", "vintage"), controls=_CONTROLS))
def specification_rows_controls(spark, sf):
    """Three controls in each half of the vintages, both clusterings."""
    halves = _sample(spark, sf, controls=_CONTROLS).withColumn("spec", F.when(F.col("vintage") < 1995, "early").otherwise("late"))
    return _fit(inference.ols_fe(halves, keys=("spec",), clusters=("firm_id", "vintage"), controls=_CONTROLS), "spec")


@query("ols_two_way", _ols_sql(clusters=("firm_id", "vintage")))
def ols_two_way(spark, sf):
    return _fit(inference.ols_fe(_sample(spark, sf), clusters=("firm_id", "vintage")))


@query("clustered_t", _ols_sql(clusters=("sponsor_id",)))
def clustered_t(spark, sf):
    return _fit(inference.ols_fe(_sample(spark, sf), clusters=("sponsor_id",)))


_SPECS = "(SELECT *, unnest(list_filter(['1 all', CASE WHEN NOT not_meaningful THEN '2 mature' END, CASE WHEN NOT not_meaningful AND fund_number_gap = 1 THEN '3 adjacent' END, CASE WHEN vintage < 1998 THEN '4 early' END, CASE WHEN vintage >= 1998 THEN '5 late' END], lambda s: s IS NOT NULL)) AS spec FROM sample)"


def _specs(df):
    mature, adjacent, v = ~F.col("not_meaningful"), F.col("fund_number_gap") == 1, F.col("vintage")
    labels = F.array_compact(F.array(F.lit("1 all"), F.when(mature, "2 mature"), F.when(mature & adjacent, "3 adjacent"), F.when(v < 1998, "4 early"), F.when(v >= 1998, "5 late")))
    return df.withColumn("spec", F.explode(labels))


@query("specification_rows", _ols_sql(sample=_SPECS, key="spec"))
def specification_rows(spark, sf):
    return _fit(inference.ols_fe(_specs(_sample(spark, sf)), keys=("spec",)), "spec")


@query("ci95", f"SELECT spec, beta, se, round(beta - 1.96 * se, 4) AS low, round(beta + 1.96 * se, 4) AS high, round(beta - 1.96 * se, 4) <= 0 AND round(beta + 1.96 * se, 4) >= 0 AS includes_zero FROM ({_ols_sql(sample=_SPECS, key='spec').replace('WITH m AS', 'WITH m AS')})")
def ci95(spark, sf):
    fit = specification_rows(spark, sf).select("spec", "beta", "se").withColumn("low", F.round(F.col("beta") - 1.96 * F.col("se"), 4)).withColumn("high", F.round(F.col("beta") + 1.96 * F.col("se"), 4))
    return fit.withColumn("includes_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


@query("sample_split_rows", _ols_sql(sample="(SELECT *, lag(y) OVER w AS y_lag FROM (SELECT *, ln(greatest(tvpi, 0.01)) AS y FROM plans) WINDOW w AS (PARTITION BY source, firm_id ORDER BY sequence, fund_id) QUALIFY lag(y) OVER w IS NOT NULL)", key="source"))
def sample_split_rows(spark, sf):
    # every plan's panel is rebuilt from its own rows
    p = V.plans(spark, sf)
    w = Window.partitionBy("source", "firm_id").orderBy("sequence", "fund_id")
    y = p.withColumn("y", F.ln(F.greatest("tvpi", F.lit(0.01))))
    return _fit(inference.ols_fe(y.withColumn("y_lag", F.lag("y").over(w)).filter("y_lag is not null"), keys=("source",)), "source")


@query("winsorise", "SELECT fund_id, round(least(greatest(y, lo), hi), 6) AS y, round(least(greatest(y_lag, lo), hi), 6) AS y_lag FROM sample, (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM (SELECT y AS v FROM sample UNION ALL SELECT y_lag FROM sample))")
def winsorise(spark, sf):
    return panel.winsorise(_sample(spark, sf), 0.01, 0.99).select("fund_id", r6("y").alias("y"), r6("y_lag").alias("y_lag"))


@query("robustness_rows", _ols_sql(sample="(SELECT * REPLACE (least(greatest(y, lo), hi) AS y, least(greatest(y_lag, lo), hi) AS y_lag) FROM sample, (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM (SELECT y AS v FROM sample UNION ALL SELECT y_lag FROM sample)))"))
def robustness_rows(spark, sf):
    return _fit(inference.ols_fe(panel.winsorise(_sample(spark, sf), 0.05, 0.95)))


_LOO = "WITH d AS (SELECT DISTINCT {by} AS dropped FROM sample), m AS (SELECT dropped, y - avg(y) OVER w AS dy, y_lag - avg(y_lag) OVER w AS dx FROM d JOIN sample ON {by} <> dropped WINDOW w AS (PARTITION BY dropped, vintage)) SELECT dropped, round(sum(dx * dy) / sum(dx * dx), 6) AS beta, count(*) AS n FROM m GROUP BY 1"


@query("leave_one_out", _LOO.format(by="vintage"))
def leave_one_out(spark, sf):
    return inference.leave_one_out(_sample(spark, sf), "vintage").select("dropped", r6("beta").alias("beta"), "n")


@query("leave_one_sponsor_out", _LOO.format(by="sponsor_id"))
def leave_one_sponsor_out(spark, sf):
    return inference.leave_one_out(_sample(spark, sf), "sponsor_id").select("dropped", r6("beta").alias("beta"), "n")


_ATT = "var_samp(a - b) / 2"


@query("attenuation", f"SELECT n_pairs, round(e, 8) AS var_error, round(v, 8) AS var_true, round(v / (v + e), 6) AS lambda, round(m, 6) AS mean_abs_diff, round(p, 6) AS median_pct_diff FROM (SELECT count(*) AS n_pairs, {_ATT} AS e, greatest(var_samp((a + b) / 2) - {_ATT} / 2, 0) AS v, avg(abs(a - b)) AS m, quantile_cont(abs(exp(a - b) - 1), 0.5) AS p FROM reports)")
def attenuation(spark, sf):
    out = inference.attenuation(V.reports(spark, sf))
    return out.select("n_pairs", r6("var_error", 8).alias("var_error"), r6("var_true", 8).alias("var_true"), r6("lambda").alias("lambda"), r6("mean_abs_diff").alias("mean_abs_diff"), r6("median_pct_diff").alias("median_pct_diff"))


# Over whole tables with 9999 draws SQL is too slow for these four; tests/test_whole.py and tests/test_resample.py have them against brute force.


@query("wild_cluster_bootstrap")
def wild_cluster_bootstrap(spark, sf):
    return inference.wild_cluster_bootstrap(_sample(spark, sf)).select(r6("beta").alias("beta"), r6("t").alias("t"), r6("p").alias("p"), "n_boot")


@query("spearman_within")
def spearman_within(spark, sf):
    return resample.spearman_within(_sample(spark, sf)).select(r6("rho").alias("rho"), r6("p").alias("p"), "n")


@query("transition_permutation_test")
def transition_permutation_test(spark, sf):
    return resample.transition_permutation(_sample(spark, sf)).select(r6("diagonal").alias("diagonal"), r6("null_diagonal").alias("null_diagonal"), r6("p").alias("p"), "n")


@query("bootstrap_lambda")
def bootstrap_lambda(spark, sf):
    return resample.bootstrap_lambda(V.reports(spark, sf)).select(r6("low").alias("low"), r6("high").alias("high"), "n_boot")


@query("overlap_keyed", f"SELECT count(*) AS n, round(corr(ln(a.tvpi), ln(b.tvpi)), 6) AS r FROM plans a JOIN plans b ON a.firm_id = b.firm_id AND a.fund_number = b.fund_number AND a.vintage = b.vintage WHERE a.source = '{V.A}' AND b.source = '{V.B}' AND a.tvpi > 0 AND b.tvpi > 0")
def overlap_keyed(spark, sf):
    p = V.plans(spark, sf).filter("tvpi > 0").select("firm_id", "fund_number", "vintage", "tvpi", "source")
    a, b = p.filter(F.col("source") == V.A), p.filter(F.col("source") == V.B).withColumnRenamed("tvpi", "tvpi_b")
    return a.join(b, ["firm_id", "fund_number", "vintage"]).agg(F.count("*").alias("n"), r6(F.corr(F.ln("tvpi"), F.ln("tvpi_b"))).alias("r"))


@query("interpolate_mde", "WITH g AS (SELECT o_custkey % 40 / 40 AS beta, avg((o_orderkey // 8 % 40 < o_custkey % 40)::INT) AS power FROM orders GROUP BY 1), s AS (SELECT beta, power, lag(beta) OVER (ORDER BY beta) AS b0, lag(power) OVER (ORDER BY beta) AS p0 FROM g) SELECT round(arg_min(CASE WHEN p0 IS NULL OR power = p0 THEN beta ELSE b0 + (0.8 - p0) * (beta - b0) / (power - p0) END, beta), 6) AS crossing FROM s WHERE power >= 0.8")
def interpolate_mde(spark, sf):
    """The shares of orders of forty slopes are the powers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 40
    grid = V.table(spark, sf, "orders").groupBy((c / 40).alias("beta")).agg(F.avg((F.floor(k / 8) % 40 < c).cast("int")).alias("power"))
    return inference.interpolate_crossing(grid).select(r6("crossing").alias("crossing"))


@query("beta_correction", f"SELECT round(f.beta / l.lambda, 6) AS corrected FROM ({_ols_sql()}) f, (SELECT v / (v + e) AS lambda FROM (SELECT {_ATT} AS e, greatest(var_samp((a + b) / 2) - {_ATT} / 2, 0) AS v FROM reports)) l")
def beta_correction(spark, sf):
    lam = inference.attenuation(V.reports(spark, sf)).select("lambda")
    return ols_fe(spark, sf).crossJoin(F.broadcast(lam)).select(r6(F.col("beta") / F.col("lambda")).alias("corrected"))


# ---- reviews, parsers, sources ---------------------------------------------


_STEM = r"trim(upper(trim(regexp_replace(regexp_replace(regexp_replace({}, '[,\.]', '', 'g'), '\s+(?:L\.?P\.?|LLC|Ltd|Fund|Partners)?\s*$', ''), '\s+(?:[IVXLC]+|\d+)\s*$', ''))))"
_ROMANS = repr([N.roman(n) for n in range(1, N.MAX_FUND_NUMBER + 1)])
_ORPHAN = r"coalesce(list_filter(regexp_split_to_array({}, '\s+')[2:], lambda t: list_contains(" + _ROMANS + r", split_part(t, '-', 1)) OR coalesce(try_cast(nullif(regexp_extract(split_part(t, '-', 1), '^\d{{1,9}}$'), '') AS INT) BETWEEN 1 AND 60, false))[1], '')"
_REVIEWED = f"(SELECT *, {_STEM.format('fund_name')} AS raw FROM (SELECT p_partkey AS fund_id, split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 9 = 0 THEN ' Growth' WHEN p_partkey % 14 = 0 THEN ' and' ELSE '' END || ' Partners ' || ({[N.roman(n) for n in range(1, 13)]!r})[p_partkey % 12 + 1] || ({list(V.SUFFIXES)!r})[p_partkey % 5 + 1] AS fund_name, p_partkey % 12 + 1 AS number, (1990 + p_size % 30)::INT AS vintage, CASE WHEN p_partkey % 3 = 0 THEN '{V.B}' ELSE '{V.A}' END AS source FROM part))"


def _reviewed(spark, sf):
    """Funds named by the first word of a part, so that families have several."""
    k = F.col("p_partkey")
    numeral = F.element_at(F.array(*(F.lit(N.roman(n)) for n in range(1, 13))), (k % 12 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, V.SUFFIXES)), (k % 5 + 1).cast("int"))
    middle = F.when(k % 9 == 0, " Growth").when(k % 14 == 0, " and").otherwise("")
    name = F.concat(F.split("p_name", " ")[0], middle, F.lit(" Partners "), numeral, suffix)
    one = V.table(spark, sf, "part").select(k.alias("fund_id"), name.alias("fund_name"), (F.lit(1990) + F.col("p_size") % 30).cast("int").alias("vintage"), F.when(k % 3 == 0, V.B).otherwise(V.A).alias("source"))
    return review.load_universe([one.filter(F.col("source") == V.A), one.filter(F.col("source") == V.B)])


@query("load_universe", f"SELECT raw, source, count(*) AS n FROM {_REVIEWED} GROUP BY 1, 2")
def load_universe(spark, sf):
    return _reviewed(spark, sf).groupBy(F.col("firm_id_raw").alias("raw"), "source").agg(F.count("*").alias("n"))


@query("family_review", f"""WITH f AS (SELECT *, CASE WHEN length(raw) % 4 = 0 THEN split_part(raw, ' ', 1) ELSE raw END AS final FROM {_REVIEWED}),
t AS (SELECT raw, bool_or(plans = 1 OR numbers > 1) AS clash FROM (SELECT raw, vintage, count(*) AS n, count(DISTINCT number) AS numbers, count(DISTINCT source) AS plans FROM f GROUP BY 1, 2) WHERE n > 1 GROUP BY 1),
s AS (SELECT DISTINCT raw FROM f), p AS (SELECT a.raw AS a, b.raw AS b FROM s a JOIN s b ON starts_with(b.raw, a.raw || ' ')),
near AS (SELECT a AS raw, string_agg(b, ' | ' ORDER BY b) AS near FROM (SELECT a, b FROM p UNION SELECT b, a FROM p) GROUP BY 1),
g AS (SELECT raw, string_agg(DISTINCT final, '|' ORDER BY final) AS final, count(*) AS n, count(DISTINCT upper(fund_name) LIKE '%GROWTH%') AS sidecars, string_agg(vintage::VARCHAR, ';' ORDER BY vintage, fund_name) AS vintages, string_agg(fund_name, ' | ' ORDER BY vintage, fund_name) AS fund_names FROM f GROUP BY 1),
o AS (SELECT g.*, t.clash, coalesce(near.near, '') AS near, {_ORPHAN.format('g.raw')} AS orphan, coalesce(z.n, 0) AS n_final FROM g LEFT JOIN t USING (raw) LEFT JOIN near USING (raw) LEFT JOIN (SELECT final, count(*) AS n FROM f GROUP BY 1) z ON z.final = g.final),
x AS (SELECT *, array_to_string(list_filter([CASE WHEN sidecars > 1 THEN '{review.SIDECAR}' END, CASE WHEN orphan <> '' THEN replace('{review.STRANDED.replace("'", "''")}', '%s', orphan) END, CASE WHEN regexp_matches(raw, '(?:[-&/]|\\bNO|\\bTHE|\\bAND|\\bOF)\\s*$') THEN '{review.DANGLING}' END, CASE WHEN orphan <> '' AND near <> '' THEN '{review.SIBLING}' END, CASE WHEN clash THEN '{review.CLASH}' WHEN clash IS NOT NULL THEN '{review.DUPLICATE}' END], lambda s: s IS NOT NULL), ' ; ') AS flags, CASE WHEN length(raw) % 3 = 0 THEN 'keep_separate' ELSE 'unreviewed' END AS decision FROM o)
SELECT raw AS firm_id_raw, final AS firm_id_final, n AS n_funds_raw, vintages, fund_names, orphan AS orphan_number, near AS neighbour_stems, flags, decision, CASE WHEN length(raw) % 3 = 0 THEN 'checked' ELSE '' END AS reason, n_final AS n_funds_final, decision = 'unreviewed' AND flags <> '' AS needs_review FROM x""")
def family_review(spark, sf):
    raw = F.col("firm_id_raw")
    f = _reviewed(spark, sf).withColumn("firm_id", F.when(F.length(raw) % 4 == 0, F.split(raw, " ")[0]).otherwise(raw))
    overrides = f.filter(F.length(raw) % 3 == 0).select("firm_id_raw").distinct().select("firm_id_raw", F.lit("keep_separate").alias("decision"), F.lit("checked").alias("reason"))
    return review.family_review(f, overrides)


@query("numeral_diagnostic", f"""WITH f AS (SELECT source, fund_name, raw AS stem, regexp_replace(fund_name, '[,\\.]', '', 'g') AS plain, {_ORPHAN.format('raw')} AS orphan FROM {_REVIEWED}),
t AS (SELECT *, CASE WHEN starts_with(upper(trim(plain)), stem) THEN trim(substr(upper(trim(plain)), length(stem) + 1)) ELSE '' END AS tail FROM f WHERE orphan <> '')
SELECT source, fund_name, stem, tail AS removed_tail, orphan AS stranded_number, CASE WHEN trim(regexp_replace(tail, '\\b(?:LP|LLC|LTD)\\b', '', 'g')) IN ('I', 'V', 'X', 'L', 'C') THEN 'CONSUMED+STRANDED' ELSE 'STRANDED' END AS failure FROM t""")
def numeral_diagnostic(spark, sf):
    return review.diagnose_names(_reviewed(spark, sf))


@query("calpers_as_of", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate::DATE END AS as_of FROM orders")
def calpers_as_of(spark, sf):
    d = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 6 > 0, F.concat(F.lit("<p>Performance as of "), F.date_format(d, "MMMM d, yyyy"), F.lit("</p>"))).otherwise("<p>as of today</p>")
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), P.banner_date(text).alias("as_of"))


def _report_lines(spark, sf):
    k = F.col("o_orderkey")
    money = lambda m: F.concat(F.lit("$"), (k % m).cast("string"), F.lit(".5"))
    star = F.when(k % 4 == 0, "* ").otherwise("")
    nav = F.when(k % 3 == 0, F.concat(F.lit("("), money(11), F.lit(")"))).otherwise(money(11))
    tail = F.when(k % 5 == 0, " n.m.").otherwise(F.concat(F.lit(" 1."), (k % 10).cast("string"), F.lit("x "), (k % 30).cast("string"), F.lit(".5%")))
    line = F.when(k % 50 == 0, "Total partnerships $1").otherwise(F.concat(star, F.year("o_orderdate").cast("string"), F.lit(" Fund "), k.cast("string"), F.lit(" "), money(97), F.lit(" "), money(89), F.lit(" "), money(83), F.lit(" "), nav, tail))
    return V.table(spark, sf, "orders").select(line.alias("line"), k.alias("line_no"))


@query("oregon_parse_lines", """SELECT 'OPERF::Fund ' || o_orderkey AS fund_id, year(o_orderdate)::INT AS vintage, round((o_orderkey % 97 + 0.5) * 1e6, 6) AS commitment, round((CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 11 + 0.5) * 1e6, 6) AS nav,
  CASE WHEN o_orderkey % 5 > 0 THEN round(1 + o_orderkey % 10 / 10, 6) END AS multiple, CASE WHEN o_orderkey % 5 > 0 THEN round((o_orderkey % 30 + 0.5) / 100, 6) END AS irr, o_orderkey % 5 = 0 AS not_meaningful, o_orderkey % 4 = 0 AS sold_secondary FROM orders WHERE o_orderkey % 50 > 0""")
def oregon_parse_lines(spark, sf):
    out = disclosures.report_lines(_report_lines(spark, sf))
    return out.select("fund_id", "vintage", r6("commitment").alias("commitment"), r6("nav").alias("nav"), r6("reported_multiple").alias("multiple"), r6("net_irr").alias("irr"), "not_meaningful", "sold_secondary")


@query("oregon_as_of", "SELECT o_custkey AS path, arg_min(o_orderdate, o_orderkey) FILTER (o_orderkey % 3 > 0)::DATE AS as_of FROM orders GROUP BY 1")
def oregon_as_of(spark, sf):
    """Reports of a few lines, some of which have dates."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "MMMM d, yyyy")
    said = F.when(k % 3 == 0, "As of sometime").otherwise(F.concat(F.lit("As of "), d))
    return disclosures.report_as_of(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), k.alias("line_no"), said.alias("line")), key="path")


@query("calpers_parse", """SELECT 'CALPERS::Fund ' || o_orderkey AS fund_id, year(o_orderdate)::INT AS vintage, (o_orderkey % 900 + 100)::DOUBLE AS contributions, (o_orderkey % 700)::DOUBLE AS distributions, (o_orderkey % 700 + o_orderkey % 300)::DOUBLE AS total_value, (o_orderkey % 300)::DOUBLE AS nav,
  round((o_orderkey % 700 + o_orderkey % 300) / (o_orderkey % 900 + 100), 6) AS tvpi_reported, CASE WHEN o_orderkey % 8 > 0 THEN round((o_orderkey % 40 - 10 + 0.0) / 100, 6) END AS net_irr, o_orderkey % 8 = 0 AS not_meaningful FROM orders WHERE o_orderkey % 60 > 0 AND o_orderkey % 61 > 0""")
def calpers_parse(spark, sf):
    k = F.col("o_orderkey")
    usd = lambda c: F.concat(F.lit("$"), c.cast("string"))
    raw = V.table(spark, sf, "orders").select(
        F.when(k % 60 == 0, "Fund").otherwise(F.concat(F.lit(" Fund "), k.cast("string"))).alias("Fund"),
        F.year("o_orderdate").cast("string").alias("Vintage Year"),
        usd(k).alias("Capital Committed"),
        F.when(k % 61 == 0, "-").otherwise(usd(k % 900 + 100)).alias("Cash In"),
        usd(k % 700).alias("Cash Out"),
        usd(k % 700 + k % 300).alias("Cash Out & Remaining Value"),
        F.when(k % 8 == 0, "N/M 1").otherwise(F.concat((k % 40 - 10).cast("string"), F.lit(".0%  1"))).alias("Net IRR"),
        F.lit("1.0x").alias("Investment Multiple"),
    )
    out = disclosures.calpers_parse(raw)
    return out.select("fund_id", "vintage", "contributions", "distributions", "total_value", "nav", r6("tvpi_reported").alias("tvpi_reported"), r6("net_irr").alias("net_irr"), "not_meaningful")


@query("discover_links", """WITH l AS (SELECT DISTINCT CASE o_orderkey % 5 WHEN 0 THEN printf('/x/%d/OPERF-Private-Equity-Portfolio-Quarter-%d-%d.pdf', y + 1, q, y) WHEN 1 THEN printf('/x/PrivateEquity-Q%d-%d.PDF', q, y) WHEN 2 THEN printf('/x/OPERF_Private_Equity_Portfolio_-_Quarter_%d_%d.pdf', q, y) END AS href, y::INT AS year, q::INT AS quarter FROM (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders) WHERE o_orderkey % 5 < 3)
SELECT 'https://www.oregon.gov' || href AS url, split_part(href, '/', -1) AS file, year, quarter FROM l""")
def discover_links(spark, sf):
    """Pages link to reports under three names, to another asset's report and to a file without a quarter."""
    k, y, q = F.col("o_orderkey"), F.year("o_orderdate"), F.quarter("o_orderdate")
    href = F.when(k % 5 == 0, F.format_string("/x/%d/OPERF-Private-Equity-Portfolio-Quarter-%d-%d.pdf", y + 1, q, y)).when(k % 5 == 1, F.format_string("/x/PrivateEquity-Q%d-%d.PDF", q, y)).when(k % 5 == 2, F.format_string("/x/OPERF_Private_Equity_Portfolio_-_Quarter_%d_%d.pdf", q, y)).when(k % 5 == 3, F.format_string("/x/Fixed-Income-Quarter-%d-%d.pdf", q, y)).otherwise("/x/private-equity-notes.pdf")
    return disclosures.report_links(V.table(spark, sf, "orders").select(F.concat(F.lit('<p><a href="'), href, F.lit('">report</a>')).alias("html")))


@query("calpers_load", "SELECT 'CALPERS::' || p_name AS fund_id, 2001 AS vintage, (p_size + 1)::DOUBLE AS contributions, p_size::DOUBLE AS distributions, make_date((2000 + p_partkey % 20)::INT, 6, 30) AS as_of FROM part")
def calpers_load(spark, sf):
    """Pages with a small table before the large one, each with its own date."""
    p = V.table(spark, sf, "part")
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("p_name")), cell(F.lit("2001")), cell(F.lit("$9")), cell(F.col("p_size") + 1), cell(F.col("p_size")), cell(F.col("p_size") * 2), cell(F.lit("N/M")), cell(F.lit("1.0x")), F.lit("</tr>"))
    banner = F.concat(F.lit("<p>As of June 30, "), (2000 + F.col("p_partkey") % 20).cast("string"), F.lit("</p>"))
    head = "<table><tr><td>x</td></tr></table><table><tr>" + "".join(f"<th>{c.replace('&', '&amp;')}</th>" for c in disclosures.CALPERS_COLUMNS) + "</tr>"
    page = p.groupBy(F.col("p_partkey").alias("path")).agg(F.concat(F.max(banner), F.lit(head), F.max(row), F.lit("</table>")).alias("html"))
    return disclosures.calpers_load(page).select("fund_id", "vintage", "contributions", "distributions", "as_of")


#: Lines of one report.
_REPORT = 4096


@query("oregon_load", f"SELECT 'OPERF::Fund ' || o_orderkey AS fund_id, year(o_orderdate)::INT AS vintage, o_orderkey % 5 = 0 AS not_meaningful, make_date((2000 + o_orderkey // {_REPORT} % 20)::INT, 3, 31) AS as_of FROM orders WHERE o_orderkey % 50 > 0")
def oregon_load(spark, sf):
    """Reports' texts are written, a file for each range of orders, and read in one go; each file has its own date."""
    path = readers.scratch_dir(spark, "report")
    lines = _report_lines(spark, sf).select(F.floor(F.col("line_no") / _REPORT).alias("report"), "line_no", F.col("line").alias("value"))
    day = F.concat(F.lit("As of March 31, "), (2000 + F.col("report") % 20).cast("string"))
    heads = lines.select("report").distinct().select("report", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("line_no"), F.lit("Private equity").alias("value")), F.struct(F.lit(-1).cast("long").alias("line_no"), day.alias("value")))).alias("e")).select("report", "e.*")
    lines.unionByName(heads).repartition("report").sortWithinPartitions("report", "line_no").select("report", "value").write.partitionBy("report").text(path)
    return disclosures.oregon_load(spark, f"{path}/report=*").select("fund_id", "vintage", "not_meaningful", "as_of")


@query("pdf_lines", f"SELECT o_orderkey // {_REPORT} AS report, count(*) AS lines, sum(o_orderkey) AS total, (max(n) + max(n) // 50)::INT AS last, (max(n) // 50)::INT AS page FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // {_REPORT} ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1")
def pdf_lines(spark, sf):
    """Orders' keys as the lines of reports of fifty lines a page; numbers and pages are each report's own."""
    path = readers.scratch_dir(spark, "pages")
    k = F.col("o_orderkey")
    keyed = V.table(spark, sf, "orders").select(F.floor(k / _REPORT).alias("report"), k.alias("k"))
    nth = F.row_number().over(Window.partitionBy("report").orderBy("k")) - 1
    feed = F.when((nth > 0) & (nth % 50 == 0), "\f").otherwise("")
    # a feed is written at the end of the line before, and ends one of its own
    lines = keyed.withColumn("_feed", feed).withColumn("value", F.concat(F.col("k").cast("string"), F.coalesce(F.lead("_feed").over(Window.partitionBy("report").orderBy("k")), F.lit(""))))
    lines.sortWithinPartitions("report", "k").select("report", "value").write.partitionBy("report").text(path)
    read = disclosures.pdf_lines(spark, f"{path}/report=*").filter("line <> ''")
    report = F.regexp_extract("path", r"report=(\d+)", 1).cast("long")
    return read.groupBy(report.alias("report")).agg(F.count("*").alias("lines"), F.sum(F.col("line").cast("long")).alias("total"), F.max("line_no").alias("last"), F.max("page").alias("page"))


@query("quarter_url", f"SELECT o_orderkey AS k, printf('{disclosures.OREGON_URL}', year(o_orderdate), quarter(o_orderdate), year(o_orderdate)) AS url FROM orders")
def quarter_url(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), disclosures.quarter_url(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("url"))


_FACTORS = "SELECT o_orderkey AS k, last_day(o_orderdate::DATE) AS date, CASE WHEN o_orderkey % 7 > 0 THEN round((o_orderkey % 9 - 4) / 100, 6) END AS mkt_rf, CASE WHEN o_orderkey % 11 > 0 THEN round(0.1 / 100, 6) END AS rf FROM orders"


def _factor_lines(spark, sf):
    """A line of factors for each order, among prose and annual figures."""
    k = F.col("o_orderkey")
    monthly = F.concat_ws(",", F.date_format("o_orderdate", "yyyyMM"), F.when(k % 7 == 0, "-99.99").otherwise(F.concat((k % 9 - 4).cast("string"), F.lit(".0"))), F.lit(" 1.0"), F.lit("0.5"), F.when(k % 11 == 0, "-999").otherwise("0.1"))
    annual = F.concat_ws(",", F.year("o_orderdate").cast("string"), F.lit("1.0"), F.lit("1.0"), F.lit("1.0"), F.lit("1.0"))
    lines = F.array(monthly, annual, F.lit("This file was made from prices"), F.lit(",Mkt-RF,SMB,HML,RF"), F.lit(""))
    return V.table(spark, sf, "orders").select(F.explode(lines).alias("value"))


@query("factor_scan", f"SELECT date, mkt_rf, rf, count(*) AS n FROM ({_FACTORS}) GROUP BY ALL")
def factor_scan(spark, sf):
    return disclosures.factors(_factor_lines(spark, sf)).groupBy("date", r6("mkt_rf").alias("mkt_rf"), r6("rf").alias("rf")).agg(F.count("*").alias("n"))


@query("missing_guard", f"SELECT year(date)::INT AS year, count(*) AS n, count(*) FILTER (mkt_rf IS NULL OR rf IS NULL) AS missing, min(date) FILTER (mkt_rf IS NULL OR rf IS NULL) AS first FROM ({_FACTORS}) GROUP BY 1")
def missing_guard(spark, sf):
    """The months at which an index would have a hole, by year."""
    rows = disclosures.factors(_factor_lines(spark, sf)).withColumn("year", F.year("date"))
    return cashflow.first_missing(rows, ("mkt_rf", "rf"), keys=("year",))


def _scanned(p):
    page = F.concat(F.lit("<table><tr><td>x</td></tr></table><table class='w'><tr><th>Name</th><th>Size</th></tr><tr><td> <b>"), "p_name", F.lit("</b></td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    rows = disclosures.widest_table(disclosures.html_tables(p.select(F.col("p_partkey").alias("path"), page.alias("html"))))
    return rows.filter("row > 0").select("path", "row", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("size"))


@query("html_table_scan", "SELECT p_partkey AS path, 1 AS \"row\", p_name AS name, p_size::VARCHAR AS size FROM part")
def html_table_scan(spark, sf):
    return _scanned(V.table(spark, sf, "part"))


@query("manifest_source_as_of", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'CalPERS PEP' WHEN 1 THEN 'Oregon PERS OPERF' ELSE '' END AS source, CASE o_orderkey % 3 WHEN 0 THEN (o_orderdate::DATE)::VARCHAR WHEN 1 THEN last_day(make_date(year(o_orderdate)::INT, (quarter(o_orderdate) * 3)::INT, 1))::VARCHAR ELSE '' END AS as_of FROM orders")
def manifest_source_as_of(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    name = F.when(k % 3 == 0, F.concat(F.lit("calpers_"), d.cast("string"), F.lit(".csv"))).when(k % 3 == 1, F.concat(F.lit("oregon_"), F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"), F.lit(".pdf"))).otherwise("other.txt")
    return V.table(spark, sf, "orders").select(k.alias("k"), manifest.file_source(name).alias("source"), manifest.file_as_of(name).alias("as_of"))


@query("compare_manifests", "SELECT coalesce(a.k, b.k)::VARCHAR AS file, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'untracked' ELSE 'changed' END AS state FROM (SELECT p_partkey AS k, p_size AS h FROM part WHERE p_partkey % 3 > 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS h FROM part WHERE p_partkey % 4 > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h")
def compare_manifests(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size")
    a = p.filter("k % 3 > 0").select(F.col("k").cast("string").alias("file"), F.col("p_size").cast("string").alias("sha256"))
    b = p.filter("k % 4 > 0").select(F.col("k").cast("string").alias("file"), F.when(F.col("k") % 5 == 0, "-1").otherwise(F.col("p_size").cast("string")).alias("sha256"))
    return manifest.compare(a, b)


@query("resolve_families", "SELECT source, count(*) AS n, count(DISTINCT firm_id) AS firms FROM (SELECT firm_id, fund_number, source FROM (SELECT *, min(source) OVER (PARTITION BY firm_id, fund_number) AS best FROM plans WHERE fund_number IS NOT NULL) WHERE source = best GROUP BY ALL UNION ALL SELECT firm_id, fund_number, source FROM plans WHERE fund_number IS NULL) GROUP BY 1")
def resolve_families(spark, sf):
    pooled = entity.share_class_rollup(entity.pool_plans(V.plans(spark, sf), (V.A, V.B)))
    return pooled.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("firm_id").alias("firms"))


# ---- simulation ------------------------------------------------------------


@query("simulate")
def simulate_universe(spark, sf):
    out = simulate.simulate(spark, simulate.Universe(firms=60))
    return out.select("firm_id", "fund_id", "sequence", "vintage", r6("commitment").alias("commitment"), r6("tvpi").alias("tvpi"), F.size("flows").alias("n_flows"))


@query("sim_validation")
def sim_validation(spark, sf):
    """Estimated against true slope for the reference's six skill settings."""
    worlds = [simulate.Universe(firms=260, skill_sd=x, idio_sd=0.34, threshold=0.0) for x in (0.0, 0.08, 0.14, 0.18, 0.24, 0.30)]
    # firms of different settings are different families
    funds = [simulate.simulate(spark, u).drop("flows").withColumns({"firm_id": F.col("firm_id") + i * u.firms, "skill_sd": F.lit(u.skill_sd), "true_beta": F.lit(round(u.true_beta, 6))}) for i, u in enumerate(worlds)]
    sample = panel.estimation_sample(panel.build_panel(functools.reduce(DataFrame.unionByName, funds)))
    return inference.ols_fe(sample, keys=("skill_sd", "true_beta")).select("skill_sd", "true_beta", r6("beta").alias("beta"), r6("se").alias("se"), "n")


@query("sim_index", f"""WITH u AS (SELECT i, (('0x' || substr(md5('{simulate.Universe.seed}|r|' || i), 1, 12))::BIGINT + 0.5) / 281474976710656 AS r, (('0x' || substr(md5('{simulate.Universe.seed}|a|' || i), 1, 12))::BIGINT + 0.5) / 281474976710656 AS a FROM range(0, 140) t(i))
SELECT last_day(DATE '1995-03-31' + to_months((3 * i)::INT)) AS date, round(100 * exp(sum((0.085 - 0.5 * 0.16 * 0.16) / 4 + 0.08 * sqrt(-2 * ln(r)) * cos(2 * pi() * a)) OVER (ORDER BY i)), 6) AS level FROM u""")
def sim_index(spark, sf):
    return simulate.index_path(spark).select("date", r6("level").alias("level"))


@query("displace", "SELECT shift, n FROM (SELECT CASE WHEN u < 25 THEN 0 WHEN u < 39 THEN 1 ELSE 2 END AS shift, count(*) AS n FROM (SELECT ('0x' || substr(md5('11|' || fund_id), 1, 8))::BIGINT % 43 AS u FROM funds) GROUP BY 1)")
def displace(spark, sf):
    f = V.funds(spark, sf).withColumn("before", F.col("vintage"))
    return simulate.displaced(f).groupBy((F.col("vintage") - F.col("before")).alias("shift")).agg(F.count("*").alias("n"))


@query("power_at")
def power_at(spark, sf):
    """Power of the wild cluster bootstrap over the reference's grid, for both clusterings of the whole sample."""
    # the sample is built once
    path = readers.scratch_dir(spark, "sample")
    _sample(spark, sf).select("y", "y_lag", "vintage", "firm_id", "sponsor_id").write.parquet(path)
    s = spark.read.parquet(path)
    by = [inference.power_at(s, [i / 10 for i in range(9)], cluster=c).withColumn("clustered_on", F.lit(c)) for c in ("firm_id", "sponsor_id")]
    return by[0].unionByName(by[1]).select("clustered_on", "true_beta", r6("power").alias("power"), "n")
