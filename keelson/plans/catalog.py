"""Registered queries: relational core, names, parsers, windows and aggregates, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import numbers as M
from ..functions import parsing as P
from ..operators import entity, panel, ranks
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = V.with_views(sql)
        return fn

    return register


def r6(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---- projections and scalar functions --------------------------------------


@query("rename", "SELECT o_orderkey AS fund_id, o_totalprice AS commitment FROM orders")
def rename(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").withColumnsRenamed({"o_orderkey": "fund_id", "o_totalprice": "commitment"})


@query("namespaced_id", "SELECT 'OPERF::' || p_name AS fund_id, p_partkey AS k FROM part")
def namespaced_id(spark, sf):
    return V.table(spark, sf, "part").select(F.concat(F.lit("OPERF::"), "p_name").alias("fund_id"), F.col("p_partkey").alias("k"))


@query("nav_from_totals", "SELECT fund_id, round(total_value - distributions, 6) AS nav FROM snap")
def nav_from_totals(spark, sf):
    return V.snap(spark, sf).select("fund_id", r6(F.col("total_value") - F.col("distributions")).alias("nav"))


@query("total_from_parts", "SELECT fund_id, round(distributions + nav, 6) AS total_value FROM snap")
def total_from_parts(spark, sf):
    return V.snap(spark, sf).select("fund_id", r6(F.col("distributions") + F.col("nav")).alias("total_value"))


@query("tvpi_reported", "SELECT fund_id, round(total_value / nullif(CASE WHEN fund_id % 9 = 0 THEN 0 ELSE contributions END, 0), 6) AS tvpi_reported FROM snap")
def tvpi_reported(spark, sf):
    paid = F.when(F.col("fund_id") % 9 == 0, 0.0).otherwise(F.col("contributions"))
    return V.snap(spark, sf).select("fund_id", r6(M.ratio(F.col("total_value"), paid)).alias("tvpi_reported"))


@query("tvpi_panel", "SELECT fund_id, round(total_value / contributions, 6) AS tvpi FROM snap WHERE contributions > 0")
def tvpi_panel(spark, sf):
    return V.snap(spark, sf).filter("contributions > 0").select("fund_id", r6(F.col("total_value") / F.col("contributions")).alias("tvpi")).filter("tvpi is not null")


@query("unit_scale", "SELECT fund_id, round(commitment * 1e6, 0) AS dollars FROM funds")
def unit_scale(spark, sf):
    return V.funds(spark, sf).select("fund_id", r6(F.col("commitment") * 1e6, 0).alias("dollars"))


@query("flags_validate", """SELECT fund_id, contributions <= 0 AS zero_paid_in, nav < 0 AS negative_nav, coalesce(contributions / nullif(commitment, 0) < 0.1, false) AS unfunded,
  vintage > (SELECT year(max(as_of)) FROM snap) - 5 AS young FROM snap""")
def flags_validate(spark, sf):
    return entity.validity_flags(V.snap(spark, sf)).select("fund_id", "zero_paid_in", "negative_nav", "unfunded", "young")


@query("fully_uncalled", "SELECT fund_id, as_of, contributions <= 0 AS fully_uncalled FROM snapshots")
def fully_uncalled(spark, sf):
    return V.snapshots(spark, sf).select("fund_id", "as_of", (F.col("contributions") <= 0).alias("fully_uncalled"))


@query("log_perf", "SELECT fund_id, round(CASE WHEN fund_id % 5 > 0 THEN ln(greatest(tvpi - 1, 0.01)) END, 6) AS y FROM snap")
def log_perf(spark, sf):
    return V.snap(spark, sf).select("fund_id", r6(M.log_performance(F.when(F.col("fund_id") % 5 > 0, F.col("tvpi") - 1))).alias("y"))


@query("log_commitment", "SELECT fund_id, round(ln(commitment), 6) AS log_commitment FROM funds WHERE commitment > 0")
def log_commitment(spark, sf):
    return V.funds(spark, sf).filter("commitment > 0").select("fund_id", r6(F.ln("commitment")).alias("log_commitment"))


@query("decade", "SELECT (vintage // 10 * 10)::INT AS decade, count(*) AS n FROM funds GROUP BY 1")
def decade(spark, sf):
    return V.funds(spark, sf).groupBy((F.floor(F.col("vintage") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@query("unrealised_share", "SELECT fund_id, round(nav / nullif(nav + distributions, 0), 6) AS share FROM snap")
def unrealised_share(spark, sf):
    return V.snap(spark, sf).select("fund_id", r6(M.ratio(F.col("nav"), F.col("nav") + F.col("distributions"))).alias("share"))


@query("dpi_snapshot", "SELECT fund_id, as_of, round(distributions / nullif(contributions, 0), 6) AS dpi FROM snapshots")
def dpi_snapshot(spark, sf):
    return V.snapshots(spark, sf).select("fund_id", "as_of", r6(M.ratio(F.col("distributions"), F.col("contributions"))).alias("dpi"))


@query("pct_diff", "SELECT fund_id, round(abs(exp(a - b) - 1), 6) AS pct FROM reports")
def pct_diff(spark, sf):
    return V.reports(spark, sf).select("fund_id", r6(F.abs(F.expm1(F.col("a") - F.col("b")))).alias("pct"))


@query("family_stem", r"""SELECT fund_id, upper(trim(regexp_replace(regexp_replace(regexp_replace(fund_name, '[,\.]', '', 'g'), '\s+(?:L\.?P\.?|LLC|Ltd|Fund|Partners)?\s*$', ''), '\s+(?:[IVXLC]+|\d+)\s*$', ''))) AS stem FROM names""")
def family_stem(spark, sf):
    return V.names(spark, sf).select("fund_id", N.family_stem(F.col("fund_name")).alias("stem"))


_ROMANS = repr([N.roman(n) for n in range(1, 61)])
_TOKENS = rf"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(upper(fund_name), '(?i){N.ENTITY_WORDS}', ' ', 'g'), '[^\pL\pN_\s-]', ' ', 'g'), '\s+'), lambda t: t <> '')[2:]"""
_VALUE = rf"""CASE WHEN regexp_full_match(split_part(t, '-', 1), '\d{{1,9}}') THEN CASE WHEN try_cast(split_part(t, '-', 1) AS INT) BETWEEN 1 AND 60 THEN try_cast(split_part(t, '-', 1) AS INT) END ELSE nullif(coalesce(list_position({_ROMANS}, split_part(t, '-', 1)), 0), 0) END"""


@query("fund_number", f"SELECT fund_id, list_filter(list_transform({_TOKENS}, lambda t: {_VALUE}), lambda v: v IS NOT NULL)[1]::INT AS number FROM names")
def fund_number(spark, sf):
    return V.names(spark, sf).select("fund_id", N.fund_number(F.col("fund_name")).alias("number"))


@query("stranded_number", f"SELECT fund_id, coalesce(split_part(list_filter({_TOKENS}, lambda t: ({_VALUE}) IS NOT NULL)[1], '-', 1), '') AS token FROM names")
def stranded_number(spark, sf):
    return V.names(spark, sf).select("fund_id", N.stranded_number(F.col("fund_name")).alias("token"))


@query("roman_to_int", f"SELECT fund_id, numeral, CASE WHEN list_contains({_ROMANS}, numeral) THEN list_position({_ROMANS}, numeral)::INT END AS value FROM (SELECT p_partkey AS fund_id, CASE WHEN p_partkey % 5 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE ({_ROMANS})[p_partkey % 60 + 1] END AS numeral FROM part)")
def roman_to_int(spark, sf):
    """Numerals of all funds, and words that are none."""
    k, numerals = F.col("p_partkey"), F.array(*(F.lit(N.roman(n)) for n in range(1, 61)))
    numeral = F.when(k % 5 == 0, F.upper(F.split("p_name", " ")[0])).otherwise(F.element_at(numerals, (k % 60 + 1).cast("int")))
    return V.table(spark, sf, "part").select(k.alias("fund_id"), numeral.alias("numeral")).withColumn("value", N.roman_value(F.col("numeral")))


@query("sponsor_token", """WITH s AS (SELECT fund_id, CASE WHEN fund_id % 3 = 0 THEN 'THE ' || upper(fund_name) ELSE upper(fund_name) END AS family FROM names)
SELECT fund_id, CASE WHEN split_part(family, ' ', 1) = 'THE' AND split_part(family, ' ', 2) <> '' THEN split_part(family, ' ', 2) ELSE split_part(family, ' ', 1) END AS sponsor FROM s""")
def sponsor_token(spark, sf):
    family = F.when(F.col("fund_id") % 3 == 0, F.concat(F.lit("THE "), F.upper("fund_name"))).otherwise(F.upper("fund_name"))
    return V.names(spark, sf).select("fund_id", N.sponsor_token(family).alias("sponsor"))


@query("removed_tail", r"""WITH s AS (SELECT fund_id, upper(trim(regexp_replace(fund_name, '[,\.]', '', 'g'))) AS whole, upper(trim(regexp_replace(regexp_replace(regexp_replace(fund_name, '[,\.]', '', 'g'), '\s+(?:L\.?P\.?|LLC|Ltd|Fund|Partners)?\s*$', ''), '\s+(?:[IVXLC]+|\d+)\s*$', ''))) AS stem FROM names)
SELECT fund_id, CASE WHEN starts_with(whole, stem) THEN trim(substr(whole, length(stem) + 1)) ELSE '' END AS tail FROM s""")
def removed_tail(spark, sf):
    return V.names(spark, sf).select("fund_id", N.removed_tail(F.col("fund_name")).alias("tail"))


@query("money_us", r"""SELECT o_orderkey AS k, try_cast(regexp_replace(CASE WHEN o_orderkey % 10 = 0 THEN '-' WHEN o_orderkey % 10 = 1 THEN 'N/A' ELSE '$' || o_orderkey || ',' || (100 + o_orderkey % 900) || ' ' END, '[\$,\s]', '', 'g') AS DOUBLE) AS money FROM orders""")
def money_us(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 0, "-").when(k % 10 == 1, "N/A").otherwise(F.concat(F.lit("$"), k.cast("string"), F.lit(","), (k % 900 + 100).cast("string"), F.lit(" ")))
    return V.table(spark, sf, "orders").select(k.alias("k"), P.money_us(text).alias("money"))


@query("money_paren", r"""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN -1 WHEN 1 THEN -1 ELSE 1 END * CASE WHEN o_orderkey % 4 < 3 THEN (o_orderkey || '.5')::DOUBLE END AS money FROM orders""")
def money_paren(spark, sf):
    k = F.col("o_orderkey")
    amount = F.concat(F.lit("$"), k.cast("string"), F.lit(".5"))
    text = F.when(k % 4 == 0, F.concat(F.lit("("), amount, F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("-"), amount)).when(k % 4 == 2, amount).otherwise("n.a")
    return V.table(spark, sf, "orders").select(k.alias("k"), P.money_paren(text).alias("money"))


@query("percent", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN round(((o_orderkey % 400 - 100) || '.' || o_orderkey % 10)::DOUBLE / 100, 6) END AS pct FROM orders""")
def percent(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 5 > 0, F.concat((k % 400 - 100).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("%  1"))).otherwise("N/M 1")
    return V.table(spark, sf, "orders").select(k.alias("k"), r6(P.percent(text)).alias("pct"))


@query("month_end", "SELECT o_orderkey AS k, last_day(o_orderdate::DATE) AS month_end, last_day(make_date(year(o_orderdate)::INT, (quarter(o_orderdate) * 3)::INT, 1)) AS quarter_end, round(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 365.25, 6) AS years FROM orders")
def month_end(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.last_day(d).alias("month_end"), P.quarter_end(F.year(d), F.quarter(d)).alias("quarter_end"), r6(P.years_between(F.lit("1995-01-01").cast("date"), d)).alias("years"))


@query("string_agg", "SELECT n_regionkey, string_agg(n_name, ' | ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def string_agg(spark, sf):
    return V.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " | ").alias("names"))


@query("coalesce_flag", "SELECT fund_id, coalesce(sold_secondary, false) AS sold FROM funds")
def coalesce_flag(spark, sf):
    return V.funds(spark, sf).select("fund_id", M.flag(F.col("sold_secondary")).alias("sold"))


# ---- filters ---------------------------------------------------------------


@query("mature_only", "SELECT fund_id FROM funds WHERE NOT coalesce(not_meaningful, false)")
def mature_only(spark, sf):
    return panel.mature_only(V.funds(spark, sf)).select("fund_id")


@query("exclude_secondary", "SELECT fund_id FROM funds WHERE NOT coalesce(sold_secondary, false)")
def exclude_secondary(spark, sf):
    return V.funds(spark, sf).filter(~M.flag(F.col("sold_secondary"))).select("fund_id")


@query("era_split", "SELECT era, count(*) AS n FROM (SELECT unnest(list_filter(['all', CASE WHEN vintage < 2000 THEN 'pre-2000' END, CASE WHEN vintage >= 2000 THEN '2000+' END, CASE WHEN vintage >= 2010 THEN '2010+' END], lambda e: e IS NOT NULL)) AS era FROM funds) GROUP BY 1")
def era_split(spark, sf):
    v = F.col("vintage")
    eras = F.array_compact(F.array(F.lit("all"), F.when(v < 2000, "pre-2000"), F.when(v >= 2000, "2000+"), F.when(v >= 2010, "2010+")))
    return V.funds(spark, sf).select(F.explode(eras).alias("era")).groupBy("era").agg(F.count("*").alias("n"))


@query("families_min_size", "SELECT fund_id FROM (SELECT fund_id, count(*) OVER (PARTITION BY firm_id) AS n FROM funds) WHERE n >= 12")
def families_min_size(spark, sf):
    return panel.families_min_size(V.funds(spark, sf), 12).select("fund_id")


@query("adjacent_pairs", "SELECT fund_id, round(y, 6) AS y, round(y_lag, 6) AS y_lag FROM panel WHERE fund_number_gap = 1 AND y IS NOT NULL AND y_lag IS NOT NULL")
def adjacent_pairs(spark, sf):
    return panel.adjacent_pairs(panel.build_panel(V.snap(spark, sf))).select("fund_id", r6("y").alias("y"), r6("y_lag").alias("y_lag"))


@query("estimation_sample", "SELECT fund_id, vintage, firm_id, fund_number_gap FROM sample WHERE fund_number_gap <= 1")
def estimation_sample(spark, sf):
    return panel.estimation_sample(panel.build_panel(V.snap(spark, sf)), max_gap=1).select("fund_id", "vintage", "firm_id", "fund_number_gap")


@query("outcome_censoring", "SELECT fund_id FROM (SELECT fund_id, tvpi, quantile_cont(tvpi, 0.25) OVER (PARTITION BY vintage) AS q FROM snap) WHERE tvpi > q")
def outcome_censoring(spark, sf):
    s = V.snap(spark, sf)
    # one row for each vintage
    return s.join(ranks.quantiles(s, "tvpi", (0.25,), ("vintage",)), "vintage").filter("tvpi > q0").select("fund_id")


@query("nonzero_flow", "SELECT fund_id, as_of FROM snapshots WHERE CASE WHEN fund_id % 4 > 0 THEN contributions END IS NULL OR contributions <> 0")
def nonzero_flow(spark, sf):
    amount = F.when(F.col("fund_id") % 4 > 0, F.col("contributions"))
    return V.snapshots(spark, sf).filter(amount.isNull() | (amount != 0)).select("fund_id", "as_of")


@query("skip_lines", "SELECT p_partkey AS k FROM part WHERE trim(p_name) <> '' AND NOT starts_with(lower(trim(p_name)), 'red')")
def skip_lines(spark, sf):
    line = F.trim("p_name")
    return V.table(spark, sf, "part").filter((line != "") & ~F.startswith(F.lower(line), F.lit("red"))).select(F.col("p_partkey").alias("k"))


@query("string_flags", "SELECT p_partkey AS k, contains(lower(p_type), 'eco') AS a, regexp_matches(p_brand, '(?i)BRAND#1') AS b FROM part")
def string_flags(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lower("p_type").contains("eco").alias("a"), F.col("p_brand").rlike("(?i)BRAND#1").alias("b"))


# ---- joins -----------------------------------------------------------------


@query("join_one_to_one", "SELECT fund_id, vintage, round(tvpi, 6) AS tvpi FROM snap")
def join_one_to_one(spark, sf):
    metrics = V.snap(spark, sf).select("fund_id", "tvpi")
    return V.funds(spark, sf).join(metrics, "fund_id").select("fund_id", "vintage", r6("tvpi").alias("tvpi"))


@query("join_composite_suffixed", f"""SELECT a.firm_id, a.fund_number, a.fund_id AS fund_id_a, b.fund_id AS fund_id_b FROM plans a JOIN plans b ON a.firm_id = b.firm_id AND a.fund_number = b.fund_number WHERE a.source = '{V.A}' AND b.source = '{V.B}'""")
def join_composite_suffixed(spark, sf):
    p = V.plans(spark, sf).select("firm_id", "fund_number", "fund_id", "source")
    a, b = p.filter(F.col("source") == V.A), p.filter(F.col("source") == V.B)
    return a.join(b.withColumnRenamed("fund_id", "fund_id_b"), ["firm_id", "fund_number"]).select("firm_id", "fund_number", F.col("fund_id").alias("fund_id_a"), "fund_id_b")


def _overrides(spark, sf):
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.filter(k % 10 == 3).select(k.alias("firm_id_raw"), (k - 3).alias("firm_id_canonical"), F.when(k % 20 == 3, "merge").otherwise("keep_separate").alias("decision"))


_OVERRIDES = "ov AS (SELECT c_custkey AS firm_id_raw, c_custkey - 3 AS firm_id_canonical, CASE WHEN c_custkey % 20 = 3 THEN 'merge' ELSE 'keep_separate' END AS decision FROM customer WHERE c_custkey % 10 = 3)"


@query("lookup_override", f"WITH {_OVERRIDES} SELECT fund_id, coalesce(firm_id_canonical, firm_id) AS family FROM funds f LEFT JOIN (SELECT * FROM ov WHERE decision = 'merge') m ON f.firm_id = m.firm_id_raw")
def lookup_override(spark, sf):
    return entity.apply_overrides(V.funds(spark, sf), _overrides(spark, sf), raw="firm_id", out="family").select("fund_id", "family")


@query("lookup_decisions", f"WITH {_OVERRIDES} SELECT fund_id, coalesce(decision, 'unreviewed') AS decision FROM funds f LEFT JOIN ov ON f.firm_id = ov.firm_id_raw")
def lookup_decisions(spark, sf):
    return entity.lookup(V.funds(spark, sf), "firm_id", _overrides(spark, sf), "firm_id_raw", "decision", "decision", F.lit("unreviewed")).select("fund_id", "decision")


@query("lookup_sponsor", "SELECT fund_id, coalesce(n_name, 'S' || sponsor_id) AS sponsor FROM funds LEFT JOIN nation ON sponsor_id = n_nationkey")
def lookup_sponsor(spark, sf):
    return entity.lookup(V.funds(spark, sf), "sponsor_id", V.table(spark, sf, "nation"), "n_nationkey", "n_name", "sponsor", F.concat(F.lit("S"), F.col("sponsor_id").cast("string"))).select("fund_id", "sponsor")


@query("anti_stale", f"WITH {_OVERRIDES} SELECT DISTINCT firm_id_raw FROM ov WHERE firm_id_raw NOT IN (SELECT firm_id FROM funds WHERE firm_id % 7 > 0) AND firm_id_raw NOT IN (SELECT firm_id_canonical FROM ov WHERE decision = 'merge')")
def anti_stale(spark, sf):
    return entity.stale_overrides(V.funds(spark, sf).filter("firm_id % 7 > 0"), _overrides(spark, sf), raw="firm_id")


@query("anti_uncovered", f"WITH {_OVERRIDES} SELECT DISTINCT firm_id FROM funds WHERE firm_id % 10 IN (2, 3) AND firm_id NOT IN (SELECT firm_id_raw FROM ov)")
def anti_uncovered(spark, sf):
    suspects = V.funds(spark, sf).filter("firm_id % 10 in (2, 3)").select("firm_id").distinct()
    return suspects.join(_overrides(spark, sf).select(F.col("firm_id_raw").alias("firm_id")), "firm_id", "left_anti")


def _faults(p):
    o = p.select(F.col("p_size").alias("firm_id_raw"), (F.col("p_size") % 7 + 40).alias("firm_id_canonical"), F.when(F.col("p_partkey") % 50 == 0, "other").otherwise("merge").alias("decision"))
    return entity.override_faults(o)


@query("override_faults", """WITH o AS (SELECT p_size AS k, p_size % 7 + 40 AS c, CASE WHEN p_partkey % 50 = 0 THEN 'other' ELSE 'merge' END AS d FROM part)
SELECT 'repeated' AS fault, k AS key FROM o GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'decision', k FROM o WHERE d NOT IN ('merge', 'keep_separate') UNION ALL SELECT DISTINCT 'chained', c FROM o WHERE d = 'merge' AND c IN (SELECT k FROM o WHERE d = 'merge')""")
def override_faults(spark, sf):
    return _faults(V.table(spark, sf, "part"))


@query("theta_prefix_self", "WITH s AS (SELECT DISTINCT upper(fund_name) AS stem FROM names) SELECT a.stem, b.stem AS longer FROM s a JOIN s b ON starts_with(b.stem, a.stem || ' ')")
def theta_prefix_self(spark, sf):
    return entity.prefix_pairs(V.names(spark, sf).select(F.upper("fund_name").alias("stem")))


@query("asof_backward", "SELECT f.fund_id, f.date, i.level FROM flows f ASOF JOIN idx i ON f.date >= i.date")
def asof_backward(spark, sf):
    from ..operators.cashflow import asof_level

    return asof_level(V.flows(spark, sf), V.index(spark, sf)).select("fund_id", "date", "level")


@query("range_window_firstlast", "SELECT s.fund_id, arg_min(i.level, i.date) AS first_level, arg_max(i.level, i.date) AS last_level FROM (SELECT fund_id, min(date) AS d FROM flows GROUP BY 1) s JOIN idx i ON i.date BETWEEN s.d AND s.d + INTERVAL 2 YEAR GROUP BY 1")
def range_window_firstlast(spark, sf):
    start = V.flows(spark, sf).groupBy("fund_id").agg(F.min("date").alias("d"))
    months = start.select("fund_id", "d", F.explode(F.sequence(F.trunc("d", "month"), F.add_months(F.trunc("d", "month"), 24), F.expr("interval 1 month"))).alias("m"))
    i = V.index(spark, sf).withColumn("m", F.trunc("date", "month"))
    hit = months.join(i, "m").filter((F.col("date") >= F.col("d")) & (F.col("date") <= F.add_months("d", 24)))
    return hit.groupBy("fund_id").agg(F.min_by("level", "date").alias("first_level"), F.max_by("level", "date").alias("last_level"))


@query("join_last_row", "SELECT s.fund_id, s.as_of, s.nav, CASE WHEN e.fund_id IS NOT NULL THEN round(s.distributions / nullif(s.contributions, 0), 6) END AS dpi FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY as_of DESC) AS rn FROM snapshots) s LEFT JOIN (SELECT fund_id FROM snapshots GROUP BY 1 HAVING arg_min(contributions, as_of) <= 0 AND count(DISTINCT as_of) >= 2) e USING (fund_id) WHERE rn = 1")
def join_last_row(spark, sf):
    from ..operators.cashflow import observed_from_inception

    s = V.snapshots(spark, sf)
    last = s.groupBy("fund_id").agg(F.max_by(F.struct("as_of", "contributions", "distributions", "nav"), "as_of").alias("l")).select("fund_id", "l.*")
    eligible = observed_from_inception(s).withColumn("e", F.lit(True))
    return last.join(eligible, "fund_id", "left").select("fund_id", "as_of", "nav", r6(F.when(F.col("e"), M.ratio(F.col("distributions"), F.col("contributions")))).alias("dpi"))


@query("semi_flows_nav", "SELECT f.fund_id, greatest(n.nav_date, max(f.date)) AS nav_date, n.nav, count(*) AS n_flows FROM flows f JOIN navs n USING (fund_id) WHERE f.fund_id % 2 = 0 GROUP BY f.fund_id, n.nav_date, n.nav")
def semi_flows_nav(spark, sf):
    grouped = V.flows(spark, sf).groupBy("fund_id").agg(F.max("date").alias("last"), F.count("*").alias("n_flows"))
    return grouped.join(V.navs(spark, sf).filter("fund_id % 2 = 0"), "fund_id").select("fund_id", F.greatest("nav_date", "last").alias("nav_date"), "nav", "n_flows")


@query("replicate_drop_level", "SELECT d.vintage AS dropped, count(*) AS n FROM (SELECT DISTINCT vintage FROM funds) d JOIN funds f ON f.vintage <> d.vintage GROUP BY 1")
def replicate_drop_level(spark, sf):
    # every row but the level's own: totals less the level, nothing replicated
    f = V.funds(spark, sf).groupBy("vintage").agg(F.count("*").alias("own"))
    total = f.agg(F.sum("own").alias("total"))
    return f.crossJoin(F.broadcast(total)).select(F.col("vintage").alias("dropped"), (F.col("total") - F.col("own")).alias("n"))


# ---- set operations, sorts, top-k ------------------------------------------


@query("union_all", f"SELECT source, count(*) AS n, count(fund_number) AS numbered FROM plans GROUP BY 1")
def union_all(spark, sf):
    return V.plans(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count("fund_number").alias("numbered"))


@query("pool_plans", f"SELECT fund_id, source FROM (SELECT *, min(source) OVER (PARTITION BY firm_id, fund_number) AS best FROM plans WHERE fund_number IS NOT NULL) WHERE source = best UNION ALL SELECT fund_id, source FROM plans WHERE fund_number IS NULL")
def pool_plans(spark, sf):
    return entity.pool_plans(V.plans(spark, sf), (V.A, V.B)).select("fund_id", "source")


@query("overlap_report", "SELECT firm_id, fund_number, string_agg(DISTINCT source, ' | ' ORDER BY source) AS plans, string_agg(fund_name, ' | ' ORDER BY source, fund_id) AS fund_names, min(source) AS kept, count(DISTINCT source) AS n_plans FROM plans WHERE fund_number IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source) > 1")
def overlap_report(spark, sf):
    return entity.overlap_report(V.plans(spark, sf), (V.A, V.B))


@query("column_stack", "SELECT round(quantile_cont(v, 0.01), 6) AS low, round(quantile_cont(v, 0.99), 6) AS high FROM (SELECT y AS v FROM sample UNION ALL SELECT y_lag FROM sample)")
def column_stack(spark, sf):
    s = panel.estimation_sample(panel.build_panel(V.snap(spark, sf)))
    return s.select(F.explode(F.array("y", "y_lag")).alias("v")).transform(ranks.quantiles, "v", (0.01, 0.99)).select(r6("q0").alias("low"), r6("q1").alias("high"))


@query("set_difference", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_difference(spark, sf):
    c = V.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    return V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().join(c, "k", "left_anti")


@query("set_intersection", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf):
    return V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).intersect(V.table(spark, sf, "supplier").select("s_nationkey"))


@query("top_count", "SELECT firm_id, count(*) AS n FROM funds GROUP BY 1 ORDER BY n DESC, firm_id LIMIT 10")
def top_count(spark, sf):
    return V.funds(spark, sf).groupBy("firm_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "firm_id").limit(10)


@query("head_per_group", "SELECT firm_id, fund_id FROM (SELECT firm_id, fund_id, row_number() OVER (PARTITION BY firm_id ORDER BY commitment DESC, fund_id) AS rn FROM funds) WHERE rn <= 3")
def head_per_group(spark, sf):
    w = Window.partitionBy("firm_id").orderBy(F.desc("commitment"), "fund_id")
    return V.funds(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("firm_id", "fund_id")


@query("drop_duplicates", "SELECT firm_id, fund_number, fund_id FROM (SELECT *, row_number() OVER (PARTITION BY firm_id, fund_number ORDER BY fund_id) AS rn FROM funds WHERE fund_number IS NOT NULL) WHERE rn = 1")
def drop_duplicates(spark, sf):
    w = Window.partitionBy("firm_id", "fund_number").orderBy("fund_id")
    return V.funds(spark, sf).filter("fund_number is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("firm_id", "fund_number", "fund_id")


# ---- aggregations ----------------------------------------------------------


@query("paid_in_distributed", "SELECT fund_id, round(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END), 6) AS paid_in, round(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END), 6) AS distributed FROM flows GROUP BY 1")
def paid_in_distributed(spark, sf):
    a = F.col("amount")
    return V.flows(spark, sf).groupBy("fund_id").agg(r6(F.sum(F.when(a < 0, -a).otherwise(0.0))).alias("paid_in"), r6(F.sum(F.when(a > 0, a).otherwise(0.0))).alias("distributed"))


_GAPPY = "SELECT *, CASE WHEN (fund_id + day(as_of)) % 3 > 0 THEN nav END AS v FROM snapshots"


def _gappy(spark, sf):
    return V.snapshots(spark, sf).withColumn("v", F.when((F.col("fund_id") + F.dayofmonth("as_of")) % 3 > 0, F.col("nav")))


@query("first_row_per_group", f"SELECT fund_id, arg_min(v, as_of) FILTER (v IS NOT NULL) AS first_v FROM ({_GAPPY}) GROUP BY 1")
def first_row_per_group(spark, sf):
    return _gappy(spark, sf).groupBy("fund_id").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("as_of"))).alias("first_v"))


@query("last_row_per_group", f"SELECT fund_id, arg_max(v, as_of) FILTER (v IS NOT NULL) AS last_v FROM ({_GAPPY}) GROUP BY 1")
def last_row_per_group(spark, sf):
    return _gappy(spark, sf).groupBy("fund_id").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("as_of"))).alias("last_v"))


@query("count_distinct", "SELECT count(DISTINCT firm_id) AS firms, count(DISTINCT sponsor_id) AS sponsors, count(DISTINCT as_of) AS dates FROM funds")
def count_distinct(spark, sf):
    return V.funds(spark, sf).agg(F.countDistinct("firm_id").alias("firms"), F.countDistinct("sponsor_id").alias("sponsors"), F.countDistinct("as_of").alias("dates"))


@query("count_distinct_incl_null", "SELECT firm_id, count(DISTINCT fund_number) + max(CASE WHEN fund_number IS NULL THEN 1 ELSE 0 END) AS n FROM funds GROUP BY 1")
def count_distinct_incl_null(spark, sf):
    return V.funds(spark, sf).groupBy("firm_id").agg((F.countDistinct("fund_number") + F.max(F.col("fund_number").isNull().cast("int"))).alias("n"))


@query("share_class_rollup", """SELECT firm_id, fund_number, fund_id, vintage, round(commitment, 6) AS commitment, round(nav, 6) AS nav, round(total_value, 6) AS total_value, not_meaningful, n FROM (
  SELECT firm_id, fund_number, arg_max(fund_id, (commitment, -fund_id)) AS fund_id, min(vintage) AS vintage, sum(commitment) AS commitment, sum(nav) AS nav, sum(distributions) + sum(nav) AS total_value, bool_or(not_meaningful) AS not_meaningful, count(*) AS n FROM snap WHERE fund_number IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT firm_id, fund_number, fund_id, vintage, commitment, nav, total_value, not_meaningful, 1 FROM snap WHERE fund_number IS NULL)""")
def share_class_rollup(spark, sf):
    out = entity.share_class_rollup(V.snap(spark, sf))
    return out.select("firm_id", "fund_number", "fund_id", "vintage", r6("commitment").alias("commitment"), r6("nav").alias("nav"), r6("total_value").alias("total_value"), "not_meaningful", F.col("n_share_classes").cast("long").alias("n"))


@query("share_class_report", "SELECT firm_id, fund_number, count(*) AS n_share_classes, string_agg(fund_name, ' | ' ORDER BY fund_id) AS fund_names, string_agg(vintage::VARCHAR, ';' ORDER BY vintage) AS vintages, min(vintage) AS vintage_kept, round(sum(commitment), 6) AS commitment_total FROM plans WHERE source = 'Plan A' AND fund_number IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def share_class_report(spark, sf):
    return entity.share_class_report(V.plans(spark, sf).filter(F.col("source") == V.A)).withColumn("commitment_total", r6("commitment_total"))


@query("vintage_coverage", "SELECT vintage, count(*) AS n, round(median(tvpi), 6) AS median_tvpi, round(median(nav / total_value), 6) AS median_unrealised FROM snap GROUP BY 1")
def vintage_coverage(spark, sf):
    s = V.snap(spark, sf).withColumn("unrealised", F.col("nav") / F.col("total_value"))
    median = lambda c: ranks.quantiles(s, c, (0.5,), ("vintage",)).select("vintage", r6("q0").alias(f"median_{c}"))
    return s.groupBy("vintage").agg(F.count("*").alias("n")).join(median("tvpi"), "vintage", "left").join(median("unrealised"), "vintage", "left")


@query("decade_summary", "SELECT (vintage // 10 * 10)::INT AS decade, count(*) AS n, round(sum(total_value) / sum(contributions), 6) AS pooled FROM snap GROUP BY 1")
def decade_summary(spark, sf):
    return V.snap(spark, sf).groupBy((F.floor(F.col("vintage") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"), r6(F.sum("total_value") / F.sum("contributions")).alias("pooled"))


@query("plan_flag_share", "SELECT source, count(*) AS n, sum(not_meaningful::INT) AS flagged, median(vintage) AS median_vintage, round(avg(not_meaningful::INT), 6) AS share FROM plans GROUP BY 1")
def plan_flag_share(spark, sf):
    f = F.col("not_meaningful").cast("int")
    return V.plans(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum(f).alias("flagged"), F.percentile("vintage", F.lit(0.5)).alias("median_vintage"), r6(F.avg(f)).alias("share"))


@query("weighted_mean", "SELECT vintage, round(sum(commitment * tvpi) / sum(commitment), 6) AS weighted FROM snap GROUP BY 1")
def weighted_mean(spark, sf):
    return V.snap(spark, sf).groupBy("vintage").agg(r6(F.sum(F.col("commitment") * F.col("tvpi")) / F.sum("commitment")).alias("weighted"))


@query("describe", "SELECT count(tvpi) AS n, round(avg(tvpi), 6) AS mean, round(stddev_samp(tvpi), 6) AS sd, round(min(tvpi), 6) AS low, round(quantile_cont(tvpi, 0.25), 6) AS q1, round(median(tvpi), 6) AS q2, round(quantile_cont(tvpi, 0.75), 6) AS q3, round(max(tvpi), 6) AS high FROM snap")
def describe(spark, sf):
    s = V.snap(spark, sf)
    # one row each
    quarters = ranks.quantiles(s, "tvpi", (0.25, 0.5, 0.75)).select(*(r6(f"q{i}").alias(f"q{i + 1}") for i in (0, 1, 2)))
    return s.agg(F.count("tvpi").alias("n"), r6(F.avg("tvpi")).alias("mean"), r6(F.stddev_samp("tvpi")).alias("sd"), r6(F.min("tvpi")).alias("low"), r6(F.max("tvpi")).alias("high")).crossJoin(F.broadcast(quarters))


@query("funnel", "SELECT unnest(['funds', 'numbered', 'lagged', 'adjacent', 'mature']) AS step, unnest([count(*), count(fund_number), count(y_lag), sum((fund_number_gap = 1)::INT)::BIGINT, sum((fund_number_gap = 1 AND NOT not_meaningful)::INT)::BIGINT]) AS n FROM panel")
def funnel(spark, sf):
    p = panel.build_panel(V.snap(spark, sf))
    adjacent = F.col("fund_number_gap") == 1
    one = p.agg(F.count("*").alias("funds"), F.count("fund_number").alias("numbered"), F.count("y_lag").alias("lagged"), F.count_if(adjacent).alias("adjacent"), F.count_if(adjacent & ~F.col("not_meaningful")).alias("mature"))
    return one.unpivot([], ["funds", "numbered", "lagged", "adjacent", "mature"], "step", "n")


@query("usable_pairs", "SELECT sum(greatest(n - 1, 0))::BIGINT AS pairs FROM (SELECT count(*) AS n FROM funds GROUP BY firm_id)")
def usable_pairs(spark, sf):
    return V.funds(spark, sf).groupBy("firm_id").agg(F.count("*").alias("n")).agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("pairs"))


@query("variance_corr", "SELECT round(var_samp(tvpi), 6) AS var_tvpi, round(corr(tvpi, commitment), 6) AS r FROM snap")
def variance_corr(spark, sf):
    return V.snap(spark, sf).agg(r6(F.var_samp("tvpi")).alias("var_tvpi"), r6(F.corr("tvpi", "commitment")).alias("r"))


@query("quantiles", "SELECT vintage, round(quantile_cont(tvpi, 0.5), 6) AS q50, round(quantile_cont(tvpi, 0.9), 6) AS q90, round(quantile_cont(tvpi, 0.975), 6) AS q975 FROM snap GROUP BY 1")
def quantiles(spark, sf):
    q = ranks.quantiles(V.snap(spark, sf), "tvpi", (0.5, 0.9, 0.975), ("vintage",))
    return q.select("vintage", *(r6(f"q{i}").alias(n) for i, n in enumerate(("q50", "q90", "q975"))))


@query("argmax_row", "SELECT firm_id, arg_max(fund_id, (abs(tvpi - 1), -fund_id)) AS fund_id FROM snap GROUP BY 1")
def argmax_row(spark, sf):
    return V.snap(spark, sf).groupBy("firm_id").agg(F.max_by("fund_id", F.struct(F.abs(F.col("tvpi") - 1), -F.col("fund_id"))).alias("fund_id"))


@query("firm_average_skill", "SELECT round(corr(m, s), 6) AS r, count(*) AS n FROM (SELECT firm_id, avg(y) AS m, arg_min(log_commitment, sequence) AS s, count(*) AS n FROM panel GROUP BY 1) WHERE n >= 3")
def firm_average_skill(spark, sf):
    g = panel.build_panel(V.snap(spark, sf)).groupBy("firm_id").agg(F.avg("y").alias("m"), F.min_by("log_commitment", "sequence").alias("s"), F.count("*").alias("n"))
    return g.filter("n >= 3").agg(r6(F.corr("m", "s")).alias("r"), F.count("*").alias("n"))


# ---- windows ---------------------------------------------------------------


@query("sequence", "SELECT fund_id, row_number() OVER (PARTITION BY firm_id ORDER BY vintage NULLS LAST, commitment NULLS LAST, fund_id)::INT AS sequence, count(*) OVER (PARTITION BY firm_id, vintage) > 1 AS parallel_vintage FROM funds")
def sequence(spark, sf):
    return entity.add_sequence(V.funds(spark, sf).drop("sequence")).select("fund_id", "sequence", "parallel_vintage")


@query("lag_panel", "SELECT fund_id, round(y, 6) AS y, round(y_lag, 6) AS y_lag, prior_vintage, prior_fund_number, prior_sequence, vintage_gap, fund_number_gap FROM panel")
def lag_panel(spark, sf):
    return panel.build_panel(V.snap(spark, sf)).select("fund_id", r6("y").alias("y"), r6("y_lag").alias("y_lag"), "prior_vintage", "prior_fund_number", "prior_sequence", "vintage_gap", "fund_number_gap")


@query("lag_interim", "SELECT fund_id, round(lag(ln(greatest(nav / contributions, 0.01))) OVER (PARTITION BY firm_id ORDER BY sequence, fund_id), 6) AS y_lag, 'interim' AS lag_source FROM snap")
def lag_interim(spark, sf):
    s = V.snap(spark, sf).withColumn("interim", F.col("nav") / F.col("contributions"))
    return panel.build_panel(s, predecessor="interim").select("fund_id", r6("y_lag").alias("y_lag"), "lag_source")


@query("first_difference", "SELECT fund_id, as_of, round(greatest(coalesce(contributions - lag(contributions) OVER w, contributions), 0), 6) AS called FROM snapshots WINDOW w AS (PARTITION BY fund_id ORDER BY as_of)")
def first_difference(spark, sf):
    w = Window.partitionBy("fund_id").orderBy("as_of")
    moved = F.coalesce(F.col("contributions") - F.lag("contributions").over(w), F.col("contributions"))
    return V.snapshots(spark, sf).select("fund_id", "as_of", r6(M.floor_at(moved, 0.0)).alias("called"))


@query("cumprod_index", "SELECT date, round(100 * exp(sum(ln(1 + r)) OVER (ORDER BY date)), 6) AS level FROM (SELECT date, level / 10000 AS r FROM idx)")
def cumprod_index(spark, sf):
    from ..operators.cashflow import compound_index

    i = V.index(spark, sf).select("date", (F.col("level") / 10000).alias("r"))
    return compound_index(i).select("date", r6("level").alias("level"))


@query("pct_change_guard", "SELECT date, level, round(step, 6) AS step FROM (SELECT *, abs(level / lag(level) OVER (ORDER BY date) - 1) AS step FROM idx) WHERE level <= 0 OR step > 0.1")
def pct_change_guard(spark, sf):
    step = F.abs(F.col("level") / F.lag("level").over(Window.orderBy("date")) - 1)
    return V.index(spark, sf).withColumn("step", step).filter("level <= 0 or step > 0.1").withColumn("step", r6("step"))


@query("ffill", f"SELECT fund_id, as_of, last_value(v IGNORE NULLS) OVER (PARTITION BY fund_id ORDER BY as_of) AS v FROM ({_GAPPY})")
def ffill(spark, sf):
    w = Window.partitionBy("fund_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    return _gappy(spark, sf).select("fund_id", "as_of", F.last("v", ignorenulls=True).over(w).alias("v"))


@query("group_size_nunique", "SELECT f.fund_id, s.n, s.kinds FROM funds f JOIN (SELECT firm_id, count(*) AS n, count(DISTINCT vintage)::INT AS kinds FROM funds GROUP BY 1) s USING (firm_id)")
def group_size_nunique(spark, sf):
    w = Window.partitionBy("firm_id")
    return V.funds(spark, sf).select("fund_id", F.count("*").over(w).alias("n"), F.size(F.collect_set("vintage").over(w)).alias("kinds"))


@query("pct_rank_avg", "SELECT fund_id, round((rank() OVER (PARTITION BY vintage ORDER BY k) + (count(*) OVER (PARTITION BY vintage, k) - 1) / 2) / count(*) OVER (PARTITION BY vintage), 6) AS pct FROM (SELECT fund_id, vintage, round(commitment / 1e4) AS k FROM funds)")
def pct_rank_avg(spark, sf):
    d = V.funds(spark, sf).withColumn("k", F.round(F.col("commitment") / 1e4))
    return ranks.average_rank(d, "k", "vintage", "pct").select("fund_id", r6("pct").alias("pct"))


_QUARTILES = "SELECT *, 1 + (y > quantile_cont(y, 0.25) OVER v)::INT + (y > quantile_cont(y, 0.5) OVER v)::INT + (y > quantile_cont(y, 0.75) OVER v)::INT AS q_now, 1 + (y_lag > quantile_cont(y_lag, 0.25) OVER v)::INT + (y_lag > quantile_cont(y_lag, 0.5) OVER v)::INT + (y_lag > quantile_cont(y_lag, 0.75) OVER v)::INT AS q_prev FROM sample WINDOW v AS (PARTITION BY vintage)"


@query("quartile_within", f"SELECT fund_id, q_now, q_prev FROM ({_QUARTILES})")
def quartile_within(spark, sf):
    s = panel.estimation_sample(panel.build_panel(V.snap(spark, sf)))
    return panel.quartile(panel.quartile(s, "y", "vintage", "q_now"), "y_lag", "vintage", "q_prev").select("fund_id", "q_now", "q_prev")


@query("quartile_transitions", f"SELECT q_prev, q_now, n, round(n / sum(n) OVER (PARTITION BY q_prev), 6) AS share FROM (SELECT q_prev, q_now, count(*) AS n FROM ({_QUARTILES}) GROUP BY 1, 2)")
def quartile_transitions(spark, sf):
    s = panel.estimation_sample(panel.build_panel(V.snap(spark, sf)))
    return panel.transitions(s).withColumn("share", r6("share"))


@query("crosstab_counts", f"SELECT q_prev, count(*) FILTER (q_now = 1) AS q1, count(*) FILTER (q_now = 2) AS q2, count(*) FILTER (q_now = 3) AS q3, count(*) FILTER (q_now = 4) AS q4 FROM ({_QUARTILES}) GROUP BY 1")
def crosstab_counts(spark, sf):
    s = panel.estimation_sample(panel.build_panel(V.snap(spark, sf)))
    t = panel.transitions(s).groupBy("q_prev").pivot("q_now", [1, 2, 3, 4]).agg(F.sum("n"))
    return t.select("q_prev", *(F.coalesce(F.col(str(q)), F.lit(0)).alias(f"q{q}") for q in (1, 2, 3, 4)))


@query("vintage_anomalies", """WITH w AS (SELECT fund_id, fund_number, vintage, lag(vintage) OVER o AS b, lead(vintage) OVER o AS a, count(*) OVER f AS n, max(fund_number) OVER f - min(fund_number) OVER f AS spread, regr_slope(vintage, fund_number) OVER f AS s, regr_intercept(vintage, fund_number) OVER f AS c
  FROM funds WHERE fund_number IS NOT NULL WINDOW o AS (PARTITION BY firm_id ORDER BY fund_number, fund_id), f AS (PARTITION BY firm_id)),
r AS (SELECT *, coalesce(vintage < b, false) OR coalesce(a < vintage, false) AS out_of_order, CASE WHEN n >= 3 AND spread > 0 THEN vintage - (c + s * fund_number) END AS e FROM w)
SELECT fund_id, out_of_order, round(e, 6) AS trend_residual, out_of_order OR coalesce(abs(e) > 1, false) AS vintage_anomaly FROM r UNION ALL SELECT fund_id, false, NULL, false FROM funds WHERE fund_number IS NULL""")
def vintage_anomalies(spark, sf):
    return entity.vintage_anomalies(V.funds(spark, sf), 1.0).select("fund_id", "out_of_order", r6("trend_residual").alias("trend_residual"), "vintage_anomaly")


@query("clash_same_vintage", "SELECT firm_id, vintage, count(*) AS n FROM funds GROUP BY 1, 2 HAVING count(*) > 1")
def clash_same_vintage(spark, sf):
    w = Window.partitionBy("firm_id", "vintage")
    return V.funds(spark, sf).withColumn("n", F.count("*").over(w)).filter("n > 1").select("firm_id", "vintage", "n").distinct()


@query("top_rep", "SELECT firm_id, arg_max(fund_id, (commitment, -fund_id)) AS fund_id FROM funds GROUP BY 1")
def top_rep(spark, sf):
    return V.funds(spark, sf).groupBy("firm_id").agg(F.max_by("fund_id", F.struct("commitment", -F.col("fund_id"))).alias("fund_id"))
