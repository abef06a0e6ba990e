"""Fund-domain views over the star-schema tables, as DataFrames and as SQL.

The SQL is the same derivation for a reference engine: ``VIEWS[name]`` is the
body of a common table expression, and :func:`with_views` puts those that a
query needs, in order, before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import roman

A, B = "Plan A", "Plan B"
SUFFIXES = (", L.P.", " (A)", " SCSp", "-C", "")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def funds(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: family, vintage, commitment, flags, sequence and fund number."""
    o = table(spark, sf, "orders")
    key, firm = F.col("o_orderkey"), F.col("o_custkey")
    base = o.select(key.alias("fund_id"), firm.alias("firm_id"), (firm % 97).alias("sponsor_id"), F.year("o_orderdate").alias("vintage"), F.col("o_totalprice").alias("commitment"), (key % 13 == 0).alias("not_meaningful"), F.when(key % 7 != 0, key % 17 == 0).alias("sold_secondary"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("as_of"))
    seq = base.withColumn("sequence", F.row_number().over(Window.partitionBy("firm_id").orderBy("vintage", "commitment", "fund_id")))
    s = F.col("sequence")
    number = F.when(F.col("fund_id") % 11 != 0, F.when(F.col("firm_id") % 5 == 0, F.floor((s + 1) / 2)).otherwise(s + F.floor(s / 4))).cast("int")
    return seq.withColumn("fund_number", number)


def snap(spark: SparkSession, sf: str) -> DataFrame:
    """funds with paid-in, distributed and remaining value from their lines."""
    li = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    back = F.col("l_returnflag") == "R"
    cash = li.groupBy(F.col("l_orderkey").alias("fund_id")).agg(F.round(F.sum("l_extendedprice"), 6).alias("contributions"), F.round(F.sum(F.when(back, net).otherwise(0.0)), 6).alias("distributions"), F.round(F.sum(F.when(~back, net * (1 + F.col("l_tax"))).otherwise(0.0)), 6).alias("nav"))
    both = funds(spark, sf).join(cash, "fund_id")
    return both.withColumn("total_value", F.col("distributions") + F.col("nav")).withColumn("tvpi", F.col("total_value") / F.col("contributions"))


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping plans of named funds."""
    s = snap(spark, sf).withColumn("fund_name", F.concat(F.lit("FUND "), F.col("fund_id").cast("string")))
    return s.filter("status in ('F', 'O')").withColumn("source", F.lit(A)).unionByName(s.filter("status in ('O', 'P')").withColumn("source", F.lit(B)))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Fund names built from part names, numerals and suffixes."""
    p = table(spark, sf, "part")
    numeral = F.element_at(F.array(*(F.lit(roman(n)) for n in range(1, 13))), (F.col("p_partkey") % 12 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("fund_id"), F.concat("p_name", F.lit(" Partners "), numeral, suffix).alias("fund_name"), (F.lit(1990) + F.col("p_size") % 30).cast("int").alias("vintage"), F.col("p_retailprice").alias("commitment"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Cash flows by supplier: calls before 1998, distributions after."""
    li = table(spark, sf, "lineitem")
    amount = F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return li.groupBy(F.col("l_suppkey").alias("fund_id"), F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.sum(amount), 6).alias("amount"))


def navs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fund_id"), (F.abs("s_acctbal") * 1000).alias("nav"), F.lit("2001-12-31").cast("date").alias("nav_date"))


def index(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly level from order prices, with an anchor before the first flow."""
    o = table(spark, sf, "orders")
    monthly = o.groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("date")).agg(F.round(F.avg("o_totalprice") / 1000, 6).alias("level"))
    anchor = o.limit(1).select(F.lit("1994-12-31").cast("date").alias("date"), F.lit(100.0).alias("level"))
    return monthly.unionByName(anchor)


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative weekly totals by user, with a restatement for every fifth."""
    e = table(spark, sf, "events")
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date")
    paid = F.col("event_type").isin("purchase", "signup")
    weekly = e.groupBy(F.col("user_id").alias("fund_id"), week.alias("as_of")).agg(F.sum(F.when(~paid, F.col("value")).otherwise(0.0)).alias("c"), F.sum(F.when(paid, F.col("value")).otherwise(0.0)).alias("d"))
    w = Window.partitionBy("fund_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("fund_id").orderBy("as_of")) == 1
    total = weekly.select("fund_id", "as_of", F.sum("c").over(w).alias("contributions"), F.sum("d").over(w).alias("distributions"), first.alias("first"), (F.col("c") + F.col("d")).alias("nav"))
    called = F.when(F.col("first") & (F.col("fund_id") % 3 == 0), 0.0).when((F.col("fund_id") % 5 == 0) & (F.dayofmonth("as_of") == 22), F.col("contributions") - 100.0).otherwise(F.col("contributions"))
    return total.select("fund_id", "as_of", F.round(called, 6).alias("contributions"), F.round("distributions", 6).alias("distributions"), F.round("nav", 6).alias("nav"))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of noisy reports of one value."""
    s = snap(spark, sf).filter("tvpi > 0")
    return s.select("fund_id", "vintage", F.ln("tvpi").alias("a"), (F.ln("tvpi") + F.col("fund_id") % 7 / 100 - 0.03).alias("b"))


VIEWS = {
    "funds0": """SELECT o_orderkey AS fund_id, o_custkey AS firm_id, o_custkey % 97 AS sponsor_id, year(o_orderdate)::INT AS vintage, o_totalprice AS commitment,
  o_orderkey % 13 = 0 AS not_meaningful, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 17 = 0 END AS sold_secondary, o_orderstatus AS status, o_orderdate::DATE AS as_of,
  row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_totalprice, o_orderkey)::INT AS sequence FROM orders""",
    "funds": """SELECT *, CASE WHEN fund_id % 11 <> 0 THEN CASE WHEN firm_id % 5 = 0 THEN (sequence + 1) // 2 ELSE sequence + sequence // 4 END END::INT AS fund_number FROM funds0""",
    "snap": """SELECT f.*, contributions, distributions, nav, distributions + nav AS total_value, (distributions + nav) / contributions AS tvpi FROM funds f JOIN (
  SELECT l_orderkey AS fund_id, round(sum(l_extendedprice), 6) AS contributions,
    round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 6) AS distributions,
    round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) * (1 + l_tax) ELSE 0 END), 6) AS nav FROM lineitem GROUP BY 1) c USING (fund_id)""",
    "plans": f"""SELECT *, 'FUND ' || fund_id AS fund_name, '{A}' AS source FROM snap WHERE status IN ('F', 'O') UNION ALL SELECT *, 'FUND ' || fund_id, '{B}' FROM snap WHERE status IN ('O', 'P')""",
    "names": "SELECT p_partkey AS fund_id, p_name || ' Partners ' || (" + repr([roman(n) for n in range(1, 13)]) + ")[p_partkey % 12 + 1] || (" + repr(list(SUFFIXES)) + ")[p_partkey % 5 + 1] AS fund_name, (1990 + p_size % 30)::INT AS vintage, p_retailprice AS commitment FROM part",
    "flows": """SELECT l_suppkey AS fund_id, l_shipdate::DATE AS date, round(sum(CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN -l_extendedprice ELSE l_extendedprice * (1 - l_discount) END), 6) AS amount FROM lineitem GROUP BY 1, 2""",
    "navs": "SELECT s_suppkey AS fund_id, abs(s_acctbal) * 1000 AS nav, DATE '2001-12-31' AS nav_date FROM supplier",
    "idx": "SELECT last_day(o_orderdate::DATE) AS date, round(avg(o_totalprice) / 1000, 6) AS level FROM orders GROUP BY 1 UNION ALL SELECT DATE '1994-12-31', 100.0",
    "weekly": """SELECT user_id AS fund_id, date_trunc('week', ts)::DATE AS as_of, sum(CASE WHEN event_type NOT IN ('purchase', 'signup') THEN value ELSE 0 END) AS c, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END) AS d FROM events GROUP BY 1, 2""",
    "snapshots": """SELECT fund_id, as_of, round(CASE WHEN rn = 1 AND fund_id % 3 = 0 THEN 0 WHEN fund_id % 5 = 0 AND day(as_of) = 22 THEN cc - 100 ELSE cc END, 6) AS contributions, round(dd, 6) AS distributions, round(c + d, 6) AS nav FROM (
  SELECT *, sum(c) OVER w AS cc, sum(d) OVER w AS dd, row_number() OVER (PARTITION BY fund_id ORDER BY as_of) AS rn FROM weekly WINDOW w AS (PARTITION BY fund_id ORDER BY as_of ROWS UNBOUNDED PRECEDING))""",
    "reports": "SELECT fund_id, vintage, ln(tvpi) AS a, ln(tvpi) + fund_id % 7 / 100 - 0.03 AS b FROM snap WHERE tvpi > 0",
    "panel": """SELECT *, vintage - prior_vintage AS vintage_gap, fund_number - prior_fund_number AS fund_number_gap FROM (
  SELECT *, lag(y) OVER w AS y_lag, lag(vintage) OVER w AS prior_vintage, lag(fund_number) OVER w AS prior_fund_number, lag(sequence) OVER w AS prior_sequence, ln(commitment) AS log_commitment
  FROM (SELECT *, CASE WHEN tvpi IS NOT NULL THEN ln(greatest(tvpi, 0.01)) END AS y FROM snap) WINDOW w AS (PARTITION BY firm_id ORDER BY sequence, fund_id))""",
    "sample": "SELECT * FROM panel WHERE y IS NOT NULL AND y_lag IS NOT NULL AND vintage IS NOT NULL",
    "tflows": """SELECT fund_id, date, sum(amount) AS amount FROM (SELECT fund_id, date, amount FROM flows UNION ALL
  SELECT n.fund_id, greatest(n.nav_date, l.last), n.nav FROM navs n JOIN (SELECT fund_id, max(date) AS last FROM flows GROUP BY 1) l USING (fund_id)) GROUP BY 1, 2""",
    "leveled": """SELECT f.*, i.level, max(f.date) OVER (PARTITION BY f.fund_id) AS last, last_value(i.level) OVER (PARTITION BY f.fund_id ORDER BY f.date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lend FROM tflows f ASOF JOIN idx i ON f.date >= i.date""",
}


def with_views(sql: str, recursive: bool = False) -> str:
    """``sql`` after the views it needs."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                needed.add(name)
                add(body)

    add(sql)
    heads = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    rest = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if rest:
        recursive = recursive or bool(rest[1])
        sql = sql[rest.end() :]
        heads.append(sql)
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads)
    return (("WITH " + ",\n".join(heads) + "\n") if heads else "") + sql
