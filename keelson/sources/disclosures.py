"""Parsers of the plans' disclosures: HTML tables, report lines, link pages, factor files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.numbers import ratio
from ..schemas import require_columns
from .reportfiles import report_lines_of

# Published column names, source names, URL form, missing codes.
CALPERS_COLUMNS = {
    "Fund": "fund_name",
    "Vintage Year": "vintage",
    "Capital Committed": "commitment",
    "Cash In": "contributions",
    "Cash Out": "distributions",
    "Cash Out & Remaining Value": "total_value",
    "Net IRR": "net_irr",
    "Investment Multiple": "reported_multiple",
}
CALPERS_SOURCE = "CalPERS PEP"
OREGON_SOURCE = "Oregon PERS OPERF"
OREGON_URL = (
    "https://www.oregon.gov/treasury/invested-for-oregon/Documents/"
    "Invested-for-OR-Performance-and-Holdings/%d/"
    "OPERF_Private_Equity_Portfolio_-_Quarter_%d_%d.pdf"
)
OREGON_SITE = "https://www.oregon.gov"
FACTOR_MISSING = (-99.0, -99.99, -999.0)
MILLIONS = 1e6
# The grammar of a report's line (flag, vintage, name, four amounts, rest) and of its file's name.
REPORT_NAME = r"(?i)Q(?:uarter)?[-_ ]?([1-4])[-_ ]((?:19|20)\d{2})"
REPORT_KIND = r"(?i)private[-_ ]?equity"
REPORT_LINE = rf"^(\*\s+)?((?:19|20)\d{{2}})\s+(.+?)\s+({P.MONEY_TOKEN})\s+({P.MONEY_TOKEN})\s+({P.MONEY_TOKEN})\s+({P.MONEY_TOKEN})(.*)$"


def html_tables(pages: DataFrame, html: str = "html", key: str = "path") -> DataFrame:
    """(key, table, row, cells) of every table of a page."""
    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)
        return F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"&amp;", "&")))

    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)).alias("table", "body"))
    rows = tables.select(key, "table", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "tr"))
    return rows.select(key, "table", "row", cells(F.col("tr")).alias("cells"))


def widest_table(rows: DataFrame, key: str = "path") -> DataFrame:
    """The rows of each page's table with the most columns (the first of equals)."""
    width = rows.groupBy(key, "table").agg(F.max(F.size("cells")).alias("_w"))
    best = width.groupBy(key).agg(F.max_by("table", F.struct("_w", -F.col("table"))).alias("table"))
    return rows.join(best, [key, "table"], "left_semi")


def calpers_parse(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The canonical snapshot from the published string table."""
    require_columns(raw, CALPERS_COLUMNS, "CalPERS table")
    df = raw.select(*(F.col(f"`{a}`").alias(b) for a, b in CALPERS_COLUMNS.items()), *([as_of.alias("_day")] if as_of is not None else []))
    df = df.withColumn("fund_name", F.trim("fund_name")).filter("fund_name <> 'Fund'")
    df = df.withColumn("not_meaningful", F.coalesce(F.lower("net_irr").contains("n/m"), F.lit(False)))
    df = df.withColumns({c: P.money_us(F.col(c)) for c in ("commitment", "contributions", "distributions", "total_value")})
    df = df.withColumn("vintage", F.trim("vintage").try_cast("int")).withColumn("net_irr", P.percent(F.col("net_irr")))
    df = df.na.drop(subset=["vintage", "contributions"]).filter("contributions > 0")
    return df.select(F.concat(F.lit("CALPERS::"), "fund_name").alias("fund_id"), "fund_name", "vintage", "commitment", "contributions", "distributions", "total_value", (F.col("total_value") - F.col("distributions")).alias("nav"), ratio(F.col("total_value"), F.col("contributions")).alias("tvpi_reported"), "net_irr", "not_meaningful", F.lit(CALPERS_SOURCE).alias("source"), (F.col("_day") if as_of is not None else F.lit(None).cast("date")).alias("as_of"))


def report_as_of(lines: DataFrame, line: str = "line", number: str = "line_no", key: str = "path") -> DataFrame:
    """(key, as_of): the date of each report's first line that has one; null if none has."""
    day = P.line_date(F.col(line))
    return lines.groupBy(key).agg(F.min_by(day, F.when(day.isNotNull(), F.col(number))).alias("as_of"))


def is_fund_line(line: Column) -> Column:
    text = F.trim(line)
    return (text != "") & ~F.lower(text).startswith("total") & text.rlike(REPORT_LINE)


def report_lines(lines: DataFrame, line: str = "line", as_of: Column | None = None) -> DataFrame:
    """The canonical snapshot from a report's text lines."""
    df = lines.withColumn("_l", F.trim(line)).filter(is_fund_line(F.col("_l")))
    group = lambda i: F.regexp_extract("_l", REPORT_LINE, i)
    df = df.withColumns({"_star": group(1), "vintage": group(2).cast("int"), "fund_name": F.trim(group(3)), "_tail": group(8), **{c: P.money_paren(group(i)) * MILLIONS for i, c in ((4, "commitment"), (5, "contributions"), (6, "distributions"), (7, "nav"))}})
    df = df.filter((F.col("fund_name") != "") & (F.lower("fund_name") != "partnership"))
    total = F.col("distributions") + F.col("nav")
    return df.select(F.concat(F.lit("OPERF::"), "fund_name").alias("fund_id"), "fund_name", "vintage", "commitment", "contributions", "distributions", total.alias("total_value"), "nav", ratio(total, F.col("contributions")).alias("tvpi_reported"), P.tail_multiple(F.col("_tail")).alias("reported_multiple"), P.tail_percent(F.col("_tail")).alias("net_irr"), P.not_meaningful(F.col("_tail")).alias("not_meaningful"), (F.col("_star") != "").alias("sold_secondary"), (F.col("contributions") <= 0).alias("fully_uncalled"), F.lit(OREGON_SOURCE).alias("source"), (as_of if as_of is not None else F.lit(None).cast("date")).alias("as_of"))


def report_links(pages: DataFrame, base: str = OREGON_SITE, html: str = "html") -> DataFrame:
    """(url, file, year, quarter) of the private-equity reports that pages link to, newest first.

    Year and quarter are those of the file's name, whatever folder holds it;
    a file whose name has no quarter is left out.
    """
    href = F.explode(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+\.pdf)"'), 1))
    found = pages.select(href.alias("href")).distinct().filter(F.col("href").rlike(REPORT_KIND))
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim("href", F.lit("/"))))
    named = found.select(url.alias("url")).distinct().withColumn("file", F.substring_index("url", "/", -1))
    part = lambda i: F.regexp_extract("file", REPORT_NAME, i).try_cast("int")
    dated = named.withColumns({"year": part(2), "quarter": part(1)}).filter("quarter is not null")
    return dated.orderBy(F.desc("year"), F.desc("quarter"), "url")


def quarter_url(year: Column, quarter: Column) -> Column:
    return F.format_string(OREGON_URL, year, quarter, year)


def factors(lines: DataFrame, line: str = "value") -> DataFrame:
    """Monthly factors as fractions from a text file with prose and an annual block."""
    parts = F.split(line, ",")
    df = lines.select(F.transform(parts, lambda p: F.trim(p)).alias("p")).filter((F.size("p") >= 5) & F.col("p")[0].rlike(r"^\d{6}$"))
    value = lambda i: F.when(~F.col("p")[i].try_cast("double").isin(*FACTOR_MISSING), F.col("p")[i].try_cast("double") / 100)
    return df.select(F.last_day(F.to_date(F.col("p")[0], "yyyyMM")).alias("date"), *(value(i).alias(n) for i, n in ((1, "mkt_rf"), (2, "smb"), (3, "hml"), (4, "rf"))))


def pdf_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, page, line_no, line) of reports' text, in reading order; reports come as the text that a PDF tool took from them."""
    return report_lines_of(spark, pattern)


def _dated(rows: DataFrame, dates: DataFrame, key: str, as_of: str | None, what: str) -> DataFrame:
    """``rows`` with the date of the file each is from; a file without one is an error."""
    if as_of:
        return rows.withColumn("_as_of", F.lit(as_of).cast("date"))
    # at most five rows
    lacking = [r[0] for r in dates.filter("_as_of is null").select(key).limit(5).collect()]
    if lacking:
        raise ValueError(f"{what} without a reporting date; pass as_of, for the day of download would misalign plans: {lacking}")
    return rows.join(dates, key)


def oregon_load(spark: SparkSession, pattern: str, as_of: str | None = None) -> DataFrame:
    """The snapshots of all reports, each dated by itself unless ``as_of`` is given; a report without a date or without rows is an error."""
    lines = pdf_lines(spark, pattern)
    day = P.line_date(F.col("line"))
    files = lines.groupBy("path").agg(F.min_by(day, F.when(day.isNotNull(), F.col("line_no"))).alias("_as_of"), F.count_if(is_fund_line(F.col("line"))).alias("_rows"))
    # at most five rows
    empty = [r[0] for r in files.filter("_rows = 0").select("path").limit(5).collect()]
    if empty:
        raise ValueError(f"reports without a fund: {empty}")
    return report_lines(_dated(lines, files.select("path", "_as_of"), "path", as_of, "reports"), as_of=F.col("_as_of"))


def calpers_load(pages: DataFrame, as_of: str | None = None, html: str = "html", key: str = "path") -> DataFrame:
    """The snapshots in all pages' widest tables, each dated by its page unless ``as_of`` is given; a page without a date is an error."""
    dates = pages.groupBy(key).agg(F.max(P.banner_date(F.col(html))).alias("_as_of"))
    rows = widest_table(html_tables(pages, html, key), key)
    heads = rows.filter("row = 0").select(key, F.col("cells").alias("_names"))
    # rows of another width than their head are no funds
    named = rows.filter("row > 0").join(heads, key).filter("size(cells) = size(_names)").withColumn("_m", F.map_from_arrays("_names", "cells"))
    dated = _dated(named, dates, key, as_of, "pages")
    return calpers_parse(dated.select(*(F.col("_m")[c].alias(c) for c in CALPERS_COLUMNS), "_as_of"), F.col("_as_of"))
