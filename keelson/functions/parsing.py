"""Money, percentages, multiples and dates out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of the disclosures.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
AS_OF_BANNER = rf"[Aa]s of\s+((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})"
AS_OF_LINE = r"(?i)As of\s+(.+?)\s*$"
PERCENT = r"(-?\d+\.?\d*)\s*%"
PERCENT_TAIL = r"(-?[\d,]+\.?\d*)\s*%"
MULTIPLE_TAIL = r"(?i)(-?[\d,]+\.?\d*)\s*x"
NOT_MEANINGFUL = r"(?i)n\.?\s*m\.?"
MONEY_TOKEN = r"\(?-?\$-?[\d,]+\.?\d*\)?"


def _number(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, ",", ""), F.lit("")).try_cast("double")


def money_us(text: Column) -> Column:
    """'$1,234' to 1234.0; dashes, blanks and words to null."""
    return F.regexp_replace(text, r"[\$,\s]", "").try_cast("double")


def money_paren(text: Column) -> Column:
    """'$1,234.5' to 1234.5; '($3.0)' and '-$3.0' to -3.0; no digit to null."""
    digits = F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
    return F.when(F.trim(text).rlike(r"^(\(|-\$)"), -digits).otherwise(digits)


def percent(text: Column) -> Column:
    """The first percentage as a fraction; a footnote after it is ignored."""
    return F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit("")).try_cast("double") / 100


def tail_multiple(tail: Column) -> Column:
    return _number(F.regexp_extract(tail, MULTIPLE_TAIL, 1))


def tail_percent(tail: Column) -> Column:
    return _number(F.regexp_extract(tail, PERCENT_TAIL, 1)) / 100


def not_meaningful(tail: Column) -> Column:
    return tail.rlike(NOT_MEANINGFUL)


def banner_date(html: Column) -> Column:
    """'As of September 30, 2025' anywhere in a page; null if absent or no date."""
    return F.try_to_date(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, AS_OF_BANNER, 1), ",", ""), r"\s+", " "), "MMMM d yyyy")


def line_date(line: Column) -> Column:
    """The date of a line that ends in 'As of <date>'."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, AS_OF_LINE, 1), ",", ""), r"\s+", " ")
    return F.coalesce(F.try_to_date(text, "MMMM d yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)
