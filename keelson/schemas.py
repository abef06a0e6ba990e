"""Schemas of the engine's tables, and checks of what operators are given."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


S, I, D, B, DATE = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.DateType()

SNAPSHOT = _struct(fund_id=S, fund_name=S, vintage=I, commitment=D, contributions=D, distributions=D, total_value=D, nav=D, tvpi_reported=D, reported_multiple=D, net_irr=D, not_meaningful=B, sold_secondary=B, fully_uncalled=B, source=S, as_of=DATE)
CASHFLOW = _struct(fund_id=S, date=DATE, amount=D)
BENCHMARK = _struct(date=DATE, level=D)
FACTORS = _struct(date=DATE, mkt_rf=D, smb=D, hml=D, rf=D)
FAMILY_OVERRIDES = _struct(firm_id_raw=S, firm_id_canonical=S, decision=S, confidence=S, reason=S)
SPONSOR_OVERRIDES = _struct(firm_id=S, sponsor_id=S, confidence=S, reason=S)
MANIFEST = _struct(kind=S, file=S, source=S, as_of=S, captured_utc=S, sha256=S, rows=S)


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """``df``, or a ValueError that names the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """``df``, or a ValueError if a key repeats. Costs a shuffle, so callers opt in."""
    if not df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():
        raise ValueError(f"{what} repeats {keys}")
    return df
