from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keelson.functions import names as N
from keelson.functions import parsing as P


def values(frame, fn, texts):
    rows = frame("i int, s string", list(enumerate(texts)))
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("s")).alias("v")).collect()]


def test_roman_rule():
    assert [N.roman(n) for n in (1, 4, 9, 14, 40, 49, 60)] == ["I", "IV", "IX", "XIV", "XL", "XLIX", "LX"]


def test_stems_of_one_family_agree(frame):
    assert values(frame, N.family_stem, ["Acme Capital Partners VII, L.P.", "Acme Capital Partners VI"]) == ["ACME CAPITAL PARTNERS"] * 2


def test_unnumbered_first_fund_keeps_its_own_stem(frame):
    assert values(frame, N.family_stem, ["Acme Partners", "Acme Partners II"]) == ["ACME", "ACME PARTNERS"]


def test_numeral_class_of_the_stem(frame):
    assert values(frame, N.family_stem, ["Acme Fund III D", "Acme Fund III I"]) == ["ACME FUND III D", "ACME FUND III"]


@pytest.mark.parametrize(
    ("name", "number"),
    [("Harbour Capital Partners V", 5), ("Osprey Fund 6 SCSp", 6), ("Larch International GPE VII-C", 7), ("BVB Capital Partners IX (A)", 9), ("41 Lamps Global Opportunities Fund 2", 2), ("Mistral XI Opportunities Fund I", 11), ("QQR 2006 Fund", None), ("The Tide Fund", None), ("Acme Fund L.P.", None), (None, None)],
)
def test_fund_number(frame, name, number):
    assert values(frame, N.fund_number, [name]) == [number]


def test_stranded_token(frame):
    assert values(frame, N.stranded_number, ["BVB Capital Partners IX (A)", "Acme Growth"]) == ["IX", ""]


def test_sponsor(frame):
    assert values(frame, N.sponsor_token, ["THE TIDE FUND", "COPPER POND PARTNERS", "THE", "", None]) == ["TIDE", "COPPER", "THE", "", None]


def test_money_and_percent(frame):
    assert values(frame, P.money_us, ["$1,234,567", "-", "", None]) == [1234567.0, None, None, None]
    assert values(frame, P.money_paren, ["$50.0", "$1,234.5", "$0.0", "($3.0)", "-$0.3", "n/a"]) == [50, 1234.5, 0, -3, -0.3, None]
    assert values(frame, P.percent, ["5.7%", "14.1%  1", "N/M 1", "-18.5%"]) == pytest.approx([0.057, 0.141, None, -0.185])


def test_banner_date(frame):
    got = values(frame, P.banner_date, ["x as of September 30, 2025 y", "As of June 3 2020", "as of today", None])
    assert [str(d) if d else None for d in got] == ["2025-09-30", "2020-06-03", None, None]
