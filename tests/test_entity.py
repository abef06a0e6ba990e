from __future__ import annotations

import random

import duckdb
import pytest

from keelson.operators import entity as E
from keelson.sources import disclosures

FUNDS = "fund_id long, fund_name string, firm_id string, fund_number int, vintage int, commitment double, contributions double, distributions double, nav double, total_value double, net_irr double"


def test_share_classes_collapse(frame):
    rows = [(1, "A III C", "A", 3, 2005, 100.0, 80.0, 90.0, 20.0, 110.0, 0.1), (2, "A III D", "A", 3, 2006, 50.0, 40.0, 30.0, 10.0, 40.0, 0.2), (3, "A IV", "A", 4, 2010, 70.0, 60.0, 0.0, 70.0, 70.0, 0.3)]
    out = {r.fund_number: r for r in E.share_class_rollup(frame(FUNDS, rows)).collect()}
    assert len(out) == 2
    r = out[3]
    assert (r.commitment, r.contributions, r.distributions, r.nav, r.total_value, r.vintage, r.net_irr, r.fund_name, r.n_share_classes) == (150, 120, 120, 30, 150, 2005, None, "A III C", 2)
    assert out[4].net_irr == 0.3


def test_unnumbered_funds_stay_apart(frame):
    rows = [(i, f"A {i}", "A", None, 2000, 1.0, 1.0, 1.0, 1.0, 2.0, None) for i in range(3)]
    assert E.share_class_rollup(frame(FUNDS, rows)).count() == 3


PLANS = "fund_id long, fund_name string, source string, firm_id string, fund_number int"
CAL, ORE = E.PRIORITY


@pytest.mark.parametrize("flip", [False, True])
def test_pooling_keeps_all_rows_of_the_first_plan(frame, flip):
    rows = [(1, "x", CAL, "A", 3), (2, "y", CAL, "A", 3), (3, "z", ORE, "A", 3), (4, "w", ORE, "A", 4), (5, "v", ORE, "A", None), (6, "u", CAL, "A", None)]
    got = E.pool_plans(frame(PLANS, rows[::-1] if flip else rows))
    assert sorted(r.fund_id for r in got.collect()) == [1, 2, 4, 5, 6]
    report = E.overlap_report(frame(PLANS, rows)).collect()
    assert [(r.fund_number, r.plans, r.kept, r.n_plans) for r in report] == [(3, f"{CAL} | {ORE}", CAL, 2)]


def test_pooling_refuses_unknown_plans(frame):
    with pytest.raises(ValueError, match="priority"):
        E.pool_plans(frame(PLANS, [(1, "x", "Other", "A", 1)]))
    with pytest.raises(ValueError, match="fund_number"):
        E.pool_plans(frame("firm_id string, source string", [("A", CAL)]))


def test_overrides(frame):
    o = frame("firm_id_raw string, firm_id_canonical string, decision string", [("A1", "A", "merge"), ("A2", "A", "merge"), ("B", "B", "keep_separate"), ("GONE", "A", "merge")])
    f = frame("fund_id int, firm_id_raw string", [(1, "A1"), (2, "A2"), (3, "B"), (4, "C")])
    assert [r.firm_id for r in E.apply_overrides(f, o).orderBy("fund_id").collect()] == ["A", "A", "B", "C"]
    assert [r[0] for r in E.stale_overrides(f, o).collect()] == ["GONE"]
    bad = frame("firm_id_raw string, firm_id_canonical string, decision string", [("A", "B", "merge"), ("B", "C", "merge"), ("A", "D", "maybe")])
    assert {(r.fault, r.key) for r in E.override_faults(bad).collect()} == {("repeated", "A"), ("decision", "A"), ("chained", "B")}


def test_sequence_and_anomalies(frame):
    f = frame("fund_id long, firm_id string, vintage int, commitment double", [(1, "A", 2004, 1.0), (2, "A", 2000, 1.0), (3, "B", 2001, 1.0), (4, "B", 2001, 2.0)])
    got = {r.fund_id: (r.sequence, r.parallel_vintage) for r in E.add_sequence(f).collect()}
    assert got == {1: (2, False), 2: (1, False), 3: (1, True), 4: (2, True)}

    def flags(numbers, vintages):
        rows = [(i, "A", n, v) for i, (n, v) in enumerate(zip(numbers, vintages, strict=True))]
        out = E.vintage_anomalies(frame("fund_id long, firm_id string, fund_number int, vintage int", rows))
        return [r.vintage_anomaly for r in out.orderBy("fund_id").collect()]

    assert flags([3, 4], [2015, 2008]) == [True, True]
    assert any(flags([1, 2, 3, 4], [2000, 2003, 2006, 2020]))
    assert not any(flags([1, 2, 3, 4], [2000, 2003, 2006, 2009]))
    assert not any(flags([None, 2], [2015, 2008]))


def test_trend_residuals_on_the_threshold_have_the_bits_of_the_sql(frame):
    rng = random.Random(5)
    rows, n = [], 0
    for firm in range(400):
        vintage = 1995
        for i in range(rng.randint(1, 12)):
            vintage += rng.choice([0, 0, 1, 1, 2])
            rows.append((n := n + 1, firm or None, i // 2 + 1 if firm % 5 == 0 else i + 1 + i // 4, vintage))
    con = duckdb.connect()
    con.execute("set threads=1")
    con.execute("create table f (fund_id bigint, firm_id bigint, fund_number int, vintage int)")
    con.executemany("insert into f values (?, ?, ?, ?)", rows)
    sql = """SELECT fund_id, CASE WHEN n >= 3 AND spread > 0 THEN vintage - (c + s * fund_number) END FROM (SELECT *, count(*) OVER w AS n, max(fund_number) OVER w - min(fund_number) OVER w AS spread,
      regr_slope(vintage, fund_number) OVER w AS s, regr_intercept(vintage, fund_number) OVER w AS c FROM f WINDOW w AS (PARTITION BY firm_id ORDER BY fund_number, fund_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
    out = E.vintage_anomalies(frame("fund_id long, firm_id long, fund_number int, vintage int", rows), 1.0)
    assert {r.fund_id: r.trend_residual for r in out.collect()} == dict(con.execute(sql).fetchall())


def test_prefix_pairs_are_whole_tokens(frame):
    got = E.prefix_pairs(frame("stem string", [("ACME",), ("ACME GROWTH",), ("ACMES",), ("ACME GROWTH ASIA",)])).collect()
    assert {(r.stem, r.longer) for r in got} == {("ACME", "ACME GROWTH"), ("ACME", "ACME GROWTH ASIA"), ("ACME GROWTH", "ACME GROWTH ASIA")}


def test_report_links(frame):
    page = '<a href="/x/Private-Equity-Quarter-1-2021.pdf">a</a><a href="https://h/PrivateEquity-Q3-2023.pdf">b</a><a href="/x/Private-Equity-Quarter-1-2021.pdf">again</a><a href="/real-estate.pdf">c</a><a href="/private-equity.html">d</a>'
    got = disclosures.report_links(frame("html string", [(page,)]), "https://h").collect()
    assert [(r.url, r.year, r.quarter) for r in got] == [("https://h/PrivateEquity-Q3-2023.pdf", 2023, 3), ("https://h/x/Private-Equity-Quarter-1-2021.pdf", 2021, 1)]


def test_undated_pages_are_an_error(spark, frame, tmp_path):
    with pytest.raises(ValueError, match="date"):
        disclosures.calpers_load(frame("path string, html string", [("a", "<table></table>")]))
    (tmp_path / "r.txt").write_text("Private equity\n2001 Fund A $1 $1 $1 $1 1.0x 2%\n")
    with pytest.raises(ValueError, match="date"):
        disclosures.oregon_load(spark, str(tmp_path / "r.txt"))
    assert disclosures.oregon_load(spark, str(tmp_path / "r.txt"), "2024-03-31").count() == 1


def test_a_review_sheet(frame):
    from keelson.operators import review

    rows = [("A", "A", "Acme Partners II, L.P.", 2001, "x"), ("A", "A", "Acme Growth Partners II", 2001, "y"), ("B II", "B", "B II (A)", 2002, "x"), ("B", "B", "B I", None, "x"), ("C AND", "C AND", "C and III", 2003, "x"), ("C AND", "C AND", "C and IV", 2003, "x")]
    funds = frame("firm_id_raw string, firm_id string, fund_name string, vintage int, source string", rows)
    decided = frame("firm_id_raw string, decision string, reason string", [("C AND", "merge", "known")])
    got = {r.firm_id_raw: r for r in review.family_review(funds, decided).collect()}
    assert got["A"].flags == " ; ".join((review.OVERMERGE, review.SIDECAR, review.DUPLICATE)) and got["A"].needs_review
    assert got["B II"].flags == " ; ".join((review.STRANDED % "II", review.SIBLING)) and got["B II"].neighbour_stems == "B" and got["B II"].n_funds_final == 2
    assert got["C AND"].flags == " ; ".join((review.DANGLING, review.CLASH)) and not got["C AND"].needs_review and got["C AND"].reason == "known"
    assert got["B"].flags == "" and got["B"].vintages == ""
    found = {r.fund_name: r.failure for r in review.diagnose_names(funds).collect()}
    assert found == {"B II (A)": "STRANDED"}


def test_bad_layout_is_an_error(frame):
    with pytest.raises(ValueError, match="missing"):
        disclosures.calpers_parse(frame("Something string", [("x",)]))


def test_manifest(spark, tmp_path):
    from keelson.sources import manifest

    (tmp_path / "oregon_2024-03-31.csv").write_text("a,b\n1,2\n3,4\n")
    first = manifest.build(spark, str(tmp_path / "*.csv"), "snapshot").cache()
    row = first.collect()[0]
    assert (row.as_of, row.rows, row.source) == ("2024-03-31", "2", "Oregon PERS OPERF")
    old = first.withColumn("captured_utc", first.captured_utc.substr(1, 0))
    again = manifest.build(spark, str(tmp_path / "*.csv"), "snapshot", old).collect()[0]
    assert again.captured_utc == ""
    assert manifest.compare(first, first).count() == 0
