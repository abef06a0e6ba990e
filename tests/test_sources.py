"""Sources and sinks on files of their own."""

from __future__ import annotations

import datetime
import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from keelson.functions.numbers import round_half_even
from keelson.schemas import FAMILY_OVERRIDES, SPONSOR_OVERRIDES
from keelson.sources import archive, disclosures, manifest, readers, reportfiles

DATED = "source string, as_of date, nav double"
Q1, Q2, Q3 = (datetime.date(2020, m, d) for m, d in ((3, 31), (6, 30), (9, 30)))


def told(spark, path):
    return sorted(tuple(r) for r in archive.read_archive(spark, path).select("source", "as_of", "nav").collect())


# ---- the archive -----------------------------------------------------------


def test_archive_grows_and_known_dates_stay(spark, frame, tmp_path):
    path = str(tmp_path / "archive")
    assert archive.append_only_sink(frame(DATED, [("Plan A", Q1, 1.0), ("Plan A", Q2, 2.0)]), path) == ["source=Plan A/as_of=2020-03-31", "source=Plan A/as_of=2020-06-30"]
    assert archive.append_only_sink(frame(DATED, [("Plan A", Q2, 9.0), ("Plan A", Q3, 3.0), ("B/C", Q2, 4.0)]), path) == ["source=B%2FC/as_of=2020-06-30", "source=Plan A/as_of=2020-09-30"]
    assert told(spark, path) == [("B/C", Q2, 4.0), ("Plan A", Q1, 1.0), ("Plan A", Q2, 2.0), ("Plan A", Q3, 3.0)]
    # nothing new, and nothing left behind
    assert archive.append_only_sink(frame(DATED, [("B/C", Q2, 7.0), ("Plan A", Q1, 7.0)]), path) == []
    assert archive.append_only_sink(frame(DATED, []), path) == []
    assert sorted(p.name for p in (tmp_path / "archive").iterdir() if not p.name.startswith(".")) == ["source=B%2FC", "source=Plan A"]


def test_archive_takes_no_row_without_a_date(spark, frame, tmp_path):
    path = str(tmp_path / "archive")
    with pytest.raises(ValueError, match="can't be archived"):
        archive.append_only_sink(frame(DATED, [("A", Q1, 1.0), ("A", None, 2.0)]), path)
    assert archive.partitions(spark, path) == []
    with pytest.raises(ValueError, match="missing columns"):
        archive.append_only_sink(frame("source string", [("A",)]), path)


def test_two_writers_of_one_date(spark, frame, tmp_path, monkeypatch):
    """Both see an archive without the date; one copy of it stays, whole."""
    path, both, added = str(tmp_path / "archive"), threading.Barrier(2), []
    seen, first = archive.partitions, {}

    def late(spark, where, depth):
        found = seen(spark, where, depth)
        if where == path and threading.get_ident() not in first:
            first[threading.get_ident()] = True
            both.wait(60)
        return found

    monkeypatch.setattr(archive, "partitions", late)
    frames = [frame(DATED, [("A", Q1, float(w)) for _ in range(50)]) for w in (1, 2)]
    writers = [threading.Thread(target=lambda f=f: added.append(archive.append_only_sink(f, path))) for f in frames]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(map(len, added)) == [0, 1]
    rows = told(spark, path)
    assert len(rows) == 50 and len(set(rows)) == 1


def test_a_move_onto_a_taken_place_is_refused(spark, tmp_path):
    for name in ("new", "old"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    assert not archive._moved(spark, str(tmp_path / "new"), str(tmp_path / "old"))
    assert (tmp_path / "old" / "x").read_text() == "old" and [p.name for p in (tmp_path / "old").iterdir()] == ["x"]


# ---- report files ----------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_lines_of_pieces(size):
    raw = "one\r\ntwo é\n\fthree\fvier\n\nlast".encode()
    pieces = [raw[i : i + size] for i in range(0, len(raw), size)]
    assert list(reportfiles.lines_of(iter(pieces))) == [(0, "one"), (0, "two é"), (0, ""), (1, "three"), (2, "vier"), (2, ""), (2, "last")]
    assert list(reportfiles.lines_of(iter([b"broken \xff"]))) == [(0, "broken �")]
    assert list(reportfiles.lines_of(iter([]))) == []


def test_reports_keep_their_own_numbers_and_dates(spark, tmp_path):
    row = "2001 Fund {} $1.0 $2.0 $3.0 $4.0 1.5x 10.0%"
    (tmp_path / "a.txt").write_text("Private equity\nAs of March 31, 2024\n" + row.format("A") + "\n\f" + row.format("B") + "\nTotal $1\n")
    (tmp_path / "b.txt").write_text("As of nothing\nAs of June 30, 2024\n" + row.format("A") + "\nAs of June 30, 2030\n")
    (tmp_path / "_notes").write_text("no report")
    lines = disclosures.pdf_lines(spark, str(tmp_path / "*"))
    assert lines.rdd.getNumPartitions() == 2
    got = sorted((r.path.rpartition("/")[2], r.line_no, r.page) for r in lines.filter("line like '2001%'").collect())
    assert got == [("a.txt", 2, 0), ("a.txt", 4, 1), ("b.txt", 2, 0)]
    loaded = disclosures.oregon_load(spark, str(tmp_path / "*"))
    assert sorted((r.fund_name, r.as_of) for r in loaded.collect()) == [("Fund A", datetime.date(2024, 3, 31)), ("Fund A", datetime.date(2024, 6, 30)), ("Fund B", datetime.date(2024, 3, 31))]
    assert {r.as_of for r in disclosures.oregon_load(spark, str(tmp_path / "*"), "2020-01-01").collect()} == {datetime.date(2020, 1, 1)}
    (tmp_path / "c.txt").write_text(row.format("C"))
    with pytest.raises(ValueError, match="without a reporting date.*c.txt"):
        disclosures.oregon_load(spark, str(tmp_path / "*"))
    (tmp_path / "d.txt").write_text("As of June 30, 2024\nnothing\n")
    with pytest.raises(ValueError, match="without a fund.*d.txt"):
        disclosures.oregon_load(spark, str(tmp_path / "*"))
    with pytest.raises(FileNotFoundError):
        disclosures.pdf_lines(spark, str(tmp_path / "none*"))


def test_long_reports_come_in_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(40_000)))
    got = disclosures.pdf_lines(spark, str(tmp_path / "long.txt")).agg(F.count("*"), F.max("line_no"), F.sum((F.col("line") == F.concat(F.lit("line "), F.col("line_no"))).cast("int"))).first()
    assert tuple(got) == (40_000, 39_999, 40_000)


def test_pages_of_several_dates(spark, frame, tmp_path):
    head = "".join(f"<th>{c.replace('&', '&amp;')}</th>" for c in disclosures.CALPERS_COLUMNS)
    for name, day in (("a", "June 30, 2024"), ("b", "September 30, 2024")):
        cells = "".join(f"<td>{v}</td>" for v in (f"Fund {name}", 2001, "$9", "$5", "$4", "$8", "N/M", "1.0x"))
        (tmp_path / f"{name}.html").write_bytes(f"<p>As of {day}</p><table><tr>{head}</tr><tr>{cells}</tr></table>".encode() + b"\xff")
    pages = reportfiles.web_pages(spark, str(tmp_path / "*.html"))
    assert sorted((r.fund_name, r.as_of.month) for r in disclosures.calpers_load(pages).collect()) == [("Fund a", 6), ("Fund b", 9)]
    with pytest.raises(ValueError, match="pages without a reporting date"):
        disclosures.calpers_load(pages.unionByName(frame("path string, html string", [("x", "<p>")])))


# ---- manifest, overrides, files --------------------------------------------


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_digests_of_files_in_pieces(spark, frame, tmp_path, chunk):
    rng, want = random.Random(1), {}
    for i, size in enumerate((0, 1, 6, 7, 8, 5000)):
        raw = bytes(rng.choice(b"ab\n") for _ in range(size))
        (tmp_path / f"{i}.csv").write_bytes(raw)
        want[f"file:{tmp_path}/{i}.csv"] = (hashlib.sha256(raw).hexdigest(), raw.count(b"\n"))
    got = manifest.digests(frame("path string", [(p,) for p in want]), chunk)
    assert {r.path: (r.sha256, r.newlines) for r in got.collect()} == want


HEADER = "firm_id_raw,firm_id_canonical,decision,confidence,reason\n"


@pytest.mark.parametrize(("rows", "fault"), [("A,B,maybe,,\n", "decision"), ("A,B,merge,,\nA,C,merge,,\n", "repeated"), ("A,B,merge,,\nB,C,merge,,\n", "chained")])
def test_faulty_overrides_are_errors(spark, tmp_path, rows, fault):
    (tmp_path / "o.csv").write_text(HEADER + "# reviewed by hand\n" + rows)
    with pytest.raises(ValueError, match=fault):
        readers.override_scan(spark, str(tmp_path / "o.csv"), FAMILY_OVERRIDES)


def test_overrides(spark, tmp_path):
    path = tmp_path / "o.csv"
    assert readers.override_scan(spark, str(path), FAMILY_OVERRIDES).collect() == []
    path.write_text("# a comment\n" + 'reason,firm_id_raw,firm_id_canonical,decision,confidence\n"of ""one"", two",A,B,merge,\n# more\n,B,,keep_separate,high\n')
    assert sorted(tuple(r) for r in readers.override_scan(spark, str(path), FAMILY_OVERRIDES).collect()) == [("A", "B", "merge", "", 'of "one", two'), ("B", "", "keep_separate", "high", "")]
    path.write_text("firm_id_raw,decision\nA,merge\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.override_scan(spark, str(path), FAMILY_OVERRIDES)
    sponsors = tmp_path / "s.csv"
    sponsors.write_text("firm_id,sponsor_id,confidence,reason\nA,S,,\nA,T,,\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.override_scan(spark, str(sponsors), SPONSOR_OVERRIDES)
    sponsors.write_text("firm_id,sponsor_id,confidence,reason\nA,S,,\nB,S,high,x\n")
    assert readers.override_scan(spark, str(sponsors), SPONSOR_OVERRIDES).count() == 2


def test_resolve_latest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.resolve_latest(spark, str(tmp_path / "now.csv"), str(tmp_path / "plan_[0-9]*.csv"))
    for name in ("plan_2020-03-31.csv", "plan_2020-12-31.csv", "plan_x.csv"):
        (tmp_path / name).write_text("a\n")
    assert readers.resolve_latest(spark, str(tmp_path / "now.csv"), str(tmp_path / "plan_[0-9]*.csv")).endswith("/plan_2020-12-31.csv")
    (tmp_path / "now.csv").write_text("a\n")
    assert readers.resolve_latest(spark, str(tmp_path / "now.csv"), "") == str(tmp_path / "now.csv")


def test_fetch_and_download_once(spark, tmp_path):
    (tmp_path / "page.html").write_bytes("é".encode() + b"\xff!")
    url, target = f"file://{tmp_path}/page.html", tmp_path / "kept.html"
    assert readers.fetch_text(url) == "é!"
    assert readers.download_once(spark, url, str(target))
    assert target.read_bytes() == (tmp_path / "page.html").read_bytes()
    (tmp_path / "page.html").write_text("other")
    assert not readers.download_once(spark, url, str(target))
    assert "other" not in target.read_text(errors="ignore") and not list(tmp_path.glob("*.part"))


def test_csv_sink_replaces(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    for v in ("first", 'a "quoted", one'):
        readers.csv_sink(frame("k long, v string", [(1, v)]), path)
    schema = frame("k long, v string", []).schema
    assert [tuple(r) for r in readers.csv_scan(spark, path, schema).collect()] == [(1, 'a "quoted", one')]


# ---- rounding and streams --------------------------------------------------


@pytest.mark.parametrize("digits", [0, 2, 3, 4])
def test_rounding_is_of_the_binary_value(frame, digits):
    rng = random.Random(3)
    values = [2.675, 1.005, 0.125, 0.375, -2.675, -0.125, 0.5, 1.5, 2.5, -0.5, 1e15 + 0.5, 2.0**60, 0.0, 1e-9, 0.285, 1.115]
    values += [k / 1000 + 0.0005 for k in range(200)] + [k / 16 for k in range(-100, 100)] + [rng.uniform(-1e4, 1e4) for _ in range(500)]
    df = frame("i long, x double", list(enumerate(values))).withColumn("r", round_half_even(F.col("x"), digits))
    for r in df.collect():
        assert r.r == round(r.x, digits), r.x
    assert frame("x double", [(None,)]).select(round_half_even(F.col("x"), 2).alias("r")).first().r is None


def test_stream_reads_its_state_back(spark, tmp_path):
    from keelson.streaming import differencing

    schema = "fund_id long, as_of date, contributions double, distributions double"
    parts = [
        [(1, Q1, 100.0, 0.0), (2, Q1, 50.0, 5.0)],
        # a restated decrease, and a report that comes too late
        [(1, Q2, 90.0, 30.0), (1, datetime.date(2019, 12, 31), 500.0, 500.0)],
        [(1, Q3, 95.0, 30.0), (2, Q3, 50.0, 5.0)],
    ]
    path = str(tmp_path)
    with differencing.with_state(spark, 2):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
            query = differencing.stream_flows(spark.readStream.schema(schema).parquet(f"{path}/in")).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(differencing.OUT).parquet(f"{path}/out").collect())
    assert got == [(1, Q1, -100.0), (1, Q2, 30.0), (1, Q3, -5.0), (2, Q1, -45.0)]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
