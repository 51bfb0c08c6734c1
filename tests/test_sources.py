import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quarry.sources import days, documents, logs, reports

D = dt.date


def test_changed_days_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(D(2024, 1, 1), 1, "a"), (D(2024, 1, 2), 2, "b")], "day date, k int, v string")
    assert days.write_changed(rows, path, ["k"]) == 2
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    changed = spark.createDataFrame([(D(2024, 1, 1), 1, "a"), (D(2024, 1, 2), 2, "c")], "day date, k int, v string")
    assert days.write_changed(changed, path, ["k"]) == 1
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(set(before.items()) & set(after.items())) == 1
    assert [r["v"] for r in days.read_days(spark, path, [D(2024, 1, 2)]).collect()] == ["c"]
    assert days.read_days(spark, path, lambda d: d < D(2024, 1, 2)).count() == 1
    assert days.read_days(spark, path, days.ALL_DAYS).count() == 2
    with pytest.raises(TypeError):
        days.read_days(spark, path, "2024-01-01")


def test_day_index(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), "s", [1, 2]), (D(2024, 1, 1), "t", [2])], "day date, section string, people array<int>")
    r = days.day_index(df, "section", "people").first()
    assert (r["sections"], r["people"]) == (["s", "t"], [1, 2])


def test_audit_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"ts": "2024-01-01T00:00:00", "event": "login"}) + "\nnot json\n\n" + json.dumps({"event": "no time"}) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({"ts": "2024-01-02T00:00:00", "event": "write", "status": "denied"}) + "\n")
    got = sorted((r["event"], r["status"], len(r["id"])) for r in logs.read_audit(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")).collect())
    assert got == [("login", "ok", 16), ("write", "denied", 16)]


def test_multi_line_records_and_tail(spark):
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["lost", "2024 ERROR x", "  at y", "2024 INFO z"])], "file string, at int, value string")
    got = logs.assemble(lines, "file", "at", "value", F.col("value").rlike("^2024"))
    assert sorted(r["text"] for r in got.collect()) == ["2024 ERROR x\n  at y", "2024 INFO z"]
    assert logs.at_least(got, F.regexp_extract("text", r"^\d+ (\w+)", 1), "ERROR").count() == 1
    assert [r["at"] for r in logs.tail(lines, "at", 2).collect()] == [3, 2]
    assert [r["at"] for r in logs.recent(lines, "at", 10, file="f", value=None).collect()][0] == 3


def test_append_once(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "log")
    assert logs.append_once(df, path, "b1") and not logs.append_once(df, path, "b1")
    assert spark.read.json(path).count() == 3


def test_document_tables(spark, tmp_path):
    (tmp_path / "roster_1.html").write_bytes("<table><tr><th>code</th><th>name</th></tr><tr><td>7</td><td>A&amp;B</td></tr><tr><td>7</td><td>C</td></tr></table>".encode())
    (tmp_path / "x.html").write_bytes("<table><tr><td>سلام</td></tr></table>".encode("cp1256"))
    files = documents.with_role(documents.scan(spark, str(tmp_path)), [("^roster", "roster")])
    assert sorted(r["role"] for r in files.select("role").collect()) == ["other", "roster"]
    records = documents.table_rows(files)
    assert records.where("raw = 'سلام'").count() == 1
    got = sorted((r["code"], r["name"], r["duplicate"]) for r in documents.roster(records, "code", "name").collect())
    assert got == [("7", "A&B", True), ("7", "C", True)]
    stage = documents.write_stage(records.select("path", "raw"), str(tmp_path / "out" / "stage"))
    assert stage.count() == 4 and documents.write_stage(records.select("path", "raw").limit(0), str(tmp_path / "out" / "stage")).count() == 4


def test_report_files(spark, tmp_path):
    reports.write_csv(spark.range(2), str(tmp_path / "r"), [("id", "Number")])
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).columns == ["Number"]
