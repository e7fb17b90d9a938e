"""Readers and writers on small files; the sliding windows as a stream."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lynxmark.sources import readers, sinks
from lynxmark.sources.layout import INDEX, plain
from lynxmark.streaming.bursts import sliding_counts


@pytest.mark.parametrize("charset,told", [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("cp950", "x-windows-950"), ("utf-16", "UTF-16")])
@pytest.mark.parametrize("sep", [",", "\t"])
def test_csv_encodings(spark, tmp_path, charset, told, sep):
    text = f'機構代碼{sep}機構名稱{sep}現有幼生數\r\nK1{sep}"陽光{sep}一園\n分班"{sep}"1,200 人"\r\nK2{sep}{sep}－\r\n'
    (tmp_path / "a.csv").write_bytes(text.encode(charset))
    path = f"file://{tmp_path}/a.csv"
    assert readers.encoding(spark, path) == told
    got = readers.normalize(readers.read_csv(spark, path), "institutions").orderBy("inst_id").collect()
    assert [tuple(r) for r in got] == [("K1", f"陽光{sep}一園\n分班", 1200), ("K2", None, None)]


def test_latin_is_last(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"name,city\ncaf\xe9,x\n")
    assert readers.encoding(spark, f"file://{tmp_path}/a.csv") == "ISO-8859-1"


def test_json_list_and_first_list_of_an_object(spark, tmp_path):
    rows = [{"id": "K1", "罰鍰": "30,000", "裁處日期": "112/03/05"}, {"id": "K2", "罰鍰": None, "裁處日期": "x"}]
    for name, value in {"l": rows, "o": {"total": 2, "z": rows, "a": [1]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value), encoding="utf-8")
        got = readers.normalize(readers.read_any(spark, f"file://{tmp_path}/{name}.json"), "penalties").orderBy("inst_id").collect()
        assert [(r.inst_id, r.fine_amount, r.penalty_date) for r in got] == [("K1", 30000, date(2023, 3, 5)), ("K2", None, None)]
    (tmp_path / "none.json").write_text('{"a": 1}')
    assert readers.read_any(spark, f"file://{tmp_path}/none.json").isEmpty()


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("K1", "a <b> & c", 1.5), ("K2", None, None), ("K3", "", 2.0)], "inst_id string, name string, score double")
    path = f"file://{tmp_path}/book.xlsx"
    sinks.write_workbook({"list & more": df, "second": df.select("name")}, path)
    got = readers.read_any(spark, path).collect()
    assert [tuple(r) for r in got] == [("K1", "a <b> & c", "1.5"), ("K2", None, None), ("K3", None, "2.0")]


def test_columns_of_a_sheet():
    assert [readers.column_number(x) for x in ("A", "Z", "AA", "AZ", "BA", "")] == [0, 25, 26, 51, 52, 0]


def test_header_names():
    assert INDEX[plain(" 機構（名稱） ")] == "name" and INDEX[plain("Inst-ID")] == "inst_id"
    assert INDEX[plain("年度")] == "eval_year" and plain("nothing") not in INDEX


def test_bundle(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir(), second.mkdir()
    (first / "institutions_official.csv").write_text("id,name\nK9,long\n")
    (first / "institutions.csv").write_text("id,name,_note,other\nK1,short,n,o\n")
    (second / "penalties.csv").write_text("id,date\n")
    (second / "posts.csv").write_text("id,content\nP1,text\n")
    (first / "manifest.json").write_text(json.dumps({"ledger": f"file://{second}/kept.csv"}))
    (second / "kept.csv").write_text("統一編號,會計年度,決算數\nK1,112,(5)\n")
    got = readers.load_tables(spark, [f"file://{first}", f"file://{second}", f"file://{tmp_path}/none"])
    assert set(got.tables) == {"institutions", "penalties", "evaluations", "financials", "ledger", "posts"}
    assert [r.asDict() for r in got.tables["institutions"].collect()] == [{"inst_id": "K1", "name": "short", "_note": "n"}]
    assert got.tables["ledger"].select("inst_id", "amount").collect()[0] == ("K1", -5)
    assert got.tables["penalties"].isEmpty() and "penalties: not provided" in got.warnings
    assert dict(got.tables["financials"].dtypes)["surplus"] == "bigint"


def test_guarded_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert sinks.guarded_overwrite(spark.range(5), path)
    assert not sinks.guarded_overwrite(spark.range(4), path)
    assert spark.read.parquet(path).count() == 5
    assert sinks.guarded_overwrite(spark.read.parquet(path).union(spark.range(1)), path)
    assert spark.read.parquet(path).count() == 6 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_append_and_split(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(1, 5), (2, 6), (2, 7), (None, 8)], "k int, w int")
    got = sorted(map(str, map(tuple, sinks.append_new(old, new, ["k"]).collect())))
    assert got == sorted(map(str, [(1, "a", None), (None, "b", None), (2, None, 6), (2, None, 7), (None, None, 8)]))
    good, bad = sinks.split_rejects(new, {"big": F.col("w") > 6, "two": F.col("k") == 2})
    assert [r.w for r in good.collect()] == [5] and sorted((r.w, r.reason) for r in bad.collect()) == [(6, "two"), (7, "big"), (8, "big")]


def test_files_of_reports(spark, tmp_path):
    df = spark.createDataFrame([("K1", ["a", "b"]), ("K2", None)], "inst_id string, top_reasons array<string>")
    sinks.write_risk_csv(df, f"file://{tmp_path}/c")
    assert {r.top_reasons for r in spark.read.option("header", True).csv(f"file://{tmp_path}/c").collect()} == {"a；b", None}
    sinks.write_json_files(df, f"file://{tmp_path}/j", "inst_id")
    assert (tmp_path / "j" / "_key=K1").is_dir()
    assert {r[0] for r in df.select(sinks.report_text({"Id": "inst_id"})).collect()} == {"Id: K1", "Id: K2"}
    assert sinks.write_templates({"a": df.select("inst_id"), "b": df.limit(0)}, f"file://{tmp_path}/t") == [f"file://{tmp_path}/t/a"]
    assert "﻿inst_id" in next((tmp_path / "t" / "a").glob("*.csv")).read_text(encoding="utf-8")


def test_stream_counts_like_the_table(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 5)), (1, datetime(2024, 1, 2, 5)), (2, datetime(2024, 1, 1, 9)), (9, datetime(2024, 3, 1))]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp")
    events.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = sliding_counts(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in"))
    stream.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination(120)
    closed = sliding_counts(events).where("user_id < 9")
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in closed.collect()} and got
