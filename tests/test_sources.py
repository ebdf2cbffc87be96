import gzip
import json

import pytest

from pyspark.sql import functions as F

from civitally.sources import landed, sinks
from civitally.sources.schemas import RAW_RECORD
from civitally.streaming import payments


def test_payload_shapes(spark, tmp_path):
    bodies = [
        [{"A": 1, "B": "x"}],
        {"k": json.dumps([{"A": 2}]), "l": [{"A": 3}], "m": "zz", "n": 7, "o": json.dumps({"A": 9})},
        {}, "text",
    ]
    for i, body in enumerate(bodies):
        (tmp_path / f"{i}.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("{broken")
    rows = landed.project_records(landed.flatten_payloads(landed.read_payloads(spark, str(tmp_path))), ["A", "B"])
    assert sorted((r["A"], r["B"]) for r in rows.collect()) == [("1", "x"), ("2", None), ("3", None)]


def test_union_of_different_records(spark):
    a = spark.createDataFrame([(1, "x")], "WORK_ID int, Z string")
    b = spark.createDataFrame([(None, 5.0)], "WORK_ID int, A double")
    merged = landed.combine_batches([a, b])
    assert merged.columns == ["A", "WORK_ID", "Z"] and merged.count() == 2
    assert landed.work_like(merged).count() == 1


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('﻿WORK_ID,NAME\n1,"a, ""b"""\n\n2,\n'.encode())
    df = landed.read_csv_table(spark, str(path))
    assert df.columns == ["WORK_ID", "NAME"]
    assert sorted((r[0], r[1]) for r in df.collect()) == [("1", 'a, "b"'), ("2", None)]


def test_csv_round_trip_and_column_order(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x")], "n int, l array<string>, s string")
    sinks.write_csv(sinks.order_columns(df, ["s", "missing"]), str(tmp_path / "c"))
    back = landed.read_csv_table(spark, str(tmp_path / "c"))
    assert back.columns == ["s", "n", "l"] and back.first()["l"] == '["a","b"]'


def test_json_records_and_pruned_scan(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"WORK_ID": "1", "MP_NAME": "m"}, {"WORK_ID": "2"}], indent=1))
    df = landed.read_json_records(spark, str(tmp_path / "r.json"), RAW_RECORD)
    assert df.count() == 2
    sinks.write_parquet(df, str(tmp_path / "p"), ["MP_NAME"])
    pruned = landed.read_columns(spark, str(tmp_path / "p"), ["WORK_ID", "NOT_THERE"])
    assert pruned.columns == ["WORK_ID"]
    assert "ReadSchema: struct<WORK_ID:string>" in pruned._jdf.queryExecution().toString()


def test_mapping_discovery_ignores_case_and_wrong_seats(spark):
    records = spark.createDataFrame([(" Asha Rao ", "12.0"), ("B", "x")], "MP_NAME string, CONSTITUENCY_ID string")
    candidates = spark.createDataFrame([(1, "ASHA RAO", 12), (1, "Asha Rao", 13), (2, "B", 12)],
                                       "mp_id int, mp_name string, constituency_id int")
    got = landed.discover_mappings(records, candidates).collect()
    assert [(r["mp_id"], r["constituency_id"]) for r in got] == [(1, 12)]


def test_reload_picks_up_new_files_once(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))

    def land(name, *rows):
        (tmp_path / "landing").mkdir(exist_ok=True)
        lines = [json.dumps(dict(WORK_RECOMMENDATION_DTL_ID=str(w), WORK_ID="p", FUND_DISBURSED_AMT=a,
                                 EXPENDITURE_DATE=d, VENDOR_ID="5", VENDOR_NAME="V", WORK_STATUS="Payment Success",
                                 _ord=o)) for w, a, d, o in rows]
        (tmp_path / "landing" / name).write_text("\n".join(lines))

    land("a.json", (1, "10.00", "01-02-2024", "1"), (2, "5", "01-02-2024", "2"), (2, "bad", "01-02-2024", "3"))
    payments.reload_payments(spark, landing, table, state)
    land("b.json", (1, "10.00", "01-02-2024", "4"), (1, "7.50", "03-02-2024", "5"))
    payments.reload_payments(spark, landing, table, state)
    payments.reload_payments(spark, landing, table, state)
    got = {r["WORK_ID"]: r for r in payments.current_summary(spark, table).collect()}
    assert float(got[1]["TOTAL_FUND_DISBURSED_AMT"]) == 17.5 and got[1]["PAYMENT_COUNT"] == 2
    assert float(got[2]["TOTAL_FUND_DISBURSED_AMT"]) == 5


def test_spread_of_sources(spark):
    tagged = landed.tag_source(
        spark.createDataFrame([(1,)], "WORK_ID int"), "Works Completed",
        dict(state_id=1, state_name="S", mp_id=2, mp_name="M", constituency_id=3, constituency="C"))
    assert tagged.first()["_CONSTITUENCY_ID"] == "3"
    assert tagged.select(F.col("_SOURCE_KEY")).first()[0] == "Works Completed"


def test_evidence_json_holds_no_nan(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1, nan, (2.5, [nan, 1.0, -inf]), {"a": inf, "b": 3.0}), (2, 1.5, None, None)],
        "`a.b` int, x double, s struct<y: double, z: array<double>>, m map<string, double>")
    path = str(tmp_path / "e")
    sinks.write_evidence_json(df, path)
    lines = [json.loads(r[0], parse_constant=lambda c: pytest.fail(c)) for r in spark.read.text(path).collect()]
    assert sorted(lines, key=lambda r: r["a.b"]) == [
        {"a.b": 1, "x": None, "s": {"y": 2.5, "z": [None, 1.0, None]}, "m": {"a": None, "b": 3.0}},
        {"a.b": 2, "x": 1.5, "s": None, "m": None}]


def test_json_parts_are_compressed(spark, tmp_path):
    df = spark.range(2000).selectExpr("cast(id as string) as A", *[f"cast(null as string) as ABSENT_{i}" for i in range(30)])
    sinks.write_json(df.coalesce(1), str(tmp_path / "j"))
    (part,) = (tmp_path / "j").glob("part-*")
    lines = gzip.decompress(part.read_bytes()).decode().splitlines()
    assert len(lines) == 2000 and json.loads(lines[7])["ABSENT_29"] is None and "ABSENT_29" in json.loads(lines[7])
    assert part.stat().st_size * 20 < sum(map(len, lines))
    back = landed.read_json_records(spark, str(tmp_path / "j"), df.schema, multi_line=False)
    assert back.exceptAll(df).count() == 0 and back.count() == 2000
