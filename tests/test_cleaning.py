import pytest
from pyspark.sql import functions as F

from civitally.operators import aggregates, cleaning, joining
from civitally.operators.cleaning import DataGateError
from civitally.sources.schemas import COMPLETED, EXPENDITURE, RECOMMENDED, SANCTIONED


def test_payment_dedup_general(spark):
    rows = [
        (101, 501, 500000.0, "2025-01-10", 1), (101, 501, 500000.0, "2025-01-10", 2),
        (101, 501, 300000.0, "2025-02-15", 3), (102, 502, 500000.0, "2025-01-10", 4),
    ]
    df = spark.createDataFrame(rows, "WORK_ID long, VENDOR_ID long, FUND_DISBURSED_AMT double, PAYMENT_DATE string, o int")
    got = cleaning.dedup_payments(df, ["o"])
    assert got.count() == 3
    assert got.filter("WORK_ID = 101").count() == 2
    assert got.filter("WORK_ID = 102").count() == 1
    assert {r["o"] for r in got.collect()} == {1, 3, 4}


def test_payment_dedup_without_date(spark):
    df = spark.createDataFrame(
        [(101, 501, 100000.0, 1), (102, 502, 200000.0, 2)], "WORK_ID long, VENDOR_ID long, FUND_DISBURSED_AMT double, o int"
    )
    assert cleaning.dedup_payments(df, ["o"]).count() == 2


def test_repeated_disbursement_is_removed(spark):
    rows = [(250877, 999, 450000.0, "2024-06-01", 1), (250877, 999, 450000.0, "2024-06-01", 2),
            (250877, 999, 150000.0, "2024-07-01", 3)]
    df = spark.createDataFrame(rows, "WORK_ID long, VENDOR_ID long, FUND_DISBURSED_AMT double, PAYMENT_DATE string, o int")
    got = cleaning.dedup_payments(df, ["o"])
    assert got.count() == 2
    assert got.agg(F.sum("FUND_DISBURSED_AMT")).first()[0] == 600000


def test_dedup_treats_missing_values_as_equal(spark):
    df = spark.createDataFrame([(1, None, 5.0, 1), (1, None, 5.0, 2)], "WORK_ID long, VENDOR_ID long, FUND_DISBURSED_AMT double, o int")
    assert cleaning.dedup_payments(df, ["o"]).count() == 1


def test_gates(spark):
    good = spark.createDataFrame([(1,), (2,)], "WORK_ID long")
    assert cleaning.require_unique_key(good) is good
    with pytest.raises(DataGateError):
        cleaning.require_unique_key(spark.createDataFrame([(1,), (1,)], "WORK_ID long"))
    with pytest.raises(DataGateError):
        cleaning.require_unique_key(spark.createDataFrame([(1,), (None,)], "WORK_ID long"))
    with pytest.raises(DataGateError):
        cleaning.require_columns(good, ["WORK_ID", "STATE_NAME"])
    with pytest.raises(DataGateError):
        cleaning.require_same_rows(good, good.limit(1))
    with pytest.raises(DataGateError):
        joining.one_to_one(good, good.union(good), checked=True)


def test_most_complete_record_wins_and_ties_keep_the_first(spark):
    rows = [
        ("1", None, None, None, "a", "1"), ("1", "5", "3", None, "b", "2"), ("1", "6", "3", None, "c", "3"),
        (None, None, None, None, "keyless", "4"), ("", "2", None, None, "portal", "5"),
    ]
    df = spark.createDataFrame(
        rows, "WORK_RECOMMENDATION_DTL_ID string, SANCTION_AMOUNT string, ACTUAL_AMOUNT string, "
        "WORK_STAGE string, tag string, _ord string"
    ).withColumn("WORK_ID", F.when(F.col("tag") == "portal", "WS/9"))
    assert {r["tag"] for r in cleaning.most_complete(df).collect()} == {"b", "portal"}


def test_consolidation_takes_first_meaningful_value(spark):
    rows = [
        ("7", RECOMMENDED, "nan", "10", "2"), ("7", RECOMMENDED, " Road ", "20", "3"),
        ("7", SANCTIONED, "Bridge", "bad", "1"), ("7.0", EXPENDITURE, None, None, "4"),
        (None, COMPLETED, "x", "1", "5"),
    ]
    df = spark.createDataFrame(
        rows, "WORK_RECOMMENDATION_DTL_ID string, _SOURCE_KEY string, ACTIVITY_NAME string, "
        "SANCTION_AMOUNT string, _ord string"
    )
    (row,) = aggregates.consolidate_works(df).collect()
    assert row["ACTIVITY_NAME"] == "Bridge"
    assert float(row["SANCTION_AMOUNT"]) == 10
    flags = [row[k] for k in ("IS_RECOMMENDED", "IS_SANCTIONED", "IS_COMPLETED", "HAS_EXPENDITURE_RECORD")]
    assert flags == [1, 1, 0, 1]
    assert row["RECOMMENDED_RECORD_COUNT"] == 2 and row["COMPLETED_RECORD_COUNT"] == 0


def test_payment_summary_keeps_unreadable_totals_missing(spark):
    rows = [(1, 1, "A", None, "x", 1), (2, 1, "A", 5.0, " Payment SUCCESS ", 2), (2, 2, "B", 7.0, "payment in-progress", 3)]
    df = spark.createDataFrame(rows, "WORK_ID long, VENDOR_ID long, VENDOR_NAME string, a double, WORK_STATUS string, o int")
    df = df.withColumn("FUND_DISBURSED_AMT", F.col("a").cast("decimal(18,2)")).withColumn(
        "EXPENDITURE_DATE", F.lit("2024-01-01").cast("date")
    )
    got = {r["WORK_ID"]: r for r in aggregates.payment_summary(df, ["o"]).collect()}
    assert got[1]["TOTAL_FUND_DISBURSED_AMT"] is None and got[1]["PAYMENT_COUNT"] == 0
    assert float(got[2]["TOTAL_FUND_DISBURSED_AMT"]) == 12
    assert (got[2]["PAYMENT_SUCCESS_COUNT"], got[2]["PAYMENT_IN_PROGRESS_COUNT"]) == (1, 1)
    assert (got[2]["UNIQUE_VENDOR_COUNT"], got[2]["UNIQUE_VENDOR_NAME_COUNT"]) == (2, 2)


def test_payment_summary_counts_vendors_on_short_rows(spark):
    rows = [(None, 1, "A", 1, "p"), (None, 2, "A", 2, None), (0, 1, "A", 3, None), (0, 1, "B", 4, "q"), (0, None, None, 5, "r")]
    df = spark.createDataFrame(rows, "WORK_ID long, VENDOR_ID long, VENDOR_NAME string, o int, LETTER_NO string").selectExpr(
        "*", "cast(1 as decimal(18,2)) as FUND_DISBURSED_AMT", "date'2024-01-01' as EXPENDITURE_DATE", "'x' as WORK_STATUS")
    summary = aggregates.payment_summary(df, ["o"])
    names = ["WORK_ID", "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "UNIQUE_VENDOR_NAME_COUNT", "PAYMENT_LETTER_NO"]
    got = sorted(([r[n] for n in names] for r in summary.collect()), key=str)
    assert got == [[0, 3, 1, 2, "q"], [None, 2, 2, 1, "p"]]
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    expanded = [line for line in plan.splitlines() if "Expand" in line]
    assert len(expanded) == 1 and "LETTER_NO" not in expanded[0] and "struct" not in expanded[0]


def test_possible_duplicates_flag_every_member(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, "x"), (None, "x")], "k int, t string").withColumn(
        "id", F.monotonically_increasing_id()
    )
    got = cleaning.flag_possible_duplicates(df, ["k", "t"], "id").groupBy("POSSIBLE_DUPLICATE").count()
    assert {r[0]: r[1] for r in got.collect()} == {1: 4, 0: 1}
