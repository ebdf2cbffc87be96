import datetime

from pyspark.sql import functions as F

from civitally.functions import scalar as fn
from civitally.functions import text as tx


def one(spark, column, row=None, schema="x int"):
    df = spark.createDataFrame([row or (1,)], schema)
    return df.select(column.alias("r")).first()["r"]


def test_bad_text_becomes_missing(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), ("",), (None,), ("inf",), ("NaN",)], "t string")
    assert [r[0] for r in df.select(fn.clean_numeric("t")).collect()] == [12.5] + [None] * 5
    assert [r[0] for r in df.select(fn.clean_id("t")).collect()] == [12] + [None] * 5


def test_dates_are_read_day_first_once(spark):
    texts = ["2025-04-05", "05-04-2025", "05-Apr-2025", "05/04/2025", "2025-13-45", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    day = datetime.date(2025, 4, 5)
    assert [r[0] for r in df.select(fn.clean_date("t")).collect()] == [day] * 4 + [None] * 3


def test_ratio_needs_a_positive_denominator(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (None, 2.0), (1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r[0] for r in df.select(fn.ratio("a", "b")).collect()] == [0.5, None, None, None, None]


def test_round_even_follows_the_scaled_double(spark):
    assert one(spark, fn.round_even(F.lit(2.675), 2)) == 2.68
    assert one(spark, fn.round_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, fn.round_even(F.lit(28.5), 1)) == 28.5


def test_flags_count_unknown_as_zero(spark):
    assert one(spark, fn.flag(F.lit(None).cast("int") > 1)) == 0


def test_log_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.0,)], "a double")
    assert [r[0] for r in df.select(fn.log_amount("a")).collect()] == [None, 0.0, 0.0]


def test_name_key(spark):
    df = spark.createDataFrame([("Andaman & Nicobar Islands",), ("andaman and nicobar-islands",)], "s string")
    assert len({r[0] for r in df.select(fn.name_key("s")).collect()}) == 1


def test_activity_prefix(spark):
    df = spark.createDataFrame([("WS/MP380/2025-2026/209175-Providing seats",), ("Plain",)], "a string")
    assert [r[0] for r in df.select(fn.strip_activity_prefix("a")).collect()] == ["Providing seats", "Plain"]


def test_money_and_numbers(spark):
    df = spark.createDataFrame([(1234.5, 1.2, 12.0), (None, None, None)], "m double, p double, n double")
    got = df.select(
        tx.money("m"), tx.percent("p"), tx.number("n"), tx.number("m"), tx.day_count("n"), tx.percent(F.col("p") / 2)
    ).collect()
    assert tuple(got[0]) == ("₹1,234.50", "1.2%", "12", "1,234.50", "12 days", "60.0%")
    assert set(got[1]) == {"Not available"}


def test_numbered_list_skips_repeats_and_gaps(spark):
    c = tx.numbered([F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("a")])
    assert one(spark, c) == "1. a 2. b"


def test_answers_lose_their_fence(spark):
    df = spark.createDataFrame([('```json\n{"a": {"b": 1}}\n```',), ("none",)], "t string")
    assert [r[0] for r in df.select(tx.answer_json("t")).collect()] == ['{"a": {"b": 1}}', "none"]


def test_json_list_falls_back_to_empty(spark):
    df = spark.createDataFrame([('["a","b"]',), ("oops",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.json_list("t")).collect()] == [["a", "b"], [], []]
