import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from civitally.config import Settings, Skew
from civitally.operators import audit, features, rules
from civitally.plans.national import NationalPlan
from civitally.sources import testbed

WORK = ("WORK_ID long, STATE_NAME string, CONSTITUENCY_ID long, MP_ID long, WORK_CATEGORY string, ACTIVITY_NAME string, "
        "RECOMMENDED_AMOUNT decimal(18,2), SANCTION_AMOUNT decimal(18,2), RECOMMENDATION_DATE date, SANCTION_DATE date")
PAY = ("WORK_ID long, VENDOR_ID long, VENDOR_NAME string, FUND_DISBURSED_AMT decimal(18,2), EXPENDITURE_DATE date, "
       "WORK_STATUS string, o int")
DONE = "WORK_ID long, ACTUAL_AMOUNT decimal(18,2), ACTUAL_END_DATE date"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def plan(spark, skew=Skew()):
    d = Decimal
    works = spark.createDataFrame([
        (1, "A", 1, 1, "c", "x", d(100), d(0), day(0), day(-2)),
        (2, "A", 1, None, "c", "x", d(100), None, None, None),
        (3, None, None, 1, None, None, d(50), d(40), day(0), day(5)),
        (4, "B", 2, 2, "c", "x", None, None, None, None),
    ], WORK)
    pays = spark.createDataFrame([
        (3, 1, "v", d(30), day(2), "Payment Success", 1), (3, 2, "w", d(30), day(2), " payment in-progress", 2),
    ], PAY)
    done = spark.createDataFrame([(3, d(45), day(1))], DONE)
    return NationalPlan(works, pays, done, ("o",), Settings(skew=skew))


def check(got):
    assert got[1]["DISBURSED_TO_SANCTION_RATIO"] is None and got[1]["SANCTION_TO_RECOMMENDED_RATIO"] == 0
    assert got[1]["NEGATIVE_RECOMMENDATION_TO_SANCTION"] == 1
    assert got[1]["STATE_WORK_COUNT"] == 2 and got[1]["STATE_TOTAL_DISBURSED"] == 0
    assert got[2]["MP_WORK_COUNT"] is None and got[2]["MP_TOTAL_SANCTIONED"] is None
    assert got[3]["STATE_WORK_COUNT"] is None and got[3]["STATE_NAME"] == "UNKNOWN"
    assert got[3]["PEER_COUNT"] == 1 and got[3]["CATEGORY_WORK_COUNT"] == 1 and got[3]["PEER_STD_SANCTION"] is None
    assert got[3]["EXPENDITURE_DURATION_DAYS"] == 0 and got[3]["PAYMENTS_PER_30_DAYS"] is None
    assert got[3]["DISBURSED_ABOVE_SANCTION"] == 1 and got[3]["ACTUAL_ABOVE_SANCTION"] == 1
    assert got[3]["PAYMENT_SUCCESS_RATIO"] == 0.5 and got[3]["PAYMENT_AFTER_REPORTED_COMPLETION_DAYS"] == 1
    assert got[3]["NEGATIVE_SANCTION_TO_PAYMENT"] == 1
    assert got[4]["STATE_TOTAL_SANCTIONED"] == 0 and got[4]["STATE_AVG_WORK_COST"] is None
    assert got[4]["NO_PAYMENT_RECORD"] == 1 and got[4]["PAYMENT_COUNT"] is None
    assert got[4]["MISSING_FIELD_COUNT"] == 9 and got[4]["DATA_COMPLETENESS_RATIO"] == 0


def test_missing_value_semantics(spark):
    rows = plan(spark).features.collect()
    assert len(rows) == 4
    check({r["WORK_ID"]: r for r in rows})


def test_hot_groups_give_the_same_features(spark):
    check({r["WORK_ID"]: r for r in plan(spark, Skew(hot_rows=1, bin_bits=4)).features.collect()})


def test_forced_skew_equals_default_on_generated_data(spark, small_dir):
    def build(skew):
        p = NationalPlan(testbed.works(spark, small_dir), testbed.payments(spark, small_dir),
                         testbed.completions(spark, small_dir), testbed.PAYMENT_ORDER, Settings(skew=skew))
        columns = ["WORK_ID", "PEER_COUNT", "PEER_MEDIAN_SANCTION", "LOO_VALUES", "MP_MEDIAN_SANCTION_AMOUNT",
                   "STATE_TOTAL_DISBURSED", "CATEGORY_WORK_COUNT"]
        return sorted(map(str, p.features.select(*columns).collect()))

    assert build(Skew()) == build(Skew(hot_rows=3, bin_bits=8))


def test_plan_from_landed_records(spark, small_dir):
    p = NationalPlan.from_records(testbed.raw_records(spark, small_dir))
    works = testbed.works(spark, small_dir)
    scored = rules.score_rules(p.features)
    assert scored.count() == works.count()
    direct = testbed.payments(spark, small_dir).filter("VENDOR_ID <> 13").agg(F.sum("FUND_DISBURSED_AMT")).first()[0]
    assert p.features.agg(F.sum("TOTAL_FUND_DISBURSED_AMT")).first()[0] == direct


def test_hierarchical_peers_fall_back(spark):
    rows = [(i, "S", "c", f"a{i % 2}", 100.0 + i) for i in range(30)]
    rows += [(100 + i, "T", "c", "z", 10.0 + i) for i in range(12)] + [(200, "U", "c", "z", 5.0), (201, "U", "d", "z", 5.0)]
    rows += [(202, "S", "c", "a0", None)]
    df = spark.createDataFrame(rows, "WORK_ID long, STATE_NAME string, WORK_CATEGORY string, ACTIVITY_NAME string, x double")
    df = df.withColumn("SANCTION_AMOUNT", F.col("x").cast("decimal(18,2)")).drop("x")
    for skew in (Skew(), Skew(hot_rows=4, bin_bits=6)):
        got = {r["WORK_ID"]: r for r in audit.hierarchical_peers(df, skew=skew).collect()}
        assert (got[0]["PEER_LEVEL"], got[0]["PEER_COUNT"]) == ("STATE_CATEGORY_ACTIVITY", 14)
        assert (got[200]["PEER_LEVEL"], got[200]["PEER_COUNT"]) == ("CATEGORY", 42)
        assert (got[201]["PEER_LEVEL"], got[201]["PEER_COUNT"]) == ("NONE", 0)
        assert got[202]["PEER_LEVEL"] == "NONE" and got[202]["PEER_MEDIAN_SANCTION"] is None


def test_peer_group_label_parameter(spark, small_dir):
    p = NationalPlan(testbed.works(spark, small_dir), testbed.payments(spark, small_dir),
                     testbed.completions(spark, small_dir), testbed.PAYMENT_ORDER,
                     Settings(peer_keys=("STATE_NAME", "WORK_CATEGORY")))
    groups = p.features.select("STATE_NAME", "WORK_CATEGORY", "PEER_COUNT").distinct()
    assert groups.count() == p.features.select("STATE_NAME", "WORK_CATEGORY").distinct().count()
    assert features.PEER_KEYS[:2] == ("STATE_NAME", "WORK_CATEGORY")
