import pytest
from pyspark.sql import functions as F

from civitally.operators import rules

COLUMNS = {
    "PEER_COUNT": "int", "SANCTION_TO_PEER_MEDIAN": "double", "SANCTION_PEER_Z_SCORE": "double",
    "ACTUAL_AMOUNT": "double", "SANCTION_AMOUNT": "double", "TOTAL_FUND_DISBURSED_AMT": "double",
    "PAYMENT_COUNT": "int", "UNIQUE_VENDOR_COUNT": "int", "PAYMENTS_PER_30_DAYS": "double",
    "RECOMMENDATION_TO_SANCTION_DAYS": "int", "SANCTION_TO_FIRST_PAYMENT_DAYS": "int",
    "COMPLETION_BEFORE_LAST_PAYMENT": "int", "PAYMENT_IN_PROGRESS_RATIO": "double",
    "DATA_COMPLETENESS_RATIO": "double",
}


def works(spark, *rows):
    schema = "WORK_ID long, " + ", ".join(f"{k} {t}" for k, t in COLUMNS.items())
    data = [(i, *[r.get(k) for k in COLUMNS]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


EVERYTHING = dict(
    PEER_COUNT=10, SANCTION_TO_PEER_MEDIAN=6.0, SANCTION_PEER_Z_SCORE=6.0, ACTUAL_AMOUNT=3.0,
    SANCTION_AMOUNT=2.0, TOTAL_FUND_DISBURSED_AMT=3.0, PAYMENT_COUNT=10, UNIQUE_VENDOR_COUNT=10,
    PAYMENTS_PER_30_DAYS=7.0, RECOMMENDATION_TO_SANCTION_DAYS=-1, SANCTION_TO_FIRST_PAYMENT_DAYS=-1,
    COMPLETION_BEFORE_LAST_PAYMENT=1, PAYMENT_IN_PROGRESS_RATIO=0.6, DATA_COMPLETENESS_RATIO=0.4,
)


def test_everything_fires_and_caps(spark):
    (row,) = rules.score_rules(works(spark, EVERYTHING)).collect()
    assert row["RULE_TRIGGER_COUNT"] == 17
    assert (row["RULE_FINANCIAL_SCORE"], row["RULE_PAYMENT_SCORE"], row["RULE_TIMELINE_SCORE"]) == (35, 30, 30)
    assert (row["RULE_PAYMENT_STATUS_SCORE"], row["RULE_DIVERSITY_BONUS"], row["RULE_SCORE"]) == (5, 10, 100)
    assert row["RULE_SEVERITY"] == "HIGH" and row["VERIFICATION_FLAG_COUNT"] == 2


def test_all_missing_fires_nothing(spark):
    (row,) = rules.score_rules(works(spark, {})).collect()
    assert row["RULE_SCORE"] == 0 and row["RULE_SEVERITY"] == "NONE" and row["RULE_REASONS"] == ""
    assert all(row[n] == 0 for n in rules.policy_rules().names())


@pytest.mark.parametrize("gap", list(COLUMNS))
def test_each_input_may_be_missing(spark, gap):
    (row,) = rules.score_rules(works(spark, {**EVERYTHING, gap: None})).collect()
    assert 0 <= row["RULE_SCORE"] <= 100 and row["RULE_TRIGGER_COUNT"] < 17


def test_boundaries(spark):
    rows = [
        dict(PEER_COUNT=9, SANCTION_TO_PEER_MEDIAN=9.0, SANCTION_PEER_Z_SCORE=9.0),
        dict(PEER_COUNT=10, SANCTION_TO_PEER_MEDIAN=2.0, SANCTION_PEER_Z_SCORE=3.0),
        dict(PAYMENT_COUNT=5, PAYMENTS_PER_30_DAYS=3.0), dict(PAYMENT_COUNT=1, PAYMENTS_PER_30_DAYS=9.0),
    ]
    got = [r["RULE_SCORE"] for r in rules.score_rules(works(spark, *rows)).orderBy("WORK_ID").collect()]
    assert got == [0, 0, 10, 0]


def test_verification_rules_score_nothing_but_give_reasons(spark):
    (row,) = rules.score_rules(works(spark, dict(COMPLETION_BEFORE_LAST_PAYMENT=1))).collect()
    assert row["RULE_SCORE"] == 0 and row["RULE_CANDIDATE"] == 0
    assert row["RULE_FLAGS"] == "RULE_COMPLETION_BEFORE_LAST_PAYMENT"
    assert row["RULE_REASONS"] == row["RULE_VERIFICATION_NOTES"] != ""


def test_registry_is_open(spark):
    book = rules.policy_rules().register(
        "RULE_ROUND_AMOUNT", F.col("SANCTION_AMOUNT") % 1000 == 0, "Financial", "WEAK", 7, "Round amount."
    )
    (row,) = rules.score_rules(works(spark, dict(SANCTION_AMOUNT=5000.0)), book=book).collect()
    assert row["RULE_SCORE"] == 7 and row["RULE_REASONS"] == "Round amount."
    with pytest.raises(ValueError):
        book.register("RULE_ROUND_AMOUNT", F.lit(True), "Financial", "WEAK", 1, "again")
