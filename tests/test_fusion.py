import pytest
from pyspark.sql import functions as F

from civitally.config import FusionConfig
from civitally.operators import fusion
from civitally.operators.cleaning import DataGateError


def test_quality_tiers(spark):
    df = spark.createDataFrame(
        [("1", 0, 500000.0), ("2", 1, 500000.0), ("3", 4, 500000.0), ("4", 0, None), ("5", None, -1.0)],
        "WORK_ID string, MISSING_FIELD_COUNT int, SANCTION_AMOUNT double",
    )
    got = {r["WORK_ID"]: r["DATA_QUALITY_TIER"] for r in fusion.quality_tier(df, verification_only=True).collect()}
    assert got == {"1": "HIGH", "2": "MEDIUM", "3": "LOW", "4": "VERIFICATION_ONLY", "5": "VERIFICATION_ONLY"}
    plain = {r["WORK_ID"]: r["DATA_QUALITY_TIER"] for r in fusion.quality_tier(df).collect()}
    assert plain["4"] == "HIGH"


def test_peer_sufficiency(spark):
    df = spark.createDataFrame([("1", 15.0), ("2", 10.0), ("3", 9.0), ("4", 0.0), ("5", None)], "WORK_ID string, PEER_COUNT double")
    got = [r["PEER_DATA_SUFFICIENT"] for r in fusion.peer_sufficiency(df).orderBy("WORK_ID").collect()]
    assert got == [1, 1, 0, 0, 0]
    assert fusion.peer_sufficiency(df.select("WORK_ID")).first()["PEER_DATA_SUFFICIENT"] == 1


CASES = [
    ((0.0, 0.0, 0.0), 1, (0, 0, 0), True, 0.0),
    ((100.0, 100.0, 100.0), 1, (1, 1, 1), False, 110.0),
    ((100.0, 100.0, 100.0), 1, (1, 1, 1), True, 100.0),
    ((60.0, 60.0, 60.0), 1, (1, 1, 1), True, 70.0),
    ((0.0, 0.0, 95.0), 1, (0, 0, 1), True, 28.5),
    ((70.0, 70.0, 0.0), 1, (1, 1, 0), True, 54.0),
    ((100.0, 0.0, 0.0), 1, (1, 0, 0), True, 35.0),
    ((100.0, 0.0, 0.0), 0, (1, 0, 0), True, 35.0),
    ((100.0, 80.0, 0.0), 0, (1, 1, 0), True, 40.0),
]


@pytest.mark.parametrize("scores, peers, flags, cap, expected", CASES)
def test_score_fusion(spark, scores, peers, flags, cap, expected):
    df = spark.createDataFrame(
        [(*scores, peers, *flags)],
        "RULE_SCORE_CALIBRATED double, STAT_SCORE_CALIBRATED double, ML_SCORE_CALIBRATED double, "
        "PEER_DATA_SUFFICIENT int, RULE_CANDIDATE int, STAT_CANDIDATE int, ML_CANDIDATE int",
    )
    config = FusionConfig(cap=cap)
    (row,) = fusion.triage(fusion.score_fusion(df, config), config).collect()
    assert row["HYBRID_RISK_SCORE"] == expected
    if sum(flags) == 3:
        assert (row["INVESTIGATION_PRIORITY"], row["HYBRID_RISK_LEVEL"]) == ("P1", "CRITICAL")
        assert row["DETECTOR_AGREEMENT"] == "RULE + STATISTICAL + ML"
    if expected == 0:
        assert row["INVESTIGATION_PRIORITY"] == "P0" and row["HYBRID_RISK_LEVEL"] == "NONE"


SCHEMA = ("WORK_ID string, RULE_SCORE int, RULE_SEVERITY string, RULE_CANDIDATE int, STAT_SCORE int, "
          "STAT_SEVERITY string, STAT_CANDIDATE int, ML_ANOMALY int, ML_PERCENTILE double, ML_SEVERITY string, "
          "PEER_COUNT int, MISSING_FIELD_COUNT int")


def test_empty_table(spark):
    assert fusion.fuse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_single_row_and_missing_scores(spark):
    rows = [("999999", 10, "LOW", 1, 15, "LOW", 1, 0, 80.0, "NONE", 25, 0),
            ("1", 0, "NONE", 0, 0, "NONE", 0, None, None, None, None, None)]
    got = {r["WORK_ID"]: r for r in fusion.fuse(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 0 < got["999999"]["HYBRID_RISK_SCORE"] <= 100
    assert got["1"]["HYBRID_RISK_SCORE"] == 0.0 and got["1"]["SCORE_REGIME"] == "SPARSE_PEER"


def test_calibration_ranks_only_candidates_with_average_ties(spark):
    rows = [(str(i), s, "LOW", int(s > 0)) for i, s in enumerate([0, 0, 10, 10, 20, 35])]
    df = spark.createDataFrame(rows, "WORK_ID string, RULE_SCORE int, RULE_SEVERITY string, RULE_CANDIDATE int")
    got = [r["RULE_SCORE_CALIBRATED"] for r in fusion.calibrate(df, "RULE").orderBy("WORK_ID").collect()]
    assert got == [0.0, 0.0, 37.5, 37.5, 75.0, 100.0]


def test_consensus_gate(spark):
    df = spark.createDataFrame([(3, "P2")], "INDEPENDENT_SIGNAL_COUNT int, INVESTIGATION_PRIORITY string")
    with pytest.raises(DataGateError):
        fusion.require_consensus_first(df)


def test_audit_levels(spark):
    rules = spark.createDataFrame(
        [(1, 100.0, True), (2, 100.0, True), (3, 90.0, True), (4, 10.0, False)],
        "WORK_ID int, RULE_SCORE double, RULE_ANOMALY_FLAG boolean").withColumn("RULE_REASONS", F.lit("r"))
    stats = spark.createDataFrame(
        [(1, 100.0, True), (2, 60.0, True), (3, 0.0, False), (4, 0.0, False)],
        "WORK_ID int, STATISTICAL_SCORE double, STATISTICAL_ANOMALY_FLAG boolean").withColumn(
        "STATISTICAL_REASONS", F.lit("No statistical anomaly detected"))
    ml = spark.createDataFrame([(1, 90.0, True), (2, 0.0, False)],
                               "WORK_ID int, ISOLATION_FOREST_SCORE double, ISOLATION_FOREST_ANOMALY_FLAG boolean"
                               ).withColumn("ISOLATION_FOREST_REASON", F.lit("m"))
    got = {r["WORK_ID"]: r for r in fusion.fuse_audit(rules, stats, ml, "WORK_ID").collect()}
    assert [got[i]["FINAL_RISK_LEVEL"] for i in (1, 2, 3, 4)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert [got[i]["INVESTIGATION_PRIORITY"] for i in (1, 2, 3, 4)] == [1, 2, 3, 5]
    assert got[3]["EVIDENCE_SUMMARY"] == "RULE: r | Only one detection layer identifies unusual behavior"
