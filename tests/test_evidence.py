import datetime

from pyspark.sql import functions as F

from civitally.operators import evidence, explain
from civitally.sources import sinks

SCHEMA = (
    "WORK_ID long, STATE_NAME string, CONSTITUENCY string, MP_NAME string, RECOMMENDED_AMOUNT double, "
    "SANCTION_AMOUNT double, ACTUAL_AMOUNT double, TOTAL_FUND_DISBURSED_AMT double, PAYMENT_COUNT int, "
    "UNIQUE_VENDOR_COUNT int, SANCTION_DATE date, PAYMENT_AFTER_REPORTED_COMPLETION_DAYS int, PEER_COUNT int, "
    "PEER_MEDIAN_SANCTION double, DATA_COMPLETENESS_RATIO double, MISSING_FIELD_COUNT int, ATTACH_ID long, "
    "RULE_CANDIDATE int, RULE_SCORE int, STAT_CANDIDATE int, STAT_SCORE int, ML_CANDIDATE int, ML_PERCENTILE double, "
    "HYBRID_RISK_SCORE double, HYBRID_RISK_LEVEL string, DETECTOR_AGREEMENT string, INVESTIGATION_PRIORITY string, "
    "INVESTIGATION_CANDIDATE int, INDEPENDENT_SIGNAL_COUNT int, PAYMENTS_PER_30_DAYS double"
)
FULL = (1, "Goa", "North", "A B", 100.0, 1234.5, 1500.0, 600.0, 5, 6, datetime.date(2024, 1, 2), 12, 12, 500.0, 0.5, 2,
        9, 1, 35, 1, 20, 1, 99.5, 88.25, "HIGH", "TWO METHODS AGREE", "P2", 1, 2, 2.5)
BARE = (2, None, None, None, None, None, None, None, None, None, None, None, 3, 500.0, None, None, None, 0, 0, 0, 0, 0,
        None, 12.0, "LOW", "ONE METHOD", "P4", 1, 1, None)


def frame(spark):
    return spark.createDataFrame([FULL, BARE], SCHEMA)


def test_texts(spark):
    got = {r["WORK_ID"]: r for r in evidence.add_evidence(frame(spark)).collect()}
    full = got[1]["FACTUAL_EVIDENCE"]
    assert full.startswith("Recommended amount: ₹100.00. Sanction amount: ₹1,234.50. Reported actual expenditure: ₹1,500.00.")
    assert "Actual-to-sanction ratio: 1.2%." in full and "Disbursed-to-sanction ratio: 48.6%." in full
    assert "Sanction date: 2024-01-02." in full and "12 days after reported completion." in full
    assert "Peer median sanction amount: ₹500.00." in full and full.endswith("Attachment identifier is present.")
    assert got[2]["FACTUAL_EVIDENCE"] == (
        "Peer-group size used by the feature set: 3. Attachment identifier is not present in the available record.")
    assert got[1]["VERIFICATION_FLAGS"].startswith("1. Verify the individual payment transactions")
    assert "5. Verify missing source fields" in got[1]["VERIFICATION_FLAGS"]
    assert got[2]["VERIFICATION_FLAGS"].startswith("1. Peer comparison is weak") and "2. Confirm" in got[2]["VERIFICATION_FLAGS"]
    assert got[1]["DETECTOR_EVIDENCE"] == (
        "Rule detector produced a candidate signal with score 35.0; Statistical detector produced a candidate signal "
        "with score 20.0; Isolation Forest produced an ML anomaly signal at the 99.50th percentile.")
    assert got[2]["DETECTOR_EVIDENCE"] == "No detector signal."
    assert got[1]["INVESTIGATION_SUMMARY"].startswith(
        "Goa | North | MP: A B. Hybrid risk level: HIGH; hybrid score: 88.25; detector agreement: TWO METHODS AGREE.")
    assert got[2]["INVESTIGATION_SUMMARY"].startswith("Hybrid risk level: LOW; hybrid score: 12;")


def test_queue_order_and_dossier(spark):
    df = frame(spark)
    queue = evidence.investigation_queue(df, df.select("WORK_ID", F.lit(1).alias("EXTRA")))
    assert [r["WORK_ID"] for r in queue.collect()] == [1, 2]
    record = evidence.dossier(queue).first()
    assert record["identity"]["state_name"] == "Goa" and record["risk"]["final_risk_level"] == "HIGH"


def test_review_selection_limits(spark):
    df = spark.range(400).select(
        F.col("id").alias("WORK_ID"),
        F.when(F.col("id") < 100, "CRITICAL").when(F.col("id") < 200, "HIGH").when(F.col("id") < 300, "MEDIUM")
        .otherwise("LOW").alias("HYBRID_RISK_LEVEL"),
        (F.col("id") % 50).cast("double").alias("HYBRID_RISK_SCORE"),
    )
    got = {r[0]: r[1] for r in explain.select_for_review(df).groupBy("HYBRID_RISK_LEVEL").count().collect()}
    assert got == {"CRITICAL": 50, "HIGH": 30, "MEDIUM": 20}


def test_answers_cache_and_migration(spark):
    answers = spark.createDataFrame([
        (1, '```json\n{"summary":"s","signals":["a"],"verify":"v","confidence":"LOW"}\n```'),
        (2, '{"summary":"s"}'), (3, "nothing"), (4, None)], "WORK_ID long, answer string")
    usable, rejected = explain.read_answers(answers)
    (row,) = usable.collect()
    assert (row["OBSERVED_SIGNALS"], row["WHAT_TO_VERIFY"]) == ('["a"]', '["v"]')
    assert sorted(r["WORK_ID"] for r in rejected.collect()) == [2, 3, 4]
    requests = explain.review_requests(frame(spark).withColumn("SELECTION_SCORE", F.lit(1.0)))
    fresh = requests.filter("WORK_ID = 1").select("WORK_ID", "EVIDENCE_HASH")
    state = {r["WORK_ID"]: r["CACHE_STATE"] for r in explain.cached_answers(requests, fresh).collect()}
    assert state == {1: "FRESH", 2: "MISSING"}
    legacy = spark.createDataFrame([(1,), (2,), (99,)], "WORK_ID long")
    moved = explain.migrate_answers(fresh, legacy, requests).collect()
    assert sorted((r["WORK_ID"], r["SOURCE"]) for r in moved) == [(1, None), (2, "legacy_migration")] or len(moved) == 2


def test_compact_evidence(spark):
    row = explain.review_requests(frame(spark).withColumn("SELECTION_SCORE", F.lit(1.0))).orderBy("WORK_ID").collect()
    assert '"sanction":"₹1,234"' in row[0]["EVIDENCE"] or '"sanction":"₹1,235"' in row[0]["EVIDENCE"]
    assert '"payments_per_30_days":"2.5"' in row[0]["EVIDENCE"]
    assert '"state":"Not available"' in row[1]["EVIDENCE"]


def test_default_explanation(spark):
    got = explain.default_explanation(evidence.evidence_ratios(frame(spark))).orderBy("WORK_ID").collect()
    assert "Critical severity risk score 88.25 (P2 tier)" in got[0]["OBSERVED_SIGNALS"]
    assert "Vendor distribution across 6" in got[0]["OBSERVED_SIGNALS"]
    assert got[1]["OBSERVED_SIGNALS"] == '["Hybrid risk score 12 (P4 tier)"]'


AUDIT = ("WORK_ID long, MP_NAME string, COST_VS_PEER_MEDIAN double, COST_Z_SCORE double, ACTUAL_AMOUNT double, "
         "SANCTION_AMOUNT double, RECOMMENDED_AMOUNT double, TOTAL_DISBURSED double, VENDOR_COUNT int, TRANSACTION_COUNT int, "
         "MAX_TRANSACTION_AMOUNT double, RECOMMENDATION_DATE date, SANCTION_DATE date, ACTUAL_END_DATE date, "
         "RECOMMENDATION_TO_SANCTION_DAYS int, SANCTION_TO_COMPLETION_DAYS int, HYBRID_RISK_SCORE double, FINAL_RISK_LEVEL string, "
         "DETECTOR_AGREEMENT string, DETECTOR_AGREEMENT_COUNT int, INVESTIGATION_PRIORITY int, RULE_SCORE double, "
         "STATISTICAL_SCORE double, ISOLATION_FOREST_SCORE double")


def test_audit_record_and_flat_form(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([
        (1, "M", 12.0, 4.0, 30.0, 20.0, 10.0, 25.0, 3, 4, 9.0, day, day, None, 0, None, 75.0, "CRITICAL", "STRONG", 3, 1, 9.0, 8.0, 7.0),
        (2, None, None, None, None, None, None, 0.0, 0, 0, 0.0, None, None, None, None, None, 1.0, "LOW", "NONE", 0, 5, 0.0, 0.0, None),
    ], AUDIT)
    records = evidence.audit_records(df)
    one, two = records.orderBy("work_id").collect()
    assert [f["type"] for f in one["evidence"]["financial"]] == [
        "actual_exceeds_sanction", "disbursement_exceeds_sanction", "extreme_peer_cost"]
    assert one["evidence"]["financial"][2]["finding"] == "Sanctioned cost is at least 10x the peer-group median"
    assert [f["severity"] for f in one["evidence"]["transaction"]] == ["medium", "medium"]
    assert one["summary"] == ("The work shows sanctioned cost is 12.00x the peer median; peer-group z-score is 4.00; actual "
                              "expenditure exceeds sanction; disbursement exceeds sanction; 3 vendors recorded; 4 expenditure transactions.")
    assert two["summary"] == "No major evidence signals were identified." and two["identity"]["mp_name"] == "Unknown"
    flat = sinks.flatten_struct(records, evidence.FLAT_FIELDS)
    assert flat.columns == list(evidence.FLAT_FIELDS)
    sinks.write_json(records, str(tmp_path / "e"))
    assert '"completion_date":null' in spark.read.text(str(tmp_path / "e")).orderBy("value").first()[0]
