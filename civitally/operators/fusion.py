"""Calibrated fusion of the three detectors and triage tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FusionConfig
from ..functions.scalar import flag, round_even
from .cleaning import DataGateError, first_present
from .ranking import bounded_rank_table


def peer_sufficiency(df: DataFrame, min_peers: int = 10) -> DataFrame:
    """PEER_DATA_SUFFICIENT from the peer count the table has; 1 without one."""
    name = first_present(df, ["PEER_COUNT", "STAT_PEER_COUNT"])
    value = F.lit(1) if name is None else flag(F.col(name) >= min_peers)
    return df.withColumn("PEER_DATA_SUFFICIENT", value)


def quality_tier(df: DataFrame, verification_only: bool = False) -> DataFrame:
    """DATA_QUALITY_TIER from the missing-field count.

    ``verification_only`` adds the tier for works without a positive sanction.
    """
    if "MISSING_FIELD_COUNT" in df.columns:
        missing = F.coalesce(F.col("MISSING_FIELD_COUNT"), F.lit(0))
    else:
        missing = F.lit(0)
    tier = (
        F.when(missing == 0, "HIGH").when(missing == 1, "MEDIUM").when(missing >= 2, "LOW")
        .otherwise("MEDIUM")
    )
    if verification_only and "SANCTION_AMOUNT" in df.columns:
        sanctioned = F.coalesce(F.col("SANCTION_AMOUNT") > 0, F.lit(False))
        tier = F.when(~sanctioned, "VERIFICATION_ONLY").otherwise(tier)
    return df.withColumn("DATA_QUALITY_TIER", tier)


def calibrate(df: DataFrame, prefix: str) -> DataFrame:
    """Percentile rank of a detector's score among its own candidates, else 0."""
    score, out = f"{prefix}_SCORE", f"{prefix}_SCORE_CALIBRATED"
    candidate = F.col(f"{prefix}_CANDIDATE") == 1
    # whole-number scores 0..100: the rank table has at most 101 rows
    table = F.broadcast(bounded_rank_table(df.filter(candidate), score, "_rank"))
    return (
        df.join(table, score, "left")
        .withColumn(out, F.when(candidate, F.col("_rank")).otherwise(F.lit(0.0)))
        .drop("_rank")
    )


def _weighted(c: str, weight: float) -> Column:
    return round_even(F.col(c) * weight, 2)


def score_fusion(df: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Components, bonus and hybrid score from calibrated detector scores."""
    signals = F.col("RULE_CANDIDATE") + F.col("STAT_CANDIDATE") + F.col("ML_CANDIDATE")
    df = df.withColumns(
        {
            "INDEPENDENT_SIGNAL_COUNT": signals,
            "RULE_COMPONENT": _weighted("RULE_SCORE_CALIBRATED", config.rule_weight),
            "STAT_COMPONENT": F.when(
                F.col("PEER_DATA_SUFFICIENT") == 1,
                _weighted("STAT_SCORE_CALIBRATED", config.stat_weight),
            ).otherwise(F.lit(0.0)),
            "ML_COMPONENT": _weighted("ML_SCORE_CALIBRATED", config.ml_weight),
        }
    )
    n = F.col("INDEPENDENT_SIGNAL_COUNT")
    df = df.withColumn(
        "AGREEMENT_BONUS",
        F.when(n >= 3, F.lit(config.bonus_three)).when(n >= 2, F.lit(config.bonus_two))
        .otherwise(F.lit(0.0)),
    )
    total = (
        F.col("RULE_COMPONENT") + F.col("STAT_COMPONENT") + F.col("ML_COMPONENT")
        + F.col("AGREEMENT_BONUS")
    )
    if config.cap:
        total = F.least(total, F.lit(100.0))
    return df.withColumn("HYBRID_RISK_SCORE", round_even(total, 1))


def triage(df: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Risk level, priority and agreement; three signals always mean P1."""
    score, n = F.col("HYBRID_RISK_SCORE"), F.col("INDEPENDENT_SIGNAL_COUNT")
    p1, p2, p3 = config.tiers

    def tiers(*labels: str) -> Column:
        return (
            F.when(n == 3, labels[0]).when(score >= p1, labels[0]).when(score >= p2, labels[1])
            .when(score >= p3, labels[2]).when(score > 0, labels[3]).otherwise(labels[4])
        )

    fired = [
        F.when(F.col(f"{p}_CANDIDATE") == 1, F.lit(name))
        for p, name in (("RULE", "RULE"), ("STAT", "STATISTICAL"), ("ML", "ML"))
    ]
    return df.withColumns(
        {
            "HYBRID_RISK_LEVEL": tiers("CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"),
            "INVESTIGATION_PRIORITY": tiers("P1", "P2", "P3", "P4", "P0"),
            "DETECTOR_AGREEMENT": F.when(n == 3, "RULE + STATISTICAL + ML")
            .when(n == 2, "TWO METHODS AGREE").when(n == 1, "ONE METHOD").otherwise("NO SIGNAL"),
            "DETECTOR_SET": F.concat_ws(" + ", *fired),
            "INVESTIGATION_CANDIDATE": (n > 0).cast("int"),
        }
    )


def fuse(df: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Hybrid risk for every work.

    Expects RULE_/STAT_ score, severity and candidate columns plus ML_ANOMALY,
    ML_PERCENTILE and ML_SEVERITY on each row.
    """
    df = df.withColumns(
        {
            "ML_CANDIDATE": F.coalesce(F.col("ML_ANOMALY"), F.lit(0)).cast("int"),
            "ML_SEVERITY": F.coalesce(F.col("ML_SEVERITY"), F.lit("NONE")),
            "ML_SCORE_CALIBRATED": F.coalesce(F.col("ML_PERCENTILE"), F.lit(0.0)),
        }
    )
    df = calibrate(calibrate(df, "RULE"), "STAT")
    df = quality_tier(peer_sufficiency(df, config.min_peers), config.verification_only)
    df = df.withColumn(
        "SCORE_REGIME",
        F.when(F.col("PEER_DATA_SUFFICIENT") == 1, "STANDARD").otherwise("SPARSE_PEER"),
    )
    return triage(score_fusion(df, config), config)


def require_consensus_first(hybrid: DataFrame) -> DataFrame:
    """Raise if a work flagged by all three detectors is not in P1."""
    strays = hybrid.filter(
        (F.col("INDEPENDENT_SIGNAL_COUNT") == 3) & (F.col("INVESTIGATION_PRIORITY") != "P1")
    ).count()
    if strays:
        raise DataGateError(f"{strays} three-detector works are not in P1")
    return hybrid


HYBRID_COLUMNS = (
    "WORK_ID", "STATE_ID", "STATE_NAME", "CONSTITUENCY_ID", "CONSTITUENCY", "MP_ID", "MP_NAME",
    "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_DESCRIPTION", "WORK_STAGE", "SOURCE_KEY",
    "RECOMMENDED_AMOUNT", "SANCTION_AMOUNT", "ACTUAL_AMOUNT", "TOTAL_FUND_DISBURSED_AMT",
    "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "RULE_SCORE", "RULE_SCORE_CALIBRATED",
    "RULE_SEVERITY", "RULE_CANDIDATE", "STAT_SCORE", "STAT_SCORE_CALIBRATED", "STAT_SEVERITY",
    "STAT_CANDIDATE", "ML_PERCENTILE", "ML_SCORE_CALIBRATED", "ML_SEVERITY", "ML_CANDIDATE",
    "PEER_DATA_SUFFICIENT", "SCORE_REGIME", "DATA_QUALITY_TIER", "RULE_COMPONENT",
    "STAT_COMPONENT", "ML_COMPONENT", "AGREEMENT_BONUS", "INDEPENDENT_SIGNAL_COUNT",
    "DETECTOR_AGREEMENT", "DETECTOR_SET", "HYBRID_RISK_SCORE", "HYBRID_RISK_LEVEL",
    "INVESTIGATION_PRIORITY", "INVESTIGATION_CANDIDATE",
)


def hybrid_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in HYBRID_COLUMNS if c in df.columns])


def priority_rank(c: str = "INVESTIGATION_PRIORITY") -> Column:
    """P1..P4 as 1..4, P0 last."""
    return F.when(F.col(c) == "P0", 5).otherwise(F.substring(c, 2, 1).cast("int"))


def queue_order(df: DataFrame) -> DataFrame:
    """Priority, hybrid score, ML percentile; the work id settles ties."""
    return df.orderBy(
        priority_rank(), F.desc("HYBRID_RISK_SCORE"), F.desc_nulls_last("ML_PERCENTILE"), "WORK_ID"
    )


# --- first generation -------------------------------------------------------


def fuse_audit(
    rules: DataFrame,
    stats: DataFrame | None,
    ml: DataFrame,
    key: str,
    config: FusionConfig = FusionConfig(),
) -> DataFrame:
    """First-generation hybrid: weighted raw scores and an agreement matrix.

    Without ``stats``, ``rules`` has the statistical columns as well.
    """
    scored = rules if stats is None else rules.join(stats, key, "left")
    df = scored.join(ml, key, "left")

    def part(c: str, weight: float) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)).cast("double") * weight

    df = df.withColumns(
        {
            "RULE_CONTRIBUTION": part("RULE_SCORE", config.rule_weight),
            "STATISTICAL_CONTRIBUTION": part("STATISTICAL_SCORE", config.stat_weight),
            "ML_CONTRIBUTION": part("ISOLATION_FOREST_SCORE", config.ml_weight),
            "DETECTOR_AGREEMENT_COUNT": flag(F.col("RULE_ANOMALY_FLAG"))
            + flag(F.col("STATISTICAL_ANOMALY_FLAG")) + flag(F.col("ISOLATION_FOREST_ANOMALY_FLAG")),
        }
    )
    total = (
        F.col("RULE_CONTRIBUTION") + F.col("STATISTICAL_CONTRIBUTION") + F.col("ML_CONTRIBUTION")
    )
    score, n = F.col("HYBRID_RISK_SCORE"), F.col("DETECTOR_AGREEMENT_COUNT")
    df = df.withColumns(
        {
            "HYBRID_RISK_SCORE": round_even(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2),
            "DETECTOR_AGREEMENT": F.when(n == 3, "STRONG").when(n == 2, "MODERATE")
            .when(n == 1, "SINGLE_DETECTOR").otherwise("NONE"),
        }
    )
    df = df.withColumn(
        "FINAL_RISK_LEVEL",
        F.when((score >= 70) & (n >= 2), "CRITICAL")
        .when(((score >= 50) & (n >= 2)) | ((score >= 65) & (n >= 1)), "HIGH")
        .when((score >= 30) | ((score >= 20) & (n >= 2)), "MEDIUM")
        .otherwise("LOW"),
    )
    level = F.col("FINAL_RISK_LEVEL")
    df = df.withColumn(
        "INVESTIGATION_PRIORITY",
        F.when(level == "CRITICAL", 1).when(level == "HIGH", 2).when(level == "MEDIUM", 3)
        .when(n >= 2, 4).otherwise(5),
    )
    return df.withColumn("EVIDENCE_SUMMARY", audit_summary())


def audit_summary() -> Column:
    """Detector reasons and the agreement sentence, pipe-joined."""
    def reason(prefix: str, c: str, nothing: str) -> Column:
        text = F.col(c)
        return F.when((text != "") & (text != nothing), F.concat(F.lit(prefix), text))

    agreement = F.col("DETECTOR_AGREEMENT")
    # Wording of the evidence summary.
    parts = [
        reason("RULE: ", "RULE_REASONS", "No rule-based anomaly detected"),
        reason("STATISTICAL: ", "STATISTICAL_REASONS", "No statistical anomaly detected"),
        reason("ML: ", "ISOLATION_FOREST_REASON", "No strong Isolation Forest anomaly detected"),
        F.when(agreement == "STRONG", "All three detection layers identify unusual behavior")
        .when(agreement == "MODERATE",
              "Two independent detection layers identify unusual behavior")
        .when(agreement == "SINGLE_DETECTOR",
              "Only one detection layer identifies unusual behavior"),
    ]
    text = F.concat_ws(" | ", *parts)
    return F.when(text == "", "No significant anomaly evidence detected").otherwise(text)
