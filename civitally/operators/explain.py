"""Tables around an external reviewer model: selection, prompts, answers, cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalar import round_even
from .ranking import first_per_key

# How many works of each level are sent for review.
REVIEW_LIMITS = {"CRITICAL": 50, "HIGH": 30, "MEDIUM": 20}
REVIEW_TOTAL = 100


def selection_score(df: DataFrame) -> Column:
    """Review urgency: hybrid score first, then agreement and activity."""
    def value(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)

    return (
        value("HYBRID_RISK_SCORE") * 100
        + value("INDEPENDENT_SIGNAL_COUNT") * 20
        + value("RULE_SCORE")
        + value("STAT_SCORE")
        + value("ML_PERCENTILE") * 0.5
        + F.least(value("PAYMENT_COUNT"), F.lit(50.0)) * 0.5
        + F.least(value("UNIQUE_VENDOR_COUNT"), F.lit(30.0)) * 0.5
    )


def select_for_review(
    queue: DataFrame, limits: dict[str, int] = REVIEW_LIMITS, total: int = REVIEW_TOTAL
) -> DataFrame:
    """Top works per level by selection score.

    Each level is a top-k of its own, so no level is gathered in one task.
    """
    scored = queue.withColumn("SELECTION_SCORE", selection_score(queue))
    level = F.upper(F.trim("HYBRID_RISK_LEVEL"))
    parts = [
        scored.filter(level == name)
        .withColumn("LEVEL_ORDER", F.lit(i))
        .orderBy(F.desc("SELECTION_SCORE"), "WORK_ID")
        .limit(n)
        for i, (name, n) in enumerate(limits.items())
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .orderBy("LEVEL_ORDER", F.desc("SELECTION_SCORE"), "WORK_ID")
        .limit(total)
        .drop("LEVEL_ORDER")
    )


# Evidence key -> (queue column, rendering).
COMPACT_FIELDS = {
    "work_id": ("WORK_ID", "text"), "state": ("STATE_NAME", "text"),
    "constituency": ("CONSTITUENCY", "text"), "work_category": ("WORK_CATEGORY", "text"),
    "activity": ("ACTIVITY_NAME", "text"), "description": ("WORK_DESCRIPTION", "text"),
    "work_stage": ("WORK_STAGE", "text"), "risk_level": ("HYBRID_RISK_LEVEL", "text"),
    "risk_score": ("HYBRID_RISK_SCORE", "number"), "priority": ("INVESTIGATION_PRIORITY", "text"),
    "independent_signals": ("INDEPENDENT_SIGNAL_COUNT", "number"),
    "detector_agreement": ("DETECTOR_AGREEMENT", "text"), "sanction": ("SANCTION_AMOUNT", "money"),
    "actual": ("ACTUAL_AMOUNT", "money"), "disbursed": ("TOTAL_FUND_DISBURSED_AMT", "money"),
    "payment_count": ("PAYMENT_COUNT", "number"),
    "successful_payments": ("PAYMENT_SUCCESS_COUNT", "number"),
    "in_progress_payments": ("PAYMENT_IN_PROGRESS_COUNT", "number"),
    "vendor_count": ("UNIQUE_VENDOR_COUNT", "number"),
    "payments_per_30_days": ("PAYMENTS_PER_30_DAYS", "number"),
    "completion_duration_days": ("COMPLETION_DURATION_DAYS", "number"),
    "payment_after_completion_days": ("PAYMENT_AFTER_REPORTED_COMPLETION_DAYS", "number"),
    "completion_before_last_payment": ("COMPLETION_BEFORE_LAST_PAYMENT", "text"),
    "peer_count": ("PEER_COUNT", "number"), "peer_median_sanction": ("PEER_MEDIAN_SANCTION", "money"),
    "sanction_to_peer_median": ("SANCTION_TO_PEER_MEDIAN", "number"),
    "missing_field_count": ("MISSING_FIELD_COUNT", "number"), "attachment_id": ("ATTACH_ID", "text"),
}


def compact_evidence(df: DataFrame) -> Column:
    """Struct of the facts a reviewer may use; absent facts say so."""
    fields = []
    for key, (name, kind) in COMPACT_FIELDS.items():
        if name not in df.columns:
            value = F.lit(tx.MISSING)
        elif kind == "money":
            value = tx.money(name, 0)
        elif kind == "number":
            rounded = round_even(name, 3)
            whole = rounded == F.floor(rounded)
            value = F.coalesce(
                F.when(whole, rounded.cast("bigint").cast("string")).otherwise(
                    F.regexp_replace(tx.fixed(rounded, 3), "0+$", "")
                ),
                F.lit(tx.MISSING),
            )
        else:
            value = F.coalesce(F.col(name).cast("string"), F.lit(tx.MISSING))
        fields.append(value.alias(key))
    return F.struct(*fields)


def review_requests(selected: DataFrame) -> DataFrame:
    """WORK_ID, EVIDENCE json and its hash: the table handed to the reviewer."""
    return selected.select(
        "WORK_ID", "SELECTION_SCORE", F.to_json(compact_evidence(selected)).alias("EVIDENCE")
    ).withColumn("EVIDENCE_HASH", F.sha2("EVIDENCE", 256))


ANSWER_FIELDS = ("summary", "signals", "verify", "confidence")


def read_answers(answers: DataFrame, column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) reviewer answers.

    An answer is usable when its outermost object parses and has every required
    field; a list field holding one text counts as a list of one.
    """
    body = answers.withColumn("_body", tx.answer_json(column))
    parsed = body.withColumn("_map", F.from_json("_body", "map<string,string>"))
    have = F.map_keys("_map")
    complete = F.col("_map").isNotNull()
    for field in ANSWER_FIELDS:
        complete = complete & F.array_contains(have, field)

    def listed(field: str) -> Column:
        value = F.col("_map")[field]
        as_list = F.from_json(value, "array<string>")
        return F.when(F.trim(value).startswith("["), as_list).otherwise(F.array(value))

    good = parsed.filter(F.coalesce(complete, F.lit(False)))
    usable = good.select(
        "WORK_ID",
        F.lit("GENERATED").alias("STATUS"),
        F.col("_map")["summary"].alias("RISK_SUMMARY"),
        F.to_json(listed("signals")).alias("OBSERVED_SIGNALS"),
        F.col("_map")["summary"].alias("WHY_FLAGGED"),
        F.lit("[]").alias("LIMITATIONS"),
        F.to_json(listed("verify")).alias("WHAT_TO_VERIFY"),
        F.col("_map")["confidence"].alias("CONFIDENCE"),
    )
    rejected = parsed.filter(~F.coalesce(complete, F.lit(False))).select("WORK_ID", column)
    return usable, rejected


def explanation_table(queue: DataFrame, selected: DataFrame, usable: DataFrame) -> DataFrame:
    """One row per queued work: its explanation, or NOT_SELECTED with blanks.

    Works that were selected but have no usable answer are REJECTED, with blanks.
    """
    chosen = selected.select("WORK_ID", F.lit(1).alias("_chosen"))
    base = queue.select("WORK_ID").distinct().join(chosen, "WORK_ID", "left")
    merged = base.join(usable, "WORK_ID", "left")
    status = F.when(F.col("_chosen") == 1, F.coalesce("STATUS", F.lit("REJECTED")))

    def blank(c: str, empty: str) -> Column:
        return F.coalesce(F.when(F.col("_chosen") == 1, F.col(c)), F.lit(empty)).alias(c)

    return merged.select(
        "WORK_ID", F.coalesce(status, F.lit("NOT_SELECTED")).alias("STATUS"), blank("RISK_SUMMARY", ""),
        blank("OBSERVED_SIGNALS", "[]"), blank("WHY_FLAGGED", ""), blank("LIMITATIONS", "[]"),
        blank("WHAT_TO_VERIFY", "[]"), blank("CONFIDENCE", ""),
    )


def cached_answers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """CACHE_STATE per request: FRESH, STALE (evidence changed) or MISSING."""
    known = cache.select("WORK_ID", F.col("EVIDENCE_HASH").alias("_cached"))
    state = (
        F.when(F.col("_cached").isNull(), "MISSING")
        .when(F.col("_cached") == F.col("EVIDENCE_HASH"), "FRESH").otherwise("STALE")
    )
    return requests.join(known, "WORK_ID", "left").withColumn("CACHE_STATE", state).drop("_cached")


def migrate_answers(cache: DataFrame, legacy: DataFrame, requests: DataFrame) -> DataFrame:
    """Add legacy explanations of known works that the cache does not have."""
    moved = (
        legacy.join(cache.select("WORK_ID"), "WORK_ID", "left_anti")
        .join(requests.select("WORK_ID", "EVIDENCE_HASH"), "WORK_ID")
        .withColumn("SOURCE", F.lit("legacy_migration"))
    )
    return cache.unionByName(moved, allowMissingColumns=True)


def latest_answers(answers: DataFrame, order: str) -> DataFrame:
    """One answer per work, the last landed."""
    return first_per_key(answers, ["WORK_ID"], [F.col(order)], last=True)


def default_explanation(df: DataFrame) -> DataFrame:
    """Explanation without a reviewer answer, built from the record alone."""
    c = F.col
    score = F.coalesce(c("HYBRID_RISK_SCORE"), F.lit(0.0))
    tier = F.concat(
        F.lit("risk score "), tx.number(score), F.lit(" ("), c("INVESTIGATION_PRIORITY"),
        F.lit(" tier)"),
    )
    # Wording of the explanation.
    signals = F.array_compact(
        F.array(
            F.concat(
                F.when(score >= 60, "Critical severity ").when(score >= 40, "High severity ")
                .otherwise("Hybrid "),
                tier,
            ),
            F.when(
                c("PAYMENTS_PER_30_DAYS") > 0,
                F.concat(F.lit("Recorded payment velocity: "), tx.number("PAYMENTS_PER_30_DAYS"),
                         F.lit(" disbursements per 30 days")),
            ),
            F.when(
                c("UNIQUE_VENDOR_COUNT") > 1,
                F.concat(F.lit("Vendor distribution across "),
                         c("UNIQUE_VENDOR_COUNT").cast("string"),
                         F.lit(" unique recipient entities")),
            ),
            F.when(
                c("DISBURSED_TO_SANCTION_RATIO") > 0.8,
                F.concat(F.lit("High fund utilization: "),
                         tx.fixed(c("DISBURSED_TO_SANCTION_RATIO") * 100, 1),
                         F.lit("% disbursed of sanctioned sum")),
            ),
        )
    )
    return df.select(
        "WORK_ID",
        F.concat(
            F.lit("Work #"), c("WORK_ID").cast("string"),
            F.lit(" evaluated with a Hybrid Risk Score of "), tx.number(score), F.lit(" ("),
            c("INVESTIGATION_PRIORITY"), F.lit(" priority). Triaged under "),
            c("DETECTOR_AGREEMENT"), F.lit("."),
        ).alias("RISK_SUMMARY"),
        F.to_json(signals).alias("OBSERVED_SIGNALS"),
        F.lit(
            "Selected for forensic review due to convergence of rule violations, statistical peer "
            "divergence, or isolation forest anomaly scoring."
        ).alias("WHY_FLAGGED"),
        F.lit("medium").alias("CONFIDENCE"),
        F.lit("deterministic").alias("SOURCE"),
    )


# Facts of a work that its record shows beside the risk columns.
RECORD_FACTS = (
    "MISSING_FIELD_COUNT", "PAYMENTS_PER_30_DAYS", "SANCTION_PEER_Z_SCORE", "ATTACH_ID",
    "FILE_STATUS", "DISBURSED_TO_SANCTION_RATIO", "ACTUAL_TO_SANCTION_RATIO",
    "SANCTION_TO_RECOMMENDED_RATIO", "PAYMENT_SUCCESS_COUNT", "PAYMENT_IN_PROGRESS_COUNT",
    "FIRST_EXPENDITURE_DATE", "LAST_EXPENDITURE_DATE", "RECOMMENDATION_DATE", "SANCTION_DATE",
    "ACTUAL_END_DATE", "PEER_COUNT", "PEER_MEDIAN_SANCTION", "SANCTION_TO_PEER_MEDIAN",
)


def unified_record(
    hybrid: DataFrame, features: DataFrame, queue: DataFrame, explanations: DataFrame
) -> DataFrame:
    """Every work with its own facts, and queue evidence where it has some.

    Texts have stated defaults; facts that are not known stay NULL.
    """
    facts = queue.select(
        "WORK_ID", "INVESTIGATION_SUMMARY", "FACTUAL_EVIDENCE", "VERIFICATION_FLAGS"
    )
    own = [c for c in RECORD_FACTS if c in features.columns]
    hybrid = hybrid.drop(*own).join(features.select("WORK_ID", *own), "WORK_ID", "left")
    told = explanations.select("WORK_ID", F.lit(True).alias("_told"))
    money = F.coalesce(F.col("SANCTION_AMOUNT").cast("string"), F.lit("0"))
    paid = F.coalesce(F.col("TOTAL_FUND_DISBURSED_AMT").cast("string"), F.lit("0"))
    return (
        hybrid.join(facts, "WORK_ID", "left")
        .join(told, "WORK_ID", "left")
        .withColumns(
            {
                "INVESTIGATION_SUMMARY": F.coalesce(
                    "INVESTIGATION_SUMMARY",
                    F.concat(
                        F.lit("Work record #"), F.col("WORK_ID").cast("string"),
                        F.lit(" analyzed by multi-detector engine with risk score "),
                        tx.number("HYBRID_RISK_SCORE"), F.lit("."),
                    ),
                ),
                "FACTUAL_EVIDENCE": F.coalesce(
                    "FACTUAL_EVIDENCE",
                    F.concat(F.lit("Sanction Amount: ₹"), money, F.lit(", Disbursed: ₹"), paid),
                ),
                "VERIFICATION_FLAGS": F.coalesce(
                    "VERIFICATION_FLAGS",
                    F.when(F.col("HYBRID_RISK_LEVEL") == "CRITICAL", "FLAGGED_BY_CONSENSUS")
                    .otherwise("BASELINE_AUDIT"),
                ),
                "EXPLAINED": F.coalesce("_told", F.lit(False)),
            }
        )
        .drop("_told")
    )
