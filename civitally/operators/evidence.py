"""Evidence texts, the investigation queue, dossiers and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalar import ratio
from .cleaning import first_present
from .fusion import priority_rank
from .joining import join_new_columns

# Evidence field -> columns that may hold it, in order of preference.
ALIASES = {
    "RECOMMENDED": ("RECOMMENDED_AMOUNT", "RECOMMENDED_AMT"),
    "SANCTION": ("SANCTION_AMOUNT", "SANCTION_AMT"),
    "ACTUAL": ("ACTUAL_AMOUNT", "ACTUAL_AMT"),
    "DISBURSED": ("TOTAL_FUND_DISBURSED_AMT", "TOTAL_DISBURSED_AMOUNT", "DISBURSED_AMOUNT"),
    "PAYMENTS": ("PAYMENT_COUNT", "TOTAL_PAYMENT_COUNT"),
    "VENDORS": ("UNIQUE_VENDOR_COUNT", "VENDOR_COUNT"),
    "SUCCESS": ("PAYMENT_SUCCESS_COUNT", "SUCCESSFUL_PAYMENT_COUNT"),
    "IN_PROGRESS": ("PAYMENT_IN_PROGRESS_COUNT", "IN_PROGRESS_PAYMENT_COUNT"),
    "PER_30": ("PAYMENTS_PER_30_DAYS",),
    "PER_100": ("PAYMENTS_PER_100_DAYS",),
    "RECOMMENDED_ON": ("RECOMMENDATION_DATE",),
    "SANCTIONED_ON": ("SANCTION_DATE",),
    "FIRST_PAID_ON": ("FIRST_PAYMENT_DATE", "FIRST_EXPENDITURE_DATE"),
    "LAST_PAID_ON": ("LAST_PAYMENT_DATE", "LAST_EXPENDITURE_DATE"),
    "COMPLETED_ON": ("COMPLETION_DATE", "ACTUAL_COMPLETION_DATE", "ACTUAL_END_DATE"),
    "DURATION": ("COMPLETION_DURATION_DAYS",),
    "PAID_AFTER": ("PAYMENT_AFTER_REPORTED_COMPLETION_DAYS",),
    "PEERS": ("PEER_COUNT",),
    "PEER_MEDIAN": ("PEER_MEDIAN_SANCTION",),
    "PEER_MEAN": ("PEER_MEAN_SANCTION",),
    "PEER_Z": ("SANCTION_PEER_Z_SCORE", "PEER_Z_SCORE"),
    "COMPLETENESS": ("DATA_COMPLETENESS", "DATA_COMPLETENESS_SCORE", "DATA_COMPLETENESS_RATIO"),
    "MISSING": ("MISSING_FIELD_COUNT", "MISSING_FIELDS_COUNT"),
    "ATTACHMENT": ("ATTACH_ID",),
    "FILE": ("FILE_STATUS",),
}


def resolve(df: DataFrame) -> dict[str, Column]:
    """Evidence field -> column present in the table; absent fields are left out."""
    found = {field: first_present(df, names) for field, names in ALIASES.items()}
    return {field: F.col(name) for field, name in found.items() if name}


def evidence_ratios(df: DataFrame) -> DataFrame:
    f = resolve(df)
    pairs = {
        "ACTUAL_TO_SANCTION_RATIO": ("ACTUAL", "SANCTION"),
        "DISBURSED_TO_SANCTION_RATIO": ("DISBURSED", "SANCTION"),
        "RECOMMENDED_TO_SANCTION_RATIO": ("RECOMMENDED", "SANCTION"),
        "SANCTION_TO_PEER_MEDIAN_CALCULATED": ("SANCTION", "PEER_MEDIAN"),
    }
    return df.withColumns(
        {out: ratio(f[a], f[b]) for out, (a, b) in pairs.items() if a in f and b in f}
    )


def factual_evidence(df: DataFrame) -> Column:
    """Ordered sentences on the recorded facts; absent facts are skipped."""
    f = resolve(df)
    have = set(df.columns)
    enough = (f["PEERS"] >= 10) if "PEERS" in f else F.lit(False)

    def say(field: str, label: str, render, also: Column | None = None) -> Column | None:
        if field not in f:
            return None
        sentence = F.concat(F.lit(f"{label}: "), render(f[field]), F.lit("."))
        present = f[field].isNotNull() if also is None else f[field].isNotNull() & also
        return F.when(present, sentence)

    def share(name: str, label: str) -> Column | None:
        if name not in have:
            return None
        return F.when(
            F.col(name).isNotNull(), F.concat(F.lit(f"{label}: "), tx.percent(name), F.lit("."))
        )

    def plain(c: Column) -> Column:
        return c.cast("string")

    # Wording and order of the factual sentences.
    sentences = [
        say("RECOMMENDED", "Recommended amount", tx.money),
        say("SANCTION", "Sanction amount", tx.money),
        say("ACTUAL", "Reported actual expenditure", tx.money),
        say("DISBURSED", "Recorded fund disbursement", tx.money),
        share("ACTUAL_TO_SANCTION_RATIO", "Actual-to-sanction ratio"),
        share("DISBURSED_TO_SANCTION_RATIO", "Disbursed-to-sanction ratio"),
        say("PAYMENTS", "Payment transaction count", tx.number),
        say("VENDORS", "Unique vendor count", tx.number),
        say("SUCCESS", "Successful payment count", tx.number),
        say("IN_PROGRESS", "In-progress payment count", tx.number),
        say("PER_30", "Payments per 30 days", tx.number),
        say("PER_100", "Payments per 100 days", tx.number),
        say("RECOMMENDED_ON", "Recommendation date", plain),
        say("SANCTIONED_ON", "Sanction date", plain),
        say("FIRST_PAID_ON", "First recorded payment date", plain),
        say("COMPLETED_ON", "Reported completion date", plain),
        say("LAST_PAID_ON", "Last recorded payment date", plain),
        say("DURATION", "Reported completion duration", tx.day_count),
        F.when(
            f["PAID_AFTER"] > 0,
            F.concat(
                F.lit("Recorded payment activity occurred "), tx.day_count(f["PAID_AFTER"]),
                F.lit(" after reported completion."),
            ),
        ) if "PAID_AFTER" in f else None,
        say("PEERS", "Peer-group size used by the feature set", tx.number),
        say("PEER_MEDIAN", "Peer median sanction amount", tx.money, enough),
        say("PEER_MEAN", "Peer mean sanction amount", tx.money, enough),
        say("PEER_Z", "Sanction peer z-score", tx.number, enough),
        say("COMPLETENESS", "Recorded data completeness", tx.percent),
        say("MISSING", "Missing-field count", tx.number),
        F.when(f["ATTACHMENT"].isNotNull(), "Attachment identifier is present.").otherwise(
            "Attachment identifier is not present in the available record."
        ) if "ATTACHMENT" in f else None,
        say("FILE", "File status", plain),
    ]
    return F.concat_ws(" ", *[s for s in sentences if s is not None])


def verification_flags(df: DataFrame) -> Column:
    """Numbered checks an auditor should make."""
    f = resolve(df)
    nothing = F.lit(False)

    def at(field: str, test) -> Column:
        return test(f[field]) if field in f else nothing

    def above_one(name: str) -> Column:
        return F.col(name) > 1 if name in df.columns else nothing

    # Wording and order of the checks.
    checks = [
        (at("PAYMENTS", lambda c: c >= 5),
         "Verify the individual payment transactions and supporting payment records."),
        (at("VENDORS", lambda c: c >= 5),
         "Verify vendor identities, work orders, and supporting procurement records."),
        (at("PAID_AFTER", lambda c: c > 0),
         "Verify the reported completion date against payment and measurement records."),
        (above_one("ACTUAL_TO_SANCTION_RATIO"),
         "Verify reported actual expenditure against the sanctioned amount."),
        (above_one("DISBURSED_TO_SANCTION_RATIO"),
         "Verify recorded disbursement against the sanctioned amount."),
        (at("PEERS", lambda c: c < 10),
         "Peer comparison is weak because fewer than 10 comparable works are available."),
        (at("COMPLETENESS", lambda c: c < 0.60),
         "Verify missing source fields before drawing strong conclusions from this record."),
        (F.lit(True),
         "Confirm findings against original government records and supporting documents."),
    ]
    return tx.numbered([F.when(cond, F.lit(text)) for cond, text in checks])


def detector_evidence() -> Column:
    """Which detectors fired and how strongly."""
    def part(flag: str, text: str, joiner: str, value: str, places: int, tail: str) -> Column:
        strength = F.when(
            F.col(value).isNotNull(),
            F.concat(F.lit(joiner), tx.fixed(value, places), F.lit(tail)),
        )
        return F.when(F.col(flag) == 1, F.concat(F.lit(text), F.coalesce(strength, F.lit(""))))

    # Wording of the detector sentence.
    text = F.concat_ws(
        "; ",
        part("RULE_CANDIDATE", "Rule detector produced a candidate signal", " with score ",
             "RULE_SCORE", 1, ""),
        part("STAT_CANDIDATE", "Statistical detector produced a candidate signal", " with score ",
             "STAT_SCORE", 1, ""),
        part("ML_CANDIDATE", "Isolation Forest produced an ML anomaly signal", " at the ",
             "ML_PERCENTILE", 2, "th percentile"),
    )
    return F.when(text == "", "No detector signal.").otherwise(F.concat(text, F.lit(".")))


def investigation_summary(df: DataFrame) -> Column:
    who = [F.col(c) for c in ("STATE_NAME", "CONSTITUENCY") if c in df.columns]
    if "MP_NAME" in df.columns:
        who.append(tx.when_present("MP_NAME", "MP: ", F.col("MP_NAME")))
    place = F.concat_ws(" | ", *who)
    # Wording of the summary.
    return F.concat(
        F.when(place != "", F.concat(place, F.lit(". "))).otherwise(""),
        F.lit("Hybrid risk level: "), F.coalesce("HYBRID_RISK_LEVEL", F.lit("None")),
        F.lit("; hybrid score: "), tx.number("HYBRID_RISK_SCORE"),
        F.lit("; detector agreement: "), F.coalesce("DETECTOR_AGREEMENT", F.lit("None")),
        F.lit(". This record is an investigation candidate requiring verification, not a finding "
              "of fraud or corruption."),
    )


QUEUE_COLUMNS = (
    "WORK_ID", "STATE_ID", "STATE_NAME", "CONSTITUENCY_ID", "CONSTITUENCY", "MP_ID", "MP_NAME",
    "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_DESCRIPTION", "WORK_STAGE", "RECOMMENDED_AMOUNT",
    "SANCTION_AMOUNT", "ACTUAL_AMOUNT", "TOTAL_FUND_DISBURSED_AMT", "ACTUAL_TO_SANCTION_RATIO",
    "DISBURSED_TO_SANCTION_RATIO", "RECOMMENDED_TO_SANCTION_RATIO", "PAYMENT_COUNT",
    "UNIQUE_VENDOR_COUNT", "PAYMENT_SUCCESS_COUNT", "PAYMENT_IN_PROGRESS_COUNT",
    "PAYMENTS_PER_30_DAYS", "PAYMENTS_PER_100_DAYS", "RECOMMENDATION_DATE", "SANCTION_DATE",
    "FIRST_PAYMENT_DATE", "LAST_PAYMENT_DATE", "COMPLETION_DATE", "COMPLETION_DURATION_DAYS",
    "PAYMENT_AFTER_REPORTED_COMPLETION_DAYS", "COMPLETION_BEFORE_LAST_PAYMENT", "PEER_COUNT",
    "PEER_MEDIAN_SANCTION", "PEER_MEAN_SANCTION", "SANCTION_PEER_Z_SCORE",
    "SANCTION_TO_PEER_MEDIAN", "DATA_COMPLETENESS", "MISSING_FIELD_COUNT", "ATTACH_ID",
    "FILE_STATUS", "RULE_CANDIDATE", "RULE_SCORE", "RULE_SEVERITY", "STAT_CANDIDATE", "STAT_SCORE",
    "STAT_SEVERITY", "ML_CANDIDATE", "ML_PERCENTILE", "ML_SEVERITY", "INDEPENDENT_SIGNAL_COUNT",
    "DETECTOR_AGREEMENT", "DETECTOR_SET", "HYBRID_RISK_SCORE", "HYBRID_RISK_LEVEL",
    "INVESTIGATION_PRIORITY", "INVESTIGATION_CANDIDATE", "PEER_DATA_SUFFICIENT", "SCORE_REGIME",
    "DATA_QUALITY_TIER", "DETECTOR_EVIDENCE", "FACTUAL_EVIDENCE", "VERIFICATION_FLAGS",
    "INVESTIGATION_SUMMARY",
)


def candidates_with_facts(hybrid: DataFrame, features: DataFrame) -> DataFrame:
    """Investigation candidates with the feature columns they lack."""
    return join_new_columns(hybrid.filter(F.col("INVESTIGATION_CANDIDATE") == 1), features)


def add_evidence(df: DataFrame) -> DataFrame:
    df = evidence_ratios(df)
    return df.withColumns(
        {
            "FACTUAL_EVIDENCE": factual_evidence(df),
            "VERIFICATION_FLAGS": verification_flags(df),
            "DETECTOR_EVIDENCE": detector_evidence(),
            "INVESTIGATION_SUMMARY": investigation_summary(df),
        }
    )


def investigation_queue(hybrid: DataFrame, features: DataFrame) -> DataFrame:
    """Explained candidates, P1 first."""
    df = add_evidence(candidates_with_facts(hybrid, features))
    shown = {
        "FIRST_PAYMENT_DATE": "FIRST_EXPENDITURE_DATE",
        "LAST_PAYMENT_DATE": "LAST_EXPENDITURE_DATE",
        "COMPLETION_DATE": "ACTUAL_END_DATE",
        "DATA_COMPLETENESS": "DATA_COMPLETENESS_RATIO",
    }
    df = df.withColumns(
        {new: F.col(old) for new, old in shown.items() if old in df.columns and new not in df.columns}
    )
    return queue_sorted(df.select(*[c for c in QUEUE_COLUMNS if c in df.columns]))


def queue_sorted(df: DataFrame) -> DataFrame:
    return df.orderBy(priority_rank(), F.desc("HYBRID_RISK_SCORE"), "WORK_ID")


def _fields(df: DataFrame, names: dict[str, str]) -> Column:
    return F.struct(
        *[
            (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(alias)
            for alias, c in names.items()
        ]
    )


def dossier(queue: DataFrame) -> DataFrame:
    """One nested record per work: identity, risk, money, time, peers, quality."""
    q = queue
    return q.select(
        F.col("WORK_ID").cast("string").alias("work_id"),
        _fields(q, {
            "state_id": "STATE_ID", "state_name": "STATE_NAME",
            "constituency_id": "CONSTITUENCY_ID", "constituency": "CONSTITUENCY", "mp_id": "MP_ID",
            "mp_name": "MP_NAME", "work_category": "WORK_CATEGORY",
            "activity_name": "ACTIVITY_NAME", "work_description": "WORK_DESCRIPTION",
            "work_stage": "WORK_STAGE",
        }).alias("identity"),
        _fields(q, {
            "hybrid_risk_score": "HYBRID_RISK_SCORE", "final_risk_level": "HYBRID_RISK_LEVEL",
            "investigation_priority": "INVESTIGATION_PRIORITY",
            "detector_agreement": "DETECTOR_AGREEMENT",
            "detector_agreement_count": "INDEPENDENT_SIGNAL_COUNT", "rule_score": "RULE_SCORE",
            "statistical_score": "STAT_SCORE", "ml_score": "ML_PERCENTILE",
            "peer_data_sufficient": "PEER_DATA_SUFFICIENT",
            "data_quality_tier": "DATA_QUALITY_TIER",
        }).alias("risk"),
        _fields(q, {
            "recommended_amount": "RECOMMENDED_AMOUNT", "sanction_amount": "SANCTION_AMOUNT",
            "actual_amount": "ACTUAL_AMOUNT", "total_fund_disbursed": "TOTAL_FUND_DISBURSED_AMT",
            "actual_to_sanction_ratio": "ACTUAL_TO_SANCTION_RATIO",
            "disbursed_to_sanction_ratio": "DISBURSED_TO_SANCTION_RATIO",
            "recommended_to_sanction_ratio": "RECOMMENDED_TO_SANCTION_RATIO",
        }).alias("financial"),
        _fields(q, {
            "payment_count": "PAYMENT_COUNT", "successful_payments": "PAYMENT_SUCCESS_COUNT",
            "in_progress_payments": "PAYMENT_IN_PROGRESS_COUNT",
            "unique_vendor_count": "UNIQUE_VENDOR_COUNT",
            "payments_per_30_days": "PAYMENTS_PER_30_DAYS",
            "payments_per_100_days": "PAYMENTS_PER_100_DAYS",
        }).alias("transactions"),
        _fields(q, {
            "recommendation_date": "RECOMMENDATION_DATE", "sanction_date": "SANCTION_DATE",
            "completion_duration_days": "COMPLETION_DURATION_DAYS",
            "payment_after_reported_completion_days": "PAYMENT_AFTER_REPORTED_COMPLETION_DAYS",
            "completion_before_last_payment": "COMPLETION_BEFORE_LAST_PAYMENT",
        }).alias("timeline"),
        _fields(q, {
            "peer_count": "PEER_COUNT", "peer_median_sanction": "PEER_MEDIAN_SANCTION",
            "peer_mean_sanction": "PEER_MEAN_SANCTION",
            "sanction_peer_z_score": "SANCTION_PEER_Z_SCORE",
            "sanction_to_peer_median": "SANCTION_TO_PEER_MEDIAN",
        }).alias("peer_comparison"),
        _fields(q, {
            "missing_field_count": "MISSING_FIELD_COUNT", "attachment_id": "ATTACH_ID",
            "file_status": "FILE_STATUS",
        }).alias("data_quality"),
        _fields(q, {
            "factual_evidence": "FACTUAL_EVIDENCE", "verification_flags": "VERIFICATION_FLAGS",
            "investigation_summary": "INVESTIGATION_SUMMARY",
        }).alias("investigation"),
    )


# --- first generation -------------------------------------------------------

DISCLAIMER = (
    "This system identifies anomaly/risk candidates for investigation. It does not establish "
    "fraud or wrongdoing."
)
FINDING_MEASURES = (
    "actual_amount", "disbursed_amount", "sanction_amount", "ratio", "z_score", "vendor_count",
    "transaction_count", "days",
)


def _finding(kind: str | Column, level: str | Column, text: str | Column, **measures: Column) -> Column:
    def literal(v):
        return F.lit(v) if isinstance(v, str) else v

    values = [
        (measures[m].cast("double") if m in measures else F.lit(None).cast("double")).alias(m)
        for m in FINDING_MEASURES
    ]
    dates = [
        (measures[d] if d in measures else F.lit(None)).cast("date").alias(d)
        for d in ("recommendation_date", "sanction_date", "completion_date")
    ]
    return F.struct(
        literal(kind).alias("type"), literal(level).alias("severity"),
        literal(text).alias("finding"), *values, *dates,
    )


def _kept(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def audit_records(df: DataFrame) -> DataFrame:
    """First-generation nested evidence record per work, in one projection."""
    c = F.col
    cost, z = c("COST_VS_PEER_MEDIAN"), c("COST_Z_SCORE")
    over_actual = c("ACTUAL_AMOUNT") > c("SANCTION_AMOUNT")
    over_paid = c("TOTAL_DISBURSED") > c("SANCTION_AMOUNT")
    vendors, moves = c("VENDOR_COUNT"), c("TRANSACTION_COUNT")
    # Finding types, severities and wording.
    financial = _kept(
        F.when(over_actual, _finding(
            "actual_exceeds_sanction", "high", "Actual expenditure exceeds the sanctioned amount",
            actual_amount=c("ACTUAL_AMOUNT"), sanction_amount=c("SANCTION_AMOUNT"))),
        F.when(over_paid, _finding(
            "disbursement_exceeds_sanction", "high", "Disbursement exceeds the sanctioned amount",
            disbursed_amount=c("TOTAL_DISBURSED"), sanction_amount=c("SANCTION_AMOUNT"))),
        F.when(cost >= 2, _finding(
            F.when(cost >= 5, "extreme_peer_cost").otherwise("high_peer_cost"),
            F.when(cost >= 5, "high").otherwise("medium"),
            F.concat(
                F.lit("Sanctioned cost is at least "),
                F.when(cost >= 10, "10x").when(cost >= 5, "5x").otherwise("2x"),
                F.lit(" the peer-group median")),
            ratio=cost)),
    )
    statistical = _kept(
        F.when(z >= 3, _finding(
            F.when(z >= 5, "extreme_z_score").otherwise("high_z_score"),
            F.when(z >= 5, "high").otherwise("medium"),
            F.when(z >= 10, "Cost is an extreme statistical outlier within the peer distribution")
            .when(z >= 5, "Cost is more than 5 standard deviations above the peer distribution")
            .otherwise("Cost is more than 3 standard deviations above the peer distribution"),
            z_score=z)),
    )
    transaction = _kept(
        F.when(vendors > 1, _finding(
            "multiple_vendors", "medium", "Multiple vendors are associated with this work",
            vendor_count=vendors)),
        F.when(moves >= 2, _finding(
            F.when(moves >= 4, "high_transaction_count").otherwise("multiple_transactions"),
            F.when(moves >= 4, "medium").otherwise("low"),
            "Work contains multiple expenditure transactions", transaction_count=moves)),
    )
    timeline = _kept(
        F.when(c("RECOMMENDATION_DATE").isNotNull() & c("SANCTION_DATE").isNotNull(), _finding(
            "recommendation_to_sanction", "info",
            "Recommendation and sanction dates are available",
            days=c("RECOMMENDATION_TO_SANCTION_DAYS"),
            recommendation_date=c("RECOMMENDATION_DATE"), sanction_date=c("SANCTION_DATE"))),
        F.when(c("SANCTION_DATE").isNotNull() & c("ACTUAL_END_DATE").isNotNull(), _finding(
            "sanction_to_completion", "info", "Sanction and completion dates are available",
            days=c("SANCTION_TO_COMPLETION_DAYS"),
            sanction_date=c("SANCTION_DATE"), completion_date=c("ACTUAL_END_DATE"))),
    )
    level = c("FINAL_RISK_LEVEL")
    signals = F.concat_ws(
        "; ",
        F.when(cost >= 2, F.concat(
            F.lit("sanctioned cost is "), tx.fixed(cost, 2), F.lit("x the peer median"))),
        F.when(z >= 3, F.concat(F.lit("peer-group z-score is "), tx.fixed(z, 2))),
        F.when(over_actual, "actual expenditure exceeds sanction"),
        F.when(over_paid, "disbursement exceeds sanction"),
        F.when(vendors > 1, F.concat(vendors.cast("string"), F.lit(" vendors recorded"))),
        F.when(moves >= 2, F.concat(moves.cast("string"), F.lit(" expenditure transactions"))),
    )

    def known(name: str) -> Column:
        return F.coalesce(c(name), F.lit("Unknown")) if name in df.columns else F.lit("Unknown")

    return df.select(
        c("WORK_ID").alias("work_id"),
        F.struct(
            known("MP_NAME").alias("mp_name"), known("CONSTITUENCY").alias("constituency"),
            known("WORK_CATEGORY").alias("work_category"),
            known("ACTIVITY_NAME").alias("activity_name"),
        ).alias("identity"),
        F.struct(
            c("HYBRID_RISK_SCORE").alias("hybrid_score"), level.alias("risk_level"),
            c("DETECTOR_AGREEMENT").alias("detector_agreement"),
            F.coalesce("DETECTOR_AGREEMENT_COUNT", F.lit(0)).alias("detector_agreement_count"),
            c("INVESTIGATION_PRIORITY").alias("investigation_priority"),
        ).alias("risk"),
        F.struct(
            c("RULE_SCORE").alias("rule"), c("STATISTICAL_SCORE").alias("statistical"),
            c("ISOLATION_FOREST_SCORE").alias("isolation_forest"),
        ).alias("detector_scores"),
        F.struct(
            c("RECOMMENDED_AMOUNT").alias("recommended_amount"),
            c("SANCTION_AMOUNT").alias("sanction_amount"), c("ACTUAL_AMOUNT").alias("actual_amount"),
            c("TOTAL_DISBURSED").alias("disbursed_amount"), cost.alias("cost_vs_peer_median"),
        ).alias("financial"),
        F.struct(z.alias("peer_z_score")).alias("statistical"),
        F.struct(
            moves.alias("transaction_count"), vendors.alias("vendor_count"),
            c("MAX_TRANSACTION_AMOUNT").alias("max_transaction_amount"),
        ).alias("transactions"),
        F.struct(
            c("RECOMMENDATION_DATE").alias("recommendation_date"),
            c("SANCTION_DATE").alias("sanction_date"), c("ACTUAL_END_DATE").alias("completion_date"),
            c("RECOMMENDATION_TO_SANCTION_DAYS").alias("days_recommendation_to_sanction"),
            c("SANCTION_TO_COMPLETION_DAYS").alias("days_sanction_to_completion"),
        ).alias("timeline"),
        F.struct(
            financial.alias("financial"), statistical.alias("statistical"),
            transaction.alias("transaction"), timeline.alias("timeline"),
        ).alias("evidence"),
        F.when(signals != "", F.concat(F.lit("The work shows "), signals, F.lit(".")))
        .otherwise("No major evidence signals were identified.").alias("summary"),
        F.when(level == "CRITICAL",
               "Prioritize for detailed review. Validate sanction, estimate, expenditure, vendor "
               "and implementation records.")
        .when(level == "HIGH",
              "Prioritize for investigation and cross-check the underlying financial and "
              "implementation records.")
        .when(level == "MEDIUM",
              "Review supporting records and monitor for additional anomaly signals.")
        .otherwise("No immediate investigation priority based on current detection signals.")
        .alias("investigation_guidance"),
        F.lit(DISCLAIMER).alias("disclaimer"),
    )


# Flat column -> path in the nested record.
FLAT_FIELDS = {
    "WORK_ID": "work_id", "MP_NAME": "identity.mp_name",
    "CONSTITUENCY_NAME": "identity.constituency", "WORK_CATEGORY": "identity.work_category",
    "ACTIVITY_NAME": "identity.activity_name", "HYBRID_RISK_SCORE": "risk.hybrid_score",
    "FINAL_RISK_LEVEL": "risk.risk_level", "DETECTOR_AGREEMENT": "risk.detector_agreement",
    "DETECTOR_AGREEMENT_COUNT": "risk.detector_agreement_count",
    "INVESTIGATION_PRIORITY": "risk.investigation_priority", "RULE_SCORE": "detector_scores.rule",
    "STATISTICAL_SCORE": "detector_scores.statistical",
    "ISOLATION_FOREST_SCORE": "detector_scores.isolation_forest",
    "RECOMMENDED_AMOUNT": "financial.recommended_amount",
    "SANCTION_AMOUNT": "financial.sanction_amount", "ACTUAL_AMOUNT": "financial.actual_amount",
    "DISBURSED_AMOUNT": "financial.disbursed_amount",
    "COST_VS_PEER_MEDIAN": "financial.cost_vs_peer_median",
    "PEER_Z_SCORE": "statistical.peer_z_score",
    "TRANSACTION_COUNT": "transactions.transaction_count",
    "VENDOR_COUNT": "transactions.vendor_count",
    "MAX_TRANSACTION_AMOUNT": "transactions.max_transaction_amount",
    "RECOMMENDATION_DATE": "timeline.recommendation_date",
    "SANCTION_DATE": "timeline.sanction_date", "COMPLETION_DATE": "timeline.completion_date",
    "DAYS_RECOMMENDATION_TO_SANCTION": "timeline.days_recommendation_to_sanction",
    "DAYS_SANCTION_TO_COMPLETION": "timeline.days_sanction_to_completion", "SUMMARY": "summary",
    "INVESTIGATION_GUIDANCE": "investigation_guidance", "DISCLAIMER": "disclaimer",
    "FINANCIAL_EVIDENCE": "evidence.financial", "STATISTICAL_EVIDENCE": "evidence.statistical",
    "TRANSACTION_EVIDENCE": "evidence.transaction", "TIMELINE_EVIDENCE": "evidence.timeline",
}
