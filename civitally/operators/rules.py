"""Transparent policy rules: an open registry plus the two built-in books."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RuleConfig
from ..functions.scalar import flag, total
from ..functions.text import joined


@dataclass(frozen=True)
class Rule:
    """A named condition with points; verification-only rules score nothing."""

    name: str
    condition: Column
    category: str
    strength: str
    points: int
    description: str
    verification_only: bool = False

    @property
    def fired(self) -> Column:
        return F.col(self.name) == 1

    @property
    def score(self) -> Column:
        return F.when(self.fired, F.lit(self.points)).otherwise(F.lit(0))


class RuleBook:
    """Ordered collection of rules that users may extend."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self.rules = list(rules)

    def register(self, name: str, condition: Column, category: str, strength: str, points: int,
                 description: str, verification_only: bool = False) -> RuleBook:
        if any(r.name == name for r in self.rules):
            raise ValueError(f"rule {name} is already registered")
        if points != int(points):
            raise ValueError(f"rule {name}: points are whole numbers")  # see fusion.calibrate
        self.rules.append(
            Rule(name, condition, category, strength, points, description, verification_only)
        )
        return self

    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def scoring(self, category: str) -> list[Rule]:
        return [r for r in self.rules if r.category == category and not r.verification_only]

    def flags(self, df: DataFrame) -> DataFrame:
        return df.withColumns({r.name: flag(r.condition) for r in self.rules})

    def best(self, category: str) -> Column:
        """Highest points among the firing rules of a category."""
        scores = [r.score for r in self.scoring(category)]
        return F.greatest(*scores) if len(scores) > 1 else (scores[0] if scores else F.lit(0))

    def best_of(self, names: Sequence[str]) -> Column:
        by_name = {r.name: r for r in self.rules}
        return F.greatest(*[by_name[n].score for n in names], F.lit(0))

    def summed(self, category: str, cap: int) -> Column:
        return F.least(total(r.score for r in self.scoring(category)), F.lit(cap))

    def count(self, *, strength: str | None = None, verification: bool | None = None) -> Column:
        chosen = [
            r for r in self.rules
            if (strength is None or r.strength == strength)
            and (verification is None or r.verification_only == verification)
        ]
        return total(F.col(r.name) for r in chosen)

    def texts(self, *, verification: bool | None = None, names: bool = False) -> Column:
        return joined(
            " | ",
            [
                (r.fired, r.name if names else r.description)
                for r in self.rules
                if verification is None or r.verification_only == verification
            ],
        )


def diversity_bonus(categories: Column) -> Column:
    return F.when(categories >= 3, 10).when(categories >= 2, 5).otherwise(0)


def severity(score: Column, medium: int, high: int) -> Column:
    return (
        F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").when(score > 0, "LOW")
        .otherwise("NONE")
    )


def policy_rules(config: RuleConfig = RuleConfig()) -> RuleBook:
    """The seventeen second-generation rules."""
    c = F.col
    peers = c("PEER_COUNT") >= config.min_peers
    several = c("PAYMENT_COUNT") > 1
    book = RuleBook()
    # Names, categories, strengths, points and wording of the rules.
    book.register(
        "RULE_SANCTION_ABOVE_2X_PEER",
        peers & (c("SANCTION_TO_PEER_MEDIAN") > config.peer_ratio[0]),
        "Financial", "MODERATE", 20,
        "Sanction amount is more than 2x the median sanction amount of comparable peer works.",
    )
    book.register(
        "RULE_SANCTION_ABOVE_5X_PEER",
        peers & (c("SANCTION_TO_PEER_MEDIAN") > config.peer_ratio[1]),
        "Financial", "STRONG", 35,
        "Sanction amount is more than 5x the median sanction amount of comparable peer works.",
    )
    book.register(
        "RULE_PEER_Z_ABOVE_3",
        peers & (c("SANCTION_PEER_Z_SCORE") > config.peer_z[0]),
        "Financial", "MODERATE", 20,
        "Sanction amount is more than 3 standard deviations above the comparable peer mean.",
    )
    book.register(
        "RULE_PEER_Z_ABOVE_5",
        peers & (c("SANCTION_PEER_Z_SCORE") > config.peer_z[1]),
        "Financial", "STRONG", 35,
        "Sanction amount is more than 5 standard deviations above the comparable peer mean.",
    )
    book.register(
        "RULE_ACTUAL_ABOVE_SANCTION", c("ACTUAL_AMOUNT") > c("SANCTION_AMOUNT"),
        "Financial", "STRONG", 35,
        "Reported actual expenditure exceeds the sanctioned amount.",
    )
    book.register(
        "RULE_DISBURSED_ABOVE_SANCTION", c("TOTAL_FUND_DISBURSED_AMT") > c("SANCTION_AMOUNT"),
        "Financial", "STRONG", 35,
        "Total recorded disbursement exceeds the sanctioned amount.",
    )
    book.register(
        "RULE_HIGH_PAYMENT_COUNT", c("PAYMENT_COUNT") >= config.payment_count[0],
        "Payment", "MODERATE", 10, "Work has at least 5 recorded payment transactions.",
    )
    book.register(
        "RULE_VERY_HIGH_PAYMENT_COUNT", c("PAYMENT_COUNT") >= config.payment_count[1],
        "Payment", "STRONG", 20, "Work has at least 10 recorded payment transactions.",
    )
    book.register(
        "RULE_MULTIPLE_VENDORS", c("UNIQUE_VENDOR_COUNT") >= config.vendor_count[0],
        "Payment", "MODERATE", 10, "Work has payments associated with at least 5 vendors.",
    )
    book.register(
        "RULE_MANY_VENDORS", c("UNIQUE_VENDOR_COUNT") >= config.vendor_count[1],
        "Payment", "STRONG", 20, "Work has payments associated with at least 10 vendors.",
    )
    book.register(
        "RULE_HIGH_PAYMENT_FREQUENCY",
        several & (c("PAYMENTS_PER_30_DAYS") > config.per_30_days[0]),
        "Payment", "MODERATE", 10,
        "Payment activity exceeds 3 recorded payments per 30 expenditure days.",
    )
    book.register(
        "RULE_VERY_HIGH_PAYMENT_FREQUENCY",
        several & (c("PAYMENTS_PER_30_DAYS") > config.per_30_days[1]),
        "Payment", "STRONG", 20,
        "Payment activity exceeds 6 recorded payments per 30 expenditure days.",
    )
    book.register(
        "RULE_RECOMMENDATION_BEFORE_SANCTION_VIOLATION",
        c("RECOMMENDATION_TO_SANCTION_DAYS") < 0,
        "Timeline", "STRONG", 30,
        "Recorded sanction date occurs before the recommendation date.",
    )
    book.register(
        "RULE_PAYMENT_BEFORE_SANCTION", c("SANCTION_TO_FIRST_PAYMENT_DAYS") < 0,
        "Timeline", "STRONG", 30, "Recorded expenditure occurs before the sanction date.",
    )
    book.register(
        "RULE_COMPLETION_BEFORE_LAST_PAYMENT", c("COMPLETION_BEFORE_LAST_PAYMENT") == 1,
        "Timeline", "VERIFY", 0,
        "Reported completion date precedes the last recorded payment; verify because the dates "
        "may represent different administrative events.",
        verification_only=True,
    )
    book.register(
        "RULE_HIGH_IN_PROGRESS_RATIO",
        c("PAYMENT_IN_PROGRESS_RATIO") > config.in_progress_ratio,
        "Payment Status", "WEAK", 5,
        "More than half of the recorded payment transactions are currently marked as in progress.",
    )
    book.register(
        "RULE_LOW_DATA_COMPLETENESS", c("DATA_COMPLETENESS_RATIO") < config.completeness,
        "Data Quality", "VERIFY", 0,
        "More than half of the selected analytical fields are missing; verify the underlying "
        "record.",
        verification_only=True,
    )
    return book


def score_rules(
    features: DataFrame, config: RuleConfig = RuleConfig(), book: RuleBook | None = None
) -> DataFrame:
    """Rule flags, category scores, RULE_SCORE, severity and reasons per work."""
    book = book or policy_rules(config)
    c = F.col
    scored = book.flags(features).withColumns(
        {
            "RULE_FINANCIAL_SCORE": book.best("Financial"),
            "RULE_PAYMENT_SCORE": book.summed("Payment", config.payment_cap),
            "RULE_TIMELINE_SCORE": book.best("Timeline"),
            "RULE_PAYMENT_STATUS_SCORE": book.best("Payment Status"),
        }
    )
    scored = scored.withColumn(
        "RULE_CATEGORY_COUNT",
        total(
            (c(s) > 0).cast("int")
            for s in ("RULE_FINANCIAL_SCORE", "RULE_PAYMENT_SCORE", "RULE_TIMELINE_SCORE")
        ),
    ).withColumn("RULE_DIVERSITY_BONUS", diversity_bonus(c("RULE_CATEGORY_COUNT")))
    scored = scored.withColumn(
        "RULE_SCORE",
        F.least(
            c("RULE_FINANCIAL_SCORE") + c("RULE_PAYMENT_SCORE") + c("RULE_TIMELINE_SCORE")
            + c("RULE_PAYMENT_STATUS_SCORE") + c("RULE_DIVERSITY_BONUS"),
            F.lit(100),
        ),
    )
    return scored.withColumns(
        {
            "RULE_SEVERITY": severity(c("RULE_SCORE"), config.medium, config.high),
            "RULE_TRIGGER_COUNT": book.count(),
            "STRONG_RULE_COUNT": book.count(strength="STRONG"),
            "VERIFICATION_FLAG_COUNT": book.count(verification=True),
            "RULE_CANDIDATE": (c("RULE_SCORE") > 0).cast("int"),
            "RULE_FLAGS": book.texts(names=True),
            "RULE_REASONS": book.texts(),
            "RULE_VERIFICATION_NOTES": book.texts(verification=True),
        }
    )


def rule_candidates(scored: DataFrame) -> DataFrame:
    """Works with a positive rule score, strongest first."""
    return scored.filter(F.col("RULE_CANDIDATE") == 1).orderBy(
        F.desc("RULE_SCORE"), F.desc("STRONG_RULE_COUNT"), F.desc("RULE_TRIGGER_COUNT"), "WORK_ID"
    )


# --- first generation -------------------------------------------------------


def audit_rules() -> RuleBook:
    """First-generation rules: additive points, exclusive bands."""
    c = F.col
    ratio, z = c("COST_VS_PEER_MEDIAN"), c("COST_Z_SCORE")
    sanctioned = c("SANCTION_AMOUNT") > 0
    book = RuleBook()
    # Codes, points and wording of the rules.
    for name, condition, points, text in (
        ("ACTUAL_GT_SANCTION", c("ACTUAL_AMOUNT") > c("SANCTION_AMOUNT"), 30,
         "Actual expenditure exceeds sanctioned amount"),
        ("DISBURSEMENT_GT_SANCTION", c("TOTAL_DISBURSED") > c("SANCTION_AMOUNT"), 30,
         "Total disbursement exceeds sanctioned amount"),
        ("EXTREME_PEER_COST", ratio >= 5, 20,
         "Sanctioned cost is at least 5x the peer-group median"),
        ("HIGH_PEER_COST", (ratio >= 2) & (ratio < 5), 10,
         "Sanctioned cost is at least 2x the peer-group median"),
        ("EXTREME_COST_ZSCORE", z >= 5, 15,
         "Cost is an extreme statistical outlier within the peer group"),
        ("HIGH_COST_ZSCORE", (z >= 3) & (z < 5), 8,
         "Cost is a statistically significant outlier within the peer group"),
        ("MULTIPLE_VENDORS", c("VENDOR_COUNT") > 1, 6,
         "Multiple vendors are associated with the work"),
        ("HIGH_TRANSACTION_COUNT", c("TRANSACTION_COUNT") >= 4, 5,
         "Work contains an unusually high number of expenditure transactions"),
        ("MULTIPLE_TRANSACTIONS", (c("TRANSACTION_COUNT") >= 2) & (c("TRANSACTION_COUNT") < 4), 2,
         "Work contains multiple expenditure transactions"),
        ("SANCTIONED_NO_EXPENDITURE",
         sanctioned & (F.coalesce(c("TOTAL_DISBURSED"), F.lit(0)) == 0), 5,
         "Work is sanctioned but no expenditure has been recorded"),
        ("SANCTIONED_NOT_COMPLETED", sanctioned & (F.coalesce(c("IS_COMPLETED"), F.lit(0)) == 0), 3,
         "Work is sanctioned but completion has not been recorded"),
        ("RECOMMENDED_NOT_SANCTIONED",
         (c("RECOMMENDED_AMOUNT") > 0) & c("SANCTION_AMOUNT").isNull(), 2,
         "Work has a recommendation but no sanction amount is recorded"),
        ("CHRONOLOGY_VIOLATION", c("NEGATIVE_TIMELINE_FLAG") == 1, 15,
         "Work contains an invalid event chronology"),
    ):
        book.register(name, condition, "Audit", "POINTS", points, text)
    return book


def risk_level(score: Column, critical: float = 70, high: float = 40, medium: float = 20) -> Column:
    return (
        F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH")
        .when(score >= medium, "MEDIUM").otherwise("LOW")
    )


def score_audit(
    df: DataFrame, book: RuleBook, prefix: str, score: str, nothing: str
) -> DataFrame:
    """Additive score, level, anomaly flag, codes and reasons for a point book.

    The rule flags themselves are folded into the result, not kept as columns.
    """
    scored = book.flags(df)
    points = F.least(
        F.greatest(total(r.score for r in book.rules), F.lit(0)), F.lit(100)
    ).cast("double")
    reasons = book.texts()
    return (
        scored.withColumns(
            {
                score: points,
                f"{prefix}_REASON_CODES": joined("|", [(r.fired, r.name) for r in book.rules]),
                f"{prefix}_REASONS": F.when(reasons == "", F.lit(nothing)).otherwise(reasons),
            }
        )
        .withColumns(
            {
                f"{prefix}_RISK_LEVEL": risk_level(F.col(score)),
                f"{prefix}_ANOMALY_FLAG": F.col(score) >= 20,
            }
        )
        .drop(*book.names())
    )


def score_audit_rules(features: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """First-generation rule score plus the record-quality score."""
    missing = [F.col(c).isNull().cast("int") for c in ("RECOMMENDATION_DATE", "SANCTION_DATE")]
    unsanctioned = (F.col("SANCTION_AMOUNT").isNull() & F.col("RECOMMENDED_AMOUNT").isNotNull())
    quality = F.least(total([*missing, unsanctioned.cast("int")]), F.lit(10)).cast("double")
    return score_audit(
        features.withColumn("DATA_QUALITY_SCORE", quality),
        book or audit_rules(), "RULE", "RULE_SCORE", "No rule-based anomaly detected",
    )
