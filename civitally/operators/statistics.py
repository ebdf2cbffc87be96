"""Peer statistics detector: leave-one-out comparison and distribution tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PEER_KEYS, Skew, StatConfig
from ..functions.scalar import total
from ..functions.text import group_label
from .features import LOO_COLUMNS, LOO_PROBS, attach_peers
from .ranking import grouped_quantiles
from .rules import RuleBook, diversity_bonus, score_audit, severity


def _loo_quartile(i: int, n: Column, x: Column, values: Column) -> Column:
    """Quartile i of the group's sorted values with one copy of x removed.

    Position j of the remaining values is the group's j-th value while that is
    below x, and the next one from there on.
    """
    at = [F.get(values, F.lit(3 * i + j)) for j in range(3)]
    h = (n - 2) * F.lit(LOO_PROBS[i])
    low = F.when(at[0] < x, at[0]).otherwise(at[1])
    high = F.when(at[1] < x, at[1]).otherwise(at[2])
    fraction = h - F.floor(h)
    return F.when(fraction == 0, low).otherwise(low + (high - low) * fraction)


def leave_one_out(df: DataFrame, min_peers: int = 10) -> DataFrame:
    """Mean and quartiles of a work's peers without the work itself.

    Needs the peer columns of ``attach_peers``. The mean counts every other
    work with an amount; quartiles also need an amount on the work.
    """
    x = F.col("SANCTION_AMOUNT")
    n = F.col("PEER_SANCTION_N")
    others = n - x.isNotNull().cast("int")
    rest = F.coalesce(F.col("PEER_SUM_SANCTION"), F.lit(0)) - F.coalesce(x, F.lit(0))
    enough = x.isNotNull() & (others >= min_peers)
    quartiles = [
        F.when(enough, _loo_quartile(i, n, x.cast("double"), F.col("LOO_VALUES"))) for i in range(3)
    ]
    df = df.withColumns(
        {
            "STAT_LOO_PEER_MEAN_SANCTION": F.when(
                others >= min_peers, rest.cast("double") / others
            ),
            "STAT_PEER_Q1": quartiles[0],
            "STAT_PEER_MEDIAN": quartiles[1],
            "STAT_PEER_Q3": quartiles[2],
        }
    )
    return df.withColumns(
        {
            "STAT_PEER_IQR": F.col("STAT_PEER_Q3") - F.col("STAT_PEER_Q1"),
            "STAT_SANCTION_TO_PEER_MEDIAN": F.when(
                F.col("STAT_PEER_MEDIAN") > 0, x.cast("double") / F.col("STAT_PEER_MEDIAN")
            ),
        }
    )


# Measure -> (column, rows that count, quantiles wanted).
def _tail_measures(config: StatConfig) -> dict[str, tuple[str, Column, Sequence[float]]]:
    positive = {m: F.col(m) > 0 for m in
                ("PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "PAYMENTS_PER_30_DAYS")}
    return {
        "PAYMENT": ("PAYMENT_COUNT", positive["PAYMENT_COUNT"], config.upper_tail),
        "VENDOR": ("UNIQUE_VENDOR_COUNT", positive["UNIQUE_VENDOR_COUNT"], config.upper_tail),
        "FREQUENCY": ("PAYMENTS_PER_30_DAYS", positive["PAYMENTS_PER_30_DAYS"], config.upper_tail),
        "DURATION": ("COMPLETION_DURATION_DAYS", F.col("COMPLETION_DURATION_DAYS") >= 0, (0.25, 0.75)),
        "COMPLETENESS": ("DATA_COMPLETENESS_RATIO", F.lit(True), (config.low_completeness,)),
    }


def tail_thresholds(
    features: DataFrame, config: StatConfig = StatConfig(), skew: Skew = Skew()
) -> DataFrame:
    """MEASURE, N and exact quantiles Q_LOW/Q_HIGH of the five measures."""
    measures = _tail_measures(config)
    long = features.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("MEASURE"),
                        F.when(keep, F.col(column).cast("double")).alias("VALUE"),
                    )
                    for name, (column, keep, _) in measures.items()
                ]
            )
        ).alias("m")
    ).select("m.*").filter(F.col("VALUE").isNotNull())
    probs = sorted({p for _, _, ps in measures.values() for p in ps})
    names = [f"Q{i}" for i in range(len(probs))]
    all_q = grouped_quantiles(long, ["MEASURE"], {"v": ("VALUE", probs, names)}, skew=skew)

    def pick(which: int) -> Column:
        out = F.lit(None).cast("double")
        for name, (_, _, ps) in measures.items():
            out = F.when(
                F.col("MEASURE") == name, F.col(names[probs.index(ps[min(which, len(ps) - 1)])])
            ).otherwise(out)
        return out

    return all_q.select(
        "MEASURE", F.col("v_N").alias("N"), pick(0).alias("Q_LOW"), pick(1).alias("Q_HIGH")
    )


def limits(thresholds: DataFrame, config: StatConfig = StatConfig()) -> Column:
    """The limits of the five measures as one struct, read by a scalar subquery."""
    def value(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("MEASURE") == measure, F.col(column)))

    q1, q3 = value("DURATION", "Q_LOW"), value("DURATION", "Q_HIGH")
    return thresholds.agg(
        F.struct(
            value("PAYMENT", "Q_LOW").alias("payment_high"),
            value("PAYMENT", "Q_HIGH").alias("payment_extreme"),
            value("VENDOR", "Q_LOW").alias("vendor_high"),
            value("VENDOR", "Q_HIGH").alias("vendor_extreme"),
            value("FREQUENCY", "Q_LOW").alias("frequency_high"),
            value("FREQUENCY", "Q_HIGH").alias("frequency_extreme"),
            (q3 + config.fences[0] * (q3 - q1)).alias("duration_high"),
            (q3 + config.fences[1] * (q3 - q1)).alias("duration_extreme"),
            value("COMPLETENESS", "Q_LOW").alias("completeness_low"),
        )
    ).scalar()


def statistical_rules(config: StatConfig = StatConfig()) -> RuleBook:
    c = F.col
    peers = (c("STAT_PEER_COUNT") >= config.min_peers) & (c("STAT_PEER_IQR") > 0)
    fence = [c("STAT_PEER_Q3") + f * c("STAT_PEER_IQR") for f in config.fences]
    sanction = c("SANCTION_AMOUNT").cast("double")
    many_payments, many_vendors = c("PAYMENT_COUNT") > 1, c("UNIQUE_VENDOR_COUNT") > 1
    book = RuleBook()
    # Names, categories, strengths, points and wording of the signals.
    book.register("STAT_SANCTION_ABOVE_PEER_IQR", peers & (sanction > fence[0]),
                  "Financial", "MODERATE", 20,
                  "Sanction amount exceeds the robust 1.5×IQR upper boundary of comparable works.")
    book.register("STAT_SANCTION_EXTREME_PEER_IQR", peers & (sanction > fence[1]),
                  "Financial", "STRONG", 35,
                  "Sanction amount exceeds the robust 3×IQR upper boundary of comparable works.")
    book.register("STAT_SANCTION_ABOVE_5X_PEER_MEDIAN",
                  (c("STAT_PEER_COUNT") >= config.min_peers)
                  & (c("STAT_SANCTION_TO_PEER_MEDIAN") > config.peer_ratio),
                  "Financial", "STRONG", 35,
                  "Sanction amount is more than 5x the leave-one-out peer median.")
    for measure, column, limit, several, noun in (
        ("PAYMENT_COUNT", "PAYMENT_COUNT", "payment", many_payments, "Payment transaction count"),
        ("VENDOR_COUNT", "UNIQUE_VENDOR_COUNT", "vendor", many_vendors, "Unique vendor count"),
        ("PAYMENT_FREQUENCY", "PAYMENTS_PER_30_DAYS", "frequency", many_payments,
         "Payment frequency"),
    ):
        book.register(f"STAT_{measure}_OUTLIER",
                      several & (c(column) > c(f"_limits.{limit}_high")),
                      "Payment Behavior", "MODERATE", 10,
                      f"{noun} is in the extreme upper tail of the observed distribution.")
        book.register(f"STAT_{measure}_EXTREME",
                      several & (c(column) > c(f"_limits.{limit}_extreme")),
                      "Payment Behavior", "STRONG", 20,
                      f"{noun} is beyond the 99.5th percentile of the observed distribution.")
    duration = c("COMPLETION_DURATION_DAYS")
    book.register("STAT_COMPLETION_DURATION_OUTLIER", duration > c("_limits.duration_high"),
                  "Timeline", "MODERATE", 10,
                  "Completion duration is above the robust 1.5×IQR upper boundary.")
    book.register("STAT_COMPLETION_DURATION_EXTREME", duration > c("_limits.duration_extreme"),
                  "Timeline", "STRONG", 20,
                  "Completion duration is above the robust 3×IQR upper boundary.")
    book.register("STAT_LOW_DATA_COMPLETENESS",
                  c("DATA_COMPLETENESS_RATIO") <= c("_limits.completeness_low"),
                  "Data Quality", "VERIFY", 0,
                  "Data completeness is within the lowest 10% of the observed dataset; verify "
                  "source completeness.", verification_only=True)
    return book


def score_statistics(
    features: DataFrame,
    config: StatConfig = StatConfig(),
    *,
    thresholds: DataFrame | None = None,
    peer_keys: Sequence[str] = PEER_KEYS,
    skew: Skew = Skew(),
    book: RuleBook | None = None,
) -> DataFrame:
    """Statistical flags, category scores, STAT_SCORE, severity and reasons.

    Peer ingredients are reused when the features already carry them.
    """
    book = book or statistical_rules(config)
    c = F.col
    if not set(LOO_COLUMNS) <= set(features.columns):
        features = attach_peers(features.drop("PEER_COUNT"), peer_keys, skew)
    if thresholds is None:
        thresholds = tail_thresholds(features, config, skew)
    df = leave_one_out(features, config.min_peers).withColumns(
        {"STAT_PEER_GROUP": group_label(peer_keys), "STAT_PEER_COUNT": c("PEER_COUNT")}
    )
    df = book.flags(df.withColumn("_limits", limits(thresholds, config))).drop("_limits")
    parts = {
        part: book.best_of([f"STAT_{part}_OUTLIER", f"STAT_{part}_EXTREME"])
        for part in ("PAYMENT_COUNT", "VENDOR_COUNT", "PAYMENT_FREQUENCY")
    }
    df = df.withColumns(
        {
            "STAT_FINANCIAL_SCORE": book.best("Financial"),
            "STAT_TIMELINE_SCORE": book.best("Timeline"),
            "STAT_PAYMENT_SUBSIGNAL_COUNT": total((p > 0).cast("int") for p in parts.values()),
        }
    )
    df = df.withColumn(
        "STAT_PAYMENT_CORROBORATION_BONUS",
        F.when(c("STAT_PAYMENT_SUBSIGNAL_COUNT") >= 3, 5)
        .when(c("STAT_PAYMENT_SUBSIGNAL_COUNT") >= 2, 3)
        .otherwise(0),
    )
    df = df.withColumn(
        "STAT_PAYMENT_BEHAVIOR_SCORE",
        F.least(
            F.greatest(*parts.values()) + c("STAT_PAYMENT_CORROBORATION_BONUS"),
            F.lit(config.payment_cap),
        ),
    )
    areas = ("STAT_FINANCIAL_SCORE", "STAT_PAYMENT_BEHAVIOR_SCORE", "STAT_TIMELINE_SCORE")
    df = df.withColumn(
        "STAT_CATEGORY_COUNT", total((c(a) > 0).cast("int") for a in areas)
    ).withColumn("STAT_DIVERSITY_BONUS", diversity_bonus(c("STAT_CATEGORY_COUNT")))
    df = df.withColumn(
        "STAT_SCORE", F.least(total(c(a) for a in (*areas, "STAT_DIVERSITY_BONUS")), F.lit(100))
    )
    return df.withColumns(
        {
            "STAT_SEVERITY": severity(c("STAT_SCORE"), config.medium, config.high),
            "STAT_TRIGGER_COUNT": book.count(),
            "STAT_STRONG_RULE_COUNT": total((c(a) >= 20).cast("int") for a in areas),
            "STAT_VERIFICATION_FLAG_COUNT": book.count(verification=True),
            "STAT_CANDIDATE": (c("STAT_SCORE") > 0).cast("int"),
            "STAT_FLAGS": book.texts(names=True),
            "STAT_REASONS": book.texts(verification=False),
            "STAT_VERIFICATION_NOTES": book.texts(verification=True),
        }
    )


def statistical_candidates(scored: DataFrame) -> DataFrame:
    """Works with a positive statistical score, strongest first."""
    return scored.filter(F.col("STAT_CANDIDATE") == 1).orderBy(
        F.desc("STAT_SCORE"), F.desc("STAT_CATEGORY_COUNT"), F.desc("STAT_STRONG_RULE_COUNT"),
        F.desc("STAT_TRIGGER_COUNT"), "WORK_ID",
    )


# --- first generation -------------------------------------------------------


def cost_signals() -> RuleBook:
    """First-generation cost bands against the peer distribution."""
    c = F.col
    ratio, z, robust = c("COST_VS_PEER_MEDIAN"), c("COST_Z_SCORE"), c("COST_VS_PEER_ROBUST_Z")
    rank = F.when(c("COST_PEER_PERCENTILE") <= 1, c("COST_PEER_PERCENTILE") * 100).otherwise(
        c("COST_PEER_PERCENTILE")
    )

    def band(x: Column, low: float, high: float | None = None) -> Column:
        return x >= low if high is None else (x >= low) & (x < high)

    book = RuleBook()
    # Codes, points and wording of the signals.
    for name, condition, points, text in (
        ("PEER_RATIO_HIGH", band(ratio, 2, 5), 15,
         "Sanctioned cost is at least 2x the peer-group median"),
        ("PEER_RATIO_EXTREME", band(ratio, 5, 10), 30,
         "Sanctioned cost is at least 5x the peer-group median"),
        ("PEER_RATIO_SEVERE", band(ratio, 10), 40,
         "Sanctioned cost is at least 10x the peer-group median"),
        ("ZSCORE_HIGH", band(z, 3, 5), 20,
         "Cost is more than 3 standard deviations above the peer distribution"),
        ("ZSCORE_EXTREME", band(z, 5, 10), 30,
         "Cost is more than 5 standard deviations above the peer distribution"),
        ("ZSCORE_SEVERE", band(z, 10), 40, "Cost is an extremely distant statistical outlier"),
        ("ROBUST_Z_HIGH", band(robust, 3, 5), 15,
         "Cost is significantly above the robust peer distribution"),
        ("ROBUST_Z_EXTREME", band(robust, 5), 25,
         "Cost is an extreme outlier under robust statistical analysis"),
        ("PEER_PERCENTILE_HIGH", band(rank, 95, 99), 10,
         "Cost lies in the top 5% of the peer distribution"),
        ("PEER_PERCENTILE_EXTREME", band(rank, 99), 20,
         "Cost lies in the top 1% of the peer distribution"),
    ):
        book.register(name, condition, "Cost", "POINTS", points, text)
    return book


def peer_confidence(count: Column) -> Column:
    return (
        F.when(count >= 30, "HIGH").when(count >= 10, "MEDIUM").when(count < 10, "LOW")
        .otherwise("UNKNOWN")
    )


def score_cost_signals(features: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """First-generation statistical score with peer confidence."""
    return score_audit(
        features.withColumn("STATISTICAL_CONFIDENCE", peer_confidence(F.col("PEER_COUNT"))),
        book or cost_signals(), "STATISTICAL", "STATISTICAL_SCORE",
        "No statistical anomaly detected",
    )
