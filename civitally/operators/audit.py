"""First-generation feature set with hierarchical peer fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PEER_KEYS, Skew
from ..functions.scalar import days, finite, flag, log_amount, missing_count, ratio, total
from .ranking import (
    Ranked,
    Store,
    attach_group_stats,
    grouped_profile,
    grouped_quantiles,
    interpolate,
    kept_stats,
    percent_rank_of,
    quantile_positions,
)

# Peer levels from narrow to wide and the name each one records.
PEER_LEVELS = (
    ("STATE_CATEGORY_ACTIVITY", ("STATE_NAME", "WORK_CATEGORY", "ACTIVITY_NAME")),
    ("STATE_CATEGORY", ("STATE_NAME", "WORK_CATEGORY")),
    ("CATEGORY", ("WORK_CATEGORY",)),
)
AMOUNTS = ("RECOMMENDED_AMOUNT", "SANCTION_AMOUNT", "ACTUAL_AMOUNT")
DATES = ("RECOMMENDATION_DATE", "SANCTION_DATE", "ACTUAL_END_DATE")


def master_ratios(df: DataFrame) -> DataFrame:
    """Ratios, differences, durations and gaps of the consolidated works.

    Division by zero gives NULL.
    """
    rec, san, act = (F.col(c).cast("double") for c in AMOUNTS)
    return df.withColumns(
        {
            "RECOMMENDATION_TO_SANCTION_RATIO": F.try_divide(san, rec),
            "ACTUAL_TO_SANCTION_RATIO": F.try_divide(act, san),
            "SANCTION_MINUS_RECOMMENDED": san - rec,
            "SANCTION_MINUS_ACTUAL": san - act,
            "RECOMMENDATION_TO_SANCTION_DAYS": days("RECOMMENDATION_DATE", "SANCTION_DATE"),
            "SANCTION_TO_COMPLETION_DAYS": days("SANCTION_DATE", "ACTUAL_END_DATE"),
            "RECOMMENDATION_TO_COMPLETION_DAYS": days("RECOMMENDATION_DATE", "ACTUAL_END_DATE"),
            **{
                f"MISSING_{c}": F.col(c).isNull().cast("int")
                for c in ("SANCTION_AMOUNT", "ACTUAL_AMOUNT", "RECOMMENDATION_DATE", "SANCTION_DATE")
            },
        }
    )


def attach_spending(works: DataFrame, spending: DataFrame) -> DataFrame:
    """Payment summary on works; absent counts and amounts become 0."""
    zero = ("TRANSACTION_COUNT", "VENDOR_COUNT", "EXPENDITURE_DATE_COUNT")
    money = ("TOTAL_DISBURSED", "AVERAGE_TRANSACTION_AMOUNT", "MAX_TRANSACTION_AMOUNT",
             "MIN_TRANSACTION_AMOUNT")
    df = works.join(spending, "WORK_ID", "left")
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in zero},
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in money},
        }
    )


def level_stats(works: DataFrame, keys: Sequence[str], skew: Skew = Skew()) -> DataFrame:
    """Sanction median, mean, std and count of each group of one peer level."""
    profile = grouped_profile(
        works,
        keys,
        moments={
            "_mean": F.sum("SANCTION_AMOUNT").cast("double")
            / F.nullif(F.count("SANCTION_AMOUNT"), F.lit(0)).cast("double"),
            "_std": F.stddev_samp(F.col("SANCTION_AMOUNT").cast("double")),
        },
        ranked={"_s": Ranked("SANCTION_AMOUNT", quantile_positions([0.5]))},
        skew=skew,
    )
    (median,) = interpolate(F.col("_s"), F.col("_s_N"), [0.5])
    return profile.select(
        *keys, F.col("GROUP_ROWS").alias("_rows"), median.alias("_median"), "_mean", "_std",
        F.col("_s_N").alias("_n"),
    )


def hierarchical_peers(
    works: DataFrame, min_peers: int = 10, skew: Skew = Skew(), store: Store | None = None
) -> DataFrame:
    """Peer statistics from the narrowest level with enough other works.

    Returns WORK_ID with PEER_LEVEL, PEER_COUNT (self excluded), median, mean
    and std. Missing keys form groups of their own.
    """
    keys = list(dict.fromkeys(k for _, ks in PEER_LEVELS for k in ks))
    df = works.select("WORK_ID", *keys, "SANCTION_AMOUNT")
    for i, (_, level_keys) in enumerate(PEER_LEVELS):
        stats, small = kept_stats(
            level_stats(works.select(*level_keys, "SANCTION_AMOUNT"), level_keys, skew),
            f"peer_level_{i}", store, skew,
        )
        df = attach_group_stats(
            df, stats, level_keys, size="_rows", spread="WORK_ID", source=works, skew=skew,
            small=small,
        ).withColumnsRenamed({c: f"{c}{i}" for c in ("_median", "_mean", "_std", "_n")}).drop("_rows")
    known = F.col("SANCTION_AMOUNT").isNotNull()

    def chosen(pick, otherwise: Column) -> Column:
        out = None
        for i in range(len(PEER_LEVELS)):
            enough = known & (F.col(f"_n{i}") - 1 >= min_peers) & F.col(f"_median{i}").isNotNull()
            out = F.when(enough, pick(i)) if out is None else out.when(enough, pick(i))
        return out.otherwise(otherwise)

    nothing = F.lit(None).cast("double")
    return df.select(
        "WORK_ID",
        chosen(lambda i: F.lit(PEER_LEVELS[i][0]), F.lit("NONE")).alias("PEER_LEVEL"),
        chosen(lambda i: F.col(f"_n{i}") - 1, F.lit(0)).cast("int").alias("PEER_COUNT"),
        chosen(lambda i: F.col(f"_median{i}"), nothing).alias("PEER_MEDIAN_SANCTION"),
        chosen(lambda i: F.col(f"_mean{i}"), nothing).alias("PEER_MEAN_SANCTION"),
        chosen(lambda i: F.col(f"_std{i}"), nothing).alias("PEER_STD_SANCTION"),
    )


def robust_peer_z(
    works: DataFrame,
    keys: Sequence[str] = PEER_KEYS,
    *,
    min_peers: int = 10,
    skew: Skew = Skew(),
    store: Store | None = None,
) -> DataFrame:
    """WORK_ID, COST_VS_PEER_ROBUST_Z: distance from the median in scaled MADs.

    ``store`` settles the distances from the first pass, which the second pass
    reads more than once.
    """
    rows = works.select("WORK_ID", *keys, F.col("SANCTION_AMOUNT").cast("double").alias("_x"))
    medians, small = kept_stats(
        grouped_quantiles(rows, keys, {"m": ("_x", [0.5], ["_median"])}, skew=skew),
        "peer_medians", store, skew,
    )
    distance = F.col("_x") - F.col("_median")
    centred = attach_group_stats(
        rows, medians, keys, size="GROUP_ROWS", spread="WORK_ID", source=works, skew=skew,
        small=small,
    ).select("WORK_ID", *keys, distance.alias("_d"), F.abs(distance).alias("_dev"))
    if store is not None:
        centred = store(centred, "peer_distance")
    mads, small = kept_stats(
        grouped_quantiles(centred, keys, {"d": ("_dev", [0.5], ["_mad"])}, skew=skew),
        "peer_mads", store, skew,
    )
    df = attach_group_stats(
        centred, mads, keys, size="GROUP_ROWS", spread="WORK_ID", source=works, skew=skew,
        small=small,
    )
    z = F.col("_d") / (F.col("_mad") * 1.4826)
    enough = (F.col("d_N") - 1 >= min_peers) & (F.col("_mad") > 0)
    return df.select("WORK_ID", F.when(enough, z).alias("COST_VS_PEER_ROBUST_Z"))


def peer_percentile(
    works: DataFrame, keys: Sequence[str] = PEER_KEYS, *, min_peers: int = 10, skew: Skew = Skew(),
    store: Store | None = None,
) -> DataFrame:
    """WORK_ID, COST_PEER_PERCENTILE: average-tie rank of the sanction, 0..100."""
    rows = works.select("WORK_ID", *keys, "SANCTION_AMOUNT")
    sizes, small = kept_stats(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_rows"), F.count("SANCTION_AMOUNT").alias("_n")
        ), "peer_sizes", store, skew,
    )
    ranked = percent_rank_of(
        rows, "SANCTION_AMOUNT", "_rank", spread="WORK_ID", keys=keys, skew=skew
    )
    df = attach_group_stats(
        ranked, sizes, keys, size="_rows", spread="WORK_ID", source=works, skew=skew, small=small
    )
    return df.select(
        "WORK_ID", F.when(F.col("_n") - 1 >= min_peers, F.col("_rank")).alias("COST_PEER_PERCENTILE")
    )


def build_audit_features(
    works: DataFrame,
    spending: DataFrame,
    *,
    min_peers: int = 10,
    skew: Skew = Skew(),
    store: Store | None = None,
) -> DataFrame:
    """All first-generation features; ``works`` should be a settled layer."""
    c = F.col
    df = attach_spending(works, spending)
    rec, san, act, paid = (c(x).cast("double") for x in (*AMOUNTS, "TOTAL_DISBURSED"))
    moves, vendors = c("TRANSACTION_COUNT"), c("VENDOR_COUNT")

    def before(later: str, earlier: str) -> Column:
        return flag(c(later) < c(earlier))

    df = df.withColumns(
        {
            "RECOMMENDATION_TO_SANCTION_DAYS": days("RECOMMENDATION_DATE", "SANCTION_DATE"),
            "SANCTION_TO_COMPLETION_DAYS": days("SANCTION_DATE", "ACTUAL_END_DATE"),
            "RECOMMENDATION_TO_COMPLETION_DAYS": days("RECOMMENDATION_DATE", "ACTUAL_END_DATE"),
            "INVALID_RECOMMENDATION_SANCTION_ORDER": before("SANCTION_DATE", "RECOMMENDATION_DATE"),
            "INVALID_SANCTION_COMPLETION_ORDER": before("ACTUAL_END_DATE", "SANCTION_DATE"),
            "INVALID_RECOMMENDATION_COMPLETION_ORDER": before(
                "ACTUAL_END_DATE", "RECOMMENDATION_DATE"
            ),
            "RECOMMENDATION_TO_SANCTION_RATIO": ratio("SANCTION_AMOUNT", "RECOMMENDED_AMOUNT"),
            "ACTUAL_TO_SANCTION_RATIO": ratio("ACTUAL_AMOUNT", "SANCTION_AMOUNT"),
            "DISBURSEMENT_TO_SANCTION_RATIO": ratio("TOTAL_DISBURSED", "SANCTION_AMOUNT"),
            "UNSPENT_AMOUNT": san - paid,
            "SANCTION_DEVIATION": san - rec,
            "ACTUAL_DEVIATION": act - san,
            "SANCTION_MINUS_RECOMMENDED": san - rec,
            "SANCTION_MINUS_ACTUAL": san - act,
            "MISSING_RECOMMENDATION_DATE": c("RECOMMENDATION_DATE").isNull().cast("int"),
            "MISSING_SANCTION_DATE": c("SANCTION_DATE").isNull().cast("int"),
            "MISSING_COMPLETION_DATE": c("ACTUAL_END_DATE").isNull().cast("int"),
            **{f"MISSING_{x}": c(x).isNull().cast("int") for x in AMOUNTS},
            **{f"LOG_{x}": log_amount(x) for x in (*AMOUNTS, "TOTAL_DISBURSED")},
            "TRANSACTION_AMOUNT_VARIATION": ratio(
                "MAX_TRANSACTION_AMOUNT", "AVERAGE_TRANSACTION_AMOUNT"
            ),
            "MULTIPLE_VENDOR_FLAG": flag(vendors > 1),
            "MULTIPLE_TRANSACTION_FLAG": flag(moves > 1),
            "SINGLE_TRANSACTION_FLAG": flag(moves == 1),
            "HIGH_TRANSACTION_COUNT_FLAG": flag(moves >= 3),
            "NO_EXPENDITURE_RECORD_FLAG": flag(moves == 0),
            "NO_VENDOR_INFORMATION_FLAG": flag(vendors == 0),
            "ACTUAL_EXCEEDS_SANCTION_FLAG": flag(act > san),
            "DISBURSEMENT_EXCEEDS_SANCTION_FLAG": flag(paid > san),
            "SANCTION_BELOW_RECOMMENDED_FLAG": flag(san < rec),
            "NEGATIVE_SANCTION_AMOUNT_FLAG": flag(san < 0),
            "NEGATIVE_ACTUAL_AMOUNT_FLAG": flag(act < 0),
            "NEGATIVE_DISBURSEMENT_FLAG": flag(paid < 0),
            "RECOMMENDED_NOT_SANCTIONED_FLAG": flag((c("IS_RECOMMENDED") == 1) & (c("IS_SANCTIONED") == 0)),
            "SANCTIONED_NOT_COMPLETED_FLAG": flag((c("IS_SANCTIONED") == 1) & (c("IS_COMPLETED") == 0)),
            "SANCTIONED_WITHOUT_EXPENDITURE_FLAG": flag((c("IS_SANCTIONED") == 1) & (moves == 0)),
            "COMPLETED_WITHOUT_EXPENDITURE_FLAG": flag((c("IS_COMPLETED") == 1) & (moves == 0)),
            "DATA_COMPLETENESS_SCORE": F.lit(1.0) - missing_count((*DATES, *AMOUNTS)) / F.lit(6.0),
        }
    )
    df = df.withColumn(
        "NEGATIVE_TIMELINE_FLAG",
        flag(total(c(x) for x in (
            "INVALID_RECOMMENDATION_SANCTION_ORDER", "INVALID_SANCTION_COMPLETION_ORDER",
            "INVALID_RECOMMENDATION_COMPLETION_ORDER")) > 0),
    )
    keyed = works.select("WORK_ID", *PEER_KEYS, "SANCTION_AMOUNT")
    df = (
        df.join(hierarchical_peers(keyed, min_peers, skew, store), "WORK_ID")
        .join(robust_peer_z(keyed, min_peers=min_peers, skew=skew, store=store), "WORK_ID")
        .join(
            peer_percentile(keyed, min_peers=min_peers, skew=skew, store=store), "WORK_ID"
        )
    )
    z = F.when(
        c("PEER_STD_SANCTION") > 0, (san - c("PEER_MEAN_SANCTION")) / c("PEER_STD_SANCTION")
    )
    df = df.withColumns(
        {
            "COST_VS_PEER_MEDIAN": finite(ratio("SANCTION_AMOUNT", "PEER_MEDIAN_SANCTION")),
            "COST_Z_SCORE": z,
            "PEER_GROUP_RELIABLE_FLAG": flag(c("PEER_COUNT") >= min_peers),
        }
    )
    return df.withColumns(
        {
            "HIGH_COST_VS_PEER_FLAG": flag(c("COST_VS_PEER_MEDIAN") >= 2),
            "EXTREME_COST_VS_PEER_FLAG": flag(c("COST_VS_PEER_MEDIAN") >= 5),
            "HIGH_COST_Z_SCORE_FLAG": flag(c("COST_Z_SCORE") >= 3),
            "EXTREME_COST_Z_SCORE_FLAG": flag(c("COST_Z_SCORE") >= 5),
        }
    )
