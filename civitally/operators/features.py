"""Second-generation feature set: one row per work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PEER_KEYS, Skew
from ..functions.scalar import (
    days,
    flag,
    missing_count,
    peer_label,
    ratio,
    strip_activity_prefix,
)
from .cleaning import fill_peer_keys
from .joining import one_to_one
from .ranking import (
    Ranked,
    Store,
    attach_group_stats,
    grouped_profile,
    interpolate,
    kept_stats,
    quantile_positions,
)


def _minus(a: str, b: str) -> Column:
    return F.col(a) - F.col(b)


def _per_days(amount: str, length: str, unit: float = 1.0) -> Column:
    n = F.col(length)
    rate = F.col(amount).cast("double") / n.cast("double")
    return F.when(n > 0, rate * unit if unit != 1.0 else rate)


def build_expenditure(master: DataFrame, payment_agg: DataFrame) -> DataFrame:
    """Work master with payment totals and payment-derived columns."""
    df = one_to_one(master, payment_agg)
    df = df.withColumns(
        {
            "HAS_PAYMENT_RECORD": F.coalesce(F.col("PAYMENT_COUNT"), F.lit(0)) > 0,
            "DISBURSED_TO_SANCTION_RATIO": ratio("TOTAL_FUND_DISBURSED_AMT", "SANCTION_AMOUNT"),
            "REMAINING_SANCTION_AMOUNT": _minus("SANCTION_AMOUNT", "TOTAL_FUND_DISBURSED_AMT"),
            "EXPENDITURE_DURATION_DAYS": days("FIRST_EXPENDITURE_DATE", "LAST_EXPENDITURE_DATE"),
        }
    )
    return df.withColumn(
        "PAYMENTS_PER_100_DAYS", _per_days("PAYMENT_COUNT", "EXPENDITURE_DURATION_DAYS", 100.0)
    )


def build_financial_master(expenditure: DataFrame, completion: DataFrame) -> DataFrame:
    """Expenditure with completion amounts, dates and their ratios."""
    df = one_to_one(expenditure, completion)
    return df.withColumns(
        {
            "HAS_COMPLETION_RECORD": F.col("ACTUAL_AMOUNT").isNotNull(),
            "ACTUAL_TO_SANCTION_RATIO": ratio("ACTUAL_AMOUNT", "SANCTION_AMOUNT"),
            "ACTUAL_TO_RECOMMENDED_RATIO": ratio("ACTUAL_AMOUNT", "RECOMMENDED_AMOUNT"),
            "ACTUAL_VS_DISBURSED_RATIO": ratio("ACTUAL_AMOUNT", "TOTAL_FUND_DISBURSED_AMT"),
            "COMPLETION_DURATION_DAYS": days("RECOMMENDATION_DATE", "ACTUAL_END_DATE"),
            "SANCTION_TO_COMPLETION_DAYS": days("SANCTION_DATE", "ACTUAL_END_DATE"),
        }
    )


# Fields whose absence lowers the completeness ratio.
QUALITY_FIELDS = (
    "WORK_DESCRIPTION", "WORK_STAGE", "RECOMMENDED_AMOUNT", "SANCTION_AMOUNT",
    "RECOMMENDATION_DATE", "SANCTION_DATE", "TOTAL_FUND_DISBURSED_AMT",
    "FIRST_EXPENDITURE_DATE", "LAST_EXPENDITURE_DATE", "ACTUAL_AMOUNT", "ACTUAL_END_DATE",
)


def row_features(df: DataFrame) -> DataFrame:
    """Features that need only the work's own row."""
    paid = F.coalesce(F.col("PAYMENT_COUNT"), F.lit(0))
    vendors = F.coalesce(F.col("UNIQUE_VENDOR_COUNT"), F.lit(0))
    quality = [c for c in QUALITY_FIELDS if c in df.columns]
    df = df.withColumns(
        {
            "RECOMMENDED_TO_SANCTION_DIFFERENCE": _minus("RECOMMENDED_AMOUNT", "SANCTION_AMOUNT"),
            "SANCTION_TO_RECOMMENDED_RATIO": ratio("SANCTION_AMOUNT", "RECOMMENDED_AMOUNT"),
            "DISBURSED_TO_RECOMMENDED_RATIO": ratio("TOTAL_FUND_DISBURSED_AMT", "RECOMMENDED_AMOUNT"),
            "REMAINING_SANCTION_RATIO": ratio("REMAINING_SANCTION_AMOUNT", "SANCTION_AMOUNT"),
            "AVERAGE_PAYMENT_AMOUNT": ratio("TOTAL_FUND_DISBURSED_AMT", "PAYMENT_COUNT"),
            "PAYMENT_SUCCESS_RATIO": ratio("PAYMENT_SUCCESS_COUNT", "PAYMENT_COUNT"),
            "PAYMENT_IN_PROGRESS_RATIO": ratio("PAYMENT_IN_PROGRESS_COUNT", "PAYMENT_COUNT"),
            "PAYMENTS_PER_VENDOR": ratio("PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT"),
            "RECOMMENDATION_TO_SANCTION_DAYS": days("RECOMMENDATION_DATE", "SANCTION_DATE"),
            "SANCTION_TO_FIRST_PAYMENT_DAYS": days("SANCTION_DATE", "FIRST_EXPENDITURE_DATE"),
            "RECOMMENDATION_TO_FIRST_PAYMENT_DAYS": days(
                "RECOMMENDATION_DATE", "FIRST_EXPENDITURE_DATE"
            ),
            "LAST_PAYMENT_TO_COMPLETION_DAYS": days("LAST_EXPENDITURE_DATE", "ACTUAL_END_DATE"),
            "RECOMMENDATION_TO_COMPLETION_DAYS": days("RECOMMENDATION_DATE", "ACTUAL_END_DATE"),
            "PAYMENTS_PER_30_DAYS": _per_days("PAYMENT_COUNT", "EXPENDITURE_DURATION_DAYS", 30.0),
            "DISBURSED_PER_EXPENDITURE_DAY": _per_days(
                "TOTAL_FUND_DISBURSED_AMT", "EXPENDITURE_DURATION_DAYS"
            ),
            "IS_COMPLETED": flag(F.col("HAS_COMPLETION_RECORD")),
            "HAS_ACTUAL_AMOUNT": flag(F.col("ACTUAL_AMOUNT").isNotNull()),
            "HAS_ACTUAL_END_DATE": flag(F.col("ACTUAL_END_DATE").isNotNull()),
            "ACTUAL_MINUS_SANCTION": _minus("ACTUAL_AMOUNT", "SANCTION_AMOUNT"),
            "ACTUAL_MINUS_DISBURSED": _minus("ACTUAL_AMOUNT", "TOTAL_FUND_DISBURSED_AMT"),
            "DISBURSED_MINUS_ACTUAL": _minus("TOTAL_FUND_DISBURSED_AMT", "ACTUAL_AMOUNT"),
            "NO_PAYMENT_RECORD": flag(~F.col("HAS_PAYMENT_RECORD")),
            "MULTIPLE_PAYMENTS": flag(paid > 1),
            "MULTIPLE_VENDORS": flag(vendors > 1),
            "PAYMENT_COUNT_GE_5": flag(paid >= 5),
            "PAYMENT_COUNT_GE_10": flag(paid >= 10),
            "VENDOR_COUNT_GE_5": flag(vendors >= 5),
            "VENDOR_COUNT_GE_10": flag(vendors >= 10),
            "MISSING_FIELD_COUNT": missing_count(quality),
            "ACTUAL_ABOVE_SANCTION": flag(F.col("ACTUAL_AMOUNT") > F.col("SANCTION_AMOUNT")),
            "DISBURSED_ABOVE_SANCTION": flag(
                F.col("TOTAL_FUND_DISBURSED_AMT") > F.col("SANCTION_AMOUNT")
            ),
            "RECOMMENDATION_YEAR": F.year("RECOMMENDATION_DATE"),
            "RECOMMENDATION_MONTH": F.month("RECOMMENDATION_DATE"),
            "SANCTION_YEAR": F.year("SANCTION_DATE"),
            "FIRST_PAYMENT_YEAR": F.year("FIRST_EXPENDITURE_DATE"),
            "COMPLETION_YEAR": F.year("ACTUAL_END_DATE"),
        }
    )
    late = F.col("LAST_PAYMENT_TO_COMPLETION_DAYS")
    return df.withColumns(
        {
            "DATA_COMPLETENESS_RATIO": F.lit(1.0)
            - F.col("MISSING_FIELD_COUNT") / F.lit(float(len(quality))),
            "NEGATIVE_RECOMMENDATION_TO_SANCTION": flag(
                F.col("RECOMMENDATION_TO_SANCTION_DAYS") < 0
            ),
            "NEGATIVE_SANCTION_TO_PAYMENT": flag(F.col("SANCTION_TO_FIRST_PAYMENT_DAYS") < 0),
            "COMPLETION_BEFORE_LAST_PAYMENT": flag(late < 0),
            "PAYMENT_AFTER_REPORTED_COMPLETION_DAYS": F.when(late < 0, -late),
            "AVERAGE_PAYMENT_ABOVE_1M": flag(F.col("AVERAGE_PAYMENT_AMOUNT") > 1_000_000),
            "TOTAL_DISBURSED_ABOVE_5M": flag(F.col("TOTAL_FUND_DISBURSED_AMT") > 5_000_000),
        }
    )


def _sum0(c: str) -> Column:
    """Group total that is 0, not NULL, when every value is missing."""
    return F.coalesce(F.sum(c).cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)"))


def _mean(c: str) -> Column:
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)).cast("double")


def state_stats(works: DataFrame, skew: Skew = Skew()) -> DataFrame:
    return grouped_profile(
        works.filter(F.col("STATE_NAME").isNotNull()),
        ["STATE_NAME"],
        moments={
            "STATE_TOTAL_RECOMMENDED": _sum0("RECOMMENDED_AMOUNT"),
            "STATE_TOTAL_SANCTIONED": _sum0("SANCTION_AMOUNT"),
            "STATE_TOTAL_DISBURSED": _sum0("TOTAL_FUND_DISBURSED_AMT"),
            "STATE_AVG_WORK_COST": _mean("SANCTION_AMOUNT"),
        },
        skew=skew,
    ).withColumnRenamed("GROUP_ROWS", "STATE_WORK_COUNT")


def mp_stats(works: DataFrame, skew: Skew = Skew()) -> DataFrame:
    profile = grouped_profile(
        works.filter(F.col("MP_ID").isNotNull()),
        ["MP_ID"],
        moments={
            "MP_TOTAL_RECOMMENDED": _sum0("RECOMMENDED_AMOUNT"),
            "MP_TOTAL_SANCTIONED": _sum0("SANCTION_AMOUNT"),
            "MP_TOTAL_DISBURSED": _sum0("TOTAL_FUND_DISBURSED_AMT"),
            "MP_AVG_SANCTION_AMOUNT": _mean("SANCTION_AMOUNT"),
        },
        ranked={"_san": Ranked("SANCTION_AMOUNT", quantile_positions([0.5]))},
        skew=skew,
    )
    (median,) = interpolate(F.col("_san"), F.col("_san_N"), [0.5])
    return (
        profile.withColumn("MP_MEDIAN_SANCTION_AMOUNT", median)
        .drop("_san", "_san_N")
        .withColumnRenamed("GROUP_ROWS", "MP_WORK_COUNT")
    )


def constituency_stats(works: DataFrame, skew: Skew = Skew()) -> DataFrame:
    return grouped_profile(
        works.filter(F.col("CONSTITUENCY_ID").isNotNull()),
        ["CONSTITUENCY_ID"],
        moments={
            "CONSTITUENCY_TOTAL_SANCTIONED": _sum0("SANCTION_AMOUNT"),
            "CONSTITUENCY_TOTAL_DISBURSED": _sum0("TOTAL_FUND_DISBURSED_AMT"),
            "CONSTITUENCY_AVG_SANCTION": _mean("SANCTION_AMOUNT"),
        },
        skew=skew,
    ).withColumnRenamed("GROUP_ROWS", "CONSTITUENCY_WORK_COUNT")


LOO_PROBS = (0.25, 0.50, 0.75)


def _loo_positions(n: Column) -> list[Column]:
    """Positions that can hold a quantile once one of n values is removed."""
    out = []
    for q in LOO_PROBS:
        k = F.floor((n - 2) * F.lit(q)).cast("bigint")
        out += [k, k + 1, k + 2]
    return out


def peer_stats(
    works: DataFrame, keys: Sequence[str] = PEER_KEYS, skew: Skew = Skew()
) -> DataFrame:
    """Peer-group count, median, mean, std and leave-one-out ingredients.

    ``LOO_VALUES`` holds the nine order statistics from which the quartiles of
    the group without any one member follow.
    """
    profile = grouped_profile(
        works,
        keys,
        moments={
            "PEER_MEAN_SANCTION": _mean("SANCTION_AMOUNT"),
            "PEER_STD_SANCTION": F.stddev_samp(F.col("SANCTION_AMOUNT").cast("double")),
            "PEER_SUM_SANCTION": F.sum("SANCTION_AMOUNT").cast("decimal(28,2)"),
        },
        ranked={
            "_san": Ranked(
                "SANCTION_AMOUNT", lambda n: quantile_positions([0.5])(n) + _loo_positions(n)
            ),
            "_dis": Ranked("TOTAL_FUND_DISBURSED_AMT", quantile_positions([0.5])),
        },
        skew=skew,
    )
    (median,) = interpolate(F.col("_san"), F.col("_san_N"), [0.5])
    (disbursed,) = interpolate(F.col("_dis"), F.col("_dis_N"), [0.5])
    return profile.select(
        *keys,
        F.col("GROUP_ROWS").alias("PEER_COUNT"),
        median.alias("PEER_MEDIAN_SANCTION"),
        "PEER_MEAN_SANCTION",
        "PEER_STD_SANCTION",
        disbursed.alias("PEER_MEDIAN_DISBURSED"),
        F.col("_san_N").alias("PEER_SANCTION_N"),
        "PEER_SUM_SANCTION",
        F.slice("_san", 3, 9).alias("LOO_VALUES"),
    )


def peer_relative(df: DataFrame) -> DataFrame:
    """Ratios, z-score and flags of a work against its peer group."""
    z = F.when(
        F.col("PEER_STD_SANCTION") > 0,
        (F.col("SANCTION_AMOUNT").cast("double") - F.col("PEER_MEAN_SANCTION"))
        / F.col("PEER_STD_SANCTION"),
    )
    df = df.withColumns(
        {
            "SANCTION_TO_PEER_MEDIAN": ratio("SANCTION_AMOUNT", "PEER_MEDIAN_SANCTION"),
            "DISBURSED_TO_PEER_MEDIAN": ratio("TOTAL_FUND_DISBURSED_AMT", "PEER_MEDIAN_DISBURSED"),
            "SANCTION_PEER_Z_SCORE": z,
        }
    )
    return df.withColumns(
        {
            "ABS_PEER_COST_Z_SCORE": F.abs("SANCTION_PEER_Z_SCORE"),
            "SANCTION_ABOVE_2X_PEER_MEDIAN": flag(F.col("SANCTION_TO_PEER_MEDIAN") > 2),
            "SANCTION_ABOVE_5X_PEER_MEDIAN": flag(F.col("SANCTION_TO_PEER_MEDIAN") > 5),
            "DISBURSED_ABOVE_2X_PEER_MEDIAN": flag(F.col("DISBURSED_TO_PEER_MEDIAN") > 2),
        }
    )


LOO_COLUMNS = ("PEER_SANCTION_N", "PEER_SUM_SANCTION", "LOO_VALUES")


def attach_peers(
    works: DataFrame, keys: Sequence[str] = PEER_KEYS, skew: Skew = Skew()
) -> DataFrame:
    """Peer statistics on every work; ``works`` has filled peer keys."""
    stats = peer_stats(works, keys, skew)
    return attach_group_stats(works, stats, keys, size="PEER_COUNT", spread="WORK_ID", skew=skew)


AMOUNTS = ("RECOMMENDED_AMOUNT", "SANCTION_AMOUNT", "TOTAL_FUND_DISBURSED_AMT")
# Group kind -> its key column and the features taken from it.
GROUP_KINDS = {
    "STATE": ("STATE_NAME", {
        "STATE_WORK_COUNT": "GROUP_ROWS", "STATE_TOTAL_RECOMMENDED": "_recommended",
        "STATE_TOTAL_SANCTIONED": "_sanctioned", "STATE_TOTAL_DISBURSED": "_disbursed",
        "STATE_AVG_WORK_COST": "_mean",
    }),
    "MP": ("MP_ID", {
        "MP_WORK_COUNT": "GROUP_ROWS", "MP_TOTAL_RECOMMENDED": "_recommended",
        "MP_TOTAL_SANCTIONED": "_sanctioned", "MP_TOTAL_DISBURSED": "_disbursed",
        "MP_AVG_SANCTION_AMOUNT": "_mean", "MP_MEDIAN_SANCTION_AMOUNT": "_median",
    }),
    "CONSTITUENCY": ("CONSTITUENCY_ID", {
        "CONSTITUENCY_WORK_COUNT": "GROUP_ROWS", "CONSTITUENCY_TOTAL_SANCTIONED": "_sanctioned",
        "CONSTITUENCY_TOTAL_DISBURSED": "_disbursed", "CONSTITUENCY_AVG_SANCTION": "_mean",
    }),
    "CATEGORY": ("_CATEGORY", {"CATEGORY_WORK_COUNT": "GROUP_ROWS"}),
    "ACTIVITY": ("_ACTIVITY", {"ACTIVITY_WORK_COUNT": "GROUP_ROWS"}),
}


def group_profile(works: DataFrame, skew: Skew = Skew()) -> DataFrame:
    """KIND, KEY and the totals of every group of the five groupings.

    One pass: a work gives five short rows, which shrink to its groups before the
    shuffle. Category and activity are the filled peer keys; works without a
    state, MP or seat are in no group of that kind.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(kind).alias("KIND"), F.col(key).cast("string").alias("KEY"))
            for kind, (key, _) in GROUP_KINDS.items()
        ]
    )
    long = (
        works.select(F.explode(pairs).alias("g"), *AMOUNTS)
        .select("g.KIND", "g.KEY", *AMOUNTS)
        .filter(F.col("KEY").isNotNull())
        .withColumn("_mp_sanction", F.when(F.col("KIND") == "MP", F.col("SANCTION_AMOUNT")))
    )
    profile = grouped_profile(
        long,
        ["KIND", "KEY"],
        moments={
            "_recommended": _sum0("RECOMMENDED_AMOUNT"),
            "_sanctioned": _sum0("SANCTION_AMOUNT"),
            "_disbursed": _sum0("TOTAL_FUND_DISBURSED_AMT"),
            "_mean": _mean("SANCTION_AMOUNT"),
        },
        ranked={"_m": Ranked("_mp_sanction", quantile_positions([0.5]))},
        skew=skew,
    )
    (median,) = interpolate(F.col("_m"), F.col("_m_N"), [0.5])
    return profile.withColumn("_median", median).drop("_m", "_m_N")


def attach_groups(
    works: DataFrame, skew: Skew = Skew(), store: Store | None = None
) -> DataFrame:
    """Works with the totals and counts of their five groups, in place.

    Kinds with few groups are broadcast, so the rows stay where they are; for one
    with very many (an MP for each ten works, an activity text of its own for each)
    they are sent by its key once, before the others are added, and not sorted.
    """
    profile = group_profile(works, skew)
    sizes: dict[str, int] = {}
    if store is not None:
        profile = store(profile, "group_profile")
        sizes = {r["KIND"]: r["count"] for r in profile.groupBy("KIND").count().collect()}
    out = works
    for kind in sorted(GROUP_KINDS, key=lambda k: sizes.get(k, 0) <= skew.sent_rows):
        key, outputs = GROUP_KINDS[kind]
        stats = profile.filter(F.col("KIND") == kind).select(
            F.col("KEY").alias("_key"), F.col("GROUP_ROWS").alias("_group_rows"),
            *[F.col(source).alias(name) for name, source in outputs.items()],
        )
        # rows without a key are counted too: they match nothing, but a large group
        # of them is salted like any other
        out = attach_group_stats(
            out.withColumn("_key", F.col(key).cast("string")), stats, ["_key"],
            size="_group_rows", spread="WORK_ID",
            source=works.select(F.col(key).cast("string").alias("_key")), skew=skew,
            small=store is not None and sizes.get(kind, 0) <= skew.sent_rows, hashed=True,
        ).drop("_key", "_group_rows")
    added = [name for _, outputs in GROUP_KINDS.values() for name in outputs]
    return out.select(*works.columns, *added)


def stored_peers(
    financial: DataFrame,
    peer_keys: Sequence[str] = PEER_KEYS,
    normalize_activity: bool = False,
    skew: Skew = Skew(),
    store: Store | None = None,
) -> tuple[DataFrame, bool]:
    """Peer statistics of the financial rows, and whether they may be broadcast."""
    filled = fill_peer_keys(
        financial.select("WORK_ID", *PEER_KEYS, "SANCTION_AMOUNT", "TOTAL_FUND_DISBURSED_AMT"),
        PEER_KEYS,
        normalize_activity=normalize_activity,
    )
    return kept_stats(peer_stats(filled, peer_keys, skew), "peer_stats", store, skew)


def build_features(
    financial: DataFrame,
    *,
    peer_keys: Sequence[str] = PEER_KEYS,
    normalize_activity: bool = False,
    skew: Skew = Skew(),
    store: Store | None = None,
    peers: tuple[DataFrame, bool] | None = None,
    groups: bool = True,
) -> DataFrame:
    """All features. ``financial`` should be a settled layer.

    Group statistics are computed on narrow projections (ids, keys and amounts) and
    joined to the financial rows themselves, whose own features are added last: the
    row is sent at most once for each group kind that is too large to broadcast.
    ``peers`` are statistics of ``stored_peers``; without ``groups`` the totals of
    states, MPs, seats, categories and activities are left out.
    """
    stats, small = peers or stored_peers(financial, peer_keys, normalize_activity, skew, store)
    rows = financial
    if groups:
        activity = F.col("ACTIVITY_NAME")
        labels = {
            "_CATEGORY": peer_label("WORK_CATEGORY"),
            "_ACTIVITY": peer_label(
                strip_activity_prefix(activity) if normalize_activity else activity
            ),
        }
        rows = attach_groups(financial.withColumns(labels), skew, store).drop(*labels)
    filled = fill_peer_keys(rows, PEER_KEYS, normalize_activity=normalize_activity)
    with_peers = attach_group_stats(
        filled,
        stats,
        peer_keys,
        size="PEER_COUNT",
        spread="WORK_ID",
        source=fill_peer_keys(
            financial.select(*PEER_KEYS), PEER_KEYS, normalize_activity=normalize_activity
        ),
        skew=skew,
        small=small,
        hashed=True,
    )
    late = [c for c in with_peers.columns if c not in financial.columns]
    wide = row_features(with_peers)
    own = [c for c in wide.columns if c not in late]
    return peer_relative(wide.select(*own, *late))
