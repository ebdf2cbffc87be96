"""Detector summaries, model diagnostics and dataset audits as tidy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Skew
from ..functions.scalar import round_even
from .cleaning import DataGateError, key_profile
from .columns import column_quantiles
from .columns import grouped_column_profile
from .forest import melt
from .ranking import grouped_quantiles
from .rules import RuleBook


def row_count() -> Column:
    return F.count(F.lit(1))


def metric_rows(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """METRIC, VALUE rows from one aggregation pass."""
    row = df.agg(
        F.array(
            *[
                F.struct(F.lit(k).alias("METRIC"), v.cast("double").alias("VALUE"))
                for k, v in metrics.items()
            ]
        ).alias("m")
    )
    return row.select(F.explode("m").alias("m")).select("m.*")


def stack_reports(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union of METRIC, VALUE tables with a SECTION column."""
    out = None
    for section, part in parts.items():
        tagged = part.select(
            F.lit(section).alias("SECTION"), "METRIC", F.col("VALUE").cast("double").alias("VALUE")
        )
        out = tagged if out is None else out.unionByName(tagged)
    return out


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0)


# --- detector summaries -------------------------------------------------------


def trigger_summary(scored: DataFrame, book: RuleBook) -> DataFrame:
    """Per rule: metadata, triggered works and share of all works."""
    row = scored.agg(
        row_count().alias("_n"),
        F.array(
            *[
                F.struct(
                    F.lit(r.name).alias("RULE"), F.lit(r.category).alias("CATEGORY"),
                    F.lit(r.strength).alias("STRENGTH"), F.lit(r.points).alias("SCORE"),
                    F.lit(r.verification_only).alias("VERIFICATION_ONLY"),
                    F.coalesce(F.sum(r.name), F.lit(0)).alias("TRIGGERED_WORKS"),
                    F.lit(r.description).alias("DESCRIPTION"),
                )
                for r in book.rules
            ]
        ).alias("r"),
    )
    return (
        row.select("_n", F.explode("r").alias("r"))
        .select("r.*", percent(F.col("r.TRIGGERED_WORKS"), F.col("_n")).alias("PERCENT_OF_WORKS"))
        .orderBy(F.desc("TRIGGERED_WORKS"), "RULE")
    )


def score_distribution(scored: DataFrame, score: str, severity: str) -> DataFrame:
    return scored.groupBy(score, severity).agg(row_count().alias("WORK_COUNT")).orderBy(F.desc(score))


def score_band(score: Column) -> Column:
    return (
        F.when(score <= 0, "0").when(score <= 19.99, "1-19").when(score <= 29.99, "20-29")
        .when(score <= 39.99, "30-39").when(score <= 59.99, "40-59").otherwise("60-100")
    )


def score_bands(scored: DataFrame, score: str) -> DataFrame:
    return scored.groupBy(score_band(F.col(score)).alias("BAND")).agg(row_count().alias("WORK_COUNT"))


def with_all(df: DataFrame, key: str, values: Sequence[object], counts: Sequence[str]) -> DataFrame:
    """Add rows of zeros for listed key values that do not occur."""
    spark = df.sparkSession
    order = spark.createDataFrame(list(enumerate(values)), ["_order", key])
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
    return order.join(df, key, "left").withColumns(filled).orderBy("_order").drop("_order")


def hybrid_histogram(hybrid: DataFrame) -> DataFrame:
    """Five-point bins [lo, hi) of the hybrid score and a bin for 100 and over."""
    low = F.least((F.floor(F.col("HYBRID_RISK_SCORE") / 5) * 5), F.lit(100)).cast("int")
    candidate = F.col("INVESTIGATION_CANDIDATE") == 1
    n = F.col("INDEPENDENT_SIGNAL_COUNT")
    counted = hybrid.groupBy(low.alias("SCORE_MIN")).agg(
        row_count().alias("WORK_COUNT"),
        F.count_if(candidate).alias("CANDIDATE_COUNT"),
        *[F.count_if(candidate & (n == i)).alias(f"SIGNAL_{i}_COUNT") for i in (1, 2, 3)],
    )
    counts = ["WORK_COUNT", "CANDIDATE_COUNT", "SIGNAL_1_COUNT", "SIGNAL_2_COUNT", "SIGNAL_3_COUNT"]
    bins = with_all(counted, "SCORE_MIN", list(range(0, 101, 5)), counts)
    high = F.least(F.col("SCORE_MIN") + 5, F.lit(100))
    label = F.when(F.col("SCORE_MIN") == 100, "100").otherwise(
        F.concat(F.col("SCORE_MIN").cast("string"), F.lit("-"), high.cast("string"))
    )
    return bins.select(label.alias("BIN_LABEL"), "SCORE_MIN", high.alias("SCORE_MAX"), *counts)


def level_summary(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Counts and percentages per level in fixed order, absent levels as 0."""
    total = df.agg(row_count()).scalar()
    counted = df.groupBy(column).agg(row_count().alias("WORK_COUNT"))
    return with_all(counted, column, list(levels), ["WORK_COUNT"]).withColumn(
        "PERCENTAGE", percent(F.col("WORK_COUNT"), total)
    )


def agreement_summary(hybrid: DataFrame) -> DataFrame:
    total = hybrid.agg(row_count()).scalar()
    return (
        hybrid.groupBy("DETECTOR_AGREEMENT").agg(row_count().alias("WORK_COUNT"))
        .withColumn("PERCENTAGE", percent(F.col("WORK_COUNT"), total))
        .orderBy(F.desc("WORK_COUNT"), "DETECTOR_AGREEMENT")
    )


def candidates_per_state(hybrid: DataFrame) -> DataFrame:
    return (
        hybrid.filter((F.col("INVESTIGATION_CANDIDATE") == 1) & F.col("STATE_NAME").isNotNull())
        .groupBy("STATE_NAME").agg(row_count().alias("INVESTIGATION_CANDIDATES"))
        .orderBy(F.desc("INVESTIGATION_CANDIDATES"), "STATE_NAME")
    )


def hybrid_kpis(hybrid: DataFrame) -> DataFrame:
    candidates = F.sum("INVESTIGATION_CANDIDATE")
    n = F.col("INDEPENDENT_SIGNAL_COUNT")
    return metric_rows(hybrid, {
        "TOTAL_WORKS": row_count(),
        "INVESTIGATION_CANDIDATES": candidates,
        "CANDIDATE_PERCENTAGE": percent(candidates, row_count()),
        "RULE_CANDIDATES": F.sum("RULE_CANDIDATE"),
        "STATISTICAL_CANDIDATES": F.sum("STAT_CANDIDATE"),
        "ML_CANDIDATES": F.sum("ML_CANDIDATE"),
        "TWO_OR_MORE_METHODS": F.count_if(n >= 2),
        "ALL_THREE_METHODS": F.count_if(n == 3),
    })


def tier_composition(hybrid: DataFrame) -> DataFrame:
    """Candidates per priority: total, share, signal mix, consensus and score-only."""
    n = F.col("INDEPENDENT_SIGNAL_COUNT")
    candidates = hybrid.filter(F.col("INVESTIGATION_CANDIDATE") == 1)
    total = candidates.agg(row_count()).scalar()
    return (
        candidates.groupBy("INVESTIGATION_PRIORITY").agg(
            row_count().alias("WORK_COUNT"),
            *[F.count_if(n == i).alias(f"SIGNAL_{i}_COUNT") for i in (1, 2, 3)],
        )
        .withColumns(
            {
                "PERCENT_OF_CANDIDATES": percent(F.col("WORK_COUNT"), total),
                "SCORE_ONLY_COUNT": F.col("WORK_COUNT") - F.col("SIGNAL_3_COUNT"),
            }
        )
        .orderBy("INVESTIGATION_PRIORITY")
    )


# --- model diagnostics ----------------------------------------------------------


def _rate(anomalies: str, works: str) -> Column:
    return F.col(anomalies) / F.col(works) * 100.0


def _mean(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(28,6)")).cast("double") / F.nullif(F.count(c), F.lit(0))


# The features that the state diagnostic reads.
STATE_DIAGNOSTIC_FEATURES = (
    "STATE_NAME", "SANCTION_AMOUNT", "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "DATA_COMPLETENESS_RATIO",
    "PEER_COUNT",
)


def state_diagnostic(analysis: DataFrame, skew: Skew = Skew()) -> DataFrame:
    """Works, anomalies, medians and means per state, with the rate against all."""
    medians = {
        "s": ("SANCTION_AMOUNT", [0.5], ["MEDIAN_SANCTION"]),
        "p": ("PAYMENT_COUNT", [0.5], ["MEDIAN_PAYMENT_COUNT"]),
        "v": ("UNIQUE_VENDOR_COUNT", [0.5], ["MEDIAN_VENDOR_COUNT"]),
        "c": ("DATA_COMPLETENESS_RATIO", [0.5], ["MEDIAN_COMPLETENESS"]),
        "n": ("PEER_COUNT", [0.5], ["MEDIAN_PEER_COUNT"]),
    }
    overall = analysis.agg(F.sum("ML_ANOMALY") / row_count() * 100.0).scalar()
    table = grouped_quantiles(
        analysis.filter(F.col("STATE_NAME").isNotNull()), ["STATE_NAME"], medians,
        moments={
            "ML_ANOMALIES": F.sum("ML_ANOMALY"),
            "MEAN_SANCTION": _mean("SANCTION_AMOUNT"),
            "MEAN_PAYMENT_COUNT": _mean("PAYMENT_COUNT"),
            "MEAN_VENDOR_COUNT": _mean("UNIQUE_VENDOR_COUNT"),
        },
        skew=skew,
    )
    return (
        table.drop(*[f"{m}_N" for m in medians])
        .withColumnRenamed("GROUP_ROWS", "TOTAL_WORKS")
        .withColumn("ML_ANOMALY_RATE_PERCENT", _rate("ML_ANOMALIES", "TOTAL_WORKS"))
        .withColumn("INDIA_RATE_RATIO", F.try_divide(F.col("ML_ANOMALY_RATE_PERCENT"), overall))
        .orderBy(F.desc("ML_ANOMALY_RATE_PERCENT"), "STATE_NAME")
    )


def high_rate_states(diagnostic: DataFrame, min_works: int = 500, factor: float = 2.0) -> DataFrame:
    return diagnostic.filter(
        (F.col("TOTAL_WORKS") >= min_works) & (F.col("INDIA_RATE_RATIO") > factor)
    )


def peer_band(count: Column) -> Column:
    return F.when(count >= 30, "30+").when(count >= 10, "10-29").otherwise("0-9")


# Features that the table of peer bands reads.
PEER_BAND_FEATURES = (
    "PEER_COUNT", "SANCTION_AMOUNT", "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "DATA_COMPLETENESS_RATIO",
)


def peer_band_diagnostic(analysis: DataFrame, skew: Skew = Skew()) -> DataFrame:
    medians = {
        "s": ("SANCTION_AMOUNT", [0.5], ["MEDIAN_SANCTION"]),
        "p": ("PAYMENT_COUNT", [0.5], ["MEDIAN_PAYMENT_COUNT"]),
        "v": ("UNIQUE_VENDOR_COUNT", [0.5], ["MEDIAN_VENDOR_COUNT"]),
        "c": ("DATA_COMPLETENESS_RATIO", [0.5], ["MEDIAN_COMPLETENESS"]),
    }
    banded = analysis.withColumn("PEER_GROUP", peer_band(F.col("PEER_COUNT")))
    table = grouped_quantiles(
        banded, ["PEER_GROUP"], medians, moments={"ML_ANOMALIES": F.sum("ML_ANOMALY")}, skew=skew
    )
    return (
        table.drop(*[f"{m}_N" for m in medians])
        .withColumnRenamed("GROUP_ROWS", "TOTAL_WORKS")
        .withColumn("ML_ANOMALY_RATE_PERCENT", _rate("ML_ANOMALIES", "TOTAL_WORKS"))
    )


# Features compared between anomalies and normal works.
DIAGNOSTIC_FEATURES = (
    "SANCTION_AMOUNT", "RECOMMENDED_AMOUNT", "ACTUAL_AMOUNT", "TOTAL_FUND_DISBURSED_AMT",
    "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "DATA_COMPLETENESS_RATIO", "PEER_COUNT",
    "SANCTION_TO_PEER_MEDIAN", "SANCTION_PEER_Z_SCORE", "COMPLETION_DURATION_DAYS",
    "PAYMENT_AFTER_REPORTED_COMPLETION_DAYS",
)


def _feature_profile(
    df: DataFrame, features: Sequence[str], by: Sequence[str], probs: Sequence[float],
    names: Sequence[str], skew: Skew,
) -> DataFrame:
    """``by``, FEATURE, N, MEAN, STD and quantiles, from histograms by group; only with
    very many groups from one row for each value."""
    table = grouped_column_profile(df, features, by, probs, names)
    if table is not None:
        return table.withColumnRenamed("COLUMN", "FEATURE")
    return grouped_quantiles(
        melt(df, features, *by), [*by, "FEATURE"], {"v": ("VALUE", probs, names)},
        moments={"MEAN": F.avg("VALUE"), "STD": F.stddev_samp("VALUE")}, skew=skew,
    ).withColumnRenamed("v_N", "N")


def _two_groups(
    analysis: DataFrame, features: Sequence[str], probs: Sequence[float], skew: Skew,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per feature (and ``by``): count, quantiles, mean and std of both groups."""
    names = [f"Q{int(p * 100)}" for p in probs]
    table = _feature_profile(analysis, features, [*by, "ML_ANOMALY"], probs, names, skew)

    def side(flag: int, c: str) -> Column:
        return F.max(F.when(F.col("ML_ANOMALY") == flag, F.col(c)))

    columns = []
    for flag, name in ((1, "ANOMALY"), (0, "NORMAL")):
        columns.append(F.coalesce(side(flag, "N"), F.lit(0)).alias(f"{name}_COUNT"))
        columns += [side(flag, c).alias(f"{name}_{c}") for c in [*names, "MEAN", "STD"]]
    return table.groupBy(*by, "FEATURE").agg(*columns)


def anomaly_comparison(
    analysis: DataFrame, features: Sequence[str] = DIAGNOSTIC_FEATURES, skew: Skew = Skew()
) -> DataFrame:
    """Counts, medians, means and median ratio of anomalies against normal works."""
    sides = _two_groups(analysis, features, [0.5], skew)
    ratio = F.when(F.col("NORMAL_Q50") != 0, F.col("ANOMALY_Q50") / F.col("NORMAL_Q50"))
    return (
        sides.filter((F.col("ANOMALY_COUNT") > 0) & (F.col("NORMAL_COUNT") > 0))
        .select(
            "FEATURE", "ANOMALY_COUNT", "NORMAL_COUNT",
            F.col("ANOMALY_Q50").alias("ANOMALY_MEDIAN"), F.col("NORMAL_Q50").alias("NORMAL_MEDIAN"),
            ratio.alias("MEDIAN_RATIO"), "ANOMALY_MEAN", "NORMAL_MEAN",
            F.abs(ratio - 1).alias("ABS_MEDIAN_RATIO_DISTANCE"),
        )
        .orderBy(F.desc_nulls_last("ABS_MEDIAN_RATIO_DISTANCE"), "FEATURE")
    )


def _standardized(anomaly: Column, normal: Column, std: Column) -> Column:
    return F.when(std > 1e-12, (anomaly - normal) / std)


def feature_comparison(
    analysis: DataFrame, features: Sequence[str], *, min_side: int = 20, skew: Skew = Skew()
) -> DataFrame:
    """Distribution of each feature in both groups and the standardized gap."""
    sides = _two_groups(analysis, features, [0.5, 0.95, 0.99], skew)
    a, n = F.col("ANOMALY_Q50"), F.col("NORMAL_Q50")
    usable = F.abs(n) > 1e-12
    gap = _standardized(a, n, F.col("NORMAL_STD"))
    return (
        sides.filter((F.col("ANOMALY_COUNT") >= min_side) & (F.col("NORMAL_COUNT") >= min_side))
        .select(
            "FEATURE", "ANOMALY_COUNT", "NORMAL_COUNT", a.alias("ANOMALY_MEDIAN"),
            n.alias("NORMAL_MEDIAN"), F.when(usable, a / n).alias("MEDIAN_RATIO"),
            F.when(usable, (a - n) / F.abs(n) * 100.0).alias("MEDIAN_DIFFERENCE_PERCENT"),
            "ANOMALY_MEAN", "NORMAL_MEAN", F.col("ANOMALY_Q95").alias("ANOMALY_P95"),
            F.col("NORMAL_Q95").alias("NORMAL_P95"), F.col("ANOMALY_Q99").alias("ANOMALY_P99"),
            F.col("NORMAL_Q99").alias("NORMAL_P99"), "NORMAL_STD",
            gap.alias("STANDARDIZED_DIFFERENCE"), F.abs(gap).alias("ABS_STANDARDIZED_DIFFERENCE"),
        )
        .orderBy(F.desc_nulls_last("ABS_STANDARDIZED_DIFFERENCE"), "FEATURE")
    )


def availability_gap(analysis: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of non-missing values in anomalies and in normal works."""
    anomaly = F.col("ML_ANOMALY") == 1
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("FEATURE"),
                (F.count_if(anomaly & F.col(c).isNotNull()) / F.count_if(anomaly) * 100.0).alias(
                    "ANOMALY_AVAILABLE_PERCENT"
                ),
                (F.count_if(~anomaly & F.col(c).isNotNull()) / F.count_if(~anomaly) * 100.0).alias(
                    "NORMAL_AVAILABLE_PERCENT"
                ),
            )
            for c in features
        ]
    )
    gap = F.col("ANOMALY_AVAILABLE_PERCENT") - F.col("NORMAL_AVAILABLE_PERCENT")
    return (
        analysis.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*")
        .withColumn("AVAILABILITY_GAP_PERCENT", gap)
        .orderBy("AVAILABILITY_GAP_PERCENT", "FEATURE")
    )


def state_feature_gaps(
    analysis: DataFrame, features: Sequence[str], *, min_works: int = 100, min_anomalies: int = 5,
    min_normal: int = 20, skew: Skew = Skew(),
) -> DataFrame:
    """Standardized median gaps per state and feature, for states with enough data."""
    states = (
        analysis.filter(F.col("STATE_NAME").isNotNull()).groupBy("STATE_NAME")
        .agg(row_count().alias("TOTAL_WORKS"), F.sum("ML_ANOMALY").alias("ML_ANOMALIES"))
        .filter((F.col("TOTAL_WORKS") >= min_works) & (F.col("ML_ANOMALIES") >= min_anomalies))
        .withColumn("ML_ANOMALY_RATE_PERCENT", _rate("ML_ANOMALIES", "TOTAL_WORKS"))
    )
    sides = _two_groups(
        analysis.filter(F.col("STATE_NAME").isNotNull()), features, [0.5], skew, ["STATE_NAME"]
    )
    a, n = F.col("ANOMALY_Q50"), F.col("NORMAL_Q50")
    gap = _standardized(a, n, F.col("NORMAL_STD"))
    return (
        sides.filter(
            (F.col("ANOMALY_COUNT") >= min_anomalies) & (F.col("NORMAL_COUNT") >= min_normal)
        )
        .join(states, "STATE_NAME")
        .select(
            "STATE_NAME", "TOTAL_WORKS", "ML_ANOMALIES", "ML_ANOMALY_RATE_PERCENT", "FEATURE",
            a.alias("ANOMALY_MEDIAN"), n.alias("NORMAL_MEDIAN"), "NORMAL_STD",
            gap.alias("STANDARDIZED_DIFFERENCE"), F.abs(gap).alias("ABS_STANDARDIZED_DIFFERENCE"),
        )
        .orderBy("STATE_NAME", F.desc_nulls_last("ABS_STANDARDIZED_DIFFERENCE"), "FEATURE")
    )


def state_rates(ml: DataFrame) -> DataFrame:
    return (
        ml.filter(F.col("STATE_NAME").isNotNull()).groupBy("STATE_NAME")
        .agg(row_count().alias("TOTAL_WORKS"), F.sum("ML_ANOMALY").alias("ML_ANOMALIES"))
        .withColumn("ML_ANOMALY_RATE_PERCENT", _rate("ML_ANOMALIES", "TOTAL_WORKS"))
        .orderBy(F.desc("ML_ANOMALY_RATE_PERCENT"), "STATE_NAME")
    )


def overlap_groups() -> dict[str, Column]:
    m, r, s = (F.col(f"{p}_CANDIDATE") == 1 for p in ("ML", "RULE", "STAT"))
    return {
        "ML": m, "RULE": r, "STATISTICAL": s, "ML_AND_RULE": m & r, "ML_AND_STATISTICAL": m & s,
        "RULE_AND_STATISTICAL": r & s, "ALL_THREE": m & r & s, "ML_ONLY": m & ~r & ~s,
        "RULE_ONLY": r & ~m & ~s, "STATISTICAL_ONLY": s & ~m & ~r, "NONE": ~m & ~r & ~s,
    }


def detector_overlap(hybrid: DataFrame) -> DataFrame:
    """Sizes of the eleven detector overlap groups, from one pass."""
    return metric_rows(hybrid, {k: F.count_if(v) for k, v in overlap_groups().items()}).select(
        F.col("METRIC").alias("GROUP"), F.col("VALUE").cast("bigint").alias("COUNT")
    )


def group_members(hybrid: DataFrame, group: str) -> DataFrame:
    """Work ids of one overlap group."""
    return hybrid.filter(overlap_groups()[group]).select("WORK_ID")


# Numeric columns that name things or only serve other features.
NOT_FEATURES = ("WORK_ID", "STATE_ID", "CONSTITUENCY_ID", "MP_ID", "ATTACH_ID",
                "PEER_SANCTION_N", "PEER_SUM_SANCTION")


def numeric_features(df: DataFrame) -> list[str]:
    """Every numeric column that describes a work."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES
    ]


def ml_distribution(ml: DataFrame, feature_count: int, contamination: float | str,
                    trees: int, min_peers: int = 10) -> DataFrame:
    """Headline model metrics as METRIC, VALUE; automatic contamination is NULL."""
    fixed = F.lit(None).cast("double") if contamination == "auto" else F.lit(float(contamination))
    return metric_rows(ml, {
        "TOTAL_WORKS": row_count(),
        "ML_ANOMALIES": F.sum("ML_ANOMALY"),
        "ML_ANOMALY_PERCENTAGE": percent(F.sum("ML_ANOMALY"), row_count()),
        **{lv: F.count_if(F.col("ML_SEVERITY") == lv) for lv in ("HIGH", "MEDIUM", "LOW", "NONE")},
        "FEATURE_COUNT": F.max(F.lit(feature_count)),
        "CONTAMINATION": F.max(fixed),
        "N_ESTIMATORS": F.max(F.lit(trees)),
        "MIN_PEER_SIZE": F.max(F.lit(min_peers)),
    })


def group_distribution(
    analysis: DataFrame,
    columns: Sequence[str] = ("PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "SANCTION_AMOUNT"),
    skew: Skew = Skew(),
) -> DataFrame:
    """FEATURE, GROUP, N, MEDIAN, MEAN, P95, P99 for normal and anomalous works."""
    table = _feature_profile(
        analysis, columns, ["ML_ANOMALY"], [0.5, 0.95, 0.99], ["MEDIAN", "P95", "P99"], skew
    )
    name = F.when(F.col("ML_ANOMALY") == 1, "ML_ANOMALY").otherwise("NORMAL")
    return table.select(
        "FEATURE", name.alias("GROUP"), "N", "MEDIAN", "MEAN", "P95", "P99"
    )


def top_anomalies(analysis: DataFrame, n: int = 100) -> DataFrame:
    """Strongest anomalies with the agreement of the other detectors."""
    agree = F.lit(1) + F.col("RULE_CANDIDATE") + F.col("STAT_CANDIDATE")
    return (
        analysis.filter(F.col("ML_ANOMALY") == 1)
        .withColumns(
            {
                "RULE_AGREEMENT": F.col("RULE_CANDIDATE") == 1,
                "STATISTICAL_AGREEMENT": F.col("STAT_CANDIDATE") == 1,
                "DETECTOR_AGREEMENT_COUNT": agree,
            }
        )
        .orderBy("IF_DECISION_SCORE", "WORK_ID")
        .limit(n)
    )


# --- dataset audits -------------------------------------------------------------


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def column_profile(
    df: DataFrame, columns: Sequence[str] | None = None, skew: Skew = Skew()
) -> DataFrame:
    """Per numeric column: missing count and share, mean, std, min, median, max."""
    columns = list(columns or [c for c in df.columns if _is_number(df, c)])
    missing = df.agg(
        row_count().alias("_n"),
        F.array(
            *[
                F.struct(F.lit(c).alias("COLUMN"), F.count_if(F.col(c).isNull()).alias("MISSING"))
                for c in columns
            ]
        ).alias("m"),
    ).select("_n", F.explode("m").alias("m")).select(
        "m.*", percent(F.col("m.MISSING"), F.col("_n")).alias("MISSING_PERCENT")
    )
    stats = _feature_profile(
        df, columns, [], [0.0, 0.5, 1.0], ["MIN", "MEDIAN", "MAX"], skew
    ).withColumnsRenamed({"FEATURE": "COLUMN", "N": "COUNT"})
    return missing.join(stats, "COLUMN", "left").withColumn(
        "COUNT", F.coalesce("COUNT", F.lit(0))
    )


def category_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """COLUMN, UNIQUE_VALUES, MISSING of each text column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("COLUMN"), F.col(c).cast("string").alias("v")) for c in columns]
    )
    # distinct values are grouped first, so a frequent value is one partial row
    values = (
        df.select(F.explode(pairs).alias("p")).groupBy("p.COLUMN", "p.v").agg(row_count().alias("n"))
    )
    return values.groupBy("COLUMN").agg(
        F.count("v").alias("UNIQUE_VALUES"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("MISSING"),
    )


def ratio_bands(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of a ratio below 0, equal 0, above 1, 2 and 5, and its maximum."""
    tests = {
        "BELOW_0": lambda c: c < 0, "EQUAL_0": lambda c: c == 0, "ABOVE_1": lambda c: c > 1,
        "ABOVE_2": lambda c: c > 2, "ABOVE_5": lambda c: c > 5,
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("COLUMN"), F.count(name).alias("AVAILABLE"),
                *[F.count_if(test(F.col(name))).alias(k) for k, test in tests.items()],
                F.max(F.col(name).cast("double")).alias("MAXIMUM"),
            )
            for name in columns
        ]
    )
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def id_conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Ids that occur with more than one value of a column: KEY, COLUMN, VALUES."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("COLUMN"), F.col(c).cast("string").alias("v")) for c in columns]
    )
    seen = (
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("KEY"), F.explode(pairs).alias("p"))
        .select("KEY", "p.COLUMN", "p.v").filter(F.col("v").isNotNull()).distinct()
    )
    return seen.groupBy("KEY", "COLUMN").agg(row_count().alias("VALUES")).filter(F.col("VALUES") > 1)


def conflict_counts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    counted = id_conflicts(df, key, columns).groupBy("COLUMN").agg(row_count().alias("CONFLICTING_IDS"))
    return with_all(counted, "COLUMN", list(columns), ["CONFLICTING_IDS"])


def source_summary(df: DataFrame, source: str, key: str) -> DataFrame:
    """Records, unique ids and repeated records per portal list."""
    per_id = df.groupBy(source, key).agg(row_count().alias("n"))
    return per_id.groupBy(source).agg(
        F.sum("n").alias("RECORDS"), F.count(key).alias("UNIQUE_IDS")
    ).withColumn("DUPLICATE_RECORDS", F.col("RECORDS") - F.col("UNIQUE_IDS"))


def state_rollup(master: DataFrame) -> DataFrame:
    money = {"RECOMMENDED": "RECOMMENDED_AMOUNT", "SANCTIONED": "SANCTION_AMOUNT"}
    return (
        master.filter(F.col("STATE_NAME").isNotNull()).groupBy("STATE_NAME").agg(
            F.count_distinct("WORK_ID").alias("WORKS"), F.count_distinct("MP_ID").alias("MPS"),
            F.count_distinct("CONSTITUENCY_ID").alias("CONSTITUENCIES"),
            *[
                F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,2)").alias(k)
                for k, c in money.items()
            ],
        )
        .orderBy(F.desc("WORKS"), "STATE_NAME")
    )


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("MISSING")).alias("VALUE")).agg(
        row_count().alias("ROWS")
    ).orderBy(F.desc("ROWS"), "VALUE")
    return counted if n is None else counted.limit(n)


def amount_relation(master: DataFrame) -> DataFrame:
    r, s = F.col("RECOMMENDED_AMOUNT"), F.col("SANCTION_AMOUNT")
    return metric_rows(master, {
        "BOTH_AVAILABLE": F.count_if(r.isNotNull() & s.isNotNull()),
        "RECOMMENDED_ABOVE_SANCTIONED": F.count_if(r > s),
        "SANCTIONED_ABOVE_RECOMMENDED": F.count_if(s > r),
        "EQUAL": F.count_if(r == s),
    })


def collection_rollup(records: DataFrame) -> DataFrame:
    return (
        records.filter(F.col("_STATE_NAME").isNotNull()).groupBy("_STATE_NAME").agg(
            row_count().alias("RECORDS"), F.count_distinct("_MP_ID").alias("MPS"),
            F.count_distinct("_CONSTITUENCY_ID").alias("CONSTITUENCIES"),
        )
        .orderBy(F.desc("RECORDS"), "_STATE_NAME")
    )


def negative_timelines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which any of the given durations is negative."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    return df.filter(bad)


def extreme_costs(df: DataFrame, ratio: str, n: int = 20) -> DataFrame:
    return df.filter(F.col(ratio).isNotNull()).orderBy(F.desc(ratio), "WORK_ID").limit(n)


def _key_metrics(df: DataFrame, key: str) -> DataFrame:
    p = key_profile(df, key)
    return metric_rows(p, {c: F.max(c) for c in p.columns})


def _distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cover = category_coverage(df, columns)
    both = F.array(
        F.struct(F.concat(F.lit("UNIQUE_"), "COLUMN").alias("METRIC"), F.col("UNIQUE_VALUES").alias("VALUE")),
        F.struct(F.concat(F.lit("MISSING_"), "COLUMN").alias("METRIC"), F.col("MISSING").alias("VALUE")),
    )
    return cover.select(F.explode(both).alias("m")).select("m.*")


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def audit_raw_records(records: DataFrame) -> DataFrame:
    """Sources, exact duplicates, id repetition and field coverage of raw records."""
    content = [c for c in records.columns if c != "_ord"]
    copies = records.groupBy(*content).agg(row_count().alias("n"))
    ids = records.filter(F.col("WORK_RECOMMENDATION_DTL_ID").isNotNull()).groupBy(
        "WORK_RECOMMENDATION_DTL_ID"
    ).agg(row_count().alias("n"))
    return stack_reports({
        "SOURCES": value_counts(records, "_SOURCE_KEY").select(
            F.col("VALUE").alias("METRIC"), F.col("ROWS").alias("VALUE")
        ),
        "DUPLICATES": metric_rows(copies, {
            "ROWS": F.sum("n"), "EXACT_DUPLICATES": F.sum("n") - row_count(),
        }),
        "IDS": metric_rows(ids, {
            "ONCE": F.count_if(F.col("n") == 1), "REPEATED": F.count_if(F.col("n") > 1),
            "MAX_REPETITIONS": F.max("n"),
        }),
        "FIELDS": _distinct(records, _present(records, (
            "SANCTION_AMOUNT", "ACTUAL_AMOUNT", "FUND_DISBURSED_AMT", "WORK_ID", "MP_NAME",
            "CONSTITUENCY", "ACTIVITY_NAME", "WORK_CATEGORY", "WORK_STAGE", "RECOMMENDATION_DATE",
            "SANCTION_DATE", "ACTUAL_END_DATE",
        ))),
    })


def audit_collection(collection: DataFrame) -> DataFrame:
    """Coverage, mapping uniqueness, missing fields and cross-state ids."""
    mapping = ["_STATE_ID", "_MP_ID", "_CONSTITUENCY_ID"]
    pairs = collection.select(*mapping).distinct()
    return stack_reports({
        "KEYS": _key_metrics(collection, "WORK_RECOMMENDATION_DTL_ID"),
        "COVERAGE": _distinct(collection, ("_STATE_NAME", "_MP_ID", "_MP_NAME",
                                           "_CONSTITUENCY_ID", "_CONSTITUENCY", "_SOURCE_KEY")),
        "MAPPINGS": metric_rows(pairs, {"STATE_MP_CONSTITUENCY": row_count()}),
        "CONFLICTS": conflict_counts(
            collection, "WORK_RECOMMENDATION_DTL_ID", ["_STATE_NAME"]
        ).select(F.col("COLUMN").alias("METRIC"), F.col("CONFLICTING_IDS").alias("VALUE")),
    })


def missing_profile(df: DataFrame) -> DataFrame:
    """COLUMN, MISSING, MISSING_PERCENT of every column that has gaps, in one pass."""
    names = df.columns
    gaps = df.agg(
        row_count().alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(names)]
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("COLUMN"), F.col(f"_{i}").alias("MISSING")) for i, c in enumerate(names)
    ])
    return gaps.select("_rows", F.explode(pairs).alias("p")).select(
        "p.COLUMN", "p.MISSING", (F.col("p.MISSING") / F.col("_rows") * 100.0).alias("MISSING_PERCENT")
    ).filter("MISSING > 0")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """ROWS and DUPLICATE_ROWS (rows beyond the first of equal ones)."""
    copies = df.groupBy(*df.columns).agg(row_count().alias("_n"))
    return copies.agg(
        F.sum("_n").alias("ROWS"), (F.sum("_n") - row_count()).alias("DUPLICATE_ROWS")
    )


def amount_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """COLUMN, N, MEDIAN of amounts and durations; exact, without a global sort."""
    return column_quantiles(df, _present(df, columns), [0.5], ["MEDIAN"]).select(
        "COLUMN", "N", "MEDIAN"
    )


def state_concentration(ml: DataFrame) -> DataFrame:
    """States with their share of all anomalies, their rate against the country's,
    and their places by number and by rate (ties by name)."""
    states = state_rates(ml)
    works, anomalies = F.col("TOTAL_WORKS"), F.col("ML_ANOMALIES")
    # one row for each state, so one window over all of them is small
    every = Window.partitionBy(F.lit(0))
    rate = F.sum(anomalies).over(every) / F.sum(works).over(every) * 100.0
    by_number = every.orderBy(F.desc("ML_ANOMALIES"), "STATE_NAME")
    by_rate = every.orderBy(F.desc("ML_ANOMALY_RATE_PERCENT"), "STATE_NAME")
    share = anomalies / F.nullif(F.sum(anomalies).over(every), F.lit(0)) * 100.0
    return states.select(
        "STATE_NAME", "TOTAL_WORKS", "ML_ANOMALIES", "ML_ANOMALY_RATE_PERCENT",
        share.alias("SHARE_PERCENT"),
        (F.col("ML_ANOMALY_RATE_PERCENT") / F.nullif(rate, F.lit(0.0))).alias("INDIA_RATE_RATIO"),
        F.row_number().over(by_number).alias("PLACE_BY_NUMBER"),
        F.row_number().over(by_rate).alias("PLACE_BY_RATE"),
    )


def audit_work_ids(records: DataFrame) -> DataFrame:
    """Id completeness, repetition and conflicts with state, MP, seat, list, stage."""
    key = "WORK_RECOMMENDATION_DTL_ID"
    columns = _present(
        records, ("_STATE_NAME", "_MP_ID", "_CONSTITUENCY_ID", "_SOURCE_KEY", "WORK_STAGE")
    )
    return stack_reports({
        "KEYS": _key_metrics(records, key),
        "CONFLICTS": conflict_counts(records, key, columns).select(
            F.col("COLUMN").alias("METRIC"), F.col("CONFLICTING_IDS").alias("VALUE")
        ),
    })


def _amount_metrics(columns: Sequence[str]) -> dict[str, Column]:
    out = {}
    for c in columns:
        out |= {
            f"{c}_MISSING": F.count_if(F.col(c).isNull()),
            f"{c}_ZERO": F.count_if(F.col(c) == 0),
            f"{c}_NEGATIVE": F.count_if(F.col(c) < 0),
            f"{c}_MIN": F.min(c), f"{c}_MAX": F.max(c),
        }
    return out


def audit_master(master: DataFrame) -> DataFrame:
    """Key, amount, date and consistency checks of the work master."""
    r, s = F.col("RECOMMENDATION_DATE"), F.col("SANCTION_DATE")
    return stack_reports({
        "KEYS": _key_metrics(master, "WORK_ID"),
        "FIELDS": _distinct(master, _present(master, (
            "STATE_NAME", "CONSTITUENCY", "MP_NAME", "WORK_CATEGORY", "ACTIVITY_NAME",
            "WORK_STAGE", "SOURCE_KEY",
        ))),
        "AMOUNTS": metric_rows(master, _amount_metrics(("RECOMMENDED_AMOUNT", "SANCTION_AMOUNT"))),
        "RELATION": amount_relation(master),
        "DATES": metric_rows(master, {
            "RECOMMENDATION_DATE_MISSING": F.count_if(r.isNull()),
            "SANCTION_DATE_MISSING": F.count_if(s.isNull()),
            "SANCTION_BEFORE_RECOMMENDATION": F.count_if(s < r),
        }),
    })


def audit_payments(expenditure: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment coverage, totals and ratio checks of the expenditure table."""
    paid, r = F.col("HAS_PAYMENT_RECORD"), F.col("DISBURSED_TO_SANCTION_RATIO")
    return stack_reports({
        "KEYS": _key_metrics(expenditure, "WORK_ID"),
        "COVERAGE": metric_rows(expenditure, {
            "WITH_PAYMENTS": F.count_if(paid), "WITHOUT_PAYMENTS": F.count_if(~paid),
            "COVERAGE_PERCENT": round_even(percent(F.count_if(paid), row_count()), 2),
            "TOTAL_DISBURSED": F.sum("TOTAL_FUND_DISBURSED_AMT"),
            "MAX_PAYMENTS": F.max("PAYMENT_COUNT"),
            "AVERAGE_PAYMENTS": round_even(F.sum("PAYMENT_COUNT") / F.count("PAYMENT_COUNT"), 2),
            "RATIO_AVAILABLE": F.count(r), "RATIO_ABOVE_1": F.count_if(r > 1),
            "RATIO_ABOVE_2": F.count_if(r > 2), "ZERO_DURATION": F.count_if(
                F.col("EXPENDITURE_DURATION_DAYS") == 0),
        }),
        "TRANSACTIONS": metric_rows(payments, {
            "TRANSACTIONS": row_count(), "PAYMENT_WORKS": F.count_distinct("WORK_ID"),
        }),
    })


def audit_completions(financial: DataFrame) -> DataFrame:
    """Completion coverage, ratio and duration checks of the financial master."""
    done, r = F.col("HAS_COMPLETION_RECORD"), F.col("ACTUAL_TO_SANCTION_RATIO")
    d = F.col("COMPLETION_DURATION_DAYS")
    return metric_rows(financial, {
        "WORKS": row_count(), "WITH_COMPLETION": F.count_if(done), "WITHOUT_COMPLETION": F.count_if(~done),
        "COVERAGE_PERCENT": round_even(percent(F.count_if(done), row_count()), 2),
        "ACTUAL_ZERO": F.count_if(F.col("ACTUAL_AMOUNT") == 0),
        "RATIO_AVAILABLE": F.count(r), "RATIO_ABOVE_1": F.count_if(r > 1),
        "RATIO_ABOVE_1_5": F.count_if(r > 1.5), "RATIO_ABOVE_2": F.count_if(r > 2),
        "DURATION_AVAILABLE": F.count(d), "DURATION_NEGATIVE": F.count_if(d < 0),
        "DURATION_MIN": F.min(d), "DURATION_MAX": F.max(d),
    })


def audit_features(features: DataFrame) -> DataFrame:
    """Row integrity, missing values and flag totals of the feature table."""
    flags = _present(features, (
        "IS_COMPLETED", "NO_PAYMENT_RECORD", "MULTIPLE_PAYMENTS", "MULTIPLE_VENDORS",
        "PAYMENT_COUNT_GE_5", "PAYMENT_COUNT_GE_10", "VENDOR_COUNT_GE_5", "VENDOR_COUNT_GE_10",
        "NEGATIVE_RECOMMENDATION_TO_SANCTION", "NEGATIVE_SANCTION_TO_PAYMENT",
        "COMPLETION_BEFORE_LAST_PAYMENT", "ACTUAL_ABOVE_SANCTION", "DISBURSED_ABOVE_SANCTION",
        "SANCTION_ABOVE_2X_PEER_MEDIAN", "SANCTION_ABOVE_5X_PEER_MEDIAN",
        "AVERAGE_PAYMENT_ABOVE_1M", "TOTAL_DISBURSED_ABOVE_5M",
    ))
    doubles = [f.name for f in features.schema.fields if isinstance(f.dataType, T.DoubleType)]
    infinite = F.lit(0)
    for c in doubles:
        infinite = infinite + F.count_if(F.abs(F.col(c)) == float("inf"))
    peers = F.col("PEER_COUNT")
    return stack_reports({
        "KEYS": _key_metrics(features, "WORK_ID"),
        "FLAGS": metric_rows(features, {c: F.sum(c) for c in flags}),
        "VALUES": metric_rows(features, {
            "INFINITE_VALUES": infinite,
            "SUFFICIENT_PEERS": F.count_if(peers >= 10), "SPARSE_PEERS": F.count_if(peers < 10),
            "MAX_MISSING_FIELDS": F.max("MISSING_FIELD_COUNT"),
        }),
    })


def audit_spending_features(features: DataFrame) -> DataFrame:
    """First-generation feature audit: timelines, ratios, consistency and flags."""
    timelines = ("RECOMMENDATION_TO_SANCTION_DAYS", "SANCTION_TO_COMPLETION_DAYS",
                 "RECOMMENDATION_TO_COMPLETION_DAYS")
    flags = ("MULTIPLE_VENDOR_FLAG", "MULTIPLE_TRANSACTION_FLAG", "ACTUAL_EXCEEDS_SANCTION_FLAG",
             "DISBURSEMENT_EXCEEDS_SANCTION_FLAG", "NEGATIVE_TIMELINE_FLAG")
    a, s, r, d = (F.col(c) for c in ("ACTUAL_AMOUNT", "SANCTION_AMOUNT", "RECOMMENDED_AMOUNT",
                                     "TOTAL_DISBURSED"))
    return stack_reports({
        "TIMELINE": metric_rows(
            features, {f"{c}_NEGATIVE": F.count_if(F.col(c) < 0) for c in timelines}
        ),
        "CONSISTENCY": metric_rows(features, {
            "ACTUAL_ABOVE_SANCTION": F.count_if(a > s), "DISBURSED_ABOVE_SANCTION": F.count_if(d > s),
            "SANCTION_BELOW_RECOMMENDED": F.count_if(s < r), "NEGATIVE_SANCTION": F.count_if(s < 0),
            "NEGATIVE_ACTUAL": F.count_if(a < 0), "NEGATIVE_DISBURSEMENT": F.count_if(d < 0),
        }),
        "FLAGS": metric_rows(features, {c: F.sum(c) for c in flags}),
    })


# Ratios that the first-generation feature audit looks at.
AUDIT_RATIOS = ("RECOMMENDATION_TO_SANCTION_RATIO", "ACTUAL_TO_SANCTION_RATIO",
                "DISBURSEMENT_TO_SANCTION_RATIO", "COST_VS_PEER_MEDIAN")


def audit_feature_values(
    features: DataFrame, columns: Sequence[str] | None = None, ratios: Sequence[str] = AUDIT_RATIOS
) -> DataFrame:
    """SECTION, METRIC, VALUE: missing values of each column that has some, infinite
    values of each that has some, and the bands of the ratios that are there. Counts of
    all columns come from one pass."""
    columns = list(columns or features.columns)
    floating = [c for c in columns if isinstance(features.schema[c].dataType, (T.DoubleType, T.FloatType))]
    infinite = {c: F.count_if(F.abs(F.col(c)) == float("inf")) for c in floating}
    ratios = [c for c in ratios if c in features.columns]
    bands = ratio_bands(features, ratios)
    kinds = ("AVAILABLE", "BELOW_0", "EQUAL_0", "ABOVE_1", "ABOVE_2", "ABOVE_5", "MAXIMUM")
    cells = F.array(*[
        F.struct(F.concat("COLUMN", F.lit(f"_{k}")).alias("METRIC"), F.col(k).cast("double").alias("VALUE"))
        for k in kinds
    ])
    return stack_reports({
        "MISSING": metric_rows(
            features, {c: F.count_if(F.col(c).isNull()) for c in columns}).filter("VALUE > 0"),
        "INFINITE": metric_rows(features, infinite or {"NONE": F.lit(0)}).filter("VALUE > 0"),
        "RATIO": bands.select(F.explode(cells).alias("m")).select("m.*"),
    })


ML_OUTPUT_COLUMNS = (
    "IF_RAW_SCORE", "IF_DECISION_SCORE", "ML_ANOMALY_STRENGTH", "ML_PERCENTILE", "ML_ANOMALY",
    "ML_SEVERITY",
)


def leaked_columns(features: DataFrame) -> list[str]:
    """Model output columns found among the model's inputs (should be none)."""
    return sorted(set(ML_OUTPUT_COLUMNS) & set(features.columns))


def ml_integrity(features: DataFrame, ml: DataFrame) -> DataFrame:
    """CHECK, PASSED rows: ids complete and unique, rows matching, no leakage."""
    missing = [c for c in ("WORK_ID", *ML_OUTPUT_COLUMNS) if c not in ml.columns]
    if missing:
        raise DataGateError(f"ml output: missing required columns {missing}")
    f = key_profile(features, "WORK_ID").select(*[F.col(c).alias(f"F_{c}") for c in
                                                  ("ROWS", "MISSING_KEYS", "UNIQUE_KEYS")])
    m = key_profile(ml, "WORK_ID")
    row = f.select(
        "*", *[m.select(c).scalar().alias(f"M_{c}") for c in ("ROWS", "MISSING_KEYS", "UNIQUE_KEYS")]
    )
    c = F.col
    checks = {
        "Feature WORK_ID complete": c("F_MISSING_KEYS") == 0,
        "Feature WORK_ID unique": c("F_ROWS") == c("F_UNIQUE_KEYS") + c("F_MISSING_KEYS"),
        "ML WORK_ID complete": c("M_MISSING_KEYS") == 0,
        "ML WORK_ID unique": c("M_ROWS") == c("M_UNIQUE_KEYS") + c("M_MISSING_KEYS"),
        "ML rows match feature rows": c("M_ROWS") == c("F_ROWS"),
        "ML WORK_ID count matches feature dataset": c("M_UNIQUE_KEYS") == c("F_UNIQUE_KEYS"),
        "No ML output among features": F.lit(not leaked_columns(features)),
    }
    pairs = F.array(
        *[F.struct(F.lit(k).alias("CHECK"), v.alias("PASSED")) for k, v in checks.items()]
    )
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def final_status(checks: DataFrame) -> DataFrame:
    passed = F.bool_and("PASSED")
    return checks.agg(
        F.count_if("PASSED").alias("PASSED"), F.count_if(~F.col("PASSED")).alias("FAILED"),
        F.when(passed, "PASS").otherwise("REVIEW REQUIRED").alias("STATUS"),
    )


def severity_coverage(ml: DataFrame) -> DataFrame:
    """Severity counts among all works and among anomalies."""
    return ml.groupBy("ML_SEVERITY").agg(
        row_count().alias("WORK_COUNT"), F.coalesce(F.sum("ML_ANOMALY"), F.lit(0)).alias("ANOMALIES")
    )


def ml_validation_summary(hybrid: DataFrame, peer_column: str = "PEER_COUNT") -> DataFrame:
    """Model and overlap metrics with the share of anomalies that have peers."""
    groups = overlap_groups()
    good = F.col(peer_column) >= 10
    weak = F.col(peer_column) < 10
    m = groups["ML"]
    return metric_rows(hybrid, {
        "ML_ROWS": row_count(), "ML_ANOMALY_COUNT": F.count_if(m),
        "ML_ANOMALY_RATE_PERCENT": round_even(percent(F.count_if(m), row_count()), 4),
        "RULE_CANDIDATE_COUNT": F.count_if(groups["RULE"]),
        "STATISTICAL_CANDIDATE_COUNT": F.count_if(groups["STATISTICAL"]),
        "ML_RULE_OVERLAP": F.count_if(groups["ML_AND_RULE"]),
        "ML_STATISTICAL_OVERLAP": F.count_if(groups["ML_AND_STATISTICAL"]),
        "ALL_THREE_OVERLAP": F.count_if(groups["ALL_THREE"]),
        "ML_ONLY": F.count_if(groups["ML_ONLY"]), "RULE_ONLY": F.count_if(groups["RULE_ONLY"]),
        "STATISTICAL_ONLY": F.count_if(groups["STATISTICAL_ONLY"]),
        "NO_DETECTOR": F.count_if(groups["NONE"]),
        "WORKS_PEER_GE_10": F.count_if(good), "WORKS_PEER_LT_10": F.count_if(weak),
        "ML_ANOMALIES_PEER_GE_10": F.count_if(m & good),
        "ML_ANOMALIES_PEER_LT_10": F.count_if(m & weak),
        "WEAK_PEER_ANOMALY_PERCENT": percent(F.count_if(m & weak), F.count_if(m)),
    })
