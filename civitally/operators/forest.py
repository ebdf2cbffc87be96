"""Isolation forest detector (Liu, Ting and Zhou, 2008) on Spark.

Every tree sees a small sample chosen by hashing work ids, trees are grown in
parallel, and the forest - at most ``trees * (2 * sample - 1)`` nodes whatever
the data size - is broadcast to score all works in Arrow batches.

Whatever is drawn - a tree's works and features, a split's feature and threshold -
is a hash of the seed and of what it is drawn for, and leaf lengths are multiples of
2**-32, so sums do not depend on order. A recursive SQL query can follow all of it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ForestConfig, Skew
from ..functions.scalar import finite, round_even
from .cleaning import DataGateError
from .columns import column_quantiles
from .ranking import grouped_quantiles, percent_rank_of

# Measurements of a work that may enter the model.
CORE_FEATURES = (
    "RECOMMENDED_AMOUNT", "SANCTION_AMOUNT", "TOTAL_FUND_DISBURSED_AMT", "ACTUAL_AMOUNT",
    "DISBURSED_TO_SANCTION_RATIO", "REMAINING_SANCTION_AMOUNT", "ACTUAL_TO_SANCTION_RATIO",
    "ACTUAL_TO_RECOMMENDED_RATIO", "ACTUAL_VS_DISBURSED_RATIO", "DISBURSED_TO_RECOMMENDED_RATIO",
    "REMAINING_SANCTION_RATIO", "ACTUAL_MINUS_SANCTION", "ACTUAL_MINUS_DISBURSED",
    "DISBURSED_MINUS_ACTUAL", "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "UNIQUE_VENDOR_NAME_COUNT",
    "PAYMENT_SUCCESS_COUNT", "PAYMENT_IN_PROGRESS_COUNT", "PAYMENTS_PER_100_DAYS",
    "PAYMENTS_PER_30_DAYS", "AVERAGE_PAYMENT_AMOUNT", "PAYMENT_SUCCESS_RATIO",
    "PAYMENT_IN_PROGRESS_RATIO", "PAYMENTS_PER_VENDOR", "EXPENDITURE_DURATION_DAYS",
    "RECOMMENDATION_TO_SANCTION_DAYS", "SANCTION_TO_FIRST_PAYMENT_DAYS",
    "RECOMMENDATION_TO_FIRST_PAYMENT_DAYS", "LAST_PAYMENT_TO_COMPLETION_DAYS",
    "RECOMMENDATION_TO_COMPLETION_DAYS", "SANCTION_TO_COMPLETION_DAYS",
    "COMPLETION_DURATION_DAYS", "DISBURSED_PER_EXPENDITURE_DAY",
    "PAYMENT_AFTER_REPORTED_COMPLETION_DAYS", "IS_COMPLETED", "HAS_ACTUAL_AMOUNT",
    "HAS_ACTUAL_END_DATE", "NO_PAYMENT_RECORD", "MISSING_FIELD_COUNT", "DATA_COMPLETENESS_RATIO",
    "COMPLETION_BEFORE_LAST_PAYMENT", "ATTACH_ID", "FLAG", "PEER_COUNT",
)
PEER_RELATIVE = (
    "PEER_MEDIAN_SANCTION", "PEER_MEAN_SANCTION", "PEER_STD_SANCTION", "PEER_MEDIAN_DISBURSED",
    "SANCTION_TO_PEER_MEDIAN", "SANCTION_PEER_Z_SCORE", "ABS_PEER_COST_Z_SCORE",
)
IDENTIFIERS = ("WORK_ID", "STATE_ID", "CONSTITUENCY_ID", "MP_ID")
DETECTOR_PREFIXES = ("RULE_", "STAT_", "ML_", "IF_")
ADMINISTRATIVE = (
    "STATE_WORK_COUNT", "MP_WORK_COUNT", "CONSTITUENCY_WORK_COUNT", "CATEGORY_WORK_COUNT",
    "ACTIVITY_WORK_COUNT",
)
ADMINISTRATIVE_PREFIXES = ("STATE_TOTAL_", "MP_TOTAL_", "CONSTITUENCY_TOTAL_")
RULE_DERIVED = (
    "SANCTION_ABOVE_2X_PEER_MEDIAN", "SANCTION_ABOVE_5X_PEER_MEDIAN", "AVERAGE_PAYMENT_ABOVE_1M",
    "TOTAL_DISBURSED_ABOVE_5M", "PAYMENT_COUNT_GE_5", "PAYMENT_COUNT_GE_10", "VENDOR_COUNT_GE_5",
    "VENDOR_COUNT_GE_10",
)
CALENDAR = (
    "RECOMMENDATION_YEAR", "RECOMMENDATION_MONTH", "SANCTION_YEAR", "FIRST_PAYMENT_YEAR",
    "COMPLETION_YEAR",
)
# First-generation model inputs, in the names this engine uses.
AUDIT_FEATURES = (
    "RECOMMENDED_AMOUNT", "SANCTION_AMOUNT", "ACTUAL_AMOUNT", "TOTAL_DISBURSED",
    "DISBURSEMENT_COUNT", "ACTUAL_TO_SANCTION_RATIO", "DISBURSEMENT_TO_SANCTION_RATIO",
    "COST_VS_PEER_MEDIAN", "COST_VS_PEER_MEAN", "COST_VS_PEER_STD", "COST_Z_SCORE",
    "RECOMMENDATION_TO_SANCTION_DAYS", "SANCTION_TO_COMPLETION_DAYS",
    "RECOMMENDATION_TO_COMPLETION_DAYS", "TRANSACTION_COUNT", "VENDOR_COUNT",
    "AVERAGE_TRANSACTION_AMOUNT", "MAX_TRANSACTION_AMOUNT", "MIN_TRANSACTION_AMOUNT",
    "TRANSACTION_AMOUNT_STD", "TRANSACTION_AMOUNT_VARIATION", "LOG_SANCTION_AMOUNT",
    "LOG_ACTUAL_AMOUNT", "LOG_TOTAL_DISBURSED", "DATA_COMPLETENESS_SCORE",
)
SEED_SPACE = 2**31
DRAWS = 2**48
LENGTH_STEPS = 2.0**32


def classify_columns(df: DataFrame) -> dict[str, str]:
    """Why each numeric column is used by or kept out of the model."""
    out = {}
    for f in df.schema.fields:
        if not isinstance(f.dataType, T.NumericType):
            continue
        name = f.name
        if name in IDENTIFIERS:
            out[name] = "identifier"
        elif name.startswith(DETECTOR_PREFIXES):
            out[name] = "detector"
        elif name in ADMINISTRATIVE or name.startswith(ADMINISTRATIVE_PREFIXES):
            out[name] = "administrative"
        elif name in RULE_DERIVED:
            out[name] = "rule_derived"
        elif name in CALENDAR:
            out[name] = "calendar"
        else:
            out[name] = "selected" if name in CORE_FEATURES else "other"
    return out


def model_features(df: DataFrame) -> list[str]:
    chosen = [c for c, why in classify_columns(df).items() if why == "selected"]
    if not chosen:
        raise DataGateError("no usable model features")
    return chosen


def audit_features(df: DataFrame, minimum: int = 5) -> tuple[list[str], list[str]]:
    """(present, missing) first-generation features; too few is an error."""
    present = [c for c in AUDIT_FEATURES if c in df.columns]
    if len(present) < minimum:
        raise DataGateError(f"only {len(present)} model features present")
    return present, [c for c in AUDIT_FEATURES if c not in df.columns]


def _numeric(c: str) -> Column:
    return finite(F.col(c).cast("double"))


def feature_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """FEATURE, VALUES_SEEN (0, 1, 2 or 3 = more than two distinct values).

    Two passes of plain min/max aggregates instead of one distinct count per
    feature.
    """
    ends = df.agg(
        *[F.min(_numeric(c)).alias(f"lo_{i}") for i, c in enumerate(features)],
        *[F.max(_numeric(c)).alias(f"hi_{i}") for i, c in enumerate(features)],
    ).first()
    between = []
    for i, c in enumerate(features):
        lo, hi = ends[f"lo_{i}"], ends[f"hi_{i}"]
        inner = F.lit(0) if lo is None else F.count_if((_numeric(c) > lo) & (_numeric(c) < hi))
        base = 0 if lo is None else (1 if lo == hi else 2)
        between.append(
            F.struct(
                F.lit(c).alias("FEATURE"),
                (F.lit(base) + F.when(inner > 0, 1).otherwise(0)).alias("VALUES_SEEN"),
            )
        )
    return df.agg(F.array(*between).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def mask_weak_peers(df: DataFrame, min_peers: int = 10) -> DataFrame:
    """Peer-relative columns become NULL where the group is too small."""
    columns = {c: F.when(~(F.col("PEER_COUNT") < min_peers), F.col(c))
               for c in PEER_RELATIVE if c in df.columns}
    return df.withColumns(columns) if columns else df


def melt(df: DataFrame, features: Sequence[str], *carry: str) -> DataFrame:
    """FEATURE, VALUE rows of the non-missing values, plus carried columns."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("FEATURE"), _numeric(c).alias("VALUE")) for c in features]
    )
    return (
        df.select(*carry, F.explode(pairs).alias("p"))
        .select(*carry, "p.FEATURE", "p.VALUE")
        .filter(F.col("VALUE").isNotNull())
    )


def feature_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """FEATURE, N, LOWEST, HIGHEST and the exact MEDIAN of every feature."""
    return column_quantiles(df, list(features), [0.5], ["MEDIAN"]).withColumnRenamed(
        "COLUMN", "FEATURE"
    )


def feature_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Imputer table: FEATURE, MEDIAN."""
    return feature_profile(df, features).select("FEATURE", "MEDIAN")


def impute(df: DataFrame, features: Sequence[str], medians: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(_numeric(c), F.lit(float(medians[c]))) for c in features}
    )


def require_finite(df: DataFrame, features: Sequence[str]) -> DataFrame:
    bad = df.agg(
        *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c))).alias(c) for c in features]
    ).first()
    wrong = {c: bad[c] for c in features if bad[c]}
    if wrong:
        raise DataGateError(f"non-finite model values: {wrong}")
    return df


def drawn(*parts: object) -> int:
    """A number below ``DRAWS``, fixed by the parts."""
    text = ":".join(map(str, parts))
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:12], 16)


def drawn_column(*parts: Column) -> Column:
    """``drawn`` of columns."""
    text = F.concat_ws(":", *[c.cast("string") for c in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


NODE_SCHEMA = T.StructType(
    [
        T.StructField("TREE", T.IntegerType()),
        T.StructField("NODE", T.IntegerType()),
        T.StructField("FEATURE", T.IntegerType()),
        T.StructField("THRESHOLD", T.DoubleType()),
        T.StructField("LEFT", T.IntegerType()),
        T.StructField("RIGHT", T.IntegerType()),
        T.StructField("DEPTH", T.IntegerType()),
        T.StructField("SIZE", T.IntegerType()),
    ]
)


def grow_tree(
    x: np.ndarray, tree: int, seed: int, depth_limit: int, usable: int, names: Sequence[str]
) -> list[tuple]:
    """Nodes of one isolation tree over the sample ``x``.

    A split takes a random feature that still varies in the node and a uniform
    threshold between its extremes; leaves have FEATURE -1. Draws name a node by its
    path: 1 for the root, twice that for a left child, one more for a right one.
    """
    drawn_first = sorted(range(len(names)), key=lambda j: (drawn(seed, tree, names[j]), names[j]))
    allowed = np.array(sorted(drawn_first[:usable], key=lambda j: names[j]))
    nodes: list[tuple] = []
    todo = [(0, 1, np.arange(len(x)), 0)]
    taken = 1
    while todo:
        node, path, rows, depth = todo.pop()
        part = x[np.ix_(rows, allowed)]
        lo, hi = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if depth >= depth_limit or len(rows) <= 1 or not len(varying):
            nodes.append((tree, node, -1, 0.0, -1, -1, depth, len(rows)))
            continue
        j = varying[drawn(seed, tree, path, "feature") % len(varying)]
        cut = lo[j] + drawn(seed, tree, path, "cut") / DRAWS * (hi[j] - lo[j])
        if not cut < hi[j]:  # rounded up: the largest value would have no side
            cut = lo[j]
        goes_left = part[:, j] <= cut
        left, right = taken, taken + 1
        taken += 2
        nodes.append((tree, node, int(allowed[j]), float(cut), left, right, depth, len(rows)))
        todo.append((right, 2 * path + 1, rows[~goes_left], depth + 1))
        todo.append((left, 2 * path, rows[goes_left], depth + 1))
    return nodes


def tree_samples(
    df: DataFrame, features: Sequence[str], rows: int, config: ForestConfig
) -> DataFrame:
    """(tree, rank, x) rows: each tree's candidates, about 1.5 samples' worth.

    Membership depends on the work id and seed only, so it is the same for every
    partitioning. A work joins ``trees * share`` trees, one more or one fewer by
    its hash: from a hashed first tree on, in hashed steps that are coprime with
    the number of trees, so they are distinct. The rule is the same at any size.
    """
    share = min(1.0, 1.5 * config.sample / max(rows, 1))
    trees, whole = config.trees, math.floor(config.trees * share)
    steps = [s for s in range(1, max(trees, 2)) if math.gcd(s, trees) == 1]

    def draw(salt: int, space: int) -> Column:
        return drawn_column(F.lit(config.seed), F.lit(salt), F.col("WORK_ID")) % F.lit(space)

    more = (draw(0, SEED_SPACE) < F.lit(int((trees * share - whole) * SEED_SPACE))).cast("int")
    joined = df.select(
        "WORK_ID",
        F.array(*[F.col(c) for c in features]).alias("x"),
        (F.lit(whole) + more).alias("_trees"),
        draw(1, trees).alias("_first"),
        F.get(F.array(*[F.lit(s) for s in steps]), draw(2, len(steps)).cast("int")).alias("_step"),
    ).filter("_trees > 0")
    picked = joined.select(
        "WORK_ID", "x", "_first", "_step",
        F.explode(F.sequence(F.lit(0), F.col("_trees") - 1)).alias("_i"),
    ).select(
        F.pmod(F.col("_first") + F.col("_i") * F.col("_step"), F.lit(trees)).cast("int")
        .alias("tree"), "WORK_ID", "x",
    )
    return picked.withColumn(
        "rank", drawn_column(F.lit(config.seed + 1), F.col("tree"), F.col("WORK_ID"))
    )


@dataclass(frozen=True)
class IsolationForest:
    """Fitted forest: node rows, imputer medians and the sample size."""

    features: tuple[str, ...]
    medians: dict[str, float]
    nodes: pd.DataFrame
    sample: int
    config: ForestConfig

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def imputer_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, c, self.medians[c], self.sample) for i, c in enumerate(self.features)],
            "POSITION int, FEATURE string, MEDIAN double, SAMPLE int",
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.node_table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        self.imputer_table(spark).write.mode("overwrite").parquet(f"{path}/imputer")

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: ForestConfig = ForestConfig()):
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        imputer = spark.read.parquet(f"{path}/imputer").orderBy("POSITION").collect()
        return cls(
            tuple(r["FEATURE"] for r in imputer), {r["FEATURE"]: r["MEDIAN"] for r in imputer},
            nodes, imputer[0]["SAMPLE"], config,
        )

    def packed(self) -> tuple[np.ndarray, ...]:
        """Nodes as flat arrays with global child positions and leaf depths."""
        n = self.nodes.sort_values(["TREE", "NODE"]).reset_index(drop=True)
        start = n.groupby("TREE").NODE.transform("size")
        roots = np.flatnonzero(n.NODE.to_numpy() == 0)
        base = np.repeat(roots, start.to_numpy()[roots])
        leaf = n.FEATURE.to_numpy() < 0
        here = np.arange(len(n))
        left = np.where(leaf, here, base + n.LEFT.to_numpy())
        right = np.where(leaf, here, base + n.RIGHT.to_numpy())
        length = np.where(leaf, n.DEPTH.to_numpy() + average_path(n.SIZE.to_numpy()), 0.0)
        length = np.rint(length * LENGTH_STEPS) / LENGTH_STEPS
        feature = np.where(leaf, 0, n.FEATURE.to_numpy())
        return roots, feature, n.THRESHOLD.to_numpy(), left, right, length, int(n.DEPTH.max())

    def strength(self, df: DataFrame, out: str = "ML_ANOMALY_STRENGTH") -> DataFrame:
        """(WORK_ID, strength): 2 ** (-mean path / expected path), 0..1."""
        packed = self.packed()  # a few MB at most, sent with the function
        features, normal = list(self.features), float(average_path(float(self.sample)))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            roots, feature, threshold, left, right, length, depth = packed
            for batch in batches:
                x = batch[features].to_numpy(dtype=float)
                mean = np.zeros(len(x))
                rows = np.arange(len(x))
                for root in roots:
                    at = np.full(len(x), root)
                    for _ in range(depth):
                        at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                    mean += length[at]
                strength = np.exp2(-(mean / len(roots)) / normal)
                yield pd.DataFrame({"WORK_ID": batch["WORK_ID"], out: strength})

        ready = impute(df.select("WORK_ID", *[F.col(c) for c in features]), features, self.medians)
        return ready.mapInPandas(score, f"WORK_ID bigint, {out} double")


def fit_forest(
    df: DataFrame,
    features: Sequence[str] | None = None,
    config: ForestConfig = ForestConfig(),
) -> IsolationForest:
    """Fit on all works. ``df`` should be a settled layer; this runs jobs."""
    features = list(features or model_features(df))
    if config.mask_weak_peers and "PEER_COUNT" in df.columns:
        df = mask_weak_peers(df, config.min_peers)
    profile = {r["FEATURE"]: r for r in feature_profile(df, features).collect()}
    features = [c for c in features if c in profile and profile[c]["LOWEST"] < profile[c]["HIGHEST"]]
    if not features:
        raise DataGateError("every model feature is constant")
    medians = {c: profile[c]["MEDIAN"] for c in features}
    # Values that are not finite are imputed, so the matrix is finite if the medians are.
    wrong = [c for c, m in medians.items() if not math.isfinite(m)]
    if wrong:
        raise DataGateError(f"non-finite model values: {wrong}")
    rows = df.count()
    ready = impute(df.select("WORK_ID", *features), features, medians)
    sample = min(config.sample, rows)
    depth_limit = max(1, math.ceil(math.log2(max(sample, 2))))
    usable = max(1, int(config.max_features * len(features)))
    seed = config.seed

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = pdf.sort_values(["rank", "WORK_ID"]).head(sample)
        x = np.vstack(chosen["x"].to_numpy())
        nodes = grow_tree(x, int(pdf["tree"].iloc[0]), seed, depth_limit, usable, features)
        return pd.DataFrame(nodes, columns=[f.name for f in NODE_SCHEMA.fields])

    grown = tree_samples(ready, features, rows, config).groupBy("tree").applyInPandas(
        grow, NODE_SCHEMA
    )
    return IsolationForest(tuple(features), medians, grown.toPandas(), sample, config)


def ml_severity(percentile: Column) -> Column:
    return (
        F.when(percentile >= 99, "HIGH").when(percentile >= 97.5, "MEDIUM")
        .when(percentile >= 95, "LOW").otherwise("NONE")
    )


def strength_cutoff(
    strengths: DataFrame, contamination: float | str, skew: Skew = Skew()
) -> float:
    """Strength above which a work is an anomaly; 0.5 in automatic mode."""
    if contamination == "auto":
        return 0.5
    row = grouped_quantiles(
        strengths.withColumn("_all", F.lit(1)), ["_all"],
        {"s": ("ML_ANOMALY_STRENGTH", [1.0 - float(contamination)], ["CUT"])}, skew=skew,
    ).first()
    return float(row["CUT"])


def score_forest(
    df: DataFrame, forest: IsolationForest, skew: Skew = Skew(), *, store=None
) -> DataFrame:
    """Scores, percentile, anomaly flag and severity of every work.

    ``store`` settles the strengths, which the percentile rank reads twice.
    """
    if forest.config.mask_weak_peers and "PEER_COUNT" in df.columns:
        df = mask_weak_peers(df, forest.config.min_peers)
    strengths = forest.strength(df)
    if store is not None:
        strengths = store(strengths, "ml_strength")
    cut = strength_cutoff(strengths, forest.config.contamination, skew)
    ranked = percent_rank_of(
        strengths, "ML_ANOMALY_STRENGTH", "ML_PERCENTILE", spread="WORK_ID", skew=skew,
        store=store,
    )
    strength = F.col("ML_ANOMALY_STRENGTH")
    return ranked.select(
        "WORK_ID",
        (-strength).alias("IF_RAW_SCORE"),
        (F.lit(cut) - strength).alias("IF_DECISION_SCORE"),
        "ML_ANOMALY_STRENGTH",
        "ML_PERCENTILE",
        (strength > cut).cast("int").alias("ML_ANOMALY"),
        ml_severity(F.col("ML_PERCENTILE")).alias("ML_SEVERITY"),
    )


def score_audit_forest(df: DataFrame, forest: IsolationForest, *, store=None) -> DataFrame:
    """First-generation scores: decision strength scaled to 0..100, level, reason."""
    strengths = forest.strength(df)
    if store is not None:
        strengths = store(strengths, "audit_strength")
    cut = strength_cutoff(strengths, forest.config.contamination)
    ends = strengths.agg(
        F.struct(
            F.min("ML_ANOMALY_STRENGTH").alias("lo"), F.max("ML_ANOMALY_STRENGTH").alias("hi")
        )
    ).scalar()
    s = F.col("ML_ANOMALY_STRENGTH")
    scaled = F.when(
        F.col("_e.hi") > F.col("_e.lo"),
        (s - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo")) * 100.0,
    ).otherwise(F.lit(0.0))
    scored = strengths.withColumn("_e", ends).select(
        "WORK_ID",
        F.when(s > cut, -1).otherwise(1).alias("ISOLATION_FOREST_PREDICTION"),
        round_even(F.lit(cut) - s, 6).alias("ISOLATION_FOREST_DECISION_SCORE"),
        round_even(scaled, 2).alias("ISOLATION_FOREST_SCORE"),
        (s > cut).alias("ISOLATION_FOREST_ANOMALY_FLAG"),
    )
    score = F.col("ISOLATION_FOREST_SCORE")

    def band(critical: str, high: str, medium: str, low: str) -> Column:
        return (
            F.when(score >= 80, critical).when(score >= 60, high).when(score >= 40, medium)
            .otherwise(low)
        )

    return scored.withColumns(
        {
            "ISOLATION_FOREST_RISK_LEVEL": band("CRITICAL", "HIGH", "MEDIUM", "LOW"),
            # Wording of the model reason.
            "ISOLATION_FOREST_REASON": band(
                "Isolation Forest identified the work as highly unusual compared with the overall "
                "feature distribution",
                "Isolation Forest identified the work as unusually different from typical works",
                "Isolation Forest identified moderate deviation from typical work patterns",
                "No strong Isolation Forest anomaly detected",
            ),
        }
    )
