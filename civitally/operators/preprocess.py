"""Model inputs as a stored, versioned table: which features are there, what their values
are like, and the medians and quartiles that scaling uses.

``fit_inputs`` makes it in one pass over the values and the two of the quantiles,
``require_inputs`` is the gate before a model is fitted or applied, ``robust_scale``
applies it, ``save_inputs`` and ``load_inputs`` keep its versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .cleaning import DataGateError
from .columns import column_quantiles

SCHEMA = ("POSITION int, FEATURE string, PRESENT boolean, N bigint, MISSING bigint, NONFINITE bigint, "
          "MEDIAN double, Q1 double, Q3 double, IQR double")


def _usable(value: Column) -> Column:
    """The value if it is finite, NaN too is not."""
    return F.when(~F.isnan(value), finite(value))


def fit_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row for each feature in its position. N counts finite values, MISSING nulls,
    NONFINITE infinite values and NaN; a feature that ``df`` does not have is not PRESENT."""
    spark, present = df.sparkSession, [c for c in features if c in df.columns]
    listed = spark.createDataFrame(
        [(i, c, c in df.columns) for i, c in enumerate(features)],
        "POSITION int, FEATURE string, PRESENT boolean")
    if not present:
        return listed.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (
            x.split() for x in SCHEMA.split(", ")[3:])])
    number = {c: F.col(c).cast("double") for c in present}
    found = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("FEATURE"), F.count(_usable(v)).alias("N"), F.count_if(v.isNull()).alias("MISSING"),
            F.count_if(v.isNotNull() & _usable(v).isNull()).alias("NONFINITE"))
        for c, v in number.items()
    ]).alias("f")).select(F.explode("f").alias("f")).select("f.*")
    quartiles = column_quantiles(df, present, [0.25, 0.5, 0.75], ["Q1", "MEDIAN", "Q3"]).select(
        F.col("COLUMN").alias("FEATURE"), "MEDIAN", "Q1", "Q3", (F.col("Q3") - F.col("Q1")).alias("IQR"))
    # one row for each feature in every table
    return listed.join(found, "FEATURE", "left").join(quartiles, "FEATURE", "left").select(
        *[x.split()[0] for x in SCHEMA.split(", ")])


def missing_features(inputs: DataFrame) -> list[str]:
    return [r["FEATURE"] for r in inputs.filter(~F.col("PRESENT")).orderBy("POSITION").collect()]


def require_inputs(inputs: DataFrame, minimum: int = 5, known: DataFrame | None = None) -> DataFrame:
    """``inputs`` if a model can use them: at least ``minimum`` features are there, none
    holds infinite values or NaN, and those that ``known`` (the inputs of a fitted
    model) lists as there are there now."""
    rows = inputs.collect()
    there = {r["FEATURE"] for r in rows if r["PRESENT"]}
    if len(there) < minimum:
        raise DataGateError(f"only {len(there)} model features present")
    wrong = {r["FEATURE"]: r["NONFINITE"] for r in rows if r["NONFINITE"]}
    if wrong:
        raise DataGateError(f"non-finite model values: {wrong}")
    if known is not None:
        gone = sorted({r["FEATURE"] for r in known.filter("PRESENT").collect()} - there)
        if gone:
            raise DataGateError(f"model features gone since the fit: {gone}")
    return inputs


def scaled(c: str, median: float | None, iqr: float | None) -> Column:
    """(value or median - median) / IQR; an IQR of zero leaves the difference as it is."""
    if median is None:
        return F.lit(0.0)
    value = F.coalesce(_usable(F.col(c).cast("double")), F.lit(median))
    return (value - F.lit(median)) / F.lit(iqr or 1.0)


def robust_scale(df: DataFrame, inputs: DataFrame, key: str = "WORK_ID") -> DataFrame:
    """``key`` and every present feature, missing values at the median, scaled. A feature
    without values is 0 everywhere."""
    rows = inputs.filter("PRESENT").orderBy("POSITION").collect()
    return df.select(key, *[scaled(r["FEATURE"], r["MEDIAN"], r["IQR"]).alias(r["FEATURE"]) for r in rows])


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def save_inputs(inputs: DataFrame, path: str) -> int:
    """Write the next version and return its number; earlier ones stay."""
    version = max(_versions(inputs.sparkSession, path), default=0) + 1
    inputs.coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def load_inputs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    known = _versions(spark, path)
    if not known or version is not None and version not in known:
        raise DataGateError(f"no version {version or ''} of the model inputs in {path}")
    return spark.read.parquet(f"{path}/version={version or known[-1]}")
