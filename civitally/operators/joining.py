"""Joins between pipeline layers; all of them are equi-joins on the work id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleaning import require_unique_key


def one_to_one(
    left: DataFrame, right: DataFrame, key: str = "WORK_ID", *, checked: bool = False
) -> DataFrame:
    """Left join of two tables that are unique on ``key``.

    ``checked=True`` verifies uniqueness first, which costs one pass per side.
    Sides built by a groupBy on the key need no check, and the plans check the
    tables they are given (``require_unique_keys``) before they get here.
    """
    if checked:
        require_unique_key(left, key, "left side")
        require_unique_key(right, key, "right side")
    return left.join(right, key, "left")


def join_new_columns(left: DataFrame, right: DataFrame, key: str = "WORK_ID") -> DataFrame:
    """Left join that brings only columns the left side does not have."""
    fresh = [c for c in right.columns if c != key and c not in left.columns]
    return left.join(right.select(key, *fresh), key, "left")


def join_with_suffix(
    left: DataFrame, right: DataFrame, key: str, suffix: str, how: str = "left"
) -> DataFrame:
    """Join that renames clashing right-hand columns."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c != key and c in left.columns}
    return left.join(right.withColumnsRenamed(clash), key, how)


def membership_flags(
    rows: DataFrame, key: str, category: str, flags: dict[str, str]
) -> DataFrame:
    """Per key 0/1 flags telling which category values occur."""
    return rows.groupBy(key).agg(
        *[
            F.max((F.col(category) == value).cast("int")).alias(name)
            for name, value in flags.items()
        ]
    )


def join_detectors(
    base: DataFrame, rules: DataFrame, stats: DataFrame, ml: DataFrame | None = None
) -> DataFrame:
    """Attach separately stored detector outputs to all works.

    Works absent from a detector table get score 0, flag 0 and severity NONE.
    """
    def part(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "WORK_ID", f"{prefix}_CANDIDATE", f"{prefix}_SCORE", f"{prefix}_SEVERITY"
        )

    out = base if ml is None else base.join(ml, "WORK_ID", "left")
    for df, prefix in ((rules, "RULE"), (stats, "STAT")):
        out = out.drop(f"{prefix}_CANDIDATE", f"{prefix}_SCORE", f"{prefix}_SEVERITY")
        out = out.join(part(df, prefix), "WORK_ID", "left").withColumns(
            {
                f"{prefix}_CANDIDATE": F.coalesce(F.col(f"{prefix}_CANDIDATE"), F.lit(0)),
                f"{prefix}_SCORE": F.coalesce(F.col(f"{prefix}_SCORE"), F.lit(0)),
                f"{prefix}_SEVERITY": F.coalesce(F.col(f"{prefix}_SEVERITY"), F.lit("NONE")),
            }
        )
    return out


def lookup(df: DataFrame, key: str, values: Sequence[object]) -> DataFrame:
    """Point lookup; the predicate reaches the Parquet scan."""
    return df.filter(F.col(key).isin(list(values)))
