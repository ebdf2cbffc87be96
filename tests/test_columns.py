"""Grouped two-pass quantiles against pandas."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from civitally.operators import columns, reports

PROBS, NAMES = [0.0, 0.5, 0.95, 1.0], ["LOW", "MID", "P95", "HIGH"]


def rows_of(seed, n=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        crowded = 1.0 + rng.randrange(50) * 1e-12
        wide = rng.choice([None, float("nan"), -0.0, 0.0, rng.uniform(-1e9, 1e9), 10 ** rng.uniform(-300, 300)])
        out.append((rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 1, None]),
                    crowded, wide, rng.randrange(5), None))
    return out


SCHEMA = "g string, h int, crowded double, wide double, few int, none double"


def expected(rows, by):
    frame = pd.DataFrame(rows, columns=["g", "h", "crowded", "wide", "few", "none"])
    out = {}
    groups = frame.groupby(by, dropna=False) if by else [((), frame)]
    for key, part in groups:
        key = tuple(None if pd.isna(k) else k for k in key)
        for c in ("crowded", "wide", "few", "none"):
            v = part[c].astype(float).to_numpy()
            v = v[np.isfinite(v)]
            if len(v):
                std = v.std(ddof=1) if len(v) > 1 else None
                out[key, c] = [len(v), v.mean(), std, *np.quantile(v, PROBS)]
    return out


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
@pytest.mark.parametrize("most", [100_000, 3])
def test_against_pandas(spark, by, most):
    rows = rows_of(len(by))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    table = columns.grouped_column_profile(
        df, ["crowded", "wide", "few", "none"], by, PROBS, NAMES, most_in_bin=most)
    got = {(tuple(r[c] for c in by), r["COLUMN"]): list(r[len(by) + 1:]) for r in table.collect()}
    want = expected(rows, by)
    assert got.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-4), (key, got[key], values)


def test_no_row_for_each_value(spark):
    df = spark.createDataFrame(rows_of(5), SCHEMA).filter("h is not null").withColumnRenamed("h", "ML_ANOMALY")
    table = reports.feature_comparison(df, ["crowded", "wide", "few"], min_side=1)
    assert "Generate" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert {r["FEATURE"] for r in table.collect()} == {"crowded", "wide", "few"}


def test_many_groups_take_the_other_way(spark):
    df = spark.createDataFrame(rows_of(6), SCHEMA).fillna({"h": 7})
    assert columns.grouped_column_profile(df, ["few"], ["h"], [0.5], ["MID"], most_targets=2) is None
    near = reports._feature_profile(df, ["few", "crowded"], ["h"], [0.5], ["MID"], reports.Skew())
    keep, columns_profile = reports.grouped_column_profile, None
    try:
        reports.grouped_column_profile = lambda *a, **k: columns_profile
        far = reports._feature_profile(df, ["few", "crowded"], ["h"], [0.5], ["MID"], reports.Skew())
    finally:
        reports.grouped_column_profile = keep
    pick = lambda t: sorted((r["h"], r["FEATURE"], r["N"], r["MID"], round(r["STD"], 9))
                            for r in t.collect())
    assert pick(near) == pick(far)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert columns.grouped_column_profile(empty, ["few"], ["g"], PROBS, NAMES).count() == 0
    assert columns.grouped_column_profile(empty, ["few"], [], PROBS, NAMES).count() == 0
