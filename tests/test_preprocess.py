"""Model inputs: report, gate, scaling, versions; the row-count gate of the plan."""

import math

import numpy as np
import pytest

from checks.context import Context
from civitally.operators import preprocess, reports
from civitally.operators.cleaning import DataGateError

FEATURES = ("a", "gone", "b", "flat", "void")


def table(spark, bad=()):
    rows = [(i, float(i), None if i % 4 else i * 3, 5.0, None) for i in range(41)]
    return spark.createDataFrame(rows + list(bad), "WORK_ID long, a double, b long, flat double, void double")


def test_report(spark):
    bad = [(90, float("inf"), 1, 5.0, None), (91, float("nan"), 2, 5.0, None)]
    got = {r["FEATURE"]: r for r in preprocess.fit_inputs(table(spark, bad), FEATURES).collect()}
    assert [got[c]["POSITION"] for c in FEATURES] == list(range(5))
    a, gone, void = got["a"], got["gone"], got["void"]
    assert (a["PRESENT"], a["N"], a["MISSING"], a["NONFINITE"], a["MEDIAN"], a["IQR"]) == (True, 41, 0, 2, 20.0, 20.0)
    assert not gone["PRESENT"] and gone["N"] is None and got["b"]["MISSING"] == 30
    assert void["PRESENT"] and void["N"] == 0 and void["MEDIAN"] is None
    assert preprocess.missing_features(preprocess.fit_inputs(table(spark), FEATURES)) == ["gone"]


def test_gate(spark):
    good = preprocess.fit_inputs(table(spark), FEATURES)
    assert preprocess.require_inputs(good, minimum=4) is good
    with pytest.raises(DataGateError, match="only 4"):
        preprocess.require_inputs(good)
    with pytest.raises(DataGateError, match="non-finite.*'a': 1"):
        preprocess.require_inputs(
            preprocess.fit_inputs(table(spark, [(90, float("-inf"), 1, 5.0, None)]), FEATURES), minimum=1)
    with pytest.raises(DataGateError, match="gone since the fit: \\['b'\\]"):
        preprocess.require_inputs(
            preprocess.fit_inputs(table(spark).drop("b"), FEATURES), minimum=1, known=good)
    with pytest.raises(DataGateError, match="only 0"):
        preprocess.require_inputs(preprocess.fit_inputs(table(spark), ["x", "y"]))


def test_scaling(spark):
    df = table(spark)
    inputs = preprocess.fit_inputs(df, FEATURES)
    got = preprocess.robust_scale(df, inputs).toPandas().sort_values("WORK_ID")
    frame = df.toPandas().sort_values("WORK_ID")
    assert list(got.columns) == ["WORK_ID", "a", "b", "flat", "void"]
    for c in ("a", "b"):
        filled = frame[c].fillna(frame[c].median())
        spread = frame[c].quantile(0.75) - frame[c].quantile(0.25)
        assert np.allclose(got[c], (filled - frame[c].median()) / spread)
    assert (got["flat"] == 0).all() and (got["void"] == 0).all()


def test_versions(spark, tmp_path):
    path = str(tmp_path / "inputs")
    with pytest.raises(DataGateError):
        preprocess.load_inputs(spark, path)
    first = preprocess.fit_inputs(table(spark), FEATURES)
    second = preprocess.fit_inputs(table(spark).filter("WORK_ID < 11"), FEATURES)
    assert [preprocess.save_inputs(t, path) for t in (first, second)] == [1, 2]
    median = lambda t: t.filter("FEATURE = 'a'").first()["MEDIAN"]
    assert median(preprocess.load_inputs(spark, path)) == 5.0
    assert median(preprocess.load_inputs(spark, path, 1)) == 20.0
    with pytest.raises(DataGateError):
        preprocess.load_inputs(spark, path, 3)


def test_audit_of_values(spark):
    df = table(spark, [(90, math.inf, -1, None, None)]).withColumnRenamed("a", "COST_VS_PEER_MEDIAN")
    got = {(r["SECTION"], r["METRIC"]): r["VALUE"] for r in reports.audit_feature_values(df).collect()}
    assert got["MISSING", "void"] == 42 and got["MISSING", "flat"] == 1 and ("MISSING", "WORK_ID") not in got
    assert got["INFINITE", "COST_VS_PEER_MEDIAN"] == 1 and ("INFINITE", "flat") not in got
    assert got["RATIO", "COST_VS_PEER_MEDIAN_ABOVE_5"] == 36 and got["RATIO", "COST_VS_PEER_MEDIAN_EQUAL_0"] == 1


def test_a_fan_out_stops_the_plan(spark, small_dir):
    plan = Context(spark, small_dir).plan
    ml = plan.detected.selectExpr("WORK_ID", "0 as ML_ANOMALY", "1.0 as ML_PERCENTILE", "'NONE' as ML_SEVERITY")
    plan.__dict__["ml"] = ml.unionByName(ml.limit(1))
    with pytest.raises(DataGateError, match="hybrid risk: row count changed"):
        plan.hybrid
    plan.__dict__["ml"] = ml
    assert plan.hybrid.count() == ml.count()
