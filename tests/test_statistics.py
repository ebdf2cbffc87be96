import numpy as np
import pytest
from pyspark.sql import functions as F

from civitally.config import Skew
from civitally.operators import features, statistics


def brute_force(values):
    out = []
    for i, x in enumerate(values):
        others = np.array([v for j, v in enumerate(values) if j != i and v is not None])
        if x is None or len(others) < 10:
            out.append((None,) * 3)
        else:
            out.append(tuple(np.percentile(others, [25, 50, 75])))
    return out


@pytest.mark.parametrize("skew", [Skew(), Skew(hot_rows=9, bin_bits=6)])
def test_leave_one_out_equals_brute_force(spark, skew):
    rng = np.random.default_rng(5)
    groups = {}
    for g, n in enumerate([1, 10, 11, 12, 13, 40, 57]):
        values = [float(v) for v in rng.integers(1, 30, n) * 1000]
        values[0] = None if n > 12 else values[0]
        groups[f"S{g}"] = values
    rows, want, i = [], {}, 0
    for g, values in groups.items():
        for value, expected in zip(values, brute_force(values)):
            rows.append((i, g, "c", "a", value))
            want[i] = expected
            i += 1
    df = spark.createDataFrame(rows, "WORK_ID long, STATE_NAME string, WORK_CATEGORY string, ACTIVITY_NAME string, x double")
    df = df.withColumns({
        "SANCTION_AMOUNT": F.col("x").cast("decimal(18,2)"),
        "TOTAL_FUND_DISBURSED_AMT": F.col("x").cast("decimal(28,2)"),
    })
    got = statistics.leave_one_out(features.attach_peers(df, skew=skew)).collect()
    assert len(got) == len(rows)
    for r in got:
        q = (r["STAT_PEER_Q1"], r["STAT_PEER_MEDIAN"], r["STAT_PEER_Q3"])
        expected = want[r["WORK_ID"]]
        if expected[0] is None:
            assert q == (None, None, None), r
        else:
            assert np.allclose(q, expected), r


def test_confidence_bands(spark):
    df = spark.createDataFrame([(30,), (29,), (10,), (9,), (None,)], "n int")
    got = [r[0] for r in df.select(statistics.peer_confidence(F.col("n"))).collect()]
    assert got == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "UNKNOWN"]


def test_thresholds_of_an_empty_measure_flag_nothing(spark):
    schema = ("WORK_ID long, STATE_NAME string, WORK_CATEGORY string, ACTIVITY_NAME string, "
              "SANCTION_AMOUNT decimal(18,2), TOTAL_FUND_DISBURSED_AMT decimal(28,2), PAYMENT_COUNT long, "
              "UNIQUE_VENDOR_COUNT long, PAYMENTS_PER_30_DAYS double, COMPLETION_DURATION_DAYS int, "
              "DATA_COMPLETENESS_RATIO double")
    df = spark.createDataFrame([(1, "s", "c", "a", None, None, None, None, None, None, 0.5)], schema)
    (row,) = statistics.score_statistics(df).collect()
    assert row["STAT_SCORE"] == 0 and row["STAT_SEVERITY"] == "NONE"
    assert row["STAT_LOW_DATA_COMPLETENESS"] == 1 and row["STAT_REASONS"] == ""
