import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civitally.config import Skew
from civitally.operators import ranking

SKEWS = [Skew(), Skew(hot_rows=40, bin_bits=3), Skew(hot_rows=7, bin_bits=10)]


@pytest.fixture(scope="module")
def frame():
    """Half of the rows in one group, ties, missing values, negatives and zeros."""
    rng = np.random.default_rng(3)
    n = 1500
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "g": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 90, n)),
            "v": np.round(rng.normal(20, 60, n), 0),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    pdf.loc[pdf.g == 5, "v"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    out = spark.createDataFrame(frame)
    return out.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("skew", SKEWS)
def test_grouped_quantiles_equal_pandas(df, frame, skew):
    probs = [0.1, 0.25, 0.5, 0.995]
    got = (
        ranking.grouped_quantiles(
            df, ["g"], {"q": ("v", probs, ["a", "b", "c", "d"])}, moments={"s": F.sum("v")}, skew=skew
        )
        .toPandas()
        .sort_values("g")
    )
    want = frame.groupby("g").v.quantile(probs).unstack()
    assert np.allclose(got[["a", "b", "c", "d"]].astype(float), want, equal_nan=True)
    assert list(got.GROUP_ROWS) == list(frame.groupby("g").size())


@pytest.mark.parametrize("skew", SKEWS)
@pytest.mark.parametrize("keys", [["g"], []])
def test_percent_rank_equals_pandas(df, frame, skew, keys):
    got = ranking.percent_rank_of(df, "v", "p", spread="id", keys=keys, skew=skew).toPandas()
    values = frame.groupby("g").v if keys else frame.v
    want = values.rank(pct=True, method="average") * 100
    assert np.allclose(got.sort_values("id").p.astype(float), want, equal_nan=True)
    assert len(got) == len(frame)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_results_do_not_depend_on_partitioning(df, parts):
    skew = Skew(hot_rows=40, bin_bits=3)
    spread = df.repartition(parts)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    a = ranking.percent_rank_of(df, "v", "p", spread="id", keys=["g"], skew=skew)
    b = ranking.percent_rank_of(spread, "v", "p", spread="id", keys=["g"], skew=skew)
    assert rows(a) == rows(b)


def test_attach_keeps_every_row_and_salts_hot_and_null_groups(spark):
    rows = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id")).alias("k")
    )
    stats = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    out = ranking.attach_group_stats(
        rows, stats, ["k"], size="n", spread="id", source=rows, skew=Skew(hot_rows=20)
    )
    got = out.groupBy("n").count().orderBy("n").collect()
    assert [(r["n"], r["count"]) for r in got] == [(None, 334), (1, 333), (333, 333)]


def test_hot_list_is_bounded(spark):
    rows = spark.range(1000).select((F.col("id") % 4).alias("k"))
    assert ranking.hot_keys(rows, ["k"], Skew(hot_rows=200)).count() == 4
    assert ranking.hot_keys(rows, ["k"], Skew(hot_rows=250)).count() == 0


def test_running_number(spark):
    rows = spark.range(500).select((F.col("id") * 11 + 5).alias("o"))
    got = ranking.running_number(rows, "o", "n").orderBy("o").collect()
    assert [r["n"] for r in got] == list(range(1, 501))


def test_first_per_key_keeps_null_key_group(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 3, "c"), (None, 4, "d")], "k int, o int, v string")
    got = {r["k"]: r["v"] for r in ranking.first_per_key(rows, ["k"], [F.col("o")]).collect()}
    assert got == {1: "a", None: "c"}


def test_value_bin_is_monotone(spark):
    values = [-1e9, -3.5, -3.4, -1e-9, 0.0, 1e-9, 0.3, 0.31, 1.0, 2.0, 1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r[0] for r in df.select(ranking.value_bin(F.col("v"), Skew(bin_bits=8)), "v").orderBy("v").collect()]
    assert bins == sorted(bins)


def test_the_list_of_hot_groups_is_bounded(spark):
    rows = spark.range(10_000).selectExpr("id % 500 as g")
    assert ranking.hot_keys(rows, ["g"], Skew(hot_rows=1, most_hot=100)).count() == 0
    one = rows.unionByName(spark.range(5_000).selectExpr("7L as g"))
    assert [r["g"] for r in ranking.hot_keys(one, ["g"], Skew(hot_rows=1, most_hot=100)).collect()] == [7]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_crowded_bins_are_split(spark, keys):
    rng = np.random.default_rng(4)
    near = 1.0 + rng.integers(0, 4_000, 3_000) * 2.3e-13  # all within 1e-9
    far = 5.0 + 10.0 ** -rng.uniform(0, 15, 2_000)  # ever denser towards 5
    frame = pd.DataFrame({"id": range(5_400), "g": 0, "v": np.concatenate([near, far, np.full(400, 7.0)])})
    rows, skew = spark.createDataFrame(frame), Skew(hot_rows=50)
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("CNT"))
    binned = ranking.value_bins(counts, keys, "v", skew)
    sizes = binned.groupBy("_path").count().agg(F.max("count")).first()[0]
    assert sizes <= 50 and binned.count() == counts.count()
    ends = binned.groupBy("_path").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_path").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]))
    got = ranking.percent_rank_of(rows, "v", "p", spread="id", keys=keys, skew=skew).toPandas()
    want = frame.v.rank(pct=True, method="average") * 100
    assert np.allclose(got.sort_values("id").p, want)
