import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civitally.config import ForestConfig
from civitally.operators import forest
from civitally.operators.cleaning import DataGateError
from civitally.operators.columns import column_quantiles

CONFIG = ForestConfig(trees=60, sample=64, seed=7, mask_weak_peers=False)
FEATURES = ["SANCTION_AMOUNT", "PAYMENT_COUNT", "ACTUAL_AMOUNT"]


@pytest.fixture(scope="module")
def works(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(100, 10)), int(rng.integers(1, 6)), None if i % 5 == 0 else float(rng.normal(90, 9)), 1)
            for i in range(800)]
    rows += [(900 + i, 5000.0 + i, 90, 9000.0, 1) for i in range(3)]
    return spark.createDataFrame(
        rows, "WORK_ID long, SANCTION_AMOUNT double, PAYMENT_COUNT int, ACTUAL_AMOUNT double, CONSTANT int"
    )


@pytest.fixture(scope="module")
def model(works):
    return forest.fit_forest(works, [*FEATURES, "CONSTANT"], CONFIG)


def test_constant_features_are_dropped_and_medians_exact(works, model):
    assert model.features == tuple(FEATURES)
    pdf = works.toPandas()
    for c in FEATURES:
        assert model.medians[c] == pytest.approx(pdf[c].median())
    table = forest.feature_medians(works, FEATURES).collect()
    assert {r["FEATURE"]: r["MEDIAN"] for r in table} == pytest.approx(model.medians)


@pytest.mark.parametrize("bits", [0, 4, 12])
def test_column_quantiles_equal_pandas(spark, bits):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.normal(0, 1000, 900).round(1), "b": rng.integers(-2, 3, 900).astype(float),
                        "c": np.full(900, np.nan), "d": rng.random(900)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(5)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns])
    probs = [0.0, 0.1, 0.5, 0.995]
    got = column_quantiles(df, list(pdf.columns), probs, ["q0", "q1", "q2", "q3"], bits).toPandas().set_index("COLUMN")
    assert set(got.index) == {"a", "b", "d"}
    for c in got.index:
        assert np.allclose(got.loc[c, ["q0", "q1", "q2", "q3"]].astype(float), pdf[c].quantile(probs))
        assert (got.loc[c, "N"], got.loc[c, "LOWEST"], got.loc[c, "HIGHEST"]) == (pdf[c].count(), pdf[c].min(), pdf[c].max())


def walk(nodes, x, features):
    tree = {r.NODE: r for r in nodes.itertuples()}
    node = tree[0]
    while node.FEATURE >= 0:
        node = tree[node.LEFT if x[node.FEATURE] <= node.THRESHOLD else node.RIGHT]
    return node.DEPTH + float(forest.average_path(float(node.SIZE)))


def test_strength_equals_a_plain_tree_walk(works, model):
    got = {r["WORK_ID"]: r["ML_ANOMALY_STRENGTH"] for r in model.strength(works).collect()}
    pdf = works.toPandas().fillna(model.medians).set_index("WORK_ID")
    groups = [g for _, g in model.nodes.groupby("TREE")]
    for work in (0, 5, 17, 901):
        x = pdf.loc[work, FEATURES].to_numpy()
        mean = np.mean([walk(g, x, FEATURES) for g in groups])
        assert got[work] == pytest.approx(2 ** (-mean / float(forest.average_path(float(model.sample)))))


def test_outliers_rank_first_and_scores_are_consistent(works, model):
    scored = forest.score_forest(works, model).toPandas()
    assert len(scored) == 803
    assert set(scored.nlargest(3, "ML_ANOMALY_STRENGTH").WORK_ID) == {900, 901, 902}
    assert scored.ML_ANOMALY_STRENGTH.between(0, 1).all() and scored.ML_PERCENTILE.between(0, 100).all()
    assert ((scored.ML_ANOMALY_STRENGTH > 0.5) == (scored.ML_ANOMALY == 1)).all()
    assert np.allclose(scored.IF_RAW_SCORE, -scored.ML_ANOMALY_STRENGTH)
    ranks = scored.ML_ANOMALY_STRENGTH.rank(pct=True) * 100
    assert np.allclose(ranks, scored.ML_PERCENTILE)


def test_partitioning_does_not_change_the_forest(works, model):
    again = forest.fit_forest(works.repartition(9), FEATURES, CONFIG)
    key = ["TREE", "NODE"]
    a, b = (m.nodes.sort_values(key).reset_index(drop=True) for m in (model, again))
    assert a.equals(b)


def test_disjoint_sampling_of_large_tables_fills_every_tree(spark):
    works = spark.range(60000).select(F.col("id").alias("WORK_ID"), F.rand(3).alias("A"), F.rand(4).alias("B"))
    config = ForestConfig(trees=50, sample=64, mask_weak_peers=False)
    samples = forest.tree_samples(works, ["A", "B"], 60000, config).groupBy("tree").count().toPandas()
    assert len(samples) == 50 and samples["count"].min() >= 60 and samples["count"].max() < 200


def test_contamination_sets_the_share(works, model):
    strengths = model.strength(works)
    cut = forest.strength_cutoff(strengths, 0.05)
    assert strengths.filter(F.col("ML_ANOMALY_STRENGTH") > cut).count() == pytest.approx(0.05 * 803, abs=2)


def test_save_and_load(spark, works, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    loaded = forest.IsolationForest.load(spark, str(tmp_path / "m"), CONFIG)
    a, b = (m.strength(works).orderBy("WORK_ID").collect() for m in (model, loaded))
    assert a == b


def test_audit_scores(works, model):
    got = forest.score_audit_forest(works, model).toPandas()
    assert got.ISOLATION_FOREST_SCORE.min() == 0 and got.ISOLATION_FOREST_SCORE.max() == 100
    assert set(got.ISOLATION_FOREST_PREDICTION) <= {1, -1}


def test_column_classes_and_weak_peers(spark):
    df = spark.createDataFrame([(1, 2.0, 3, 4, 5, 9, 7.0, True)],
                               "WORK_ID long, SANCTION_AMOUNT double, RULE_SCORE int, STATE_TOTAL_X int, "
                               "SANCTION_YEAR int, PEER_COUNT int, PEER_MEAN_SANCTION double, HAS_X boolean")
    kinds = forest.classify_columns(df)
    assert kinds["SANCTION_AMOUNT"] == "selected" and kinds["RULE_SCORE"] == "detector"
    assert kinds["STATE_TOTAL_X"] == "administrative" and kinds["SANCTION_YEAR"] == "calendar"
    assert "HAS_X" not in kinds
    assert forest.mask_weak_peers(df).first()["PEER_MEAN_SANCTION"] is None
    with pytest.raises(DataGateError):
        forest.audit_features(df)


@pytest.mark.parametrize("rows", [1_000, 100_000, 400_000])
def test_one_sampling_rule_at_any_size(spark, rows):
    """Trees get about 1.5 samples' worth of distinct works, or all there are."""
    config = ForestConfig(trees=20, sample=64, seed=3)
    df = spark.range(rows).select(F.col("id").alias("WORK_ID"), F.lit(1.0).alias("x1"))
    picked = forest.tree_samples(df, ["x1"], rows, config).select("tree", "WORK_ID")
    sizes = {r["tree"]: (r["n"], r["d"]) for r in picked.groupBy("tree").agg(
        F.count("*").alias("n"), F.count_distinct("WORK_ID").alias("d")).collect()}
    assert set(sizes) == set(range(20))
    want = min(rows, 1.5 * 64)
    assert all(n == d and abs(n - want) < 6 * want**0.5 for n, d in sizes.values())
    again = forest.tree_samples(df.repartition(7), ["x1"], rows, config).select("tree", "WORK_ID")
    assert picked.exceptAll(again).isEmpty()


def test_small_tables_join_every_tree(spark):
    config = ForestConfig(trees=12, sample=64)
    df = spark.range(50).select(F.col("id").alias("WORK_ID"), F.lit(1.0).alias("x1"))
    assert forest.tree_samples(df, ["x1"], 50, config).select("tree", "WORK_ID").distinct().count() == 600


def test_draws_of_columns_equal_draws_in_python(spark):
    rows = [(1, 7, "feature"), (300, -5, "cut"), (0, 2**40, "ä:b")]
    df = spark.createDataFrame(rows, "a int, b long, c string")
    got = [r[0] for r in df.select(forest.drawn_column(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [forest.drawn(*r) for r in rows] and all(0 <= g < forest.DRAWS for g in got)


def test_a_split_has_two_sides_and_columns_may_come_in_any_order(works, model):
    near = np.array([[1.0], [np.nextafter(1.0, 2.0)]])
    for tree in range(50):
        nodes = forest.grow_tree(near, tree, 3, 8, 1, ["A"])
        assert sorted(n[7] for n in nodes) == [1, 1, 2]
    turned = forest.fit_forest(works, FEATURES[::-1], CONFIG)
    a, b = (m.strength(works).orderBy("WORK_ID").collect() for m in (model, turned))
    assert a == b
    fewer = forest.grow_tree(np.random.default_rng(1).random((64, 5)), 1, 3, 8, 2, list("abcde"))
    assert len({n[2] for n in fewer if n[2] >= 0}) == 2
