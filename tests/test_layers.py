"""What layers and their shuffles leave on disk, and the helpers that send less."""

import datetime
import random
import time

from pyspark.sql import functions as F

from checks.context import Context
from civitally.config import Skew
from civitally.operators import aggregates, cleaning, ranking, reports
from civitally.plans.regional import RegionalPlan
from civitally.session import Layers, settle, shuffles_freed
from civitally.sources import testbed


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [blocks.apply(i).getName() for i in range(blocks.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_written_layer_leaves_no_shuffle(spark):
    for store in (settle, Layers()):
        before = shuffle_files(spark)
        layer = store(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
        for _ in range(100):
            left = shuffle_files(spark) - before
            if not left:
                break
            time.sleep(0.1)
        assert not left
        assert layer.agg(F.sum("count")).first()[0] == 10000
        assert any(".zstd." in f for f in layer.inputFiles())


def test_the_setting_is_as_before(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    try:
        with shuffles_freed(spark):
            assert spark.conf.get(name) == "true"
            raise ValueError
    except ValueError:
        assert spark.conf.get(name, None) == before


def paid(spark, rows=300):
    rng = random.Random(3)
    made = []
    for i in range(rows):
        work = None if i % 11 == 0 else 1 if i % 3 == 0 else rng.randint(2, 40)
        vendor = rng.choice([None, 1, 2, 3])
        day = datetime.date(2024, 1, rng.randint(1, 4)) if rng.random() < 0.8 else None
        made.append((work, vendor, rng.choice([None, "A", "B"]), rng.choice([None, 1, 2, 5]), day,
                     rng.choice(["payment success", None]), rng.choice([None, "x", "y"]), i))
    return spark.createDataFrame(
        made, "WORK_ID long, VENDOR_ID long, VENDOR_NAME string, FUND_DISBURSED_AMT int, "
        "EXPENDITURE_DATE date, WORK_STATUS string, IA_NAME string, _ord int",
    ).withColumn("FUND_DISBURSED_AMT", F.col("FUND_DISBURSED_AMT").cast("decimal(18,2)"))


def joined_exchanges(joined):
    return plan_of(joined).count("Exchange hashpartitioning")


def test_joined_payments_are_sent_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        works = spark.range(50).withColumnRenamed("id", "w")
        joined = paid(spark).join(works, F.col("WORK_ID") == F.col("w")).drop("w")
        plan = plan_of(aggregates.payment_summary(joined, ["_ord"]))
        # totals, vendors and vendor names: both sides of the join, and nothing after it
        assert plan.count("Exchange hashpartitioning") == 3 * joined_exchanges(joined)
        assert "Expand" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_payment_summary_counts_vendors(spark):
    rows = paid(spark)
    got = aggregates.payment_summary(rows, ["_ord"]).select(
        "WORK_ID", "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "UNIQUE_VENDOR_NAME_COUNT")
    want = rows.groupBy("WORK_ID").agg(
        F.count("FUND_DISBURSED_AMT"), F.count_distinct("VENDOR_ID"), F.count_distinct("VENDOR_NAME"))
    assert rows_of(got) == rows_of(want)


def test_spending_of_hot_and_other_works(spark):
    rows = paid(spark)
    for once in (False, True):
        kept = rows.select("WORK_ID", "VENDOR_ID", "FUND_DISBURSED_AMT", "EXPENDITURE_DATE")
        kept = (kept.distinct() if once else kept).filter("WORK_ID is not null")
        want = kept.groupBy("WORK_ID").agg(
            F.coalesce(F.sum("FUND_DISBURSED_AMT"), F.lit(0)), F.count("FUND_DISBURSED_AMT"),
            F.count_distinct("VENDOR_ID"), F.count_distinct("EXPENDITURE_DATE"))
        for skew in (Skew(), Skew(hot_rows=20)):
            got = aggregates.spending_summary(rows, once=once, skew=skew)
            assert rows_of(got.select("WORK_ID", "TOTAL_DISBURSED", "TRANSACTION_COUNT", "VENDOR_COUNT",
                                      "EXPENDITURE_DATE_COUNT")) == rows_of(want)
    # only the hot works' rows are expanded
    assert plan_of(aggregates.spending_summary(rows)).count("Expand") == 1


def test_first_values_against_each_field(spark):
    rng = random.Random(5)
    fields = ["a", "b", "c", "d", "e"]
    made = [(rng.randint(1, 12), f"{i:03}" if rng.random() < 0.9 else None,
             *[rng.choice([None, "x", "y", "z"]) for _ in fields]) for i in range(200)]
    rng.shuffle(made)
    df = spark.createDataFrame(made, "k int, o string, " + ", ".join(f"{f} string" for f in fields))
    aggs, values = aggregates.first_values(fields, (("a", "b", "missing"), ("c", "d"), ("e",)), "o")
    got = df.groupBy("k").agg(*aggs).select("k", *[v.alias(c) for c, v in values.items()])
    want = {}
    for k, o, *vs in sorted((r for r in made if r[1] is not None), key=lambda r: r[1]):
        held = want.setdefault(k, [None] * 5)
        want[k] = [h if h is not None else v for h, v in zip(held, vs)]
    assert {r[0]: list(r[1:]) for r in got.collect()} == want
    # a complete record sends its position once for a group's fields
    assert len(aggs) == len(fields) + 2


def test_first_per_key_sends_columns_once(spark):
    rows = spark.createDataFrame(
        [("a", 1, 2, "x"), ("a", 1, 1, "y"), ("a", 2, 9, None), (None, 1, 4, "n"), (None, 1, 3, None)],
        "k string, j int, o int, v string")
    first = ranking.first_per_key(rows, ["k", "j"], ["o", "k"])
    assert first.columns == rows.columns
    assert rows_of(first) == sorted([("a", 1, 1, "y"), ("a", 2, 9, None), (None, 1, 3, None)], key=str)
    last = cleaning.keep_last(rows, ["k", "j"], ["o"])
    assert rows_of(last) == sorted([("a", 1, 2, "x"), ("a", 2, 9, None), (None, 1, 4, "n")], key=str)
    aggregate = plan_of(first).split("Exchange")[-1]
    assert "k, k#" not in aggregate and "j, j#" not in aggregate
    assert rows_of(ranking.first_per_key(rows.select("k"), ["k"], ["k"])) == [("a",), (None,)]


def test_first_per_key_with_maps_and_signed_zeros(spark):
    rows = spark.sql("""SELECT * FROM VALUES (double('-0.0'), 1, map('a', 1)),
        (0.0D, 2, map('b', 2)), (1.0D, 5, map('c', 3)) AS t(k, o, m)""")
    got = {str(r["k"]): (r["o"], r["m"]) for r in ranking.first_per_key(rows, ["k"], ["o"]).collect()}
    assert got == {"-0.0": (1, {"a": 1}), "1.0": (5, {"c": 3})}


def test_narrow_reports_store_no_features(spark, small_dir):
    context = Context(spark, small_dir)
    rates = reports.state_rates(context.analysis_of("STATE_NAME"))
    diagnostic = reports.state_diagnostic(context.analysis_of(*reports.STATE_DIAGNOSTIC_FEATURES))
    names = context.analysed_features
    _ = context.plan.model_inputs
    described = context.plan.described
    assert "features" not in context.plan.__dict__
    wide = context.plan.features.join(context.proxy_ml, "WORK_ID")
    assert names == reports.numeric_features(context.plan.features)
    assert context.analysis.columns == wide.columns
    assert described.columns == context.plan.features.columns
    assert rows_of(context.analysis) == rows_of(wide)
    assert rows_of(rates) == rows_of(reports.state_rates(wide))
    assert rows_of(diagnostic) == rows_of(reports.state_diagnostic(wide))


def test_audit_rules_store_no_features(spark, small_dir):
    plan = RegionalPlan(settle(testbed.raw_records(spark, small_dir), "raw"))
    scored = rows_of(plan.rules.select("WORK_ID", "RULE_SCORE", "RULE_REASON_CODES", "DATA_QUALITY_SCORE"))
    inputs = rows_of(plan.model_inputs.drop("MEDIAN", "Q1", "Q3", "IQR"))
    missing = rows_of(plan.audited("WORK_ID", "VENDOR_COUNT", "VENDOR_COUNT"))
    assert "features" not in plan.__dict__
    again = RegionalPlan(plan.records)
    assert again.features.count() == len(scored)
    assert rows_of(again.rules.select("WORK_ID", "RULE_SCORE", "RULE_REASON_CODES", "DATA_QUALITY_SCORE")) == scored
    assert rows_of(again.model_inputs.drop("MEDIAN", "Q1", "Q3", "IQR")) == inputs
    assert rows_of(again.features.select("WORK_ID", "VENDOR_COUNT")) == missing
