"""Whole-plan properties on the smallest data set."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks.context import Context
from checks.queries import REGISTRY
from civitally.config import ForestConfig, Settings, Skew
from civitally.operators import aggregates, cleaning, features, forest, fusion, reports, search
from civitally.plans.national import NationalPlan
from civitally.plans.publish import publish
from civitally.session import settle
from civitally.sources import landed, schemas, testbed

FAST = Settings(forest=ForestConfig(trees=40, sample=64))


@pytest.fixture(scope="module")
def context(spark, small_dir):
    return Context(spark, small_dir, FAST)


def test_fusion_invariants(context):
    h = context.hybrid
    assert h.count() == context.works.count() == h.select("WORK_ID").distinct().count()
    assert h.filter("HYBRID_RISK_SCORE < 0 or HYBRID_RISK_SCORE > 100").count() == 0
    assert h.filter("INDEPENDENT_SIGNAL_COUNT = 3 and (INVESTIGATION_PRIORITY <> 'P1' or HYBRID_RISK_LEVEL <> 'CRITICAL')").count() == 0
    assert h.filter("SCORE_REGIME = 'SPARSE_PEER' and STAT_COMPONENT <> 0").count() == 0
    assert h.filter("RULE_CANDIDATE = 0 and RULE_SCORE_CALIBRATED <> 0").count() == 0
    assert h.filter("PEER_DATA_SUFFICIENT is null or SCORE_REGIME is null or DATA_QUALITY_TIER is null").count() == 0
    assert {r[0] for r in h.select("SCORE_REGIME").distinct().collect()} <= {"STANDARD", "SPARSE_PEER"}
    assert {r[0] for r in h.select("DATA_QUALITY_TIER").distinct().collect()} <= {"HIGH", "MEDIUM", "LOW"}
    fusion.require_consensus_first(h)


def test_queue_starts_with_p1(context):
    top = context.queue.limit(10).collect()
    assert {r["INVESTIGATION_PRIORITY"] for r in top} == {"P1"}
    scores = [r["HYBRID_RISK_SCORE"] for r in top]
    assert scores == sorted(scores, reverse=True)


@pytest.mark.parametrize("parts", [1, 23])
def test_features_do_not_depend_on_partitioning(spark, small_dir, context, parts):
    plan = NationalPlan(
        context.works.repartition(parts), context.payments.repartition(parts, "VENDOR_ID"),
        context.completions.coalesce(1), testbed.PAYMENT_ORDER, FAST,
    )
    columns = [f.name for f in plan.features.schema.fields if f.dataType.typeName() not in ("double", "array")]
    assert plan.features.select(columns).exceptAll(context.plan.features.select(columns)).count() == 0
    z = lambda p: {r[0]: r[1] for r in p.features.select("WORK_ID", "SANCTION_PEER_Z_SCORE").collect()}
    a, b = z(plan), z(context.plan)
    assert all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in b)


def test_one_work_with_a_third_of_all_payments(spark, small_dir, context):
    extra = context.payments.withColumns(
        {"WORK_ID": F.lit(77).cast("bigint"), "EXPENDITURE_DATE": F.date_add("EXPENDITURE_DATE", 1)}
    )
    both = context.payments.unionByName(extra)
    got = aggregates.payment_summary(both, testbed.PAYMENT_ORDER).filter("WORK_ID = 77").first()
    want = both.filter("WORK_ID = 77").agg(
        F.sum("FUND_DISBURSED_AMT"), F.count("*"), F.countDistinct("VENDOR_ID"), F.min("EXPENDITURE_DATE")
    ).first()
    assert (got["TOTAL_FUND_DISBURSED_AMT"], got["PAYMENT_COUNT"], got["UNIQUE_VENDOR_COUNT"],
            got["FIRST_EXPENDITURE_DATE"]) == tuple(want)


def test_publish_writes_every_table(spark, context, tmp_path):
    names = publish(context.plan, str(tmp_path / "out"))
    assert len(names) == 16
    rows = {n: spark.read.parquet(str(tmp_path / "out" / n)).count() for n in names}
    assert rows["hybrid_risk"] == rows["ml_anomalies"] == context.works.count()
    assert rows["rule_summary"] == 17 and rows["statistical_summary"] == 12
    assert rows["ml_overlap"] == 11 and rows["hybrid_summary"] == 8 and rows["score_distribution"] == 21
    one = spark.read.parquet(str(tmp_path / "out" / "hybrid_risk")).filter("STATE_ID = 3")
    assert "PartitionFilters: [isnotnull(STATE_ID" in one._jdf.queryExecution().toString()
    assert one.count() == context.works.filter("STATE_ID = 3").count()
    # a search by name reads that state's folder only
    published = spark.read.parquet(str(tmp_path / "out" / "hybrid_risk"))
    states = spark.read.parquet(str(tmp_path / "out" / "states"))
    name = one.first()["STATE_NAME"]
    page = search.query_works(published, state=f" {name.upper()} ", scope="all", states=states)
    plan = page.rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(STATE_ID" in plan and "STATE_ID#" in plan
    plain = search.query_works(published, state=name, scope="all")
    assert page.meta.first()["TOTAL"] == plain.meta.first()["TOTAL"] == one.count()
    assert search.query_works(published, state="nowhere", scope="all", states=states).rows.count() == 0


def test_repeated_keys_stop_the_plan(spark, context):
    twice = context.completions.unionByName(context.completions.limit(5))
    plan = NationalPlan(context.works, context.payments, twice, testbed.PAYMENT_ORDER, FAST)
    with pytest.raises(cleaning.DataGateError, match="completions: 5 repeated"):
        plan.financial
    works = context.works.unionByName(context.works.limit(2))
    plan = NationalPlan(works, context.payments, context.completions, testbed.PAYMENT_ORDER, FAST)
    with pytest.raises(cleaning.DataGateError, match="works: 2 repeated"):
        plan.financial


def test_repeated_completion_records_are_reduced_and_listed(spark, context):
    raw = context.raw_layer
    done = raw.filter("_SOURCE_KEY = 'Works Completed'").orderBy("_ord").limit(3)
    later = done.withColumns({"_ord": F.concat(F.lit("~"), "_ord"), "ACTUAL_AMOUNT": F.lit("1")})
    plan = NationalPlan.from_records(raw.unionByName(later), FAST)
    assert plan.financial.count() == context.works.count()
    conflicts = plan.rejected["completion_conflicts"].collect()
    assert len(conflicts) == 3 and {r["VERSIONS"] for r in conflicts} == {2}
    ids = [r["WORK_ID"] for r in conflicts]
    kept = {r["ACTUAL_AMOUNT"] for r in plan.financial.filter(F.col("WORK_ID").isin(ids)).collect()}
    assert 1 not in kept
    plan.close()
    assert plan.store.folders == []


def test_landing_order_is_required(context):
    for step in (cleaning.most_complete, cleaning.extract_payments):
        with pytest.raises(cleaning.DataGateError, match="_ord"):
            step(context.raw.drop("_ord"))


def test_from_landed_files_to_hybrid(spark, context, tmp_path):
    """Payload files of all lists, read in any split, give the plan of the records."""
    fields = [c for c in context.raw.columns if c != "_ord"]
    rows = context.raw_layer.select(F.to_json(F.struct(*fields)).alias("j"), "_ord", "_SOURCE_KEY")
    few = rows.filter("hash(_ord) % 3 = 0").orderBy("_ord").collect()
    for n in range(4):
        part = [r["j"] for r in few[n::4]]
        (tmp_path / f"list-{n}.json").write_text("[" + ",".join(part) + "]")
    records = landed.read_landed_records(spark, str(tmp_path), fields)
    assert records.count() == len(few) == records.select("_ord").distinct().count()
    again = landed.read_landed_records(spark, str(tmp_path), fields).repartition(7)
    plans = [NationalPlan.from_records(r, FAST) for r in (records, again)]
    cols = ["WORK_ID", "TOTAL_FUND_DISBURSED_AMT", "PAYMENT_IA_NAME", "ACTUAL_AMOUNT", "STATE_NAME"]
    one, two = (sorted(map(str, p.financial.select(cols).collect())) for p in plans)
    assert one == two and len(one) > 100
    assert plans[0].hybrid.count() == len(one)


def test_single_group_statistics_agree_with_the_long_table(context):
    fin = context.plan.financial
    wide = context.plan.features
    for stats, key in ((features.mp_stats(fin), "MP_ID"), (features.constituency_stats(fin), "CONSTITUENCY_ID")):
        columns = [c for c in stats.columns if c != key]
        seen = wide.filter(F.col(key).isNotNull()).select(key, *columns).distinct()
        assert seen.count() == stats.count()
        # means and medians are exact, so the rows agree value by value
        assert seen.exceptAll(stats.select(key, *columns)).count() == 0


def test_work_master_has_the_declared_types(context):
    master = cleaning.build_work_master(cleaning.most_complete(context.raw))
    declared = {f.name: f.dataType for f in schemas.WORK_MASTER.fields}
    assert {f.name: f.dataType for f in master.schema.fields} == declared
    assert {r[0] for r in context.raw.select("_SOURCE_KEY").distinct().collect()} == set(schemas.SOURCE_LISTS)


def test_model_inputs_must_be_finite(spark):
    good = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert forest.require_finite(good, ["a"]) is good
    with pytest.raises(cleaning.DataGateError):
        forest.require_finite(good.union(spark.createDataFrame([(None,)], "a double")), ["a"])


def test_stored_values_and_levels(spark):
    df = spark.createDataFrame([("", 70.0), ("LOW", 70.0), (None, None)], "HYBRID_RISK_LEVEL string, HYBRID_RISK_SCORE double")
    got = df.select(search.stored_level(df).alias("l"), cleaning.api_value("HYBRID_RISK_LEVEL").alias("v")).collect()
    assert [(r["l"], r["v"]) for r in got] == [("CRITICAL", None), ("LOW", "LOW"), (None, None)]


def test_narrow_analysis_holds_only_what_a_report_reads(context):
    narrow = context.analysis_of(*reports.PEER_BAND_FEATURES)
    assert set(narrow.columns) == {"WORK_ID", "ML_ANOMALY", *reports.PEER_BAND_FEATURES}
    wide = context.analysis.select(narrow.columns)
    assert narrow.count() == wide.count() and narrow.exceptAll(wide).count() == 0


def recorded(context, skew=None):
    """A plan over the same tables and the labels of the layers that it stores."""
    labels = []

    def store(df, label):
        labels.append(label)
        return settle(df, label)

    settings = FAST if skew is None else replace(FAST, skew=skew)
    plan = NationalPlan(context.works, context.payments, context.completions, testbed.PAYMENT_ORDER,
                        settings, store=store)
    return plan, labels


def test_detectors_and_model_store_no_wide_features(context):
    plan, labels = recorded(context)
    detected = plan.detected
    plan.forest()
    assert not {"features", "group_profile"} & set(labels) and labels.count("peer_stats") == 1
    full, _ = recorded(context)
    assert full.features.count() == context.works.count()
    assert detected.exceptAll(full.detected).count() == 0 == full.detected.exceptAll(detected).count()
    kept = plan.model_table.columns
    assert forest.model_features(plan.model_table) == forest.model_features(full.features)
    money = [c for c in kept if plan.model_table.schema[c].dataType.typeName() != "double"]
    assert plan.model_table.select(money).exceptAll(full.features.select(money)).count() == 0


def test_wide_rows_are_not_sorted_for_their_groups(context):
    # no group is small enough to be sent, and none is hot
    plan, _ = recorded(context, Skew(sent_rows=0))
    text = plan.features_plan._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
    columns = [f.name for f in plan.features.schema.fields if f.dataType.typeName() not in ("double", "array")]
    assert plan.features.columns == context.plan.features.columns
    assert plan.features.select(columns).exceptAll(context.plan.features.select(columns)).count() == 0


def test_fixed_forest_takes_its_cuts_from_histograms(context, monkeypatch):
    def refused(*_):
        raise AssertionError("all values of a column in one aggregate")

    monkeypatch.setattr(F, "percentile", refused)
    fresh = Context(context.spark, context.dir, FAST)
    got = REGISTRY["ml06_fixed_forest_scores"].build(fresh)
    assert got.count() == context.works.count() and "features" not in fresh.plan.__dict__


def test_first_generation_payments_and_scores_need_no_extra_pass(spark, small_dir):
    regional = Context(spark, small_dir, FAST).regional
    spending = regional.spending
    assert "min_by" not in spending._jdf.queryExecution().optimizedPlan().toString()
    twice = regional.transactions.unionByName(regional.transactions.withColumn("_ord", F.concat("_ord", F.lit("b"))))
    want = aggregates.spending_summary(cleaning.dedup_payments(
        twice.select("WORK_ID", "VENDOR_ID", "FUND_DISBURSED_AMT", "EXPENDITURE_DATE", "_ord"), ["_ord"]))
    regional.__dict__["transactions"] = twice
    regional.__dict__.pop("spending")
    assert regional.spending.exceptAll(want).count() == 0 == want.exceptAll(regional.spending).count()
    ml = regional.features.select("WORK_ID").withColumns({
        "ISOLATION_FOREST_SCORE": F.lit(50.0), "ISOLATION_FOREST_RISK_LEVEL": F.lit("MEDIUM"),
        "ISOLATION_FOREST_ANOMALY_FLAG": F.lit(False), "ISOLATION_FOREST_REASON": F.lit("x"),
    })
    hybrid = regional.hybrid_with(ml)
    assert hybrid._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    rules_only = ["WORK_ID", *[c for c in regional.rules.columns if c.startswith("RULE_")], "DATA_QUALITY_SCORE"]
    stats_only = ["WORK_ID", *[c for c in regional.statistics.columns if c.startswith("STATISTICAL_")]]
    joined = fusion.fuse_audit(regional.rules.select(rules_only), regional.statistics.select(stats_only), ml, "WORK_ID")
    columns = [c for c in hybrid.columns if c in joined.columns]
    assert len(columns) == len(hybrid.columns)
    assert hybrid.exceptAll(joined.select(hybrid.columns)).count() == 0 and hybrid.count() == joined.count()
