"""Plans over the driver's tables, shared by the registered queries."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitally.config import Settings
from civitally.operators import evidence, forest, fusion, index, reports
from civitally.operators.ranking import percent_rank_of
from civitally.plans.national import NationalPlan
from civitally.plans.regional import RegionalPlan
from civitally.session import layer_root, settle
from civitally.sources import testbed


class Context:
    """Everything a query may need, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = Settings()):
        self.spark, self.dir, self.settings = spark, sf_dir, settings

    @cached_property
    def works(self) -> DataFrame:
        return testbed.works(self.spark, self.dir)

    @cached_property
    def payments(self) -> DataFrame:
        return testbed.payments(self.spark, self.dir)

    @cached_property
    def completions(self) -> DataFrame:
        return testbed.completions(self.spark, self.dir)

    @cached_property
    def raw(self) -> DataFrame:
        return testbed.raw_records(self.spark, self.dir)

    @cached_property
    def raw_layer(self) -> DataFrame:
        return settle(self.raw, "raw")

    @cached_property
    def plan(self) -> NationalPlan:
        return NationalPlan(
            self.works, self.payments, self.completions, testbed.PAYMENT_ORDER, self.settings
        )

    @cached_property
    def regional(self) -> RegionalPlan:
        return RegionalPlan(self.raw_layer, self.settings)

    @cached_property
    def proxy_ml(self) -> DataFrame:
        """Stand-in for the forest in SQL-checked fusion: rank of the disbursed total."""
        strength = self.plan.financial.select(
            "WORK_ID",
            F.coalesce(F.col("TOTAL_FUND_DISBURSED_AMT").cast("double"), F.lit(0.0)).alias(
                "ML_ANOMALY_STRENGTH"
            ),
        )
        ranked = percent_rank_of(
            strength, "ML_ANOMALY_STRENGTH", "ML_PERCENTILE", spread="WORK_ID",
            skew=self.settings.skew,
        )
        return ranked.withColumns(
            {
                "ML_ANOMALY": (F.col("ML_PERCENTILE") >= 97.5).cast("int"),
                "ML_SEVERITY": forest.ml_severity(F.col("ML_PERCENTILE")),
                "IF_DECISION_SCORE": -F.col("ML_PERCENTILE"),
            }
        )

    @cached_property
    def hybrid(self) -> DataFrame:
        ml = self.proxy_ml.select("WORK_ID", "ML_ANOMALY", "ML_PERCENTILE", "ML_SEVERITY")
        return settle(fusion.hybrid_columns(self.plan.hybrid_with(ml)), "hybrid")

    @cached_property
    def analysis(self) -> DataFrame:
        """Features with the stand-in model results. These are joined to the financial
        rows, before the hundred columns are derived: so the wide rows are neither sent
        nor stored without them first."""
        scores = [c for c in self.proxy_ml.columns if c != "WORK_ID"]
        scored = settle(self.plan.financial.join(self.proxy_ml, "WORK_ID"), "scored")
        wide = self.plan.features_of(scored)
        return settle(wide.select(*[c for c in wide.columns if c not in scores], *scores), "analysis")

    @cached_property
    def analysed_features(self) -> list[str]:
        """The numeric features of ``analysis``, without the model's results."""
        scores = [c for c in self.proxy_ml.columns if c != "WORK_ID"]
        return reports.numeric_features(self.analysis.drop(*scores))

    def analysis_of(self, *columns: str) -> DataFrame:
        """The same works with these features and the anomaly flag alone, for a report
        that reads few of the hundred columns."""
        rows = self.plan.measured
        if not set(columns) <= set(rows.columns):
            rows = self.plan.features
        flags = self.proxy_ml.select("WORK_ID", "ML_ANOMALY")
        return settle(rows.select("WORK_ID", *columns).join(flags, "WORK_ID"), "analysis_of")

    @cached_property
    def index_path(self) -> str:
        return f"{layer_root(self.spark)}/civitally/index-{uuid.uuid4().hex}"

    @cached_property
    def cube(self) -> DataFrame:
        return index.write_cube(self.hybrid, self.index_path).cube

    @cached_property
    def pages(self) -> index.WorksIndex:
        """The index without its postings and cube, which pages and totals do not read."""
        return index.write_rows(self.hybrid, self.index_path, bucket_rows=2000)

    @cached_property
    def index(self) -> index.WorksIndex:
        return index.write_postings(self.pages)

    @cached_property
    def queue(self) -> DataFrame:
        return evidence.investigation_queue(self.hybrid, self.plan.features)


_SHARED: dict[tuple[str, str], Context] = {}


def shared_context(spark: SparkSession, sf_dir: str) -> Context:
    """One context per application and folder, so stored layers are reused."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Context(spark, sf_dir)
    return _SHARED[key]
