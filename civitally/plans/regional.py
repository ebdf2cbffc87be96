"""First-generation plan: landed records to nested evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ForestConfig, Settings
from ..operators import aggregates, audit, cleaning, evidence, forest, fusion, preprocess, rules, statistics
from ..session import settle

AUDIT_FOREST = ForestConfig(contamination=0.02, max_features=0.8, mask_weak_peers=False)


@dataclass
class RegionalPlan:
    records: DataFrame
    settings: Settings = field(default_factory=Settings)
    store: Callable[[DataFrame, str], DataFrame] = settle

    @cached_property
    def works_plan(self) -> DataFrame:
        consolidated = aggregates.consolidate_works(self.records)
        return consolidated.withColumnsRenamed(
            {"WORK_ID": "PORTAL_WORK_ID", "WORK_RECOMMENDATION_DTL_ID": "WORK_ID"}
        )

    @cached_property
    def works(self) -> DataFrame:
        return self.store(self.works_plan, "consolidated")

    @cached_property
    def transactions(self) -> DataFrame:
        return cleaning.extract_payments(aggregates.expenditure_records(self.records)).drop("STATE_ID")

    @cached_property
    def spending(self) -> DataFrame:
        # these are the columns that identify a payment, so equal rows are one payment
        # and the landing order, longer than the rest of the row, has nothing to choose
        paid = self.transactions.select(
            "WORK_ID", "VENDOR_ID", "FUND_DISBURSED_AMT", "EXPENDITURE_DATE"
        )
        return aggregates.spending_summary(paid, once=True, skew=self.settings.skew)

    @cached_property
    def features_plan(self) -> DataFrame:
        return audit.build_audit_features(
            self.works, self.spending, skew=self.settings.skew, store=self.store
        )

    @cached_property
    def features(self) -> DataFrame:
        return self.store(self.features_plan, "audit_features")

    @property
    def measured(self) -> DataFrame:
        """The stored features if they are there, else as they are computed: for what
        reads some columns of them once."""
        return self.features if "features" in self.__dict__ else self.features_plan

    def audited(self, *columns: str) -> DataFrame:
        """These features alone, stored, for a report that reads them more than once."""
        if "features" in self.__dict__:
            return self.features
        return self.store(self.features_plan.select(*dict.fromkeys(columns)), "audited")

    @cached_property
    def model_table(self) -> DataFrame:
        """WORK_ID and the model's features, stored as every step of the fit reads them."""
        if "features" in self.__dict__:
            return self.features
        rows = self.features_plan
        kept = [c for c in rows.columns if c == "WORK_ID" or c in forest.AUDIT_FEATURES]
        return self.store(rows.select(*kept), "audit_model_table")

    @cached_property
    def rules(self) -> DataFrame:
        return rules.score_audit_rules(self.measured)

    @cached_property
    def statistics(self) -> DataFrame:
        return statistics.score_cost_signals(self.measured)

    @cached_property
    def model_inputs(self) -> DataFrame:
        """Which listed model features are there, missing ones too, and their values."""
        return self.store(
            preprocess.fit_inputs(self.model_table, forest.AUDIT_FEATURES), "audit_model_inputs"
        )

    def ml(self, config: ForestConfig = AUDIT_FOREST) -> DataFrame:
        preprocess.require_inputs(self.model_inputs)
        present, _ = forest.audit_features(self.model_table)
        model = forest.fit_forest(self.model_table, present, config)
        return forest.score_audit_forest(self.model_table, model, store=self.store)

    def hybrid_with(self, ml: DataFrame) -> DataFrame:
        # both score the row of features they read, so neither needs a join
        scored = statistics.score_cost_signals(self.rules).select(
            "WORK_ID", "RULE_SCORE", "RULE_RISK_LEVEL", "RULE_ANOMALY_FLAG", "RULE_REASON_CODES",
            "RULE_REASONS", "DATA_QUALITY_SCORE",
            "STATISTICAL_SCORE", "STATISTICAL_RISK_LEVEL", "STATISTICAL_ANOMALY_FLAG",
            "STATISTICAL_REASON_CODES", "STATISTICAL_REASONS", "STATISTICAL_CONFIDENCE",
        )
        m = ml.select(
            "WORK_ID", "ISOLATION_FOREST_SCORE", "ISOLATION_FOREST_RISK_LEVEL",
            "ISOLATION_FOREST_ANOMALY_FLAG", "ISOLATION_FOREST_REASON",
        )
        return fusion.fuse_audit(scored, None, m, "WORK_ID", self.settings.fusion)

    def evidence_with(self, hybrid: DataFrame) -> DataFrame:
        facts = [c for c in self.features.columns if c not in hybrid.columns or c == "WORK_ID"]
        return evidence.audit_records(hybrid.join(self.features.select(*facts), "WORK_ID", "left"))


def results_sorted(hybrid: DataFrame) -> DataFrame:
    return hybrid.orderBy("INVESTIGATION_PRIORITY", F.desc("HYBRID_RISK_SCORE"), "WORK_ID")
