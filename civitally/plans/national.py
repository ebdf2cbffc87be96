"""Second-generation plan: landed tables to investigation queue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame

from ..config import Settings
from ..functions.scalar import clean_id
from ..operators import aggregates, cleaning, features, forest, fusion, preprocess, rules, statistics
from ..session import Layers
from ..sources.schemas import COMPLETED

# Columns the fusion step and the works index read.
DETECTED_COLUMNS = (
    "WORK_ID", "STATE_ID", "STATE_NAME", "CONSTITUENCY_ID", "CONSTITUENCY", "MP_ID", "MP_NAME",
    "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_DESCRIPTION", "WORK_STAGE", "SOURCE_KEY",
    "RECOMMENDED_AMOUNT", "SANCTION_AMOUNT", "ACTUAL_AMOUNT", "TOTAL_FUND_DISBURSED_AMT",
    "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "PEER_COUNT", "MISSING_FIELD_COUNT", "RULE_SCORE",
    "RULE_SEVERITY", "RULE_CANDIDATE", "STRONG_RULE_COUNT", "RULE_TRIGGER_COUNT", "RULE_FLAGS",
    "RULE_REASONS", "RULE_VERIFICATION_NOTES", "STAT_SCORE", "STAT_SEVERITY", "STAT_CANDIDATE",
    "STAT_CATEGORY_COUNT", "STAT_STRONG_RULE_COUNT", "STAT_TRIGGER_COUNT", "STAT_FLAGS",
    "STAT_REASONS", "STAT_VERIFICATION_NOTES",
)
RULE_TABLE_COLUMNS = (
    "WORK_ID", "STATE_NAME", "CONSTITUENCY", "MP_NAME", "WORK_CATEGORY", "SANCTION_AMOUNT",
    "TOTAL_FUND_DISBURSED_AMT", "ACTUAL_AMOUNT", "PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT",
    "PEER_COUNT", "PEER_MEDIAN_SANCTION", "SANCTION_TO_PEER_MEDIAN", "SANCTION_PEER_Z_SCORE",
    "RULE_FINANCIAL_SCORE", "RULE_PAYMENT_SCORE", "RULE_TIMELINE_SCORE",
    "RULE_PAYMENT_STATUS_SCORE", "RULE_DIVERSITY_BONUS", "RULE_CATEGORY_COUNT", "RULE_SCORE",
    "RULE_SEVERITY", "RULE_CANDIDATE", "RULE_TRIGGER_COUNT", "STRONG_RULE_COUNT",
    "VERIFICATION_FLAG_COUNT", "RULE_FLAGS", "RULE_REASONS", "RULE_VERIFICATION_NOTES",
)


@dataclass
class NationalPlan:
    """Lazily built layers over works, payments and completions.

    ``financial``, ``features``, ``model_table``, ``detected`` and ``ml`` are settled
    as Parquet because several aggregations read them; the rest stays lazy. ``rejected``
    holds what was set aside on the way in, by name. Works and completions must
    be unique on WORK_ID; tables given by hand are checked once (``verified``
    says that they were built unique).
    """

    works: DataFrame
    payments: DataFrame
    completions: DataFrame
    payment_order: tuple[str, ...]
    settings: Settings = field(default_factory=Settings)
    store: Callable[[DataFrame, str], DataFrame] = field(default_factory=Layers)
    rejected: dict[str, DataFrame] = field(default_factory=dict)
    verified: bool = False

    @classmethod
    def from_records(cls, records: DataFrame, settings: Settings = Settings()) -> NationalPlan:
        """Start from landed records of the four portal lists.

        Of several completion records of a work the first landed counts; the
        others are listed in ``rejected["completion_conflicts"]``.
        """
        collection = cleaning.most_complete(records)
        paid, unpaid = cleaning.quarantine(cleaning.extract_payments(records), "WORK_ID")
        done, undone = cleaning.quarantine(
            cleaning.extract_completions(records, COMPLETED, ["_ord"]), "WORK_ID"
        )
        rejected = {
            "records_without_work": cleaning.without_work_key(records),
            "works_without_id": cleaning.quarantine(
                collection.withColumn("_id", clean_id("WORK_RECOMMENDATION_DTL_ID")), "_id"
            )[1].drop("_id"),
            "payments_without_id": unpaid,
            "completions_without_id": undone.drop("_ord"),
            "completion_conflicts": cleaning.completion_conflicts(done),
        }
        first = cleaning.keep_first(done, "WORK_ID", ["_ord"]).drop("_ord")
        return cls(cleaning.build_work_master(collection), paid, first, ("_ord",), settings,
                   rejected=rejected, verified=True)

    def close(self) -> None:
        """Delete the stored layers."""
        if isinstance(self.store, Layers):
            self.store.close()

    @cached_property
    def payment_agg(self) -> DataFrame:
        return aggregates.payment_summary(
            aggregates.payment_rows(self.payments), self.payment_order
        )

    @cached_property
    def expenditure(self) -> DataFrame:
        return features.build_expenditure(self.works, self.payment_agg)

    @cached_property
    def financial_plan(self) -> DataFrame:
        if not self.verified:
            cleaning.require_unique_keys({"works": self.works, "completions": self.completions})
            self.verified = True
        return features.build_financial_master(self.expenditure, self.completions)

    @cached_property
    def financial(self) -> DataFrame:
        return self.store(self.financial_plan, "financial")

    @cached_property
    def peers(self) -> tuple[DataFrame, bool]:
        """Stored peer statistics, and whether they may be broadcast."""
        return features.stored_peers(
            self.financial, self.settings.peer_keys, self.settings.normalize_activity,
            self.settings.skew, self.store,
        )

    def features_of(self, financial: DataFrame, groups: bool = True) -> DataFrame:
        """All features of stored financial rows, which may have further columns."""
        return features.build_features(
            financial,
            peer_keys=self.settings.peer_keys,
            normalize_activity=self.settings.normalize_activity,
            skew=self.settings.skew,
            store=self.store,
            peers=self.peers,
            groups=groups,
        )

    @cached_property
    def features_plan(self) -> DataFrame:
        return self.features_of(self.financial)

    @cached_property
    def features(self) -> DataFrame:
        return self.store(self.features_plan, "features")

    @property
    def described(self) -> DataFrame:
        """All features, for what reads few of them once: the stored ones if they are
        there, else as they are computed."""
        return self.features if "features" in self.__dict__ else self.features_plan

    @property
    def measured(self) -> DataFrame:
        """Own and peer features, which are all that detectors and models read.

        These are the stored features if they are there. Else they are derived from
        the financial rows as they are read, and nothing wide is written for them.
        """
        return self.features if "features" in self.__dict__ else self.features_of(self.financial, groups=False)

    @cached_property
    def model_table(self) -> DataFrame:
        """WORK_ID and the model's features, stored as every step of the fit reads them."""
        if "features" in self.__dict__:
            return self.features
        rows = self.measured
        kept = [c for c in rows.columns if c == "WORK_ID" or c in forest.CORE_FEATURES]
        return self.store(rows.select(*kept), "model_table")

    @cached_property
    def rules(self) -> DataFrame:
        return rules.score_rules(self.measured, self.settings.rules)

    @cached_property
    def rule_table(self) -> DataFrame:
        """Stored rule results, for filters and sorts on the scores."""
        return self.store(self.rules.select(*RULE_TABLE_COLUMNS), "rules")

    @cached_property
    def statistics(self) -> DataFrame:
        return self._statistics(self.measured)

    def _statistics(self, df: DataFrame) -> DataFrame:
        stored = "features" in self.__dict__
        rows = self.features if stored else features.row_features(self.financial)
        return statistics.score_statistics(
            df,
            self.settings.stats,
            thresholds=statistics.tail_thresholds(rows, self.settings.stats, self.settings.skew),
            peer_keys=self.settings.peer_keys,
            skew=self.settings.skew,
        )

    @cached_property
    def detected_plan(self) -> DataFrame:
        """Rule and statistical detectors on the same rows, without a join."""
        scored = self._statistics(self.rules)
        return scored.select(*[c for c in DETECTED_COLUMNS if c in scored.columns])

    @cached_property
    def detected(self) -> DataFrame:
        return self.store(self.detected_plan, "detected")

    def hybrid_with(self, ml: DataFrame) -> DataFrame:
        """Fuse with ML results (WORK_ID, ML_ANOMALY, ML_PERCENTILE, ML_SEVERITY)."""
        return fusion.fuse(self.detected.join(ml, "WORK_ID", "left"), self.settings.fusion)

    @cached_property
    def model_inputs(self) -> DataFrame:
        """Which model features are there and their values, checked to be finite."""
        table = preprocess.fit_inputs(self.model_table, forest.CORE_FEATURES)
        return preprocess.require_inputs(self.store(table, "model_inputs"))

    def forest(self) -> forest.IsolationForest:
        return forest.fit_forest(self.model_table, config=self.settings.forest)

    @cached_property
    def ml(self) -> DataFrame:
        return self.store(
            forest.score_forest(
                self.model_table, self.forest(), self.settings.skew, store=self.store
            ),
            "ml",
        )

    @cached_property
    def hybrid(self) -> DataFrame:
        """Hybrid risk of every work with the fitted forest."""
        hybrid = self.store(
            fusion.hybrid_columns(
                self.hybrid_with(
                    self.ml.select("WORK_ID", "ML_ANOMALY", "ML_PERCENTILE", "ML_SEVERITY")
                )
            ),
            "hybrid",
        )
        # Both are stored, so their counts are read from file footers.
        cleaning.require_same_rows(self.detected, hybrid, "hybrid risk")
        fusion.require_consensus_first(hybrid)
        return hybrid
