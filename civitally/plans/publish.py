"""Write a finished national plan as tables for analysts and services."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evidence, forest, fusion, preprocess, reports, rules, search, statistics
from ..sources import sinks
from .national import NationalPlan


def output_tables(plan: NationalPlan) -> dict[str, DataFrame]:
    """Name -> table; summaries are small, the rest are one row per work."""
    hybrid, detected, ml = plan.hybrid, plan.detected, plan.ml
    settings = plan.settings.forest
    return {
        "rule_anomalies": rules.rule_candidates(detected),
        "statistical_anomalies": statistics.statistical_candidates(detected),
        "ml_anomalies": ml,
        "investigation_queue": evidence.investigation_queue(hybrid, plan.features),
        "rule_summary": reports.trigger_summary(plan.rules, rules.policy_rules(plan.settings.rules)),
        "statistical_summary": reports.trigger_summary(
            plan.statistics, statistics.statistical_rules(plan.settings.stats)
        ),
        "rule_distribution": reports.score_distribution(detected, "RULE_SCORE", "RULE_SEVERITY"),
        "statistical_distribution": reports.score_distribution(
            detected, "STAT_SCORE", "STAT_SEVERITY"
        ),
        "ml_summary": reports.level_summary(ml, "ML_SEVERITY", ("NONE", "LOW", "MEDIUM", "HIGH")),
        "ml_distribution": reports.ml_distribution(
            ml, len(forest.model_features(plan.features)), settings.contamination, settings.trees
        ),
        "ml_overlap": reports.detector_overlap(hybrid),
        "hybrid_summary": reports.hybrid_kpis(hybrid),
        "score_distribution": reports.hybrid_histogram(hybrid),
        "state_overview": search.state_overview(hybrid),
        "states": search.state_dimension(hybrid),
        **{f"rejected_{name}": table for name, table in plan.rejected.items()},
    }


def publish(plan: NationalPlan, path: str) -> list[str]:
    """Write every output; hybrid risk is partitioned by state.

    Index queries nearly always name a state; ``search.query_works`` looks its
    ids up in ``states`` and reads only their files. Ranges of (state, work) keep a state's rows
    together yet split a large state over many tasks. Returns the table names.
    """
    fusion.require_consensus_first(plan.hybrid)
    by_state = plan.hybrid.repartitionByRange("STATE_ID", "WORK_ID")
    sinks.write_parquet(by_state, f"{path}/hybrid_risk", ["STATE_ID"])
    tables = output_tables(plan)
    for name, table in tables.items():
        sinks.write_parquet(table, f"{path}/{name}")
    preprocess.save_inputs(plan.model_inputs, f"{path}/model_inputs")  # a version of its own
    return ["hybrid_risk", *tables]
