"""Headline queries, timed; prints one JSON line.

Each entry runs from the driver's Parquet tables with nothing shared, except
the ``on_hybrid`` queries, which read one stored hybrid layer as a service
would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks.context import Context  # noqa: E402
from civitally.operators import evidence, reports, rules, search, statistics  # noqa: E402
from civitally.plans.regional import RegionalPlan  # noqa: E402
from civitally.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def fresh() -> Context:
        return Context(spark, sf_dir)

    shared = fresh()
    landed = shared.raw_layer  # the landed records are the input, not the work

    def regional() -> RegionalPlan:
        return RegionalPlan(landed)

    jobs = {
        "payment_summary": lambda: run(fresh().plan.payment_agg),
        "financial_master": lambda: run(fresh().plan.financial_plan),
        "consolidated_works": lambda: run(regional().works_plan),
        "features": lambda: run(fresh().plan.features_plan),
        "rule_candidates": lambda: run(rules.rule_candidates(fresh().plan.rule_table)),
        "statistical_candidates": lambda: run(
            statistics.statistical_candidates(fresh().plan.detected)
        ),
        "hybrid_without_forest": lambda: run(fresh().hybrid),
        "hybrid_with_forest": lambda: run(shared.plan.hybrid),
        "queue_on_hybrid": lambda: run(
            evidence.investigation_queue(shared.plan.hybrid, shared.plan.features)
        ),
        "search_page_on_hybrid": lambda: run(
            search.query_works(shared.plan.hybrid, search="building", scope="all").rows
        ),
        "state_overview_on_hybrid": lambda: run(search.state_overview(shared.plan.hybrid)),
        "overlap_on_hybrid": lambda: run(reports.detector_overlap(shared.plan.hybrid)),
        "feature_comparison": lambda: run(
            reports.feature_comparison(
                shared.plan.features.join(
                    shared.plan.ml.select("WORK_ID", F.col("ML_ANOMALY")), "WORK_ID"
                ),
                reports.numeric_features(shared.plan.features),
            )
        ),
        "audit_features": lambda: run(regional().features_plan),
    }
    only = sys.argv[1:]
    times = {}
    for name, job in jobs.items():
        if only and name not in only:
            continue
        start = time.time()
        job()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
