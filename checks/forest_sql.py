"""The isolation forest as SQL: samples, trees level by level, scores of all works.

Every draw of the forest is a hash, so the query grows the same trees. Nodes are
numbered by path (1, then twice the number for the left child, one more for the
right), features by the order of their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from civitally.config import ForestConfig
from civitally.operators.forest import CORE_FEATURES, DRAWS, SEED_SPACE
from civitally.plans.regional import AUDIT_FOREST

SPACE = f"{float(DRAWS)!r}::DOUBLE"
SEVERITY = """CASE WHEN ML_PERCENTILE >= 99 THEN 'HIGH' WHEN ML_PERCENTILE >= 97.5 THEN 'MEDIUM'
  WHEN ML_PERCENTILE >= 95 THEN 'LOW' ELSE 'NONE' END"""


def drawn(*parts: object) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 12) AS BIGINT)"


def average_path(n: str) -> str:
    big = f"greatest({n}, 3)::DOUBLE"
    return (f"CASE WHEN {n} > 2 THEN 2e0 * (ln({big} - 1e0) + 0.5772156649015329::DOUBLE) - 2e0 * ({big} - 1e0) / {big} "
            f"WHEN {n} = 2 THEN 1e0 ELSE 0e0 END")


def forest_relations(p: str, source: str, features: Sequence[str], config: ForestConfig) -> dict[str, str]:
    """Relations named ``p``...: ``{p}strength`` holds WORK_ID, S. A level of the trees is
    a relation of its own; tables of fewer works than a sample are out of its reach."""
    names = sorted(features)
    trees, seed, depth = config.trees, config.seed, math.ceil(math.log2(config.sample))
    steps = [s for s in range(1, max(trees, 2)) if math.gcd(s, trees) == 1]
    wanted = " UNION ALL ".join(
        f"SELECT {k}::SMALLINT AS K, '{n}' AS NAME, WORK_ID, CAST({n} AS DOUBLE) AS V FROM {source}"
        for k, n in enumerate(names))
    out = {
        f"{p}melted": wanted,
        f"{p}medians": f"""SELECT K, any_value(NAME) AS NAME, quantile_cont(V, 0.5) AS M FROM {p}melted WHERE isfinite(V)
GROUP BY 1 HAVING min(V) < max(V)""",
        f"{p}values": f"""SELECT K, WORK_ID, CASE WHEN isfinite(V) THEN V ELSE M END AS X FROM {p}melted JOIN {p}medians USING (K)""",
        f"{p}share": f"""SELECT SHARE, floor({trees} * SHARE) AS WHOLE FROM (
  SELECT least(1e0, {1.5 * config.sample!r}::DOUBLE / count(*)) AS SHARE FROM {source})""",
        f"{p}joined": f"""SELECT WORK_ID, {drawn(seed, 1, 'WORK_ID')} % {trees} AS FIRST_TREE,
  ({steps})[{drawn(seed, 2, 'WORK_ID')} % {len(steps)} + 1] AS STEP, unnest(range(CAST(WHOLE AS BIGINT) +
  CASE WHEN {drawn(seed, 0, 'WORK_ID')} % {SEED_SPACE} < floor(({trees} * SHARE - WHOLE) * {SEED_SPACE}) THEN 1 ELSE 0 END)) AS I
FROM {source}, {p}share""",
        f"{p}level0": f"""SELECT TREE, WORK_ID, 1::SMALLINT AS P FROM (
  SELECT ((FIRST_TREE + I * STEP) % {trees})::SMALLINT AS TREE, WORK_ID FROM {p}joined)
QUALIFY row_number() OVER (PARTITION BY TREE ORDER BY {drawn(seed + 1, 'TREE', 'WORK_ID')}, WORK_ID) <= {config.sample}""",
        f"{p}usable": f"""SELECT T::SMALLINT AS TREE, K FROM range({trees}) AS t(T), {p}medians
QUALIFY row_number() OVER (PARTITION BY T ORDER BY {drawn(seed, 'T', 'NAME')}, NAME)
  <= greatest(1, floor({config.max_features!r}::DOUBLE * (SELECT count(*) FROM {p}medians)))""",
        f"{p}walk0": f"SELECT WORK_ID, T::SMALLINT AS TREE, 1::SMALLINT AS P FROM {source}, range({trees}) AS t(T)",
    }
    lengths = []
    for d in range(depth + 1):
        if d < depth:
            out[f"{p}ends{d}"] = f"""SELECT TREE, P, K, min(X) AS LO, max(X) AS HI FROM {p}level{d} JOIN {p}usable USING (TREE)
  JOIN {p}values USING (WORK_ID, K) GROUP BY ALL HAVING min(X) < max(X)"""
            out[f"{p}splits{d}"] = f"""SELECT TREE, P, K, CASE WHEN CUT < HI THEN CUT ELSE LO END AS CUT FROM (
  SELECT *, LO + {drawn(seed, 'TREE', 'P', "'cut'")} / {SPACE} * (HI - LO) AS CUT FROM {p}ends{d}
  QUALIFY row_number() OVER (PARTITION BY TREE, P ORDER BY K) - 1
    = {drawn(seed, 'TREE', 'P', "'feature'")} % count(*) OVER (PARTITION BY TREE, P))"""
            for kind in ("level", "walk"):
                out[f"{p}{kind}{d + 1}"] = f"""SELECT TREE, WORK_ID, (2 * P + CASE WHEN X <= CUT THEN 0 ELSE 1 END)::SMALLINT AS P
FROM {p}{kind}{d} JOIN {p}splits{d} USING (TREE, P) JOIN {p}values USING (WORK_ID, K)"""
        left_out = f" ANTI JOIN {p}splits{d} USING (TREE, P)" if d < depth else ""
        out[f"{p}leaves{d}"] = f"""SELECT TREE, P, round(({d} + {average_path('N')}) * 4294967296e0) / 4294967296e0 AS LENGTH FROM (
  SELECT TREE, P, count(*) AS N FROM {p}level{d}{left_out} GROUP BY ALL)"""
        lengths.append(f"SELECT WORK_ID, sum(LENGTH) AS L FROM {p}walk{d} JOIN {p}leaves{d} USING (TREE, P) GROUP BY 1")
    out[f"{p}strength"] = f"""SELECT WORK_ID, pow(2e0, -((sum(L) / {trees}e0) / ({average_path(config.sample)}))) AS S
FROM ({' UNION ALL '.join(lengths)}) GROUP BY 1"""
    return out


NATIONAL = ForestConfig()
FITTED_SQL = {
    **forest_relations("nf_", "feat", [k for k in CORE_FEATURES if k != "FLAG"], NATIONAL),
    "nf_ranked": """SELECT WORK_ID, S, (rank() OVER (ORDER BY S) - 1 + (count(*) OVER (PARTITION BY S) + 1) / 2e0)
  / count(*) OVER () * 100e0 AS ML_PERCENTILE FROM nf_strength""",
    "ml": f"""SELECT WORK_ID, -S AS IF_RAW_SCORE, 0.5e0 - S AS IF_DECISION_SCORE, S AS ML_ANOMALY_STRENGTH, ML_PERCENTILE,
  CASE WHEN S > 0.5e0 THEN 1 ELSE 0 END AS ML_ANOMALY, {SEVERITY} AS ML_SEVERITY FROM nf_ranked""",
}


def audit_relations(source: str, features: Sequence[str]) -> dict[str, str]:
    """The first generation's forest over ``source``; ``gf_scores`` holds its results."""
    return {
        **forest_relations("gf_", source, features, AUDIT_FOREST),
        "gf_scaled": f"""SELECT WORK_ID, S, quantile_cont(S, {1.0 - AUDIT_FOREST.contamination!r}) OVER () AS CUT,
  (S - min(S) OVER ()) / (max(S) OVER () - min(S) OVER ()) * 100e0 AS R FROM gf_strength""",
        "gf_scores": """SELECT WORK_ID, CASE WHEN S > CUT THEN -1 ELSE 1 END AS ISOLATION_FOREST_PREDICTION,
  round_even((CUT - S) * 1e6, 0) / 1e6 AS ISOLATION_FOREST_DECISION_SCORE, S > CUT AS ISOLATION_FOREST_ANOMALY_FLAG,
  round_even(R * 100e0, 0) / 100e0 AS ISOLATION_FOREST_SCORE FROM gf_scaled""",
    }
