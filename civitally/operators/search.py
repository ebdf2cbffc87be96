"""Works index: facets, text search, paging, overviews and chart feeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_numeric, round_even

# Facet -> column.
FACETS = {
    "state": "STATE_NAME", "constituency": "CONSTITUENCY", "mp": "MP_NAME",
    "risk": "HYBRID_RISK_LEVEL", "priority": "INVESTIGATION_PRIORITY",
    "agreement": "DETECTOR_AGREEMENT",
}
SEARCH_FIELDS = (
    "WORK_ID", "STATE_NAME", "CONSTITUENCY", "MP_NAME", "WORK_DESCRIPTION", "ACTIVITY_NAME",
)


def same_text(c: str, wanted: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == wanted.strip().lower()


def state_dimension(df: DataFrame) -> DataFrame:
    """STATE_ID, STATE_KEY: ids and normalised names; a few dozen rows."""
    return df.select(
        "STATE_ID", F.lower(F.trim(F.coalesce("STATE_NAME", F.lit("")))).alias("STATE_KEY")
    ).distinct()


def facet_filter(
    df: DataFrame, states: DataFrame | None = None, **facets: str | None
) -> DataFrame:
    """Conjunction of case-insensitive facet matches; empty facets pass.

    With ``states`` (``state_dimension``) a state is first turned into its ids, a
    filter that skips the other states' folders of a table partitioned by them.
    """
    wanted = facets.get("state")
    if states is not None and wanted:
        ids = [r["STATE_ID"] for r in states.filter(
            F.col("STATE_KEY") == wanted.strip().lower()).select("STATE_ID").distinct().collect()]
        known = [i for i in ids if i is not None]
        here = F.col("STATE_ID").isin(known)
        df = df.filter(here | F.col("STATE_ID").isNull() if len(known) < len(ids) else here)
    for name, wanted in facets.items():
        if wanted:
            df = df.filter(same_text(FACETS[name], wanted))
    return df


def search_text(df: DataFrame, query: str | None) -> DataFrame:
    """Rows whose joined text fields contain the query, ignoring case."""
    if not query or not query.strip():
        return df
    fields = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in SEARCH_FIELDS if c in df.columns]
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.strip().lower())))


def in_scope(df: DataFrame, scope: str = "candidates") -> DataFrame:
    """Candidates only, or all works; both carry IS_CANDIDATE."""
    flagged = df.withColumn("IS_CANDIDATE", F.col("INVESTIGATION_CANDIDATE") == 1)
    return flagged if scope == "all" else flagged.filter("IS_CANDIDATE")


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    meta: DataFrame
    limit: int
    offset: int


def clamp_page(limit: object = 50, offset: object = 0) -> tuple[int, int]:
    def number(v: object, default: int) -> int:
        try:
            return int(float(str(v))) or default
        except ValueError:
            return default

    return min(max(number(limit, 50), 1), 500), max(number(offset, 0), 0)


def query_works(
    df: DataFrame,
    *,
    search: str | None = None,
    scope: str = "candidates",
    limit: object = 50,
    offset: object = 0,
    states: DataFrame | None = None,
    **facets: str | None,
) -> Page:
    """Filtered, searched and paged works, highest score first.

    ``meta`` holds TOTAL, LIMIT, OFFSET and HAS_MORE. Deep pages are cheaper
    with ``after``-style paging, see ``next_page``.
    """
    size, skip = clamp_page(limit, offset)
    hits = search_text(facet_filter(in_scope(df, scope), states, **facets), search)
    rows = hits.orderBy(*_page_order()).offset(skip).limit(size)
    meta = hits.agg(F.count(F.lit(1)).alias("TOTAL")).select(
        "TOTAL", F.lit(size).alias("LIMIT"), F.lit(skip).alias("OFFSET"),
        (F.lit(skip + size) < F.col("TOTAL")).alias("HAS_MORE"),
    )
    return Page(rows, meta, size, skip)


def _page_order() -> list[Column]:
    return [
        F.coalesce("HYBRID_RISK_SCORE", F.lit(0.0)).desc(), F.col("WORK_ID").cast("string").asc()
    ]


def next_page(hits: DataFrame, score: float, work_id: str, limit: int = 50) -> DataFrame:
    """Page after a given (score, id): no rows are sorted only to be skipped."""
    s = F.coalesce("HYBRID_RISK_SCORE", F.lit(0.0))
    after = (s < score) | ((s == score) & (F.col("WORK_ID").cast("string") > work_id))
    return hits.filter(after).orderBy(*_page_order()).limit(limit)


def api_clean(df: DataFrame, text: list[str], numbers: list[str]) -> DataFrame:
    """Blank text cells to NULL and numeric text to finite numbers."""
    return df.withColumns(
        {
            **{c: F.nullif(F.col(c), F.lit("")) for c in text},
            **{c: clean_numeric(c) for c in numbers},
        }
    )


def fallback_level(score: Column) -> Column:
    """Level by score alone, for records stored without a level."""
    return (
        F.when(score >= 60, "CRITICAL").when(score >= 40, "HIGH").when(score >= 20, "MEDIUM")
        .when(score > 0, "LOW").when(score.isNotNull(), "NONE")
    )


def stored_level(df: DataFrame) -> Column:
    return F.coalesce(
        F.nullif(F.col("HYBRID_RISK_LEVEL"), F.lit("")), fallback_level(F.col("HYBRID_RISK_SCORE"))
    )


def detector_count(label: Column) -> Column:
    """How many detectors an agreement label stands for."""
    text = F.upper(F.trim(label))

    def any_of(*words: str) -> Column:
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(text, F.lit(w))
        return cond

    parts = sum(
        (F.contains(text, F.lit(w)).cast("int") for w in ("STATISTICAL", "ML")),
        F.contains(text, F.lit("RULE")).cast("int"),
    )
    return (
        F.when(label.isNull(), 0)
        .when((text == "RULE + STATISTICAL + ML") | any_of("3", "ALL THREE", "STRONG"), 3)
        .when(any_of("TWO", "2", "MODERATE"), 2)
        .when(any_of("ONE", "1", "SINGLE"), 1)
        .otherwise(parts)
    )


def national_overview(
    records: DataFrame, hybrid: DataFrame, payments: DataFrame, financial: DataFrame
) -> DataFrame:
    """One row of headline counts over four tables (scalar subqueries)."""
    def one(df: DataFrame, c: Column) -> Column:
        return df.agg(c).scalar()

    mapping = F.struct("STATE_ID", "MP_ID", "CONSTITUENCY_ID")
    named = F.coalesce(F.col("STATE_ID"), F.col("MP_ID"), F.col("CONSTITUENCY_ID")).isNotNull()
    base = hybrid.agg(
        F.count("WORK_ID").alias("UNIQUE_WORKS"),  # one row for each work
        F.count_distinct(F.nullif(F.trim("STATE_NAME"), F.lit(""))).alias("STATES_UTS"),
        F.count_distinct(F.when(named, mapping)).alias("MP_CONSTITUENCY_MAPPINGS"),
    )
    done = financial.filter(F.col("ACTUAL_AMOUNT").isNotNull())
    df = base.select(
        one(records, F.count(F.lit(1))).alias("RAW_RECORDS"), "*",
        one(payments, F.count(F.lit(1))).alias("PAYMENT_TRANSACTIONS"),
        one(done, F.count_distinct("WORK_ID")).alias("COMPLETED_RECORDS"),
        one(payments, F.count_distinct("WORK_ID")).alias("WORKS_WITH_PAYMENTS"),
    )
    works, paid = F.col("UNIQUE_WORKS"), F.col("WORKS_WITH_PAYMENTS")
    return df.withColumns(
        {
            "WORKS_WITHOUT_PAYMENTS": F.greatest(works - paid, F.lit(0)),
            "PAYMENT_COVERAGE_PERCENT": F.when(
                works > 0, round_even(paid / works * 100.0, 2)
            ).otherwise(F.lit(0.0)),
        }
    )


LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE")


def state_overview(hybrid: DataFrame) -> DataFrame:
    """Works, candidates and candidate levels per state, most candidates first."""
    candidate = F.col("INVESTIGATION_CANDIDATE") == 1
    rows = hybrid.groupBy(F.coalesce(F.trim("STATE_NAME"), F.lit("Unknown")).alias("STATE_NAME")).agg(
        F.count(F.lit(1)).alias("ANALYZED_WORKS"),
        F.count_if(candidate).alias("CANDIDATES"),
        *[
            F.count_if(candidate & (F.col("HYBRID_RISK_LEVEL") == lv)).alias(lv)
            for lv in LEVELS[:4]
        ],
    )
    rate = F.col("CANDIDATES") / F.col("ANALYZED_WORKS") * 100.0
    return rows.withColumn("CANDIDATE_RATE_PERCENT", round_even(rate, 2)).orderBy(
        F.desc("CANDIDATES"), "STATE_NAME"
    )


def filtered_summary(queue: DataFrame, **facets: str | None) -> DataFrame:
    """Level counts, agreement counts and mean score of the filtered candidates."""
    hits = facet_filter(queue, **facets)
    n = F.col("INDEPENDENT_SIGNAL_COUNT")
    # scores carry one decimal, so their sum is exact as a decimal
    mean = F.sum(F.col("HYBRID_RISK_SCORE").cast("decimal(18,1)")).cast("double") / F.nullif(
        F.count(F.lit(1)), F.lit(0)
    )
    return hits.agg(
        F.count(F.lit(1)).alias("TOTAL"),
        *[F.count_if(F.col("HYBRID_RISK_LEVEL") == lv).alias(lv) for lv in LEVELS],
        F.count_if(n == 3).alias("ALL_THREE"),
        F.count_if(n == 2).alias("TWO_METHODS"),
        F.count_if(n == 1).alias("ONE_METHOD"),
        F.coalesce(round_even(mean, 2), F.lit(0.0)).alias("AVERAGE_HYBRID_RISK_SCORE"),
    )


def filter_values(queue: DataFrame, **facets: str | None) -> DataFrame:
    """FACET, VALUE: distinct values of every facet column, sorted."""
    hits = facet_filter(queue, **facets)
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("FACET"), F.col(c).cast("string").alias("VALUE"))
            for name, c in FACETS.items()
        ]
    )
    return (
        hits.select(F.explode(pairs).alias("p")).select("p.*")
        .filter(F.coalesce(F.col("VALUE"), F.lit("")) != "")
        .distinct().orderBy("FACET", "VALUE")
    )


def chart_feeds(hybrid: DataFrame, financial: DataFrame, top: int = 10) -> DataFrame:
    """CHART, NAME, VALUE rows of the six dashboard charts, all computed."""
    def counts(df: DataFrame, chart: str, c: Column) -> DataFrame:
        return df.groupBy(c.cast("string").alias("NAME")).agg(
            F.count(F.lit(1)).cast("double").alias("VALUE")
        ).select(F.lit(chart).alias("CHART"), F.coalesce("NAME", F.lit("Unknown")).alias("NAME"), "VALUE")

    candidates = hybrid.filter(F.col("INVESTIGATION_CANDIDATE") == 1)
    states = (
        counts(candidates, "TOP_STATES", F.col("STATE_NAME"))
        .orderBy(F.desc("VALUE"), "NAME").limit(top)
    )
    money = financial.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("NAME"),
                    F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias("VALUE"),
                )
                for name, c in (
                    ("Total Sanctioned", "SANCTION_AMOUNT"),
                    ("Total Disbursed", "TOTAL_FUND_DISBURSED_AMT"),
                    ("Reported Actual", "ACTUAL_AMOUNT"),
                )
            ]
        ).alias("a")
    ).select(F.explode("a").alias("a")).select(F.lit("SPENDING").alias("CHART"), "a.NAME", "a.VALUE")
    out = counts(hybrid, "RISK", F.col("HYBRID_RISK_LEVEL"))
    for part in (
        counts(candidates, "CONSENSUS", F.col("INDEPENDENT_SIGNAL_COUNT")),
        states,
        counts(hybrid, "CATEGORY", F.col("WORK_CATEGORY")),
        counts(hybrid, "STAGE", F.col("WORK_STAGE")),
        money,
    ):
        out = out.unionByName(part)
    return out
