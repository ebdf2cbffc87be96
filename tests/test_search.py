import pytest
from pyspark.sql import functions as F

from civitally.operators import search


@pytest.fixture(scope="module")
def works(spark):
    rows = [
        (1, "Goa", "North", "Asha", "Road works", "A", 90.0, "CRITICAL", "P1", "ONE METHOD", 1, 1),
        (2, "Goa", "South", "Bina", "School", "B", 90.0, "CRITICAL", "P1", "ONE METHOD", 1, 1),
        (10, "Kerala", "West", "Chand", None, "road", 10.0, "LOW", "P4", "NO SIGNAL", 0, 0),
    ]
    return spark.createDataFrame(
        rows, "WORK_ID long, STATE_NAME string, CONSTITUENCY string, MP_NAME string, WORK_DESCRIPTION string, "
        "ACTIVITY_NAME string, HYBRID_RISK_SCORE double, HYBRID_RISK_LEVEL string, INVESTIGATION_PRIORITY string, "
        "DETECTOR_AGREEMENT string, INVESTIGATION_CANDIDATE int, INDEPENDENT_SIGNAL_COUNT int")


def ids(df):
    return [r["WORK_ID"] for r in df.collect()]


def test_filters_and_search(works):
    assert ids(search.facet_filter(works, state=" goa ", mp="BINA")) == [2]
    assert ids(search.facet_filter(works, state="", risk=None)) == [1, 2, 10]
    assert ids(search.search_text(works, " ROAD ")) == [1, 10]
    assert ids(search.search_text(works, "10")) == [10]


def test_paging(works):
    page = search.query_works(works, scope="all", limit=2, offset=0)
    assert ids(page.rows) == [1, 2]
    meta = page.meta.first()
    assert (meta["TOTAL"], meta["LIMIT"], meta["OFFSET"], meta["HAS_MORE"]) == (3, 2, 0, True)
    assert ids(search.query_works(works, scope="all", limit=2, offset=2).rows) == [10]
    assert ids(search.query_works(works).rows) == [1, 2]
    assert ids(search.next_page(works, 90.0, "1")) == [2, 10]


@pytest.mark.parametrize("limit, offset, want", [
    (None, None, (50, 0)), ("0", "-3", (50, 0)), ("9999", "7", (500, 7)), ("abc", "x", (50, 0)), (-4, 2, (1, 2)),
])
def test_clamp(limit, offset, want):
    assert search.clamp_page(limit, offset) == want


def test_detector_counts(spark):
    labels = ["RULE + STATISTICAL + ML", "TWO METHODS AGREE", "ONE METHOD", "NO SIGNAL", "STRONG", "SINGLE_DETECTOR",
              "RULE + ML", None, "MODERATE"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    got = [r[0] for r in df.select(search.detector_count(F.col("l"))).collect()]
    assert got == [3, 2, 1, 0, 3, 1, 2, 0, 2]


def test_levels_and_empty_summary(spark, works):
    df = spark.createDataFrame([(60.0,), (59.9,), (20.0,), (0.5,), (0.0,), (None,)], "s double")
    got = [r[0] for r in df.select(search.fallback_level(F.col("s"))).collect()]
    assert got == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE", None]
    empty = search.filtered_summary(works, state="nowhere").first()
    assert empty["TOTAL"] == 0 and empty["AVERAGE_HYBRID_RISK_SCORE"] == 0.0
