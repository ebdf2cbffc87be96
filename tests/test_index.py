"""Stored works index against the scans it stands in for."""

import random

import pytest
from pyspark.sql import functions as F

from civitally.operators import index, search

SCHEMA = ("WORK_ID long, STATE_NAME string, CONSTITUENCY string, MP_NAME string, WORK_DESCRIPTION string, "
          "ACTIVITY_NAME string, HYBRID_RISK_SCORE double, HYBRID_RISK_LEVEL string, INVESTIGATION_PRIORITY string, "
          "DETECTOR_AGREEMENT string, INVESTIGATION_CANDIDATE int, INDEPENDENT_SIGNAL_COUNT int")


def make(seed, n, first=0):
    rng = random.Random(seed)
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE", None]
    words = ["Road", "Straße", "bridge_x", "Well", "SCHOOL", "日本語の道", "a", ""]
    return [
        (first + i, rng.choice(["Goa", " Kerala ", None, "Assam"]), rng.choice(["N", "S", ""]), f"Mp {i % 7}",
         rng.choice([None, " ".join(rng.choices(words, k=3)) + f" lot{i % 50:03}"]), rng.choice(words),
         rng.choice([None, 0.0, 0.0, 35.5, round(rng.random() * 100, 1)]), rng.choice(levels),
         f"P{i % 5}", rng.choice(["ONE METHOD", "NO SIGNAL"]), rng.randrange(2), rng.randrange(4))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(make(1, 600), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def stored(works, tmp_path_factory):
    return index.write_index(works, str(tmp_path_factory.mktemp("index")), bucket_rows=60)


def rows(df):
    return [tuple(r[c] for c in sorted(df.columns) if c != "BUCKET") for r in df.collect()]


def files_read(spark, df):
    """Files opened by each scan of the rows table."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        leaves = again._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return [s.metrics().apply("numFiles").value() for s in scans if "/rows" in s.toString()
                or "rows]" in s.toString()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("scope", ["all", "candidates"])
@pytest.mark.parametrize("at", [(50, 0), (7, 118), (500, 30), (50, 299), (3, 595), (50, 5000), ("x", "-4")])
def test_pages(works, stored, scope, at):
    limit, offset = at
    got = stored.page(scope, limit, offset)
    want = search.query_works(works, scope=scope, limit=limit, offset=offset)
    assert rows(got.rows) == rows(want.rows) and rows(got.meta) == rows(want.meta)


def test_a_page_opens_few_files(spark, stored):
    whole = stored.part("rows").select("BUCKET").distinct().count()
    assert whole >= 8
    opened = files_read(spark, stored.page("all", 20, 300).rows)
    assert len(opened) == 1 and 1 <= opened[0] <= 2


@pytest.mark.parametrize("query", ["lot007", "LOT04", "road", "straße", "日本語", "語の道", "12", "a", "goa n", "mp 3 ",
                                   "zzz", "bridge_x", "%", "", None, "kerala"])
def test_search(works, stored, query):
    got, want = stored.find(query), search.search_text(works, query)
    assert sorted(rows(got), key=str) == sorted(rows(want), key=str)
    got = stored.find(query, risk="high", state="goa")
    want = search.facet_filter(search.search_text(works, query), risk="high", state="goa")
    assert sorted(rows(got), key=str) == sorted(rows(want), key=str)


def test_rare_words_do_not_scan(spark, tmp_path):
    many = spark.range(4000).selectExpr(
        "id as WORK_ID", "'Goa' as STATE_NAME", "'N' as CONSTITUENCY", "'Mp' as MP_NAME",
        "concat('work ', if(id % 1000 = 7, 'quixotic', 'plain'), ' ', id) as WORK_DESCRIPTION", "'A' as ACTIVITY_NAME",
        "cast(4000 - id as double) as HYBRID_RISK_SCORE", "'LOW' as HYBRID_RISK_LEVEL", "'P4' as INVESTIGATION_PRIORITY",
        "'ONE METHOD' as DETECTOR_AGREEMENT", "1 as INVESTIGATION_CANDIDATE", "1 as INDEPENDENT_SIGNAL_COUNT")
    stored = index.write_index(many, str(tmp_path), bucket_rows=80)
    assert [r["WORK_ID"] for r in stored.find("Quixotic").orderBy("WORK_ID").collect()] == [7, 1007, 2007, 3007]
    buckets = stored.part("rows").select("BUCKET").distinct().count()
    opened = files_read(spark, stored.find("quixotic"))
    assert buckets >= 45 and opened == [4]  # under a tenth
    assert stored.candidates("plain") is None and stored.candidates("no") is None
    scan = stored.part("postings").filter("TRIGRAM in ('qui')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(TRIGRAM), EqualTo(TRIGRAM,qui)]" in scan or "In(TRIGRAM" in scan


@pytest.mark.parametrize("facets", [{}, {"state": "goa"}, {"risk": "HIGH", "mp": "Mp 2"}, {"state": "nowhere"}])
def test_cube_answers(works, stored, facets):
    candidates = search.in_scope(works)
    assert rows(index.cube_summary(stored.cube, **facets)) == rows(search.filtered_summary(candidates, **facets))
    assert rows(index.cube_filter_values(stored.cube, **facets)) == rows(search.filter_values(candidates, **facets))
    assert rows(index.cube_state_overview(stored.cube)) == rows(search.state_overview(works))


def test_cube_after_a_reload(spark, works, stored):
    gone = works.filter("WORK_ID % 3 = 0")
    come = spark.createDataFrame(make(9, 150, first=300), SCHEMA)
    cube = index.refresh_cube(stored.cube, gone, come)
    now = works.filter("WORK_ID % 3 <> 0").unionByName(come)
    fresh = index.facet_cube(now)
    assert sorted(rows(cube), key=str) == sorted(rows(fresh), key=str)
    assert rows(index.cube_state_overview(cube)) == rows(search.state_overview(now))


def test_empty_index(works, tmp_path):
    stored = index.write_index(works.limit(0), str(tmp_path))
    assert stored.page("all").rows.count() == 0 and stored.page().meta.first()["TOTAL"] == 0
    assert stored.find("road").count() == 0 and index.cube_summary(stored.cube).first()["TOTAL"] == 0


def test_each_part_is_written_alone(works, tmp_path):
    cube = index.write_cube(works, str(tmp_path / "c"))
    assert [p.name for p in (tmp_path / "c").iterdir()] == ["cube"]
    assert rows(index.cube_state_overview(cube.cube)) == rows(search.state_overview(works))
    pages = index.write_rows(works, str(tmp_path / "p"), bucket_rows=60)
    assert {p.name for p in (tmp_path / "p").iterdir()} == {"rows", "columns", "cuts"}
    assert rows(pages.page("all", 7, 118).rows) == rows(search.query_works(works, scope="all", limit=7, offset=118).rows)


def test_folders_are_bounded(works, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_BUCKETS", 4)
    pages = index.write_rows(works, str(tmp_path), bucket_rows=2)
    assert pages.part("rows").select("BUCKET").distinct().count() <= 4 and pages.part("rows").count() == 600


def test_trigrams_are_whole_characters(spark):
    texts = ["", "ab", "abc", "aaaa", "a\nbc", "x😀y😀z", "😀😀😀😀", "日本語の道", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", index.trigrams(F.col("t")).alias("g"))
    for r in got.collect():
        want = {r["t"][i:i + 3] for i in range(len(r["t"]) - 2)} if r["t"] is not None else set()
        assert set(r["g"] or []) == want and len(r["g"] or []) == len(want), r
