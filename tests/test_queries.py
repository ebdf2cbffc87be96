"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry_module
from checks import compare
from checks.context import shared_context
from checks.queries import _RECORD, REGISTRY
from civitally.operators import cleaning

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SMALL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, con, name):
    ok, note = compare.compare(spark, con, name, SMALL)
    assert ok, note


def test_contract(spark):
    queries, twins = entry_module.queries(), entry_module.oracle_sql()
    assert set(twins) <= set(queries) and len(twins) > 100
    result = entry_module.entry(spark)
    assert result.count() == 100 and result.first()["RULE_SCORE"] >= 60


def test_collection_audits_take_every_column(spark):
    queries, records = entry_module.queries(), shared_context(spark, SMALL).raw.drop("_ord")
    assert set(_RECORD) == set(records.columns)
    profile = {r["COLUMN"] for r in queries["va02_collection_missing_profile"](spark, SMALL).collect()}
    one = cleaning.most_complete(shared_context(spark, SMALL).raw).toPandas().drop(columns="_ord")
    assert profile == {c for c in one.columns if one[c].isna().any()}
    rows = records.toPandas()
    got = queries["va02_record_duplicates"](spark, SMALL).first()
    assert (got["ROWS"], got["DUPLICATE_ROWS"]) == (len(rows), int(rows.duplicated().sum()))
