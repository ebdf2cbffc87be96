"""Registered queries: a Spark plan each, with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civitally.config import FusionConfig, Skew
from civitally.functions import scalar as fn
from civitally.functions import text as tx
from civitally.operators import (
    aggregates, audit, cleaning, columns, evidence, explain, features, forest, fusion, index, joining,
    preprocess, ranking, reports, rules, search, statistics,
)
from civitally.plans.national import NationalPlan
from civitally.plans.regional import results_sorted
from civitally.session import layer_root, settle
from civitally.sources import landed, sinks, testbed
from civitally.sources.schemas import COMPLETED
from civitally.streaming.summary import PaymentSummaryTable

from . import sql as S
from .context import Context, shared_context
from .forest_sql import FITTED_SQL, audit_relations
from .spec import spark_select


@dataclass(frozen=True)
class Query:
    build: Callable[[Context], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(shared_context(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def register(name: str, spec: str, source: str | None, *, sql: str | None = None,
             extra: dict[str, str] | None = None, tail: str = ""):
    """``source`` names a SQL relation; ``sql`` is a relation body of its own."""
    def wrap(build: Callable[[Context], DataFrame]):
        if name in REGISTRY:
            raise ValueError(name)
        twin = None
        if sql is not None:
            twin = S.query(spec, "answer", {**(extra or {}), "answer": sql}, tail)
        elif source is not None:
            twin = S.query(spec, source, extra, tail)
        REGISTRY[name] = Query(lambda ctx: spark_select(build(ctx), spec), twin)
        return build

    return wrap


def rows_only(name: str):
    def wrap(build: Callable[[Context], DataFrame]):
        REGISTRY[name] = Query(build, None)
        return build

    return wrap


# --- sources, cleansing, de-duplication ---------------------------------------------------

WORK_SPEC = (
    "WORK_ID:i STATE_ID:i STATE_NAME:s CONSTITUENCY_ID:i CONSTITUENCY:s MP_ID:i MP_NAME:s "
    "WORK_CATEGORY:s ACTIVITY_NAME:s WORK_DESCRIPTION:s WORK_STAGE:s SOURCE_KEY:s "
    "RECOMMENDED_AMOUNT:m SANCTION_AMOUNT:m RECOMMENDATION_DATE:t SANCTION_DATE:t ATTACH_ID:i "
    "FILE_STATUS:s"
)


@register("src05_works", WORK_SPEC, "works")
def _(c):
    return c.works


@register("src05_payments", "WORK_ID:i VENDOR_ID:i VENDOR_NAME:s FUND_DISBURSED_AMT:m "
          "EXPENDITURE_DATE:t WORK_STATUS:s LETTER_NO:s IA_NAME:s IDA_NAME:s", "pays")
def _(c):
    return aggregates.payment_rows(c.payments)


@register("src05_completions", "WORK_ID:i ACTUAL_AMOUNT:m ACTUAL_END_DATE:t AVERAGE_RATING:d", "dones")
def _(c):
    return c.completions


@register("src06_raw_records", "WORK_RECOMMENDATION_DTL_ID:s WORK_ID:s STATE_NAME:s MP_NAME:s "
          "RECOMMENDED_AMOUNT:s SANCTION_AMOUNT:s ACTUAL_AMOUNT:s FUND_DISBURSED_AMT:s "
          "EXPENDITURE_DATE:s ACTUAL_END_DATE:s SOURCE_KEY:s ORD:s", None,
          sql="SELECT *, DTL_ID AS WORK_RECOMMENDATION_DTL_ID, WORK_NO AS WORK_ID FROM raw")
def _(c):
    merged = landed.combine_batches([c.raw])
    return landed.work_like(merged).withColumnsRenamed({"_SOURCE_KEY": "SOURCE_KEY", "_ord": "ORD"})


@register("src01_payload_records", "STATE:s K:s N:i", None, sql="""
SELECT event_type AS STATE, json_extract_string(props, '$.k') AS K, count(*) AS N
FROM events GROUP BY 1, 2""")
def _(c):
    # each event's JSON object lands as a payload whose one value is a JSON-encoded list
    events = c.spark.read.parquet(f"{c.dir}/events.parquet")
    payloads = events.select(
        "event_type",
        F.to_json(F.struct(F.concat(F.lit("["), "props", F.lit("]")).alias("list"))).alias("payload"),
    )
    rows = landed.project_records(landed.flatten_payloads(payloads), ["k"])
    return rows.groupBy(F.col("event_type").alias("STATE"), F.col("k").alias("K")).agg(
        F.count(F.lit(1)).alias("N")
    )


@register("src08_tag_source", "_SOURCE_KEY:s _STATE_NAME:s _MP_ID:s N:i", None, sql="""
SELECT 'Works Completed' AS _SOURCE_KEY, 'Alpha' AS _STATE_NAME, '7' AS _MP_ID, count(*) AS N FROM dones""")
def _(c):
    mapping = {"state_id": 1, "state_name": "Alpha", "mp_id": 7, "mp_name": "M", "constituency_id": 3,
               "constituency": "Seat"}
    tagged = landed.tag_source(c.completions, COMPLETED, mapping)
    return tagged.groupBy("_SOURCE_KEY", "_STATE_NAME", "_MP_ID").agg(F.count(F.lit(1)).alias("N"))


TRIP_SPEC = "WORK_ID:i STATE_NAME:s SANCTION_AMOUNT:m SANCTION_DATE:t WORK_DESCRIPTION:s"


def _round_trip(c, write, read) -> DataFrame:
    """The works table written to the shared folder and read back."""
    path = f"{layer_root(c.spark)}/civitally/trip-{uuid.uuid4().hex}"
    write(c.works.select("WORK_ID", "STATE_NAME", "SANCTION_AMOUNT", "SANCTION_DATE", "WORK_DESCRIPTION"), path)
    return read(path, T.StructType([c.works.schema[n] for n in (
        "WORK_ID", "STATE_NAME", "SANCTION_AMOUNT", "SANCTION_DATE", "WORK_DESCRIPTION")]))


@register("src02_json_round_trip", TRIP_SPEC, "works")
def _(c):
    return _round_trip(c, sinks.write_json, lambda path, schema: landed.read_json_records(
        c.spark, path, schema, multi_line=False))


@register("src03_typed_csv_round_trip", TRIP_SPEC, "works")
def _(c):
    return _round_trip(c, sinks.write_csv, lambda path, schema: landed.read_csv_table(
        c.spark, path, schema))


@register("src10_raw_json_round_trip", "DTL_ID:s ORD:s SOURCE_KEY:s AMOUNT:s", None, sql="""
SELECT DTL_ID, ORD, SOURCE_KEY, FUND_DISBURSED_AMT AS AMOUNT FROM raw""")
def _(c):
    path = f"{layer_root(c.spark)}/civitally/trip-{uuid.uuid4().hex}"
    sinks.write_json(c.raw, path)
    rows = landed.read_json_records(c.spark, path, c.raw.schema, multi_line=False)
    return rows.select(F.col("WORK_RECOMMENDATION_DTL_ID").alias("DTL_ID"), F.col("_ord").alias("ORD"),
                       F.col("_SOURCE_KEY").alias("SOURCE_KEY"), F.col("FUND_DISBURSED_AMT").alias("AMOUNT"))


@register("src11_evidence_json_round_trip", "WORK_ID:i RATIO:d AMOUNT:m VALUES:i HELD:i", None, sql="""
SELECT WORK_ID, CASE WHEN WORK_ID % 5 > 1 THEN CAST(SANCTION_AMOUNT AS DOUBLE) / 7 END AS RATIO, SANCTION_AMOUNT AS AMOUNT, 2 AS VALUES,
  CASE WHEN WORK_ID % 5 > 1 AND SANCTION_AMOUNT IS NOT NULL THEN 1 ELSE 0 END AS HELD FROM works""")
def _(c):
    # nested numbers, of which some are no JSON numbers
    path = f"{layer_root(c.spark)}/civitally/trip-{uuid.uuid4().hex}"
    bad = F.when(F.col("WORK_ID") % 5 == 0, float("nan")).when(F.col("WORK_ID") % 5 == 1, float("-inf"))
    ratio = F.coalesce(bad, F.col("SANCTION_AMOUNT").cast("double") / 7)
    nested = c.works.select("WORK_ID", F.struct(ratio.alias("RATIO"), F.col("SANCTION_AMOUNT").alias("AMOUNT"),
                                                F.array(ratio, F.lit(None)).alias("SERIES")).alias("FACTS"))
    sinks.write_evidence_json(nested, path)
    rows = landed.read_json_records(c.spark, path, nested.schema, multi_line=False)
    return rows.select("WORK_ID", "FACTS.RATIO", "FACTS.AMOUNT", F.size("FACTS.SERIES").alias("VALUES"),
                       F.size(F.array_compact("FACTS.SERIES")).alias("HELD"))


@register("src14_preferred_columns", "FIRST:m SECOND:i THIRD:s", None, sql="""
SELECT SANCTION_AMOUNT AS FIRST, WORK_ID AS SECOND, STATE_NAME AS THIRD FROM works""")
def _(c):
    # read by position, as a spreadsheet shows the columns
    path = f"{layer_root(c.spark)}/civitally/trip-{uuid.uuid4().hex}"
    table = c.works.select("WORK_ID", "STATE_NAME", "SANCTION_AMOUNT")
    sinks.write_csv(sinks.order_columns(table, ["SANCTION_AMOUNT", "ABSENT"]), path)
    return landed.read_csv_table(c.spark, path).toDF("FIRST", "SECOND", "THIRD")


@register("cln17_infinite_is_missing", "WORK_ID:i VALUE:d", None, sql="""
SELECT WORK_ID, CASE WHEN WORK_ID % 5 > 1 THEN CAST(SANCTION_AMOUNT AS DOUBLE) / 7 END AS VALUE FROM works""")
def _(c):
    bad = F.when(F.col("WORK_ID") % 5 == 0, float("inf")).when(F.col("WORK_ID") % 5 == 1, float("-inf"))
    value = F.coalesce(bad, F.col("SANCTION_AMOUNT").cast("double") / 7)
    return c.works.withColumn("VALUE", value).select("WORK_ID", fn.finite("VALUE").alias("VALUE"))


@register("src04_text_csv_round_trip", "WORK_ID:s STATE_NAME:s AMOUNT:m", None, sql="""
SELECT CAST(WORK_ID AS VARCHAR) AS WORK_ID, STATE_NAME, SANCTION_AMOUNT AS AMOUNT FROM works""")
def _(c):
    rows = _round_trip(c, sinks.write_csv, lambda path, _: landed.read_csv_table(c.spark, path))
    return rows.withColumn("AMOUNT", fn.clean_money("SANCTION_AMOUNT"))


@register("src09_partitioned_round_trip", "STATE_NAME:s N:i TOTAL:m", None, sql="""
SELECT STATE_NAME, count(*) AS N, sum(SANCTION_AMOUNT) AS TOTAL FROM works GROUP BY 1""")
def _(c):
    named = lambda df, path: sinks.write_parquet(df, path, ["STATE_NAME"])
    rows = _round_trip(c, named, lambda path, _: landed.read_columns(
        c.spark, path, ["STATE_NAME", "SANCTION_AMOUNT", "NO_SUCH_COLUMN"]))
    return rows.groupBy("STATE_NAME").agg(
        F.count(F.lit(1)).alias("N"), F.sum("SANCTION_AMOUNT").alias("TOTAL"))


@register("cln01_clean_numeric_dates", "ORD:s AMOUNT:m PAID_ON:t VENDOR:i", None, sql="""
SELECT ORD, TRY_CAST(FUND_DISBURSED_AMT AS DECIMAL(18,2)) AS AMOUNT,
  CAST(try_strptime(EXPENDITURE_DATE, '%d-%m-%Y') AS DATE) AS PAID_ON, TRY_CAST(VENDOR_ID AS BIGINT) AS VENDOR
FROM raw WHERE FUND_DISBURSED_AMT IS NOT NULL""")
def _(c):
    return cleaning.extract_payments(c.raw).select(
        F.col("_ord").alias("ORD"), F.col("FUND_DISBURSED_AMT").alias("AMOUNT"),
        F.col("EXPENDITURE_DATE").alias("PAID_ON"), F.col("VENDOR_ID").alias("VENDOR"),
    )


@register("cln05_peer_keys", "WORK_ID:i STATE_NAME:s WORK_CATEGORY:s ACTIVITY_NAME:s", "keyed")
def _(c):
    return cleaning.fill_peer_keys(c.works, features.PEER_KEYS)


@register("cln07_key_profile", "ROWS:i MISSING_KEYS:i UNIQUE_KEYS:i DUPLICATE_ROWS:i", None, sql="""
SELECT count(*) AS ROWS, count(*) - count(DTL_ID) AS MISSING_KEYS, count(DISTINCT DTL_ID) AS UNIQUE_KEYS,
  count(DTL_ID) - count(DISTINCT DTL_ID) AS DUPLICATE_ROWS FROM raw""")
def _(c):
    return cleaning.key_profile(c.raw, "WORK_RECOMMENDATION_DTL_ID")


@register("cln06_quarantine_counts", "REJECTED:s N:i", None, sql="""
SELECT 'payments_without_id' AS REJECTED, count(*) AS N FROM raw WHERE FUND_DISBURSED_AMT IS NOT NULL AND VENDOR_ID = '7'
UNION ALL SELECT 'completions_without_id', count(*) FROM raw
  WHERE SOURCE_KEY = 'Works Completed' AND ACTUAL_AMOUNT IS NOT NULL AND CAST(AVERAGE_RATING AS DOUBLE) >= 4
UNION ALL SELECT 'records_without_work', count(*) FROM raw WHERE SOURCE_KEY = 'Works Sanctioned' AND CAST(SANCTION_AMOUNT AS DOUBLE) > 200000""")
def _(c):
    # ids that cannot be read, ids that are absent, and records that name no work at all
    nameless = (F.col("_SOURCE_KEY") == "Works Sanctioned") & (
        F.col("SANCTION_AMOUNT").cast("double") > 200000)
    detail = (
        F.when((F.col("VENDOR_ID") == "7") & F.col("FUND_DISBURSED_AMT").isNotNull(), "unreadable")
        .when((F.col("_SOURCE_KEY") == COMPLETED) & (F.col("AVERAGE_RATING").cast("double") >= 4),
              F.lit(None))
        .when(nameless, "0")
        .otherwise(F.col("WORK_RECOMMENDATION_DTL_ID"))
    )
    number = F.when(nameless, F.lit("")).otherwise(F.col("WORK_ID"))
    damaged = c.raw_layer.withColumns({"WORK_RECOMMENDATION_DTL_ID": detail, "WORK_ID": number})
    rejected = NationalPlan.from_records(damaged, c.settings).rejected
    names = ("payments_without_id", "completions_without_id", "records_without_work")
    return reduce(DataFrame.unionByName, [
        rejected[n].agg(F.count(F.lit(1)).alias("N")).withColumn("REJECTED", F.lit(n)) for n in names])


@register("cln08_one_to_one", "NAME:s ROWS:i MISSING_KEYS:i UNIQUE_KEYS:i DUPLICATE_ROWS:i", None, sql="""
SELECT NAME, count(*) AS ROWS, count(*) - count(WORK_ID) AS MISSING_KEYS, count(DISTINCT WORK_ID) AS UNIQUE_KEYS,
  count(WORK_ID) - count(DISTINCT WORK_ID) AS DUPLICATE_ROWS FROM (
  SELECT 'works' AS NAME, WORK_ID FROM works UNION ALL SELECT 'completions', WORK_ID FROM dones
  UNION ALL SELECT 'financial', WORK_ID FROM works UNION ALL SELECT 'payments', WORK_ID FROM pays) GROUP BY NAME""")
def _(c):
    tables = {"works": c.works, "completions": c.completions, "financial": c.plan.financial,
              "payments": aggregates.payment_rows(c.payments)}
    return reduce(DataFrame.unionByName, [
        cleaning.key_profile(df, "WORK_ID").withColumn("NAME", F.lit(n)) for n, df in tables.items()])


@register("cln09_rows_preserved", "STAGE:s ROWS:i", None, sql=" UNION ALL ".join(
    f"SELECT '{s}' AS STAGE, count(*) AS ROWS FROM works"
    for s in ("financial", "features", "detected", "hybrid")))
def _(c):
    stages = {"financial": c.plan.financial, "features": c.plan.features,
              "detected": c.plan.detected, "hybrid": c.hybrid}
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("ROWS")).withColumn("STAGE", F.lit(n))
        for n, df in stages.items()])


@register("cln18_completion_conflicts", "WORK_ID:i RECORDS:i VERSIONS:i", None, sql="""
SELECT WORK_ID, count(*) AS RECORDS, count(DISTINCT ROW(ACTUAL_AMOUNT, ACTUAL_END_DATE)) AS VERSIONS FROM (
  SELECT WORK_ID, ACTUAL_AMOUNT, ACTUAL_END_DATE FROM dones
  UNION ALL SELECT WORK_ID, ACTUAL_AMOUNT, ACTUAL_END_DATE FROM dones WHERE AVERAGE_RATING >= 4
  UNION ALL SELECT WORK_ID, ACTUAL_AMOUNT + 1, ACTUAL_END_DATE FROM dones WHERE ACTUAL_AMOUNT > 100000)
GROUP BY WORK_ID HAVING count(*) > 1""")
def _(c):
    # well rated completions landed twice, large ones with another amount
    again = c.completions.filter("AVERAGE_RATING >= 4")
    other = c.completions.filter("ACTUAL_AMOUNT > 100000").withColumn(
        "ACTUAL_AMOUNT", (F.col("ACTUAL_AMOUNT") + 1).cast(c.completions.schema["ACTUAL_AMOUNT"].dataType))
    return cleaning.completion_conflicts(c.completions.unionByName(again).unionByName(other))


@register("cln10_exact_dedup", "SOURCE_KEY:s N:i", None, sql="""
SELECT SOURCE_KEY, count(*) AS N FROM (SELECT DISTINCT * EXCLUDE (ORD) FROM raw) GROUP BY 1""")
def _(c):
    return cleaning.exact_dedup(c.raw.drop("_ord")).groupBy(
        F.col("_SOURCE_KEY").alias("SOURCE_KEY")
    ).agg(F.count(F.lit(1)).alias("N"))


@register("cln11_keep_first", "DTL_ID:s ORD:s SOURCE_KEY:s", None, sql="""
SELECT DTL_ID, min(ORD) AS ORD, arg_min(SOURCE_KEY, ORD) AS SOURCE_KEY FROM raw GROUP BY 1""")
def _(c):
    slim = c.raw.select(F.col("WORK_RECOMMENDATION_DTL_ID").alias("DTL_ID"), F.col("_ord").alias("ORD"),
                        F.col("_SOURCE_KEY").alias("SOURCE_KEY"))
    return cleaning.keep_first(slim, "DTL_ID", ["ORD"])


@register("cln12_dedup_payments", "WORK_ID:i VENDOR_ID:i FUND_DISBURSED_AMT:m EXPENDITURE_DATE:t BATCH:i",
          None, sql="""
SELECT WORK_ID, VENDOR_ID, FUND_DISBURSED_AMT, EXPENDITURE_DATE, min(BATCH) AS BATCH FROM (
  SELECT *, 1 AS BATCH FROM pays UNION ALL SELECT *, 2 AS BATCH FROM pays WHERE IA_NAME IS NOT NULL)
GROUP BY 1, 2, 3, 4""")
def _(c):
    # part of the payments is landed a second time
    again = c.payments.filter(F.col("IA_NAME").isNotNull()).withColumn("BATCH", F.lit(2))
    both = c.payments.withColumn("BATCH", F.lit(1)).unionByName(again)
    return cleaning.dedup_payments(both, ["BATCH", "SRC_LINE", "SRC_ITEM"])


_RICH = " + ".join(f"CASE WHEN {f} IS NOT NULL AND {f} NOT IN ('', 'nan') THEN 1 ELSE 0 END"
                   for f in ("SANCTION_AMOUNT", "ACTUAL_AMOUNT", "SANCTION_DATE", "ACTUAL_END_DATE", "WORK_STAGE"))


@register("cln13_most_complete", "DTL_ID:s SOURCE_KEY:s ORD:s SANCTION_AMOUNT:s", None, sql=f"""
SELECT DTL_ID, SOURCE_KEY, ORD, SANCTION_AMOUNT FROM (
  SELECT *, row_number() OVER (PARTITION BY DTL_ID ORDER BY {_RICH} DESC, ORD) AS RN FROM raw) WHERE RN = 1""")
def _(c):
    return cleaning.most_complete(c.raw).withColumnsRenamed(
        {"WORK_RECOMMENDATION_DTL_ID": "DTL_ID", "_SOURCE_KEY": "SOURCE_KEY", "_ord": "ORD"}
    )


@register("cln14_last_mapping", "MP_ID:i CONSTITUENCY_ID:i WORK_ID:i STATE_NAME:s", None, sql="""
SELECT MP_ID, CONSTITUENCY_ID, max(WORK_ID) AS WORK_ID, arg_max(coalesce(STATE_NAME, ''), WORK_ID) AS STATE_NAME
FROM works GROUP BY 1, 2""")
def _(c):
    kept = cleaning.keep_last(c.works, ["MP_ID", "CONSTITUENCY_ID"], ["WORK_ID"])
    return kept.withColumn("STATE_NAME", F.coalesce("STATE_NAME", F.lit("")))


@register("cln15_possible_duplicates", "WORK_ID:i VENDOR_ID:i SRC_LINE:i SRC_ITEM:i "
          "POSSIBLE_DUPLICATE:i", None, sql="""
SELECT WORK_ID, VENDOR_ID, SRC_LINE, SRC_ITEM,
  CASE WHEN count(*) OVER (PARTITION BY WORK_ID, WORK_STATUS) > 1 THEN 1 ELSE 0 END AS POSSIBLE_DUPLICATE
FROM pays""")
def _(c):
    return cleaning.flag_possible_duplicates(c.payments, ["WORK_ID", "WORK_STATUS"], "SRC_ITEM")


@register("cln16_transaction_numbers", "POSITION:i TRANSACTION_ID:i", None, sql="""
SELECT POSITION, row_number() OVER (ORDER BY POSITION) AS TRANSACTION_ID
FROM (SELECT event_id * 7 + 3 AS POSITION FROM events)""")
def _(c):
    events = c.spark.read.parquet(f"{c.dir}/events.parquet")
    return cleaning.number_transactions(
        events.select((F.col("event_id") * 7 + 3).alias("POSITION")), "POSITION"
    )


@register("cln19_discover_mappings", "mp_id:i constituency_id:i", None, sql="""
SELECT DISTINCT MP_ID AS mp_id, CONSTITUENCY_ID AS constituency_id FROM works WHERE MP_ID IS NOT NULL""")
def _(c):
    candidates = c.works.filter(F.col("MP_ID").isNotNull()).select(
        F.col("MP_ID").alias("mp_id"), F.upper("MP_NAME").alias("mp_name"),
        F.col("CONSTITUENCY_ID").alias("constituency_id"),
    )
    wrong = candidates.withColumn("constituency_id", F.col("constituency_id") + 50000)
    return landed.discover_mappings(c.raw, candidates.unionByName(wrong).distinct())


@register("cln20_work_master", "WORK_ID:i STATE_ID:i STATE_NAME:s CONSTITUENCY_ID:i MP_ID:i MP_NAME:s "
          "SOURCE_KEY:s SANCTION_AMOUNT:m RECOMMENDED_AMOUNT:m", None, sql=f"""
SELECT CAST(DTL_ID AS BIGINT) AS WORK_ID, STATE_ID, STATE_NAME, CONSTITUENCY_ID, MP_ID, MP_NAME, SOURCE_KEY,
  TRY_CAST(SANCTION_AMOUNT AS DECIMAL(18,2)) AS SANCTION_AMOUNT,
  TRY_CAST(RECOMMENDED_AMOUNT AS DECIMAL(18,2)) AS RECOMMENDED_AMOUNT FROM (
  SELECT *, row_number() OVER (PARTITION BY DTL_ID ORDER BY {_RICH} DESC, ORD) AS RN FROM raw) WHERE RN = 1""")
def _(c):
    return cleaning.build_work_master(cleaning.most_complete(c.raw))


@register("cln21_api_values", "ORD:s AMOUNT:d STAGE:s", None, sql="""
SELECT ORD, TRY_CAST(FUND_DISBURSED_AMT AS DOUBLE) AS AMOUNT, nullif(WORK_STAGE, '') AS STAGE FROM raw""")
def _(c):
    return search.api_clean(c.raw, ["WORK_STAGE"], ["FUND_DISBURSED_AMT"]).select(
        F.col("_ord").alias("ORD"), F.col("FUND_DISBURSED_AMT").alias("AMOUNT"),
        F.col("WORK_STAGE").alias("STAGE"),
    )


# --- joins ----------------------------------------------------------------------------------

PAY_SPEC = (
    "WORK_ID:i TOTAL_FUND_DISBURSED_AMT:m PAYMENT_COUNT:i FIRST_EXPENDITURE_DATE:t "
    "LAST_EXPENDITURE_DATE:t UNIQUE_VENDOR_COUNT:i UNIQUE_VENDOR_NAME_COUNT:i "
    "PAYMENT_SUCCESS_COUNT:i PAYMENT_IN_PROGRESS_COUNT:i PAYMENT_LETTER_NO:s PAYMENT_IA_NAME:s "
    "PAYMENT_IDA_NAME:s PAYMENT_WORK_STATUS:s"
)
FIN_SPEC = (
    "WORK_ID:i HAS_PAYMENT_RECORD:b DISBURSED_TO_SANCTION_RATIO:d REMAINING_SANCTION_AMOUNT:m "
    "EXPENDITURE_DURATION_DAYS:i PAYMENTS_PER_100_DAYS:d HAS_COMPLETION_RECORD:b "
    "ACTUAL_TO_SANCTION_RATIO:d ACTUAL_TO_RECOMMENDED_RATIO:d ACTUAL_VS_DISBURSED_RATIO:d "
    "COMPLETION_DURATION_DAYS:i SANCTION_TO_COMPLETION_DAYS:i AVERAGE_RATING:d PAYMENT_IA_NAME:s"
)


@register("jon01_expenditure", "WORK_ID:i HAS_PAYMENT_RECORD:b DISBURSED_TO_SANCTION_RATIO:d "
          "REMAINING_SANCTION_AMOUNT:m EXPENDITURE_DURATION_DAYS:i PAYMENTS_PER_100_DAYS:d", "fin")
def _(c):
    return c.plan.expenditure


@register("jon02_financial_master", FIN_SPEC, "fin")
def _(c):
    return c.plan.financial_plan


@register("jon03_detectors_onto_works", "WORK_ID:i RULE_SCORE:i RULE_CANDIDATE:i RULE_SEVERITY:s "
          "STAT_SCORE:i STAT_CANDIDATE:i STAT_SEVERITY:s", None, sql="""
SELECT WORK_ID, RULE_SCORE, RULE_CANDIDATE, RULE_SEVERITY, STAT_SCORE, STAT_CANDIDATE, STAT_SEVERITY
FROM scored_rules JOIN (SELECT WORK_ID, STAT_SCORE, STAT_CANDIDATE, STAT_SEVERITY FROM scored_stats) USING (WORK_ID)""")
def _(c):
    # detector tables hold candidates only, as when they are stored separately
    rule_part = c.plan.detected.filter("RULE_CANDIDATE = 1")
    stat_part = c.plan.detected.filter("STAT_CANDIDATE = 1")
    return joining.join_detectors(c.works.select("WORK_ID"), rule_part, stat_part)


@register("jon04_new_columns", "WORK_ID:i ACTUAL_AMOUNT:m STATE_NAME:s", None, sql="""
SELECT WORK_ID, ACTUAL_AMOUNT, STATE_NAME FROM works LEFT JOIN dones USING (WORK_ID)""")
def _(c):
    right = c.completions.withColumn("STATE_NAME", F.lit("ignored"))
    return joining.join_new_columns(c.works, right)


@register("jon06_suffix_join", "WORK_ID:i SANCTION_AMOUNT:m SANCTION_AMOUNT_ML:m", None, sql="""
SELECT WORK_ID, SANCTION_AMOUNT, CAST(ACTUAL_AMOUNT AS DOUBLE) AS SANCTION_AMOUNT_ML
FROM works LEFT JOIN dones USING (WORK_ID)""")
def _(c):
    right = c.completions.select("WORK_ID", F.col("ACTUAL_AMOUNT").alias("SANCTION_AMOUNT"))
    return joining.join_with_suffix(c.works, right, "WORK_ID", "_ML")


@register("jon07_lifecycle_flags", "DTL_ID:s IS_RECOMMENDED:i IS_SANCTIONED:i IS_COMPLETED:i "
          "HAS_EXPENDITURE_RECORD:i", None, sql="""
SELECT DTL_ID, max((SOURCE_KEY = 'Works Recommended')::INT) AS IS_RECOMMENDED,
  max((SOURCE_KEY = 'Works Sanctioned')::INT) AS IS_SANCTIONED,
  max((SOURCE_KEY = 'Works Completed')::INT) AS IS_COMPLETED,
  max((SOURCE_KEY LIKE 'Expenditure%')::INT) AS HAS_EXPENDITURE_RECORD FROM raw GROUP BY 1""")
def _(c):
    return joining.membership_flags(
        c.raw, "WORK_RECOMMENDATION_DTL_ID", "_SOURCE_KEY", aggregates.LIFECYCLE_FLAGS
    ).withColumnRenamed("WORK_RECOMMENDATION_DTL_ID", "DTL_ID")


@register("jon09_attach_state_stats", "WORK_ID:i STATE_WORK_COUNT:i STATE_TOTAL_SANCTIONED:m "
          "STATE_AVG_WORK_COST:d", None, sql="""
SELECT WORK_ID, STATE_WORK_COUNT, STATE_TOTAL_SANCTIONED, STATE_AVG_WORK_COST
FROM works LEFT JOIN state_st USING (STATE_NAME)""")
def _(c):
    fin = c.plan.financial
    return ranking.attach_group_stats(
        fin, features.state_stats(fin), ["STATE_NAME"], size="STATE_WORK_COUNT", spread="WORK_ID"
    )


@register("jon11_lookup", "WORK_ID:i RULE_SCORE:i", None, sql="""
SELECT WORK_ID, RULE_SCORE FROM scored_rules WHERE WORK_ID IN (SELECT max(WORK_ID) FROM works)""")
def _(c):
    newest = c.works.agg(F.max("WORK_ID")).scalar()
    return c.plan.detected.filter(F.col("WORK_ID") == newest)


# --- aggregations ----------------------------------------------------------------------------


@register("agg01_payment_summary", PAY_SPEC, "pay_agg")
def _(c):
    return c.plan.payment_agg


S.relation("landed_once", """
SELECT * FROM pays WHERE FUND_DISBURSED_AMT IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY WORK_ID, VENDOR_ID, FUND_DISBURSED_AMT, EXPENDITURE_DATE
  ORDER BY SRC_ITEM % 3, SRC_LINE, SRC_ITEM, VENDOR_ID, FUND_DISBURSED_AMT) = 1
""")


@register("agg01_reloaded_summary", PAY_SPEC, "reloaded_agg", extra={
    "reloaded_agg": S.RELATIONS["pay_agg"].replace("FROM pays WHERE", "FROM landed_once WHERE")})
def _(c):
    # three batches out of order, one of them corrected, one more taken in and withdrawn
    table = PaymentSummaryTable(c.spark, f"{layer_root(c.spark)}/civitally/reload-{uuid.uuid4().hex}",
                                testbed.PAYMENT_ORDER, buckets=4)
    part = lambda i: c.payments.filter(F.col("SRC_ITEM") % 3 == i)
    table.apply(2, part(1))
    table.apply(1, part(2))
    table.apply(9, c.payments.filter(F.col("IA_NAME").isNotNull()))
    table.apply(0, part(0))
    table.apply(1, part(1))
    table.apply(2, part(2))
    table.withdraw(9)
    return table.summary()


@register("agg05_spending_summary", "WORK_ID:i TOTAL_DISBURSED:m TRANSACTION_COUNT:i "
          "AVERAGE_TRANSACTION_AMOUNT:d MAX_TRANSACTION_AMOUNT:m MIN_TRANSACTION_AMOUNT:m "
          "VENDOR_COUNT:i EXPENDITURE_DATE_COUNT:i", None, sql=f"""
SELECT WORK_ID, coalesce(sum(FUND_DISBURSED_AMT), 0) AS TOTAL_DISBURSED, count(*) AS TRANSACTION_COUNT,
  {S.mean('FUND_DISBURSED_AMT')} AS AVERAGE_TRANSACTION_AMOUNT, max(FUND_DISBURSED_AMT) AS MAX_TRANSACTION_AMOUNT,
  min(FUND_DISBURSED_AMT) AS MIN_TRANSACTION_AMOUNT, count(DISTINCT VENDOR_ID) AS VENDOR_COUNT,
  count(DISTINCT EXPENDITURE_DATE) AS EXPENDITURE_DATE_COUNT FROM pays GROUP BY 1""")
def _(c):
    return aggregates.spending_summary(c.payments)


S.relation("consol", """
SELECT CAST(DTL_ID AS BIGINT) AS WORK_ID, arg_min(WORK_NO, ORD) AS PORTAL_WORK_ID,
  arg_min(STATE_NAME, ORD) FILTER (WHERE STATE_NAME IS NOT NULL) AS STATE_NAME,
  arg_min(MP_NAME, ORD) AS MP_NAME, arg_min(CONSTITUENCY, ORD) AS CONSTITUENCY,
  arg_min(WORK_CATEGORY, ORD) AS WORK_CATEGORY,
  arg_min(ACTIVITY_NAME, ORD) FILTER (WHERE ACTIVITY_NAME IS NOT NULL) AS ACTIVITY_NAME,
  arg_min(WORK_STAGE, ORD) FILTER (WHERE WORK_STAGE IS NOT NULL) AS WORK_STAGE,
  arg_min(VENDOR_NAME, ORD) FILTER (WHERE VENDOR_NAME IS NOT NULL) AS VENDOR_NAME,
  arg_min(TRY_CAST(RECOMMENDED_AMOUNT AS DECIMAL(18,2)), ORD) FILTER (WHERE RECOMMENDED_AMOUNT IS NOT NULL) AS RECOMMENDED_AMOUNT,
  arg_min(TRY_CAST(SANCTION_AMOUNT AS DECIMAL(18,2)), ORD) FILTER (WHERE SANCTION_AMOUNT IS NOT NULL) AS SANCTION_AMOUNT,
  arg_min(TRY_CAST(ACTUAL_AMOUNT AS DECIMAL(18,2)), ORD) FILTER (WHERE ACTUAL_AMOUNT IS NOT NULL) AS ACTUAL_AMOUNT,
  CAST(strptime(arg_min(RECOMMENDATION_DATE, ORD) FILTER (WHERE RECOMMENDATION_DATE IS NOT NULL), '%d-%m-%Y') AS DATE) AS RECOMMENDATION_DATE,
  CAST(strptime(arg_min(SANCTION_DATE, ORD) FILTER (WHERE SANCTION_DATE IS NOT NULL), '%d-%m-%Y') AS DATE) AS SANCTION_DATE,
  CAST(strptime(arg_min(ACTUAL_END_DATE, ORD) FILTER (WHERE ACTUAL_END_DATE IS NOT NULL), '%d-%m-%Y') AS DATE) AS ACTUAL_END_DATE,
  max((SOURCE_KEY = 'Works Recommended')::INT) AS IS_RECOMMENDED,
  max((SOURCE_KEY = 'Works Sanctioned')::INT) AS IS_SANCTIONED,
  max((SOURCE_KEY = 'Works Completed')::INT) AS IS_COMPLETED,
  max((SOURCE_KEY LIKE 'Expenditure%')::INT) AS HAS_EXPENDITURE_RECORD,
  count(*) FILTER (WHERE SOURCE_KEY = 'Works Recommended') AS RECOMMENDED_RECORD_COUNT,
  count(*) FILTER (WHERE SOURCE_KEY = 'Works Sanctioned') AS SANCTIONED_RECORD_COUNT,
  count(*) FILTER (WHERE SOURCE_KEY = 'Works Completed') AS COMPLETED_RECORD_COUNT,
  count(*) FILTER (WHERE SOURCE_KEY LIKE 'Expenditure%') AS EXPENDITURE_RECORD_COUNT
FROM raw GROUP BY DTL_ID
""")
CONSOL_SPEC = (
    "WORK_ID:i PORTAL_WORK_ID:s STATE_NAME:s MP_NAME:s CONSTITUENCY:s WORK_CATEGORY:s "
    "ACTIVITY_NAME:s WORK_STAGE:s VENDOR_NAME:s RECOMMENDED_AMOUNT:d SANCTION_AMOUNT:d "
    "ACTUAL_AMOUNT:d RECOMMENDATION_DATE:t SANCTION_DATE:t ACTUAL_END_DATE:t IS_RECOMMENDED:i "
    "IS_SANCTIONED:i IS_COMPLETED:i HAS_EXPENDITURE_RECORD:i RECOMMENDED_RECORD_COUNT:i "
    "SANCTIONED_RECORD_COUNT:i COMPLETED_RECORD_COUNT:i EXPENDITURE_RECORD_COUNT:i"
)


@register("agg06_consolidated_works", CONSOL_SPEC, "consol")
def _(c):
    return c.regional.works_plan


@register("agg07_source_counts", "DTL_ID:s RECOMMENDED_RECORD_COUNT:i SANCTIONED_RECORD_COUNT:i "
          "COMPLETED_RECORD_COUNT:i EXPENDITURE_RECORD_COUNT:i", None,
          sql="SELECT *, CAST(WORK_ID AS VARCHAR) AS DTL_ID FROM consol")
def _(c):
    return aggregates.source_counts(c.raw).withColumnRenamed("WORK_RECOMMENDATION_DTL_ID", "DTL_ID")


def _mean6(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,6))) AS DOUBLE) / nullif(count({x}), 0)"


S.relation("analysis", "SELECT * FROM hyb")
S.relation("state_diag", f"""
SELECT STATE_NAME, count(*) AS TOTAL_WORKS, sum(ML_ANOMALY) AS ML_ANOMALIES,
  {S.median('SANCTION_AMOUNT')} AS MEDIAN_SANCTION, {_mean6('SANCTION_AMOUNT')} AS MEAN_SANCTION,
  {S.median('PAYMENT_COUNT')} AS MEDIAN_PAYMENT_COUNT, {_mean6('PAYMENT_COUNT')} AS MEAN_PAYMENT_COUNT,
  {S.median('UNIQUE_VENDOR_COUNT')} AS MEDIAN_VENDOR_COUNT, {_mean6('UNIQUE_VENDOR_COUNT')} AS MEAN_VENDOR_COUNT,
  {S.median('DATA_COMPLETENESS_RATIO')} AS MEDIAN_COMPLETENESS, {S.median('PEER_COUNT')} AS MEDIAN_PEER_COUNT,
  sum(ML_ANOMALY) * 1e0 / count(*) * 100 AS ML_ANOMALY_RATE_PERCENT,
  (sum(ML_ANOMALY) * 1e0 / count(*) * 100) / (SELECT sum(ML_ANOMALY) * 1e0 / count(*) * 100 FROM analysis)
    AS INDIA_RATE_RATIO
FROM analysis GROUP BY 1
""")
STATE_DIAG_SPEC = (
    "STATE_NAME:s TOTAL_WORKS:i ML_ANOMALIES:i MEDIAN_SANCTION:d MEAN_SANCTION:d "
    "MEDIAN_PAYMENT_COUNT:d MEAN_PAYMENT_COUNT:d MEDIAN_VENDOR_COUNT:d MEAN_VENDOR_COUNT:d "
    "MEDIAN_COMPLETENESS:d MEDIAN_PEER_COUNT:d ML_ANOMALY_RATE_PERCENT:d INDIA_RATE_RATIO:d"
)


@register("agg08_state_diagnostic", STATE_DIAG_SPEC, "state_diag")
def _(c):
    return reports.state_diagnostic(c.analysis_of(*reports.STATE_DIAGNOSTIC_FEATURES))


@register("agg09_peer_bands", "PEER_GROUP:s TOTAL_WORKS:i ML_ANOMALIES:i MEDIAN_SANCTION:f "
          "MEDIAN_PAYMENT_COUNT:d MEDIAN_VENDOR_COUNT:d MEDIAN_COMPLETENESS:d "
          "ML_ANOMALY_RATE_PERCENT:d", None, sql=f"""
SELECT CASE WHEN PEER_COUNT >= 30 THEN '30+' WHEN PEER_COUNT >= 10 THEN '10-29' ELSE '0-9' END AS PEER_GROUP,
  count(*) AS TOTAL_WORKS, sum(ML_ANOMALY) AS ML_ANOMALIES, {S.median('SANCTION_AMOUNT')} AS MEDIAN_SANCTION,
  {S.median('PAYMENT_COUNT')} AS MEDIAN_PAYMENT_COUNT, {S.median('UNIQUE_VENDOR_COUNT')} AS MEDIAN_VENDOR_COUNT,
  {S.median('DATA_COMPLETENESS_RATIO')} AS MEDIAN_COMPLETENESS,
  sum(ML_ANOMALY) * 1e0 / count(*) * 100 AS ML_ANOMALY_RATE_PERCENT FROM analysis GROUP BY 1""")
def _(c):
    return reports.peer_band_diagnostic(c.analysis_of(*reports.PEER_BAND_FEATURES))


def _melt_sql(columns, source: str = "analysis", *carry: str) -> str:
    keep = "".join(f"{c}, " for c in carry)
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS FEATURE, ML_ANOMALY, CAST({c} AS DOUBLE) AS V FROM {source}" for c in columns
    )


def _side(fn_sql: str, side: int) -> str:
    return f"{fn_sql} FILTER (WHERE ML_ANOMALY = {side})"


@register("agg10_anomaly_comparison", "FEATURE:s ANOMALY_COUNT:i NORMAL_COUNT:i ANOMALY_MEDIAN:f "
          "NORMAL_MEDIAN:f MEDIAN_RATIO:d ANOMALY_MEAN:f NORMAL_MEAN:f ABS_MEDIAN_RATIO_DISTANCE:d",
          None, extra={"melted": _melt_sql(reports.DIAGNOSTIC_FEATURES), "sides": f"""
SELECT FEATURE, {_side('count(V)', 1)} AS ANOMALY_COUNT, {_side('count(V)', 0)} AS NORMAL_COUNT,
  {_side('quantile_cont(V, 0.5)', 1)} AS ANOMALY_MEDIAN, {_side('quantile_cont(V, 0.5)', 0)} AS NORMAL_MEDIAN,
  {_side('avg(V)', 1)} AS ANOMALY_MEAN, {_side('avg(V)', 0)} AS NORMAL_MEAN FROM melted WHERE V IS NOT NULL GROUP BY 1"""},
          sql="""
SELECT *, CASE WHEN NORMAL_MEDIAN <> 0 THEN ANOMALY_MEDIAN / NORMAL_MEDIAN END AS MEDIAN_RATIO,
  abs(CASE WHEN NORMAL_MEDIAN <> 0 THEN ANOMALY_MEDIAN / NORMAL_MEDIAN END - 1) AS ABS_MEDIAN_RATIO_DISTANCE
FROM sides WHERE ANOMALY_COUNT > 0 AND NORMAL_COUNT > 0""")
def _(c):
    return reports.anomaly_comparison(c.analysis_of(*reports.DIAGNOSTIC_FEATURES))


# Every numeric feature by name, for the SQL twins; the plans find them by their type.
NUMERIC = tuple("""
    RECOMMENDED_AMOUNT SANCTION_AMOUNT TOTAL_FUND_DISBURSED_AMT PAYMENT_COUNT UNIQUE_VENDOR_COUNT
    PAYMENT_SUCCESS_COUNT PAYMENT_IN_PROGRESS_COUNT UNIQUE_VENDOR_NAME_COUNT DISBURSED_TO_SANCTION_RATIO
    REMAINING_SANCTION_AMOUNT EXPENDITURE_DURATION_DAYS PAYMENTS_PER_100_DAYS ACTUAL_AMOUNT
    AVERAGE_RATING ACTUAL_TO_SANCTION_RATIO ACTUAL_TO_RECOMMENDED_RATIO ACTUAL_VS_DISBURSED_RATIO
    COMPLETION_DURATION_DAYS SANCTION_TO_COMPLETION_DAYS RECOMMENDED_TO_SANCTION_DIFFERENCE
    SANCTION_TO_RECOMMENDED_RATIO DISBURSED_TO_RECOMMENDED_RATIO REMAINING_SANCTION_RATIO
    AVERAGE_PAYMENT_AMOUNT PAYMENT_SUCCESS_RATIO PAYMENT_IN_PROGRESS_RATIO PAYMENTS_PER_VENDOR
    RECOMMENDATION_TO_SANCTION_DAYS SANCTION_TO_FIRST_PAYMENT_DAYS RECOMMENDATION_TO_FIRST_PAYMENT_DAYS
    LAST_PAYMENT_TO_COMPLETION_DAYS RECOMMENDATION_TO_COMPLETION_DAYS PAYMENTS_PER_30_DAYS
    DISBURSED_PER_EXPENDITURE_DAY IS_COMPLETED HAS_ACTUAL_AMOUNT HAS_ACTUAL_END_DATE
    ACTUAL_MINUS_SANCTION ACTUAL_MINUS_DISBURSED DISBURSED_MINUS_ACTUAL NO_PAYMENT_RECORD
    MULTIPLE_PAYMENTS MULTIPLE_VENDORS PAYMENT_COUNT_GE_5 PAYMENT_COUNT_GE_10 VENDOR_COUNT_GE_5
    VENDOR_COUNT_GE_10 MISSING_FIELD_COUNT ACTUAL_ABOVE_SANCTION DISBURSED_ABOVE_SANCTION
    RECOMMENDATION_YEAR RECOMMENDATION_MONTH SANCTION_YEAR FIRST_PAYMENT_YEAR COMPLETION_YEAR
    DATA_COMPLETENESS_RATIO NEGATIVE_RECOMMENDATION_TO_SANCTION NEGATIVE_SANCTION_TO_PAYMENT
    COMPLETION_BEFORE_LAST_PAYMENT PAYMENT_AFTER_REPORTED_COMPLETION_DAYS AVERAGE_PAYMENT_ABOVE_1M
    TOTAL_DISBURSED_ABOVE_5M STATE_WORK_COUNT STATE_TOTAL_RECOMMENDED STATE_TOTAL_SANCTIONED
    STATE_TOTAL_DISBURSED STATE_AVG_WORK_COST MP_WORK_COUNT MP_TOTAL_RECOMMENDED MP_TOTAL_SANCTIONED
    MP_TOTAL_DISBURSED MP_AVG_SANCTION_AMOUNT MP_MEDIAN_SANCTION_AMOUNT CONSTITUENCY_WORK_COUNT
    CONSTITUENCY_TOTAL_SANCTIONED CONSTITUENCY_TOTAL_DISBURSED CONSTITUENCY_AVG_SANCTION
    CATEGORY_WORK_COUNT ACTIVITY_WORK_COUNT PEER_COUNT PEER_MEDIAN_SANCTION PEER_MEAN_SANCTION
    PEER_STD_SANCTION PEER_MEDIAN_DISBURSED SANCTION_TO_PEER_MEDIAN DISBURSED_TO_PEER_MEDIAN
    SANCTION_PEER_Z_SCORE ABS_PEER_COST_Z_SCORE SANCTION_ABOVE_2X_PEER_MEDIAN
    SANCTION_ABOVE_5X_PEER_MEDIAN DISBURSED_ABOVE_2X_PEER_MEDIAN
""".split())
_FULL = f"""
SELECT FEATURE, {_side('count(V)', 1)} AS ANOMALY_COUNT, {_side('count(V)', 0)} AS NORMAL_COUNT,
  {_side('quantile_cont(V, 0.5)', 1)} AS A, {_side('quantile_cont(V, 0.5)', 0)} AS N,
  {_side('avg(V)', 1)} AS ANOMALY_MEAN, {_side('avg(V)', 0)} AS NORMAL_MEAN,
  {_side('quantile_cont(V, 0.95)', 1)} AS ANOMALY_P95, {_side('quantile_cont(V, 0.95)', 0)} AS NORMAL_P95,
  {_side('quantile_cont(V, 0.99)', 1)} AS ANOMALY_P99, {_side('quantile_cont(V, 0.99)', 0)} AS NORMAL_P99,
  {_side('stddev_samp(V)', 0)} AS NORMAL_STD FROM melted WHERE V IS NOT NULL GROUP BY 1"""


@register("agg11_feature_comparison", "FEATURE:s ANOMALY_COUNT:i NORMAL_COUNT:i ANOMALY_MEDIAN:f "
          "NORMAL_MEDIAN:f MEDIAN_RATIO:d MEDIAN_DIFFERENCE_PERCENT:f ANOMALY_MEAN:f NORMAL_MEAN:f "
          "ANOMALY_P95:f NORMAL_P95:f ANOMALY_P99:f NORMAL_P99:f NORMAL_STD:f "
          "STANDARDIZED_DIFFERENCE:d ABS_STANDARDIZED_DIFFERENCE:d", None,
          extra={"melted": _melt_sql(NUMERIC), "sides": _FULL}, sql="""
SELECT *, A AS ANOMALY_MEDIAN, N AS NORMAL_MEDIAN, CASE WHEN abs(N) > 1e-12 THEN A / N END AS MEDIAN_RATIO,
  CASE WHEN abs(N) > 1e-12 THEN (A - N) / abs(N) * 100 END AS MEDIAN_DIFFERENCE_PERCENT,
  CASE WHEN NORMAL_STD > 1e-12 THEN (A - N) / NORMAL_STD END AS STANDARDIZED_DIFFERENCE,
  abs(CASE WHEN NORMAL_STD > 1e-12 THEN (A - N) / NORMAL_STD END) AS ABS_STANDARDIZED_DIFFERENCE
FROM sides WHERE ANOMALY_COUNT >= 20 AND NORMAL_COUNT >= 20""")
def _(c):
    return reports.feature_comparison(c.analysis, c.analysed_features)


@register("agg12_availability_gap", "FEATURE:s ANOMALY_AVAILABLE_PERCENT:d "
          "NORMAL_AVAILABLE_PERCENT:d AVAILABILITY_GAP_PERCENT:d", None,
          extra={"melted": _melt_sql(NUMERIC)}, sql=f"""
SELECT FEATURE, {_side('count(V)', 1)} * 1e0 / {_side('count(*)', 1)} * 100 AS ANOMALY_AVAILABLE_PERCENT,
  {_side('count(V)', 0)} * 1e0 / {_side('count(*)', 0)} * 100 AS NORMAL_AVAILABLE_PERCENT,
  {_side('count(V)', 1)} * 1e0 / {_side('count(*)', 1)} * 100
    - {_side('count(V)', 0)} * 1e0 / {_side('count(*)', 0)} * 100 AS AVAILABILITY_GAP_PERCENT
FROM melted GROUP BY 1""")
def _(c):
    return reports.availability_gap(c.analysis, c.analysed_features)


@register("agg13_state_feature_gaps", "STATE_NAME:s TOTAL_WORKS:i ML_ANOMALIES:i "
          "ML_ANOMALY_RATE_PERCENT:d FEATURE:s ANOMALY_MEDIAN:f NORMAL_MEDIAN:f NORMAL_STD:f "
          "STANDARDIZED_DIFFERENCE:d", None,
          extra={"melted": _melt_sql(NUMERIC, "analysis", "STATE_NAME"), "sides": f"""
SELECT STATE_NAME, FEATURE, {_side('count(V)', 1)} AS AC, {_side('count(V)', 0)} AS NC,
  {_side('quantile_cont(V, 0.5)', 1)} AS A, {_side('quantile_cont(V, 0.5)', 0)} AS N,
  {_side('stddev_samp(V)', 0)} AS NORMAL_STD FROM melted WHERE V IS NOT NULL GROUP BY 1, 2"""}, sql="""
SELECT STATE_NAME, TOTAL_WORKS, ML_ANOMALIES, ML_ANOMALY_RATE_PERCENT, FEATURE, A AS ANOMALY_MEDIAN,
  N AS NORMAL_MEDIAN, NORMAL_STD, CASE WHEN NORMAL_STD > 1e-12 THEN (A - N) / NORMAL_STD END AS STANDARDIZED_DIFFERENCE
FROM sides JOIN state_diag USING (STATE_NAME)
WHERE TOTAL_WORKS >= 100 AND ML_ANOMALIES >= 5 AND AC >= 5 AND NC >= 20""")
def _(c):
    return reports.state_feature_gaps(c.analysis, c.analysed_features)


@register("agg14_state_rates", "STATE_NAME:s TOTAL_WORKS:i ML_ANOMALIES:i ML_ANOMALY_RATE_PERCENT:d",
          "state_diag")
def _(c):
    return reports.state_rates(c.analysis_of("STATE_NAME"))


_OVERLAP = {
    "ML": "M", "RULE": "R", "STATISTICAL": "S", "ML_AND_RULE": "M AND R", "ML_AND_STATISTICAL": "M AND S",
    "RULE_AND_STATISTICAL": "R AND S", "ALL_THREE": "M AND R AND S", "ML_ONLY": "M AND NOT R AND NOT S",
    "RULE_ONLY": "R AND NOT M AND NOT S", "STATISTICAL_ONLY": "S AND NOT M AND NOT R",
    "NONE": "NOT M AND NOT R AND NOT S",
}
_SETS = "SELECT WORK_ID, PEER_COUNT, ML_CANDIDATE = 1 AS M, RULE_CANDIDATE = 1 AS R, STAT_CANDIDATE = 1 AS S FROM hyb"


@register("agg15_detector_overlap", "GROUP:s COUNT:i", None, extra={"sets": _SETS}, sql=" UNION ALL ".join(
    f"SELECT '{g}' AS \"GROUP\", count(*) AS \"COUNT\" FROM sets WHERE {w}" for g, w in _OVERLAP.items()))
def _(c):
    return reports.detector_overlap(c.hybrid)


def _trigger_sql(book: dict, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS RULE, '{r[1]}' AS CATEGORY, '{r[2]}' AS STRENGTH, {r[3]} AS SCORE, "
        f"{'TRUE' if r[5] else 'FALSE'} AS VERIFICATION_ONLY, sum({n}) AS TRIGGERED_WORKS, "
        f"sum({n}) * 1e0 / count(*) * 100 AS PERCENT_OF_WORKS, '{r[4]}' AS DESCRIPTION FROM {source}"
        for n, r in book.items()
    )


TRIGGER_SPEC = ("RULE:s CATEGORY:s STRENGTH:s SCORE:i VERIFICATION_ONLY:b TRIGGERED_WORKS:i "
                "PERCENT_OF_WORKS:d DESCRIPTION:s")


@register("agg16_rule_triggers", TRIGGER_SPEC, None, sql=_trigger_sql(S.RULES, "scored_rules"))
def _(c):
    return reports.trigger_summary(c.plan.rules, rules.policy_rules())


@register("agg16_signal_triggers", TRIGGER_SPEC, None, sql=_trigger_sql(S.SIGNALS, "scored_stats"))
def _(c):
    return reports.trigger_summary(c.plan.statistics, statistics.statistical_rules())


@register("agg17_rule_distribution", "RULE_SCORE:i RULE_SEVERITY:s WORK_COUNT:i", None, sql="""
SELECT RULE_SCORE, RULE_SEVERITY, count(*) AS WORK_COUNT FROM scored_rules GROUP BY 1, 2""")
def _(c):
    return reports.score_distribution(c.plan.rules, "RULE_SCORE", "RULE_SEVERITY")


@register("agg17_stat_distribution", "STAT_SCORE:i STAT_SEVERITY:s WORK_COUNT:i", None, sql="""
SELECT STAT_SCORE, STAT_SEVERITY, count(*) AS WORK_COUNT FROM scored_stats GROUP BY 1, 2""")
def _(c):
    return reports.score_distribution(c.plan.statistics, "STAT_SCORE", "STAT_SEVERITY")


@register("agg18_score_bands", "BAND:s WORK_COUNT:i", None, sql="""
SELECT CASE WHEN RULE_SCORE <= 0 THEN '0' WHEN RULE_SCORE <= 19.99 THEN '1-19' WHEN RULE_SCORE <= 29.99 THEN '20-29'
  WHEN RULE_SCORE <= 39.99 THEN '30-39' WHEN RULE_SCORE <= 59.99 THEN '40-59' ELSE '60-100' END AS BAND,
  count(*) AS WORK_COUNT FROM scored_rules GROUP BY 1""")
def _(c):
    return reports.score_bands(c.plan.rules, "RULE_SCORE")


@register("agg19_hybrid_histogram", "BIN_LABEL:s SCORE_MIN:i SCORE_MAX:i WORK_COUNT:i CANDIDATE_COUNT:i "
          "SIGNAL_1_COUNT:i SIGNAL_2_COUNT:i SIGNAL_3_COUNT:i", None, sql="""
SELECT CASE WHEN b.LO = 100 THEN '100' ELSE b.LO || '-' || (b.LO + 5) END AS BIN_LABEL, b.LO AS SCORE_MIN,
  least(b.LO + 5, 100) AS SCORE_MAX, count(WORK_ID) AS WORK_COUNT,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1) AS CANDIDATE_COUNT,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 1) AS SIGNAL_1_COUNT,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 2) AS SIGNAL_2_COUNT,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 3) AS SIGNAL_3_COUNT
FROM (SELECT unnest(generate_series(0, 100, 5)) AS LO) b LEFT JOIN hyb h
  ON least(floor(h.HYBRID_RISK_SCORE / 5) * 5, 100) = b.LO GROUP BY b.LO""")
def _(c):
    return reports.hybrid_histogram(c.hybrid)


def _levels_sql(column: str, levels, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{v}' AS {column}, count(*) FILTER (WHERE {column} = '{v}') AS WORK_COUNT, "
        f"count(*) FILTER (WHERE {column} = '{v}') * 1e0 / count(*) * 100 AS PERCENTAGE FROM {source}"
        for v in levels
    )


@register("agg20_level_summary", "HYBRID_RISK_LEVEL:s WORK_COUNT:i PERCENTAGE:d", None,
          sql=_levels_sql("HYBRID_RISK_LEVEL", search.LEVELS, "hyb"))
def _(c):
    return reports.level_summary(c.hybrid, "HYBRID_RISK_LEVEL", search.LEVELS)


@register("agg21_agreement_summary", "DETECTOR_AGREEMENT:s WORK_COUNT:i PERCENTAGE:d", None, sql="""
SELECT DETECTOR_AGREEMENT, count(*) AS WORK_COUNT, count(*) * 1e0 / (SELECT count(*) FROM hyb) * 100 AS PERCENTAGE
FROM hyb GROUP BY 1""")
def _(c):
    return reports.agreement_summary(c.hybrid)


@register("agg22_candidates_per_state", "STATE_NAME:s INVESTIGATION_CANDIDATES:i", None, sql="""
SELECT STATE_NAME, count(*) AS INVESTIGATION_CANDIDATES FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 GROUP BY 1""")
def _(c):
    return reports.candidates_per_state(c.hybrid)


def _metrics_sql(metrics: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS METRIC, CAST({v} AS DOUBLE) AS VALUE FROM {source}" for k, v in metrics.items()
    )


@register("agg23_hybrid_kpis", "METRIC:s VALUE:d", None, sql=_metrics_sql({
    "TOTAL_WORKS": "count(*)", "INVESTIGATION_CANDIDATES": "sum(INVESTIGATION_CANDIDATE)",
    "CANDIDATE_PERCENTAGE": "sum(INVESTIGATION_CANDIDATE) * 1e0 / count(*) * 100",
    "RULE_CANDIDATES": "sum(RULE_CANDIDATE)", "STATISTICAL_CANDIDATES": "sum(STAT_CANDIDATE)",
    "ML_CANDIDATES": "sum(ML_CANDIDATE)",
    "TWO_OR_MORE_METHODS": "count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT >= 2)",
    "ALL_THREE_METHODS": "count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 3)"}, "hyb"))
def _(c):
    return reports.hybrid_kpis(c.hybrid)


@register("agg24_tier_composition", "INVESTIGATION_PRIORITY:s WORK_COUNT:i SIGNAL_1_COUNT:i "
          "SIGNAL_2_COUNT:i SIGNAL_3_COUNT:i PERCENT_OF_CANDIDATES:d SCORE_ONLY_COUNT:i", None, sql="""
SELECT INVESTIGATION_PRIORITY, count(*) AS WORK_COUNT,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 1) AS SIGNAL_1_COUNT,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 2) AS SIGNAL_2_COUNT,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 3) AS SIGNAL_3_COUNT,
  count(*) * 1e0 / (SELECT sum(INVESTIGATION_CANDIDATE) FROM hyb) * 100 AS PERCENT_OF_CANDIDATES,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT <> 3) AS SCORE_ONLY_COUNT
FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 GROUP BY 1""")
def _(c):
    return reports.tier_composition(c.hybrid)


@register("agg25_national_overview", "RAW_RECORDS:i UNIQUE_WORKS:i STATES_UTS:i "
          "MP_CONSTITUENCY_MAPPINGS:i PAYMENT_TRANSACTIONS:i COMPLETED_RECORDS:i "
          "WORKS_WITH_PAYMENTS:i WORKS_WITHOUT_PAYMENTS:i PAYMENT_COVERAGE_PERCENT:d", None, sql="""
SELECT (SELECT count(*) FROM raw) AS RAW_RECORDS, count(DISTINCT WORK_ID) AS UNIQUE_WORKS,
  count(DISTINCT STATE_NAME) AS STATES_UTS,
  count(DISTINCT concat(STATE_ID, '|', coalesce(CAST(MP_ID AS VARCHAR), ''), '|', CONSTITUENCY_ID)) AS MP_CONSTITUENCY_MAPPINGS,
  (SELECT count(*) FROM pays) AS PAYMENT_TRANSACTIONS, (SELECT count(*) FROM dones) AS COMPLETED_RECORDS,
  (SELECT count(DISTINCT WORK_ID) FROM pays) AS WORKS_WITH_PAYMENTS,
  greatest(count(DISTINCT WORK_ID) - (SELECT count(DISTINCT WORK_ID) FROM pays), 0) AS WORKS_WITHOUT_PAYMENTS,
  round_even((SELECT count(DISTINCT WORK_ID) FROM pays) * 1e0 / count(DISTINCT WORK_ID) * 100e0 * 100e0, 0) / 100e0
    AS PAYMENT_COVERAGE_PERCENT FROM hyb""")
def _(c):
    return search.national_overview(c.raw, c.hybrid, c.payments, c.plan.financial)


@register("agg26_state_overview", "STATE_NAME:s ANALYZED_WORKS:i CANDIDATES:i CRITICAL:i HIGH:i "
          "MEDIUM:i LOW:i CANDIDATE_RATE_PERCENT:d", None, sql="""
SELECT STATE_NAME, count(*) AS ANALYZED_WORKS, sum(INVESTIGATION_CANDIDATE) AS CANDIDATES,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL = 'CRITICAL') AS CRITICAL,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL = 'HIGH') AS HIGH,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL = 'MEDIUM') AS MEDIUM,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL = 'LOW') AS LOW,
  round_even(sum(INVESTIGATION_CANDIDATE) * 1e0 / count(*) * 100e0 * 100e0, 0) / 100e0 AS CANDIDATE_RATE_PERCENT
FROM hyb GROUP BY 1""")
def _(c):
    return search.state_overview(c.hybrid)


@register("agg27_filtered_summary", "TOTAL:i CRITICAL:i HIGH:i MEDIUM:i LOW:i NONE:i ALL_THREE:i "
          "TWO_METHODS:i ONE_METHOD:i AVERAGE_HYBRID_RISK_SCORE:d", None, sql="""
SELECT count(*) AS TOTAL, count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'CRITICAL') AS CRITICAL,
  count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'HIGH') AS HIGH,
  count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'MEDIUM') AS MEDIUM,
  count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'LOW') AS LOW,
  count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'NONE') AS "NONE",
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 3) AS ALL_THREE,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 2) AS TWO_METHODS,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 1) AS ONE_METHOD,
  round_even(CAST(sum(CAST(HYBRID_RISK_SCORE AS DECIMAL(18,1))) AS DOUBLE) / count(*) * 100e0, 0) / 100e0
    AS AVERAGE_HYBRID_RISK_SCORE
FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 AND lower(STATE_NAME) = 'nation_3'""")
def _(c):
    return search.filtered_summary(search.in_scope(c.hybrid), state=" Nation_3 ")


@register("agg29_column_profile", "COLUMN:s MISSING:i MISSING_PERCENT:d COUNT:i MEAN:f STD:f MIN:f "
          "MEDIAN:f MAX:f", None, extra={"melted": _melt_sql(NUMERIC)}, sql="""
SELECT FEATURE AS "COLUMN", count(*) - count(V) AS MISSING, (count(*) - count(V)) * 1e0 / count(*) * 100 AS MISSING_PERCENT,
  count(V) AS "COUNT", avg(V) AS MEAN, stddev_samp(V) AS STD, min(V) AS MIN, quantile_cont(V, 0.5) AS MEDIAN,
  max(V) AS MAX FROM melted GROUP BY 1""")
def _(c):
    return reports.column_profile(c.plan.features, reports.numeric_features(c.plan.features))


_CATEGORIES = ("STATE_NAME", "MP_NAME", "CONSTITUENCY", "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_STAGE")


@register("agg30_category_coverage", "COLUMN:s UNIQUE_VALUES:i MISSING:i", None, sql=" UNION ALL ".join(
    f"SELECT '{k}' AS \"COLUMN\", count(DISTINCT {k}) AS UNIQUE_VALUES, count(*) - count({k}) AS MISSING FROM works"
    for k in _CATEGORIES))
def _(c):
    return reports.category_coverage(c.works, _CATEGORIES)


_RATIOS = ("ACTUAL_TO_SANCTION_RATIO", "DISBURSED_TO_SANCTION_RATIO", "SANCTION_TO_PEER_MEDIAN")


@register("agg31_ratio_bands", "COLUMN:s AVAILABLE:i BELOW_0:i EQUAL_0:i ABOVE_1:i ABOVE_2:i ABOVE_5:i "
          "MAXIMUM:d", None, sql=" UNION ALL ".join(
    f"SELECT '{k}' AS \"COLUMN\", count({k}) AS AVAILABLE, count(*) FILTER (WHERE {k} < 0) AS BELOW_0, "
    f"count(*) FILTER (WHERE {k} = 0) AS EQUAL_0, count(*) FILTER (WHERE {k} > 1) AS ABOVE_1, "
    f"count(*) FILTER (WHERE {k} > 2) AS ABOVE_2, count(*) FILTER (WHERE {k} > 5) AS ABOVE_5, "
    f"max({k}) AS MAXIMUM FROM feat" for k in _RATIOS))
def _(c):
    return reports.ratio_bands(c.plan.features, _RATIOS)


@register("agg32_id_conflicts", "KEY:s COLUMN:s VALUES:i", None, sql=" UNION ALL ".join(
    f"SELECT DTL_ID AS KEY, '{col}' AS \"COLUMN\", count(DISTINCT {src}) AS \"VALUES\" FROM raw GROUP BY 1 "
    f"HAVING count(DISTINCT {src}) > 1"
    for col, src in (("_STATE_NAME", "STATE_NAME"), ("_MP_ID", "MP_ID"),
                     ("_CONSTITUENCY_ID", "CONSTITUENCY_ID"), ("_SOURCE_KEY", "SOURCE_KEY"),
                     ("WORK_STAGE", "WORK_STAGE"))))
def _(c):
    return reports.id_conflicts(
        c.raw, "WORK_RECOMMENDATION_DTL_ID",
        ["_STATE_NAME", "_MP_ID", "_CONSTITUENCY_ID", "_SOURCE_KEY", "WORK_STAGE"],
    )


@register("agg33_source_summary", "SOURCE_KEY:s RECORDS:i UNIQUE_IDS:i DUPLICATE_RECORDS:i", None, sql="""
SELECT SOURCE_KEY, count(*) AS RECORDS, count(DISTINCT DTL_ID) AS UNIQUE_IDS,
  count(*) - count(DISTINCT DTL_ID) AS DUPLICATE_RECORDS FROM raw GROUP BY 1""")
def _(c):
    return reports.source_summary(
        c.raw, "_SOURCE_KEY", "WORK_RECOMMENDATION_DTL_ID"
    ).withColumnRenamed("_SOURCE_KEY", "SOURCE_KEY")


@register("agg34_state_rollup", "STATE_NAME:s WORKS:i MPS:i CONSTITUENCIES:i RECOMMENDED:m SANCTIONED:m",
          None, sql="""
SELECT STATE_NAME, count(DISTINCT WORK_ID) AS WORKS, count(DISTINCT MP_ID) AS MPS,
  count(DISTINCT CONSTITUENCY_ID) AS CONSTITUENCIES, coalesce(sum(RECOMMENDED_AMOUNT), 0) AS RECOMMENDED,
  coalesce(sum(SANCTION_AMOUNT), 0) AS SANCTIONED FROM works WHERE STATE_NAME IS NOT NULL GROUP BY 1""")
def _(c):
    return reports.state_rollup(c.works)


@register("agg35_value_counts", "VALUE:s ROWS:i", None, sql="""
SELECT coalesce(CONSTITUENCY, 'MISSING') AS VALUE, count(*) AS ROWS FROM raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def _(c):
    return reports.value_counts(c.raw, "CONSTITUENCY", 30)


@register("agg36_group_distribution", "FEATURE:s GROUP:s N:i MEDIAN:f MEAN:f P95:f P99:f", None,
          extra={"melted": _melt_sql(("PAYMENT_COUNT", "UNIQUE_VENDOR_COUNT", "SANCTION_AMOUNT"))}, sql="""
SELECT FEATURE, CASE WHEN ML_ANOMALY = 1 THEN 'ML_ANOMALY' ELSE 'NORMAL' END AS "GROUP", count(V) AS N,
  quantile_cont(V, 0.5) AS MEDIAN, avg(V) AS MEAN, quantile_cont(V, 0.95) AS P95, quantile_cont(V, 0.99) AS P99
FROM melted GROUP BY 1, 2""")
def _(c):
    return reports.group_distribution(c.analysis)


@register("agg37_amount_relation", "METRIC:s VALUE:d", None, sql=_metrics_sql({
    "BOTH_AVAILABLE": "count(*) FILTER (WHERE RECOMMENDED_AMOUNT IS NOT NULL AND SANCTION_AMOUNT IS NOT NULL)",
    "RECOMMENDED_ABOVE_SANCTIONED": "count(*) FILTER (WHERE RECOMMENDED_AMOUNT > SANCTION_AMOUNT)",
    "SANCTIONED_ABOVE_RECOMMENDED": "count(*) FILTER (WHERE SANCTION_AMOUNT > RECOMMENDED_AMOUNT)",
    "EQUAL": "count(*) FILTER (WHERE RECOMMENDED_AMOUNT = SANCTION_AMOUNT)"}, "works"))
def _(c):
    return reports.amount_relation(c.works)


@register("agg38_high_rate_states", "STATE_NAME:s TOTAL_WORKS:i INDIA_RATE_RATIO:d", "state_diag",
          tail="WHERE TOTAL_WORKS >= 500 AND INDIA_RATE_RATIO > 1.1")
def _(c):
    return reports.high_rate_states(
        reports.state_diagnostic(c.analysis_of(*reports.STATE_DIAGNOSTIC_FEATURES)), 500, 1.1)


@register("agg39_filter_values", "FACET:s VALUE:s", None, sql=" UNION ALL ".join(
    f"SELECT DISTINCT '{k}' AS FACET, CAST({v} AS VARCHAR) AS VALUE FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 "
    f"AND {v} <> ''" for k, v in search.FACETS.items()))
def _(c):
    return search.filter_values(search.in_scope(c.hybrid))


def _chart(chart: str, c: str, where: str = "") -> str:
    return (f"SELECT '{chart}' AS CHART, coalesce(CAST({c} AS VARCHAR), 'Unknown') AS NAME, "
            f"CAST(count(*) AS DOUBLE) AS VALUE FROM hyb {where} GROUP BY 1, 2")


_CAND = "WHERE INVESTIGATION_CANDIDATE = 1"


@register("agg40_chart_feeds", "CHART:s NAME:s VALUE:f", None, sql=" UNION ALL ".join([
    _chart("RISK", "HYBRID_RISK_LEVEL"), _chart("CONSENSUS", "INDEPENDENT_SIGNAL_COUNT", _CAND),
    f"SELECT * FROM ({_chart('TOP_STATES', 'STATE_NAME', _CAND)} ORDER BY VALUE DESC, NAME LIMIT 10)",
    _chart("CATEGORY", "WORK_CATEGORY"), _chart("STAGE", "WORK_STAGE")] + [
    f"SELECT 'SPENDING', '{n}', CAST(sum({v}) AS DOUBLE) FROM fin" for n, v in (
        ("Total Sanctioned", "SANCTION_AMOUNT"), ("Total Disbursed", "TOTAL_FUND_DISBURSED_AMT"),
        ("Reported Actual", "ACTUAL_AMOUNT"))]))
def _(c):
    return search.chart_feeds(c.hybrid, c.plan.financial)


@register("agg41_collection_rollup", "STATE:s RECORDS:i MPS:i CONSTITUENCIES:i", None, sql="""
SELECT STATE_NAME AS STATE, count(*) AS RECORDS, count(DISTINCT MP_ID) AS MPS,
  count(DISTINCT CONSTITUENCY_ID) AS CONSTITUENCIES FROM raw WHERE STATE_NAME IS NOT NULL GROUP BY 1""")
def _(c):
    return reports.collection_rollup(c.raw).withColumnRenamed("_STATE_NAME", "STATE")


# --- windows, ranks, order statistics --------------------------------------------------------

GROUP_SPEC = (
    "WORK_ID:i STATE_WORK_COUNT:i MP_WORK_COUNT:i CONSTITUENCY_WORK_COUNT:i CATEGORY_WORK_COUNT:i "
    "ACTIVITY_WORK_COUNT:i STATE_TOTAL_RECOMMENDED:m STATE_TOTAL_SANCTIONED:m "
    "STATE_TOTAL_DISBURSED:m STATE_AVG_WORK_COST:d MP_TOTAL_RECOMMENDED:m MP_TOTAL_SANCTIONED:m "
    "MP_TOTAL_DISBURSED:m MP_AVG_SANCTION_AMOUNT:d MP_MEDIAN_SANCTION_AMOUNT:d "
    "CONSTITUENCY_TOTAL_SANCTIONED:m CONSTITUENCY_TOTAL_DISBURSED:m CONSTITUENCY_AVG_SANCTION:d"
)


@register("win01_group_features", GROUP_SPEC, "feat")
def _(c):
    return c.plan.features_plan


@register("win05_peer_stats", "STATE_NAME:s WORK_CATEGORY:s ACTIVITY_NAME:s PEER_COUNT:i "
          "PEER_MEDIAN_SANCTION:d PEER_MEAN_SANCTION:d PEER_STD_SANCTION:f PEER_MEDIAN_DISBURSED:d",
          "peer_st")
def _(c):
    return features.peer_stats(cleaning.fill_peer_keys(c.plan.financial, features.PEER_KEYS))


LOO_SPEC = (
    "WORK_ID:i STAT_PEER_GROUP:s STAT_PEER_COUNT:i STAT_LOO_PEER_MEAN_SANCTION:d STAT_PEER_Q1:d "
    "STAT_PEER_MEDIAN:d STAT_PEER_Q3:d STAT_PEER_IQR:d STAT_SANCTION_TO_PEER_MEDIAN:d"
)


def _loo(c):
    narrow = cleaning.fill_peer_keys(
        c.plan.financial.select(
            "WORK_ID", *features.PEER_KEYS, "SANCTION_AMOUNT", "TOTAL_FUND_DISBURSED_AMT"
        ),
        features.PEER_KEYS,
    )
    peers = statistics.leave_one_out(features.attach_peers(narrow, skew=c.settings.skew))
    return peers.withColumns(
        {"STAT_PEER_GROUP": tx.group_label(features.PEER_KEYS), "STAT_PEER_COUNT": F.col("PEER_COUNT")}
    )


register("win07_leave_one_out", LOO_SPEC, "stats0")(_loo)


@register("win08_tail_thresholds", "MEASURE:s N:i Q_LOW:d Q_HIGH:d", None, sql="""
SELECT 'PAYMENT' AS MEASURE, PAY_N AS N, PAY_HI AS Q_LOW, PAY_X AS Q_HIGH FROM limits UNION ALL
SELECT 'VENDOR', VEN_N, VEN_HI, VEN_X FROM limits UNION ALL
SELECT 'FREQUENCY', FREQ_N, FREQ_HI, FREQ_X FROM limits UNION ALL
SELECT 'DURATION', DUR_N, DUR_Q1, DUR_Q3 FROM limits UNION ALL
SELECT 'COMPLETENESS', COMP_N, COMP_LOW, COMP_LOW FROM limits""")
def _(c):
    return statistics.tail_thresholds(features.row_features(c.plan.financial))


@register("win09_score_ranks", "WORK_ID:i RULE_SCORE:i RULE_SCORE_CALIBRATED:d", None, sql="""
SELECT WORK_ID, RULE_SCORE, coalesce(R, 0) AS RULE_SCORE_CALIBRATED
FROM scored_rules LEFT JOIN rule_rank USING (WORK_ID)""")
def _(c):
    return fusion.calibrate(c.plan.detected, "RULE")


@register("win10_percentile_rank", "WORK_ID:i ML_ANOMALY_STRENGTH:m ML_PERCENTILE:d ML_SEVERITY:s", "ml")
def _(c):
    return c.proxy_ml


@register("win10_crowded_ranks", "WORK_ID:i CROWDED:m PERCENTILE:d", None, sql="""
SELECT WORK_ID, V AS CROWDED, (rank() OVER (ORDER BY V) - 1
  + (count(*) OVER (PARTITION BY V) + 1) / 2e0) / count(*) OVER () * 100 AS PERCENTILE
FROM (SELECT WORK_ID, 1 + ML_ANOMALY_STRENGTH * 1e-15 AS V FROM ml)""")
def _(c):
    crowded = (1 + F.col("ML_ANOMALY_STRENGTH") * F.lit(1e-15)).alias("CROWDED")
    return ranking.percent_rank_of(
        c.proxy_ml.select("WORK_ID", crowded), "CROWDED", "PERCENTILE", spread="WORK_ID",
        skew=Skew(hot_rows=100),
    )


@register("win14_stratified_top", "WORK_ID:i HYBRID_RISK_LEVEL:s SELECTION_SCORE:d", None, extra={
    "picks": """SELECT WORK_ID, HYBRID_RISK_LEVEL, HYBRID_RISK_SCORE * 100 + INDEPENDENT_SIGNAL_COUNT * 20
  + RULE_SCORE + STAT_SCORE + ML_PERCENTILE * 0.5e0 + least(coalesce(PAYMENT_COUNT, 0), 50) * 0.5e0
  + least(coalesce(UNIQUE_VENDOR_COUNT, 0), 30) * 0.5e0 AS SELECTION_SCORE FROM hyb WHERE INVESTIGATION_CANDIDATE = 1"""},
    sql="""
SELECT WORK_ID, HYBRID_RISK_LEVEL, SELECTION_SCORE FROM (
  SELECT *, row_number() OVER (PARTITION BY HYBRID_RISK_LEVEL ORDER BY SELECTION_SCORE DESC, WORK_ID) AS RN FROM picks)
WHERE RN <= CASE HYBRID_RISK_LEVEL WHEN 'CRITICAL' THEN 50 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 ELSE 0 END""")
def _(c):
    return explain.select_for_review(search.in_scope(c.hybrid))


# --- sorts, pages, sets, filters ---------------------------------------------------------------


@register("srt01_queue_order", "WORK_ID:i INVESTIGATION_PRIORITY:s HYBRID_RISK_SCORE:d ML_PERCENTILE:d", None, sql="""
SELECT * FROM hyb ORDER BY CASE INVESTIGATION_PRIORITY WHEN 'P0' THEN 5 ELSE CAST(INVESTIGATION_PRIORITY[2] AS INT) END,
  HYBRID_RISK_SCORE DESC, ML_PERCENTILE DESC, WORK_ID""")
def _(c):
    return fusion.queue_order(c.hybrid)


@register("srt02_rule_candidates", "WORK_ID:i RULE_SCORE:i STRONG_RULE_COUNT:i RULE_TRIGGER_COUNT:i", None, sql="""
SELECT * FROM scored_rules WHERE RULE_CANDIDATE = 1
ORDER BY RULE_SCORE DESC, STRONG_RULE_COUNT DESC, RULE_TRIGGER_COUNT DESC, WORK_ID""")
def _(c):
    return rules.rule_candidates(c.plan.detected)


@register("srt03_stat_candidates", "WORK_ID:i STAT_SCORE:i STAT_CATEGORY_COUNT:i STAT_TRIGGER_COUNT:i", None, sql="""
SELECT * FROM scored_stats WHERE STAT_CANDIDATE = 1 ORDER BY STAT_SCORE DESC, STAT_CATEGORY_COUNT DESC,
  STAT_STRONG_RULE_COUNT DESC, STAT_TRIGGER_COUNT DESC, WORK_ID""")
def _(c):
    return statistics.statistical_candidates(c.plan.detected)


@register("srt05_top_anomalies", "WORK_ID:i ML_PERCENTILE:d RULE_AGREEMENT:b STATISTICAL_AGREEMENT:b "
          "DETECTOR_AGREEMENT_COUNT:i", None, sql="""
SELECT WORK_ID, ML_PERCENTILE, RULE_CANDIDATE = 1 AS RULE_AGREEMENT, STAT_CANDIDATE = 1 AS STATISTICAL_AGREEMENT,
  1 + RULE_CANDIDATE + STAT_CANDIDATE AS DETECTOR_AGREEMENT_COUNT
FROM hyb WHERE ML_ANOMALY = 1 ORDER BY ML_PERCENTILE DESC, WORK_ID LIMIT 100""")
def _(c):
    scored = c.hybrid.join(c.proxy_ml.select("WORK_ID", "ML_ANOMALY", "IF_DECISION_SCORE"), "WORK_ID")
    return reports.top_anomalies(scored)


_PAGE = "lower(HYBRID_RISK_LEVEL) = 'medium' AND contains(lower(concat_ws(' ', CAST(WORK_ID AS VARCHAR), STATE_NAME, CONSTITUENCY, MP_NAME, WORK_DESCRIPTION, ACTIVITY_NAME)), 'building')"


@register("srt06_search_page", "WORK_ID:i HYBRID_RISK_SCORE:d IS_CANDIDATE:b", None, sql=f"""
SELECT *, INVESTIGATION_CANDIDATE = 1 AS IS_CANDIDATE FROM hyb WHERE {_PAGE}
ORDER BY HYBRID_RISK_SCORE DESC, CAST(WORK_ID AS VARCHAR) LIMIT 50 OFFSET 20""")
def _(c):
    return search.query_works(
        c.hybrid, search=" Building ", scope="all", limit=50, offset=20, risk="medium"
    ).rows


@register("srt06_search_meta", "TOTAL:i LIMIT:i OFFSET:i HAS_MORE:b", None, sql=f"""
SELECT count(*) AS TOTAL, 50 AS "LIMIT", 20 AS "OFFSET", 70 < count(*) AS HAS_MORE FROM hyb WHERE {_PAGE}""")
def _(c):
    return search.query_works(
        c.hybrid, search=" Building ", scope="all", limit=50, offset=20, risk="medium"
    ).meta


@register("agg26_overview_from_cube", "STATE_NAME:s ANALYZED_WORKS:i CANDIDATES:i CRITICAL:i HIGH:i "
          "MEDIUM:i LOW:i CANDIDATE_RATE_PERCENT:d", None, sql="""
SELECT STATE_NAME, count(*) AS ANALYZED_WORKS, sum(INVESTIGATION_CANDIDATE) AS CANDIDATES,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL = 'CRITICAL') AS CRITICAL,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL = 'HIGH') AS HIGH,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL = 'MEDIUM') AS MEDIUM,
  count(*) FILTER (WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL = 'LOW') AS LOW,
  round_even(sum(INVESTIGATION_CANDIDATE) * 1e0 / count(*) * 100e0 * 100e0, 0) / 100e0 AS CANDIDATE_RATE_PERCENT
FROM hyb GROUP BY 1""")
def _(c):
    return index.cube_state_overview(c.cube)


@register("agg27_summary_from_cube", "TOTAL:i CRITICAL:i HIGH:i MEDIUM:i LOW:i NONE:i ALL_THREE:i "
          "TWO_METHODS:i ONE_METHOD:i AVERAGE_HYBRID_RISK_SCORE:d", None, sql="""
SELECT count(*) AS TOTAL, count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'CRITICAL') AS CRITICAL,
  count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'HIGH') AS HIGH,
  count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'MEDIUM') AS MEDIUM,
  count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'LOW') AS LOW,
  count(*) FILTER (WHERE HYBRID_RISK_LEVEL = 'NONE') AS "NONE",
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 3) AS ALL_THREE,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 2) AS TWO_METHODS,
  count(*) FILTER (WHERE INDEPENDENT_SIGNAL_COUNT = 1) AS ONE_METHOD,
  round_even(CAST(sum(CAST(HYBRID_RISK_SCORE AS DECIMAL(18,1))) AS DOUBLE) / count(*) * 100e0, 0) / 100e0
    AS AVERAGE_HYBRID_RISK_SCORE
FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 AND lower(STATE_NAME) = 'nation_3'""")
def _(c):
    # A fifth of the works go and come back, as in a reload.
    some = c.hybrid.filter("WORK_ID % 5 = 0")
    cube = index.refresh_cube(c.cube, some, some.limit(0))
    return index.cube_summary(index.refresh_cube(cube, some.limit(0), some), state=" Nation_3 ")


@register("agg39_values_from_cube", "FACET:s VALUE:s", None, sql=" UNION ALL ".join(
    f"SELECT DISTINCT '{k}' AS FACET, CAST({v} AS VARCHAR) AS VALUE FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 "
    f"AND {v} <> ''" for k, v in search.FACETS.items()))
def _(c):
    return index.cube_filter_values(c.cube)


@register("srt06_deep_page", "WORK_ID:i HYBRID_RISK_SCORE:d IS_CANDIDATE:b", None, sql="""
SELECT *, INVESTIGATION_CANDIDATE = 1 AS IS_CANDIDATE FROM hyb
ORDER BY HYBRID_RISK_SCORE DESC, CAST(WORK_ID AS VARCHAR) LIMIT 100 OFFSET 1450""")
def _(c):
    return c.pages.page("all", limit=100, offset=1450).rows


@register("srt06_candidate_total", "TOTAL:i LIMIT:i OFFSET:i HAS_MORE:b", None, sql="""
SELECT count(*) AS TOTAL, 50 AS "LIMIT", 100 AS "OFFSET", 150 < count(*) AS HAS_MORE FROM hyb
WHERE INVESTIGATION_CANDIDATE = 1""")
def _(c):
    return c.pages.page(limit=50, offset=100).meta


def _found(words: str) -> str:
    text = "lower(concat_ws(' ', CAST(WORK_ID AS VARCHAR), STATE_NAME, CONSTITUENCY, MP_NAME, WORK_DESCRIPTION, ACTIVITY_NAME))"
    return f"SELECT WORK_ID, '{words}' AS QUERY FROM hyb WHERE contains({text}, '{words}')"


_QUERIES = ("building", "12", "117", "nation_3 ", "no such words", "customer#0000001")


@register("flt07_trigram_search", "WORK_ID:i QUERY:s", None, sql=" UNION ALL ".join(
    _found(q.strip()) for q in _QUERIES))
def _(c):
    return reduce(DataFrame.unionByName, [
        c.index.find(q).select("WORK_ID", F.lit(q.strip()).alias("QUERY")) for q in _QUERIES])


@register("srt06_next_page", "WORK_ID:i HYBRID_RISK_SCORE:d", None, sql="""
SELECT * FROM hyb WHERE HYBRID_RISK_SCORE < 50 OR (HYBRID_RISK_SCORE = 50 AND CAST(WORK_ID AS VARCHAR) > '5')
ORDER BY HYBRID_RISK_SCORE DESC, CAST(WORK_ID AS VARCHAR) LIMIT 25""")
def _(c):
    return search.next_page(c.hybrid, 50.0, "5", 25)


@register("set02_all_three", "WORK_ID:i", None, sql="""
SELECT WORK_ID FROM scored_rules WHERE RULE_CANDIDATE = 1 INTERSECT
SELECT WORK_ID FROM scored_stats WHERE STAT_CANDIDATE = 1 INTERSECT SELECT WORK_ID FROM ml WHERE ML_ANOMALY = 1""")
def _(c):
    return reports.group_members(c.hybrid, "ALL_THREE")


@register("set03_rule_only", "WORK_ID:i", None, sql="""
SELECT WORK_ID FROM scored_rules WHERE RULE_CANDIDATE = 1 EXCEPT
(SELECT WORK_ID FROM scored_stats WHERE STAT_CANDIDATE = 1 UNION SELECT WORK_ID FROM ml WHERE ML_ANOMALY = 1)""")
def _(c):
    return reports.group_members(c.hybrid, "RULE_ONLY")


@register("flt02_completed_records", "WORK_ID:i ACTUAL_AMOUNT:m ACTUAL_END_DATE:t AVERAGE_RATING:d", None, sql="""
SELECT CAST(DTL_ID AS BIGINT) AS WORK_ID, CAST(ACTUAL_AMOUNT AS DECIMAL(18,2)) AS ACTUAL_AMOUNT,
  CAST(strptime(ACTUAL_END_DATE, '%d-%m-%Y') AS DATE) AS ACTUAL_END_DATE, CAST(AVERAGE_RATING AS DOUBLE) AS AVERAGE_RATING
FROM raw WHERE SOURCE_KEY = 'Works Completed' AND ACTUAL_AMOUNT IS NOT NULL""")
def _(c):
    return cleaning.extract_completions(c.raw, COMPLETED)


@register("flt05_facets", "WORK_ID:i HYBRID_RISK_SCORE:d", None, sql="""
SELECT * FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 AND STATE_NAME = 'NATION_7' AND DETECTOR_AGREEMENT = 'TWO METHODS AGREE'
  AND INVESTIGATION_PRIORITY = 'P2'""")
def _(c):
    return search.facet_filter(
        search.in_scope(c.hybrid), state="nation_7 ", agreement="two methods agree", priority="p2", mp=None
    )


@register("flt09_negative_timelines", "WORK_ID:i RECOMMENDATION_TO_SANCTION_DAYS:i", None, sql="""
SELECT * FROM feat WHERE RECOMMENDATION_TO_SANCTION_DAYS < 0 OR SANCTION_TO_COMPLETION_DAYS < 0""")
def _(c):
    return reports.negative_timelines(
        features.row_features(c.plan.financial),
        ["RECOMMENDATION_TO_SANCTION_DAYS", "SANCTION_TO_COMPLETION_DAYS"],
    )


@register("flt09_extreme_costs", "WORK_ID:i SANCTION_TO_PEER_MEDIAN:d", None, sql="""
SELECT * FROM feat WHERE SANCTION_TO_PEER_MEDIAN IS NOT NULL ORDER BY SANCTION_TO_PEER_MEDIAN DESC, WORK_ID LIMIT 20""")
def _(c):
    return reports.extreme_costs(c.plan.features_plan, "SANCTION_TO_PEER_MEDIAN")


# --- scalar functions ---------------------------------------------------------------------------


@register("fn01_scalar_functions", "WORK_ID:i RATIO:d DAYS:i ROUNDED:d LOGGED:d MISSING:i NAME_KEY:s LABEL:s",
          None, sql=f"""
SELECT WORK_ID, {S.ratio('SANCTION_AMOUNT', 'RECOMMENDED_AMOUNT')} AS RATIO,
  {S.dd('RECOMMENDATION_DATE', 'SANCTION_DATE')} AS DAYS,
  round_even(CAST(SANCTION_AMOUNT AS DOUBLE) / 3e0 * 100e0, 0) / 100e0 AS ROUNDED,
  CASE WHEN SANCTION_AMOUNT IS NOT NULL THEN ln(1 + greatest(CAST(SANCTION_AMOUNT AS DOUBLE), 0)) END AS LOGGED,
  (SANCTION_AMOUNT IS NULL)::INT + (ACTIVITY_NAME IS NULL)::INT AS MISSING,
  regexp_replace(replace(lower(WORK_DESCRIPTION), '&', 'and'), '[^a-z0-9]', '', 'g') AS NAME_KEY,
  concat_ws(' | ', STATE_NAME, WORK_CATEGORY) AS LABEL FROM works""")
def _(c):
    return c.works.select(
        "WORK_ID", fn.ratio("SANCTION_AMOUNT", "RECOMMENDED_AMOUNT").alias("RATIO"),
        fn.days("RECOMMENDATION_DATE", "SANCTION_DATE").alias("DAYS"),
        fn.round_even(F.col("SANCTION_AMOUNT").cast("double") / 3.0, 2).alias("ROUNDED"),
        fn.log_amount("SANCTION_AMOUNT").alias("LOGGED"),
        fn.missing_count(["SANCTION_AMOUNT", "ACTIVITY_NAME"]).alias("MISSING"),
        fn.name_key("WORK_DESCRIPTION").alias("NAME_KEY"),
        tx.group_label(["STATE_NAME", "WORK_CATEGORY"]).alias("LABEL"),
    )


@register("fn10_text_functions", "WORK_ID:i MONEY:s NUMBER:s DAYS:s PERCENT:s", None, sql=f"""
SELECT WORK_ID, {S.money('SANCTION_AMOUNT')} AS MONEY, {S.number('PAYMENTS_PER_100_DAYS')} AS NUMBER,
  {S.day_count('COMPLETION_DURATION_DAYS')} AS DAYS, {S.percent('DISBURSED_TO_SANCTION_RATIO')} AS PERCENT FROM fin""")
def _(c):
    return c.plan.financial_plan.select(
        "WORK_ID", tx.money("SANCTION_AMOUNT").alias("MONEY"),
        tx.number("PAYMENTS_PER_100_DAYS").alias("NUMBER"),
        tx.day_count("COMPLETION_DURATION_DAYS").alias("DAYS"),
        tx.percent("DISBURSED_TO_SANCTION_RATIO").alias("PERCENT"),
    )


@register("fn16_json_functions", "EVENT_ID:i K:i VALUES:i", None, sql="""
SELECT event_id AS EVENT_ID, CAST(json_extract_string(props, '$.k') AS BIGINT) AS K, 1 AS "VALUES" FROM events""")
def _(c):
    # a fenced answer with the event's object inside, then a list field
    events = c.spark.read.parquet(f"{c.dir}/events.parquet")
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    body = tx.answer_json(fenced)
    listed = F.concat(F.lit('["'), F.get_json_object(body, "$.k"), F.lit('"]'))
    return events.select(
        F.col("event_id").alias("EVENT_ID"), F.get_json_object(body, "$.k").alias("K"),
        F.size(tx.json_list(listed)).alias("VALUES"),
    )


@register("fn18_fingerprint", "EVENT_ID:i HASH:s", None, sql="""
SELECT event_id AS EVENT_ID, sha256('{"event_type":"' || event_type || '","event_id":' || event_id || '}') AS HASH
FROM events""")
def _(c):
    events = c.spark.read.parquet(f"{c.dir}/events.parquet")
    return events.select(
        F.col("event_id").alias("EVENT_ID"), tx.fingerprint("event_type", "event_id").alias("HASH")
    )


@register("fn20_fallback_levels", "WORK_ID:i LEVEL:s DETECTORS:i", None, sql="""
SELECT WORK_ID, CASE WHEN HYBRID_RISK_SCORE >= 60 THEN 'CRITICAL' WHEN HYBRID_RISK_SCORE >= 40 THEN 'HIGH'
  WHEN HYBRID_RISK_SCORE >= 20 THEN 'MEDIUM' WHEN HYBRID_RISK_SCORE > 0 THEN 'LOW' ELSE 'NONE' END AS LEVEL,
  INDEPENDENT_SIGNAL_COUNT AS DETECTORS FROM hyb""")
def _(c):
    return c.hybrid.select(
        "WORK_ID", search.fallback_level(F.col("HYBRID_RISK_SCORE")).alias("LEVEL"),
        search.detector_count(F.col("DETECTOR_SET")).alias("DETECTORS"),
    )


# --- features -----------------------------------------------------------------------------------

ROW_SPEC = (
    "WORK_ID:i RECOMMENDED_TO_SANCTION_DIFFERENCE:m SANCTION_TO_RECOMMENDED_RATIO:d "
    "DISBURSED_TO_RECOMMENDED_RATIO:d REMAINING_SANCTION_RATIO:d AVERAGE_PAYMENT_AMOUNT:d "
    "PAYMENT_SUCCESS_RATIO:d PAYMENT_IN_PROGRESS_RATIO:d PAYMENTS_PER_VENDOR:d "
    "RECOMMENDATION_TO_SANCTION_DAYS:i SANCTION_TO_FIRST_PAYMENT_DAYS:i "
    "RECOMMENDATION_TO_FIRST_PAYMENT_DAYS:i LAST_PAYMENT_TO_COMPLETION_DAYS:i "
    "RECOMMENDATION_TO_COMPLETION_DAYS:i PAYMENTS_PER_30_DAYS:d DISBURSED_PER_EXPENDITURE_DAY:d "
    "IS_COMPLETED:i HAS_ACTUAL_AMOUNT:i HAS_ACTUAL_END_DATE:i ACTUAL_MINUS_SANCTION:m "
    "ACTUAL_MINUS_DISBURSED:m DISBURSED_MINUS_ACTUAL:m NO_PAYMENT_RECORD:i MULTIPLE_PAYMENTS:i "
    "MULTIPLE_VENDORS:i PAYMENT_COUNT_GE_5:i PAYMENT_COUNT_GE_10:i VENDOR_COUNT_GE_5:i "
    "VENDOR_COUNT_GE_10:i MISSING_FIELD_COUNT:i DATA_COMPLETENESS_RATIO:d "
    "NEGATIVE_RECOMMENDATION_TO_SANCTION:i NEGATIVE_SANCTION_TO_PAYMENT:i "
    "COMPLETION_BEFORE_LAST_PAYMENT:i PAYMENT_AFTER_REPORTED_COMPLETION_DAYS:i "
    "ACTUAL_ABOVE_SANCTION:i DISBURSED_ABOVE_SANCTION:i RECOMMENDATION_YEAR:i "
    "RECOMMENDATION_MONTH:i SANCTION_YEAR:i FIRST_PAYMENT_YEAR:i COMPLETION_YEAR:i "
    "AVERAGE_PAYMENT_ABOVE_1M:i TOTAL_DISBURSED_ABOVE_5M:i"
)


@register("ft10_row_features", ROW_SPEC, "feat")
def _(c):
    return features.row_features(c.plan.financial_plan)


@register("ft22_peer_features", "WORK_ID:i STATE_NAME:s WORK_CATEGORY:s ACTIVITY_NAME:s PEER_COUNT:i "
          "PEER_MEDIAN_SANCTION:d PEER_MEAN_SANCTION:d PEER_STD_SANCTION:f PEER_MEDIAN_DISBURSED:d "
          "SANCTION_TO_PEER_MEDIAN:d DISBURSED_TO_PEER_MEDIAN:d SANCTION_PEER_Z_SCORE:d "
          "ABS_PEER_COST_Z_SCORE:d SANCTION_ABOVE_2X_PEER_MEDIAN:i SANCTION_ABOVE_5X_PEER_MEDIAN:i "
          "DISBURSED_ABOVE_2X_PEER_MEDIAN:i", "feat")
def _(c):
    return c.plan.features_plan


# --- detectors, fusion, evidence ------------------------------------------------------------------

RULE_SPEC = (
    " ".join(f"{n}:i" for n in S.RULES) + " WORK_ID:i RULE_FINANCIAL_SCORE:i RULE_PAYMENT_SCORE:i "
    "RULE_TIMELINE_SCORE:i RULE_PAYMENT_STATUS_SCORE:i RULE_DIVERSITY_BONUS:i RULE_CATEGORY_COUNT:i "
    "RULE_SCORE:i RULE_SEVERITY:s RULE_TRIGGER_COUNT:i STRONG_RULE_COUNT:i "
    "VERIFICATION_FLAG_COUNT:i RULE_CANDIDATE:i RULE_FLAGS:s RULE_REASONS:s RULE_VERIFICATION_NOTES:s"
)


@register("ru01_rule_scores", RULE_SPEC, "scored_rules")
def _(c):
    return c.plan.rules


STAT_SPEC = (
    " ".join(f"{n}:i" for n in S.SIGNALS) + " WORK_ID:i STAT_FINANCIAL_SCORE:i "
    "STAT_PAYMENT_BEHAVIOR_SCORE:i STAT_PAYMENT_SUBSIGNAL_COUNT:i STAT_PAYMENT_CORROBORATION_BONUS:i "
    "STAT_TIMELINE_SCORE:i STAT_CATEGORY_COUNT:i STAT_DIVERSITY_BONUS:i STAT_SCORE:i STAT_SEVERITY:s "
    "STAT_TRIGGER_COUNT:i STAT_STRONG_RULE_COUNT:i STAT_VERIFICATION_FLAG_COUNT:i STAT_CANDIDATE:i "
    "STAT_FLAGS:s STAT_REASONS:s STAT_VERIFICATION_NOTES:s"
)


@register("st04_statistical_scores", STAT_SPEC, "scored_stats")
def _(c):
    return c.plan.statistics


HYBRID_SPEC = (
    "WORK_ID:i RULE_SCORE:i RULE_SCORE_CALIBRATED:d STAT_SCORE:i STAT_SCORE_CALIBRATED:d "
    "ML_PERCENTILE:d ML_SCORE_CALIBRATED:d ML_SEVERITY:s ML_CANDIDATE:i PEER_DATA_SUFFICIENT:i "
    "SCORE_REGIME:s DATA_QUALITY_TIER:s RULE_COMPONENT:d STAT_COMPONENT:d ML_COMPONENT:d "
    "AGREEMENT_BONUS:d INDEPENDENT_SIGNAL_COUNT:i DETECTOR_AGREEMENT:s DETECTOR_SET:s "
    "HYBRID_RISK_SCORE:d HYBRID_RISK_LEVEL:s INVESTIGATION_PRIORITY:s INVESTIGATION_CANDIDATE:i"
)


@register("hy01_hybrid_risk", HYBRID_SPEC, "hyb")
def _(c):
    return fusion.require_consensus_first(c.hybrid)


QUEUE_SPEC = (
    "WORK_ID:i STATE_NAME:s INVESTIGATION_PRIORITY:s HYBRID_RISK_SCORE:d "
    "RECOMMENDED_TO_SANCTION_RATIO:d DATA_COMPLETENESS:d FIRST_PAYMENT_DATE:t LAST_PAYMENT_DATE:t "
    "COMPLETION_DATE:t DETECTOR_EVIDENCE:s FACTUAL_EVIDENCE:s VERIFICATION_FLAGS:s "
    "INVESTIGATION_SUMMARY:s"
)


@register("ev02_investigation_queue", QUEUE_SPEC, "queue")
def _(c):
    return c.queue


@register("ev01_evidence_ratios", "WORK_ID:i ACTUAL_TO_SANCTION_RATIO:d DISBURSED_TO_SANCTION_RATIO:d "
          "RECOMMENDED_TO_SANCTION_RATIO:d SANCTION_TO_PEER_MEDIAN_CALCULATED:d", "queue")
def _(c):
    return evidence.evidence_ratios(evidence.candidates_with_facts(c.hybrid, c.plan.features))


@register("ev08_dossier", "work_id:s state_name:s final_risk_level:s sanction_amount:m payment_count:i "
          "sanction_date:t peer_count:i missing_field_count:i investigation_summary:s", None, sql="""
SELECT CAST(WORK_ID AS VARCHAR) AS work_id, STATE_NAME AS state_name, HYBRID_RISK_LEVEL AS final_risk_level,
  SANCTION_AMOUNT AS sanction_amount, PAYMENT_COUNT AS payment_count, SANCTION_DATE AS sanction_date,
  PEER_COUNT AS peer_count, MISSING_FIELD_COUNT AS missing_field_count, INVESTIGATION_SUMMARY AS investigation_summary
FROM queue""")
def _(c):
    return evidence.dossier(c.queue).select(
        "work_id", "identity.state_name", "risk.final_risk_level", "financial.sanction_amount",
        "transactions.payment_count", "timeline.sanction_date", "peer_comparison.peer_count",
        "data_quality.missing_field_count", "investigation.investigation_summary",
    )


_NUM3 = """CASE WHEN {x} IS NULL THEN 'Not available' WHEN round_even({x} * 1e3, 0) / 1e3 = floor(round_even({x} * 1e3, 0) / 1e3)
  THEN CAST(CAST(round_even({x} * 1e3, 0) / 1e3 AS BIGINT) AS VARCHAR)
  ELSE regexp_replace(format('{{:.3f}}', round_even({x} * 1e3, 0) / 1e3), '0+$', '') END"""


@register("ev11_review_requests", "WORK_ID:i STATE:s SANCTION:s PER_30:s VENDORS:s HASHED:b", None, extra={
    "picks": """SELECT *, HYBRID_RISK_SCORE * 100 + INDEPENDENT_SIGNAL_COUNT * 20
  + RULE_SCORE + STAT_SCORE + ML_PERCENTILE * 0.5e0 + least(coalesce(PAYMENT_COUNT, 0), 50) * 0.5e0
  + least(coalesce(UNIQUE_VENDOR_COUNT, 0), 30) * 0.5e0 AS SELECTION_SCORE FROM hyb WHERE INVESTIGATION_CANDIDATE = 1"""},
    sql=f"""
SELECT WORK_ID, coalesce(STATE_NAME, 'Not available') AS STATE, {S.money('SANCTION_AMOUNT', 0)} AS SANCTION,
  {_NUM3.format(x='CAST(PAYMENTS_PER_30_DAYS AS DOUBLE)')} AS PER_30,
  {_NUM3.format(x='CAST(UNIQUE_VENDOR_COUNT AS DOUBLE)')} AS VENDORS, TRUE AS HASHED FROM (
  SELECT *, row_number() OVER (PARTITION BY HYBRID_RISK_LEVEL ORDER BY SELECTION_SCORE DESC, WORK_ID) AS RN FROM picks)
WHERE RN <= CASE HYBRID_RISK_LEVEL WHEN 'CRITICAL' THEN 50 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 ELSE 0 END""")
def _(c):
    requests = explain.review_requests(explain.select_for_review(c.queue))
    return requests.select(
        "WORK_ID", F.get_json_object("EVIDENCE", "$.state").alias("STATE"),
        F.get_json_object("EVIDENCE", "$.sanction").alias("SANCTION"),
        F.get_json_object("EVIDENCE", "$.payments_per_30_days").alias("PER_30"),
        F.get_json_object("EVIDENCE", "$.vendor_count").alias("VENDORS"),
        (F.sha2("EVIDENCE", 256) == F.col("EVIDENCE_HASH")).alias("HASHED"),
    )


def _answers(c):
    """Answers derived from the queue: fenced, plain, incomplete and unreadable."""
    level = F.col("HYBRID_RISK_LEVEL")
    body = F.to_json(F.struct(
        F.col("DETECTOR_AGREEMENT").alias("summary"), F.array("STATE_NAME").alias("signals"),
        F.array(F.lit("check records")).alias("verify"), F.lit("LOW").alias("confidence"),
    ))
    text = (
        F.when(level == "CRITICAL", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(level == "HIGH", F.concat(F.lit("Here it is: "), body))
        .when(level == "MEDIUM", F.lit('{"summary": "x"}'))
        .otherwise(F.lit("no object"))
    )
    return c.hybrid.filter("INVESTIGATION_CANDIDATE = 1").select("WORK_ID", text.alias("answer"))


@register("ev12_read_answers", "WORK_ID:i STATUS:s RISK_SUMMARY:s OBSERVED_SIGNALS:s WHAT_TO_VERIFY:s "
          "CONFIDENCE:s", None, sql="""
SELECT WORK_ID, 'GENERATED' AS STATUS, DETECTOR_AGREEMENT AS RISK_SUMMARY, '["' || STATE_NAME || '"]' AS OBSERVED_SIGNALS,
  '["check records"]' AS WHAT_TO_VERIFY, 'LOW' AS CONFIDENCE
FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL IN ('CRITICAL', 'HIGH')""")
def _(c):
    return explain.read_answers(_answers(c))[0]


@register("ev12_rejected_answers", "WORK_ID:i", None, sql="""
SELECT WORK_ID FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL NOT IN ('CRITICAL', 'HIGH')""")
def _(c):
    return explain.read_answers(_answers(c))[1]


@register("set05_explanation_table", "WORK_ID:i STATUS:s RISK_SUMMARY:s CONFIDENCE:s", None, extra={
    "picks": """SELECT *, row_number() OVER (PARTITION BY HYBRID_RISK_LEVEL ORDER BY HYBRID_RISK_SCORE * 100 + INDEPENDENT_SIGNAL_COUNT * 20
  + RULE_SCORE + STAT_SCORE + ML_PERCENTILE * 0.5e0 + least(coalesce(PAYMENT_COUNT, 0), 50) * 0.5e0
  + least(coalesce(UNIQUE_VENDOR_COUNT, 0), 30) * 0.5e0 DESC, WORK_ID)
  <= CASE HYBRID_RISK_LEVEL WHEN 'CRITICAL' THEN 50 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 ELSE 0 END AS PICKED
  FROM hyb WHERE INVESTIGATION_CANDIDATE = 1"""}, sql="""
SELECT WORK_ID, CASE WHEN PICKED AND HYBRID_RISK_LEVEL = 'MEDIUM' THEN 'REJECTED' WHEN PICKED THEN 'GENERATED'
    ELSE 'NOT_SELECTED' END AS STATUS,
  CASE WHEN PICKED AND HYBRID_RISK_LEVEL <> 'MEDIUM' THEN DETECTOR_AGREEMENT ELSE '' END AS RISK_SUMMARY,
  CASE WHEN PICKED AND HYBRID_RISK_LEVEL <> 'MEDIUM' THEN 'LOW' ELSE '' END AS CONFIDENCE FROM picks""")
def _(c):
    candidates = search.in_scope(c.hybrid)
    usable, _ = explain.read_answers(_answers(c))
    return explain.explanation_table(candidates, explain.select_for_review(candidates), usable)


@register("ev13_cache_state", "WORK_ID:i CACHE_STATE:s", None, sql="""
SELECT WORK_ID, CASE HYBRID_RISK_LEVEL WHEN 'CRITICAL' THEN 'FRESH' WHEN 'HIGH' THEN 'STALE' ELSE 'MISSING' END AS CACHE_STATE
FROM hyb WHERE INVESTIGATION_CANDIDATE = 1""")
def _(c):
    candidates = search.in_scope(c.hybrid)
    requests = explain.review_requests(candidates.withColumn("SELECTION_SCORE", F.lit(0.0)))
    known = requests.join(candidates.select("WORK_ID", "HYBRID_RISK_LEVEL"), "WORK_ID")
    cache = known.filter(F.col("HYBRID_RISK_LEVEL").isin("CRITICAL", "HIGH")).select(
        "WORK_ID",
        F.when(F.col("HYBRID_RISK_LEVEL") == "CRITICAL", F.col("EVIDENCE_HASH")).otherwise("old")
        .alias("EVIDENCE_HASH"),
    )
    return explain.cached_answers(requests, cache)


@register("ev14_default_explanation", "WORK_ID:i RISK_SUMMARY:s SIGNALS:i CONFIDENCE:s", None, sql=f"""
SELECT WORK_ID, 'Work #' || WORK_ID || ' evaluated with a Hybrid Risk Score of ' || {S.number('HYBRID_RISK_SCORE')}
  || ' (' || INVESTIGATION_PRIORITY || ' priority). Triaged under ' || DETECTOR_AGREEMENT || '.' AS RISK_SUMMARY,
  1 + CASE WHEN PAYMENTS_PER_30_DAYS > 0 THEN 1 ELSE 0 END + CASE WHEN UNIQUE_VENDOR_COUNT > 1 THEN 1 ELSE 0 END
    + CASE WHEN DISBURSED_TO_SANCTION_RATIO > 0.8e0 THEN 1 ELSE 0 END AS SIGNALS, 'medium' AS CONFIDENCE FROM queue""")
def _(c):
    return explain.default_explanation(c.queue).withColumn(
        "SIGNALS", F.size(tx.json_list("OBSERVED_SIGNALS"))
    )


@register("ev09_unified_records", "WORK_ID:i INVESTIGATION_SUMMARY:s VERIFICATION_FLAGS:s "
          "MISSING_FIELD_COUNT:i PAYMENTS_PER_30_DAYS:d SANCTION_PEER_Z_SCORE:f SANCTION_DATE:t "
          "PAYMENT_SUCCESS_COUNT:i PEER_COUNT:i EXPLAINED:b", None, sql=f"""
SELECT h.WORK_ID, coalesce(q.INVESTIGATION_SUMMARY, 'Work record #' || h.WORK_ID
    || ' analyzed by multi-detector engine with risk score ' || {S.number('h.HYBRID_RISK_SCORE')} || '.') AS INVESTIGATION_SUMMARY,
  coalesce(q.VERIFICATION_FLAGS, CASE WHEN h.HYBRID_RISK_LEVEL = 'CRITICAL' THEN 'FLAGGED_BY_CONSENSUS' ELSE 'BASELINE_AUDIT' END)
    AS VERIFICATION_FLAGS, f.MISSING_FIELD_COUNT, f.PAYMENTS_PER_30_DAYS, f.SANCTION_PEER_Z_SCORE,
  f.SANCTION_DATE, f.PAYMENT_SUCCESS_COUNT, f.PEER_COUNT,
  h.INVESTIGATION_CANDIDATE = 1 AND h.HYBRID_RISK_LEVEL IN ('CRITICAL', 'HIGH') AS EXPLAINED
FROM hyb h LEFT JOIN queue q USING (WORK_ID) LEFT JOIN feat f USING (WORK_ID)""")
def _(c):
    usable, _ = explain.read_answers(_answers(c))
    return explain.unified_record(c.hybrid, c.plan.features, c.queue, usable)


# --- first generation -----------------------------------------------------------------------------

S.relation("g_pay", """
SELECT CAST(DTL_ID AS BIGINT) AS WORK_ID, TRY_CAST(VENDOR_ID AS BIGINT) AS VENDOR_ID,
  TRY_CAST(FUND_DISBURSED_AMT AS DECIMAL(18,2)) AS AMT, CAST(strptime(EXPENDITURE_DATE, '%d-%m-%Y') AS DATE) AS PAID_ON
FROM raw WHERE SOURCE_KEY LIKE 'Expenditure%' AND FUND_DISBURSED_AMT IS NOT NULL GROUP BY 1, 2, 3, 4
""")
S.relation("g_sum", """
SELECT WORK_ID, coalesce(sum(AMT), 0) AS TD, count(AMT) AS TC, CAST(sum(AMT) AS DOUBLE) / nullif(count(AMT), 0) AS AV,
  max(AMT) AS MX, min(AMT) AS MN, count(DISTINCT VENDOR_ID) AS VC, count(DISTINCT PAID_ON) AS DC FROM g_pay GROUP BY 1
""")


def _level_cte(name: str, keys: str) -> None:
    S.relation(name, f"""
SELECT {keys}, {S.median('SANCTION_AMOUNT')} AS MED, {S.mean('SANCTION_AMOUNT')} AS MEAN,
  stddev_samp(CAST(SANCTION_AMOUNT AS DOUBLE)) AS STD, count(SANCTION_AMOUNT) AS N FROM consol GROUP BY {keys}""")


_level_cte("g_lv_a", "STATE_NAME, WORK_CATEGORY, ACTIVITY_NAME")
_level_cte("g_lv_b", "STATE_NAME, WORK_CATEGORY")
_level_cte("g_lv_c", "WORK_CATEGORY")
S.relation("g_peer", """
SELECT w.WORK_ID,
  CASE WHEN SANCTION_AMOUNT IS NULL THEN 'NONE' WHEN a.N - 1 >= 10 THEN 'STATE_CATEGORY_ACTIVITY'
       WHEN b.N - 1 >= 10 THEN 'STATE_CATEGORY' WHEN c.N - 1 >= 10 THEN 'CATEGORY' ELSE 'NONE' END AS PEER_LEVEL,
  CASE WHEN SANCTION_AMOUNT IS NULL THEN 0 WHEN a.N - 1 >= 10 THEN a.N - 1 WHEN b.N - 1 >= 10 THEN b.N - 1
       WHEN c.N - 1 >= 10 THEN c.N - 1 ELSE 0 END AS PEER_COUNT,
  CASE WHEN SANCTION_AMOUNT IS NULL THEN NULL WHEN a.N - 1 >= 10 THEN a.MED WHEN b.N - 1 >= 10 THEN b.MED
       WHEN c.N - 1 >= 10 THEN c.MED END AS PEER_MEDIAN_SANCTION,
  CASE WHEN SANCTION_AMOUNT IS NULL THEN NULL WHEN a.N - 1 >= 10 THEN a.MEAN WHEN b.N - 1 >= 10 THEN b.MEAN
       WHEN c.N - 1 >= 10 THEN c.MEAN END AS PEER_MEAN_SANCTION,
  CASE WHEN SANCTION_AMOUNT IS NULL THEN NULL WHEN a.N - 1 >= 10 THEN a.STD WHEN b.N - 1 >= 10 THEN b.STD
       WHEN c.N - 1 >= 10 THEN c.STD END AS PEER_STD_SANCTION
FROM consol w
  LEFT JOIN g_lv_a a ON w.STATE_NAME IS NOT DISTINCT FROM a.STATE_NAME AND w.WORK_CATEGORY IS NOT DISTINCT FROM a.WORK_CATEGORY
    AND w.ACTIVITY_NAME IS NOT DISTINCT FROM a.ACTIVITY_NAME
  LEFT JOIN g_lv_b b ON w.STATE_NAME IS NOT DISTINCT FROM b.STATE_NAME AND w.WORK_CATEGORY IS NOT DISTINCT FROM b.WORK_CATEGORY
  LEFT JOIN g_lv_c c ON w.WORK_CATEGORY IS NOT DISTINCT FROM c.WORK_CATEGORY
""")
S.relation("g_dev", """
SELECT w.WORK_ID, w.STATE_NAME, w.WORK_CATEGORY, w.ACTIVITY_NAME, CAST(SANCTION_AMOUNT AS DOUBLE) AS X, a.MED, a.N
FROM consol w LEFT JOIN g_lv_a a ON w.STATE_NAME IS NOT DISTINCT FROM a.STATE_NAME
  AND w.WORK_CATEGORY IS NOT DISTINCT FROM a.WORK_CATEGORY AND w.ACTIVITY_NAME IS NOT DISTINCT FROM a.ACTIVITY_NAME
""")
S.relation("g_mad", """
SELECT STATE_NAME, WORK_CATEGORY, ACTIVITY_NAME, quantile_cont(abs(X - MED), 0.5) AS MAD FROM g_dev GROUP BY 1, 2, 3
""")
S.relation("g_robust", """
SELECT d.WORK_ID, CASE WHEN N - 1 >= 10 AND MAD > 0 THEN (X - MED) / (MAD * 1.4826e0) END AS COST_VS_PEER_ROBUST_Z,
  CASE WHEN N - 1 >= 10 AND X IS NOT NULL THEN
    (rank() OVER (PARTITION BY d.STATE_NAME, d.WORK_CATEGORY, d.ACTIVITY_NAME ORDER BY X) - 1
     + (count(*) OVER (PARTITION BY d.STATE_NAME, d.WORK_CATEGORY, d.ACTIVITY_NAME, X) + 1) / 2e0) / N * 100e0 END
    AS COST_PEER_PERCENTILE
FROM g_dev d JOIN g_mad m ON d.STATE_NAME IS NOT DISTINCT FROM m.STATE_NAME AND d.WORK_CATEGORY IS NOT DISTINCT FROM m.WORK_CATEGORY
  AND d.ACTIVITY_NAME IS NOT DISTINCT FROM m.ACTIVITY_NAME
""")
_g = S.flag
S.relation("g_feat", f"""
SELECT w.* EXCLUDE (WORK_ID), w.WORK_ID, p.* EXCLUDE (WORK_ID), r.* EXCLUDE (WORK_ID),
  coalesce(CAST(TD AS DOUBLE), 0) AS TOTAL_DISBURSED, coalesce(TC, 0) AS TRANSACTION_COUNT, coalesce(VC, 0) AS VENDOR_COUNT,
  coalesce(AV, 0) AS AVERAGE_TRANSACTION_AMOUNT, coalesce(CAST(MX AS DOUBLE), 0) AS MAX_TRANSACTION_AMOUNT,
  {S.dd('RECOMMENDATION_DATE', 'SANCTION_DATE')} AS RECOMMENDATION_TO_SANCTION_DAYS,
  {S.dd('SANCTION_DATE', 'ACTUAL_END_DATE')} AS SANCTION_TO_COMPLETION_DAYS,
  {_g('SANCTION_DATE < RECOMMENDATION_DATE OR ACTUAL_END_DATE < SANCTION_DATE OR ACTUAL_END_DATE < RECOMMENDATION_DATE')}
    AS NEGATIVE_TIMELINE_FLAG,
  {S.ratio('SANCTION_AMOUNT', 'PEER_MEDIAN_SANCTION')} AS COST_VS_PEER_MEDIAN,
  CASE WHEN PEER_STD_SANCTION > 0 THEN (CAST(SANCTION_AMOUNT AS DOUBLE) - PEER_MEAN_SANCTION) / PEER_STD_SANCTION END AS COST_Z_SCORE,
  {S.ratio('coalesce(TD, 0)', 'SANCTION_AMOUNT')} AS DISBURSEMENT_TO_SANCTION_RATIO,
  CAST(SANCTION_AMOUNT AS DOUBLE) - coalesce(CAST(TD AS DOUBLE), 0) AS UNSPENT_AMOUNT,
  CASE WHEN SANCTION_AMOUNT IS NOT NULL THEN ln(1 + greatest(CAST(SANCTION_AMOUNT AS DOUBLE), 0)) END AS LOG_SANCTION_AMOUNT,
  {S.ratio('MX', 'AV')} AS TRANSACTION_AMOUNT_VARIATION,
  1 - ((RECOMMENDATION_DATE IS NULL)::INT + (SANCTION_DATE IS NULL)::INT + (ACTUAL_END_DATE IS NULL)::INT
    + (RECOMMENDED_AMOUNT IS NULL)::INT + (SANCTION_AMOUNT IS NULL)::INT + (ACTUAL_AMOUNT IS NULL)::INT) / 6e0
    AS DATA_COMPLETENESS_SCORE,
  {_g('coalesce(TC, 0) >= 3')} AS HIGH_TRANSACTION_COUNT_FLAG, {_g('coalesce(VC, 0) > 1')} AS MULTIPLE_VENDOR_FLAG,
  {_g('coalesce(TC, 0) = 0')} AS NO_EXPENDITURE_RECORD_FLAG,
  {_g('IS_RECOMMENDED = 1 AND IS_SANCTIONED = 0')} AS RECOMMENDED_NOT_SANCTIONED_FLAG,
  {_g('IS_SANCTIONED = 1 AND IS_COMPLETED = 0')} AS SANCTIONED_NOT_COMPLETED_FLAG,
  {_g('IS_COMPLETED = 1 AND coalesce(TC, 0) = 0')} AS COMPLETED_WITHOUT_EXPENDITURE_FLAG,
  {_g('SANCTION_AMOUNT < RECOMMENDED_AMOUNT')} AS SANCTION_BELOW_RECOMMENDED_FLAG
FROM consol w LEFT JOIN g_sum s ON w.WORK_ID = s.WORK_ID JOIN g_peer p ON w.WORK_ID = p.WORK_ID
  JOIN g_robust r ON w.WORK_ID = r.WORK_ID
""")
AUDIT_SPEC = (
    "WORK_ID:i TOTAL_DISBURSED:m TRANSACTION_COUNT:i VENDOR_COUNT:i AVERAGE_TRANSACTION_AMOUNT:d "
    "MAX_TRANSACTION_AMOUNT:m RECOMMENDATION_TO_SANCTION_DAYS:i SANCTION_TO_COMPLETION_DAYS:i "
    "NEGATIVE_TIMELINE_FLAG:i DISBURSEMENT_TO_SANCTION_RATIO:d UNSPENT_AMOUNT:f LOG_SANCTION_AMOUNT:d "
    "TRANSACTION_AMOUNT_VARIATION:d DATA_COMPLETENESS_SCORE:d HIGH_TRANSACTION_COUNT_FLAG:i "
    "MULTIPLE_VENDOR_FLAG:i NO_EXPENDITURE_RECORD_FLAG:i RECOMMENDED_NOT_SANCTIONED_FLAG:i "
    "SANCTIONED_NOT_COMPLETED_FLAG:i COMPLETED_WITHOUT_EXPENDITURE_FLAG:i "
    "SANCTION_BELOW_RECOMMENDED_FLAG:i COST_VS_PEER_MEDIAN:d COST_Z_SCORE:d"
)


@register("fg05_audit_features", AUDIT_SPEC, "g_feat")
def _(c):
    return c.regional.features_plan


@register("fg01_master_ratios", "WORK_ID:i RECOMMENDATION_TO_SANCTION_RATIO:d ACTUAL_TO_SANCTION_RATIO:d "
          "SANCTION_MINUS_RECOMMENDED:f SANCTION_MINUS_ACTUAL:f RECOMMENDATION_TO_COMPLETION_DAYS:i "
          "MISSING_SANCTION_AMOUNT:i", None, sql=f"""
SELECT WORK_ID, CASE WHEN RECOMMENDED_AMOUNT <> 0 THEN CAST(SANCTION_AMOUNT AS DOUBLE) / CAST(RECOMMENDED_AMOUNT AS DOUBLE) END AS RECOMMENDATION_TO_SANCTION_RATIO,
  CASE WHEN SANCTION_AMOUNT <> 0 THEN CAST(ACTUAL_AMOUNT AS DOUBLE) / CAST(SANCTION_AMOUNT AS DOUBLE) END AS ACTUAL_TO_SANCTION_RATIO,
  SANCTION_AMOUNT - RECOMMENDED_AMOUNT AS SANCTION_MINUS_RECOMMENDED, SANCTION_AMOUNT - ACTUAL_AMOUNT AS SANCTION_MINUS_ACTUAL,
  {S.dd('RECOMMENDATION_DATE', 'ACTUAL_END_DATE')} AS RECOMMENDATION_TO_COMPLETION_DAYS,
  {_g('SANCTION_AMOUNT IS NULL')} AS MISSING_SANCTION_AMOUNT FROM consol""")
def _(c):
    return audit.master_ratios(c.regional.works_plan)


@register("win13_hierarchical_peers", "WORK_ID:i PEER_LEVEL:s PEER_COUNT:i PEER_MEDIAN_SANCTION:d "
          "PEER_MEAN_SANCTION:d PEER_STD_SANCTION:f", "g_peer")
def _(c):
    return audit.hierarchical_peers(c.regional.works)


@register("win11_robust_peer_z", "WORK_ID:i COST_VS_PEER_ROBUST_Z:d", "g_robust")
def _(c):
    return audit.robust_peer_z(c.regional.works)


@register("win12_peer_percentile", "WORK_ID:i COST_PEER_PERCENTILE:d", "g_robust")
def _(c):
    return audit.peer_percentile(c.regional.works)


# First-generation code -> (condition, points, wording).
_AUDIT_RULES = {
    "ACTUAL_GT_SANCTION": ("ACTUAL_AMOUNT > SANCTION_AMOUNT", 30, "Actual expenditure exceeds sanctioned amount"),
    "DISBURSEMENT_GT_SANCTION": ("TOTAL_DISBURSED > SANCTION_AMOUNT", 30, "Total disbursement exceeds sanctioned amount"),
    "EXTREME_PEER_COST": ("COST_VS_PEER_MEDIAN >= 5", 20, "Sanctioned cost is at least 5x the peer-group median"),
    "HIGH_PEER_COST": ("COST_VS_PEER_MEDIAN >= 2 AND COST_VS_PEER_MEDIAN < 5", 10, "Sanctioned cost is at least 2x the peer-group median"),
    "EXTREME_COST_ZSCORE": ("COST_Z_SCORE >= 5", 15, "Cost is an extreme statistical outlier within the peer group"),
    "HIGH_COST_ZSCORE": ("COST_Z_SCORE >= 3 AND COST_Z_SCORE < 5", 8, "Cost is a statistically significant outlier within the peer group"),
    "MULTIPLE_VENDORS": ("VENDOR_COUNT > 1", 6, "Multiple vendors are associated with the work"),
    "HIGH_TRANSACTION_COUNT": ("TRANSACTION_COUNT >= 4", 5, "Work contains an unusually high number of expenditure transactions"),
    "MULTIPLE_TRANSACTIONS": ("TRANSACTION_COUNT >= 2 AND TRANSACTION_COUNT < 4", 2, "Work contains multiple expenditure transactions"),
    "SANCTIONED_NO_EXPENDITURE": ("SANCTION_AMOUNT > 0 AND TOTAL_DISBURSED = 0", 5, "Work is sanctioned but no expenditure has been recorded"),
    "SANCTIONED_NOT_COMPLETED": ("SANCTION_AMOUNT > 0 AND IS_COMPLETED = 0", 3, "Work is sanctioned but completion has not been recorded"),
    "RECOMMENDED_NOT_SANCTIONED": ("RECOMMENDED_AMOUNT > 0 AND SANCTION_AMOUNT IS NULL", 2, "Work has a recommendation but no sanction amount is recorded"),
    "CHRONOLOGY_VIOLATION": ("NEGATIVE_TIMELINE_FLAG = 1", 15, "Work contains an invalid event chronology"),
}
_PCT = "CASE WHEN COST_PEER_PERCENTILE <= 1 THEN COST_PEER_PERCENTILE * 100 ELSE COST_PEER_PERCENTILE END"
_COST_SIGNALS = {
    "PEER_RATIO_HIGH": ("COST_VS_PEER_MEDIAN >= 2 AND COST_VS_PEER_MEDIAN < 5", 15, "Sanctioned cost is at least 2x the peer-group median"),
    "PEER_RATIO_EXTREME": ("COST_VS_PEER_MEDIAN >= 5 AND COST_VS_PEER_MEDIAN < 10", 30, "Sanctioned cost is at least 5x the peer-group median"),
    "PEER_RATIO_SEVERE": ("COST_VS_PEER_MEDIAN >= 10", 40, "Sanctioned cost is at least 10x the peer-group median"),
    "ZSCORE_HIGH": ("COST_Z_SCORE >= 3 AND COST_Z_SCORE < 5", 20, "Cost is more than 3 standard deviations above the peer distribution"),
    "ZSCORE_EXTREME": ("COST_Z_SCORE >= 5 AND COST_Z_SCORE < 10", 30, "Cost is more than 5 standard deviations above the peer distribution"),
    "ZSCORE_SEVERE": ("COST_Z_SCORE >= 10", 40, "Cost is an extremely distant statistical outlier"),
    "ROBUST_Z_HIGH": ("COST_VS_PEER_ROBUST_Z >= 3 AND COST_VS_PEER_ROBUST_Z < 5", 15, "Cost is significantly above the robust peer distribution"),
    "ROBUST_Z_EXTREME": ("COST_VS_PEER_ROBUST_Z >= 5", 25, "Cost is an extreme outlier under robust statistical analysis"),
    "PEER_PERCENTILE_HIGH": (f"{_PCT} >= 95 AND {_PCT} < 99", 10, "Cost lies in the top 5% of the peer distribution"),
    "PEER_PERCENTILE_EXTREME": (f"{_PCT} >= 99", 20, "Cost lies in the top 1% of the peer distribution"),
}


def _audit_sql(book: dict, prefix: str, score: str, nothing: str, extra: str = "") -> str:
    points = " + ".join(f"CASE WHEN {w} THEN {p} ELSE 0 END" for w, p, _ in book.values())
    codes = ", ".join(f"CASE WHEN {w} THEN '{k}' END" for k, (w, _, _) in book.items())
    texts = ", ".join(f"CASE WHEN {w} THEN '{t}' END" for w, _, t in book.values())
    return f"""
SELECT *, CASE WHEN {score} >= 70 THEN 'CRITICAL' WHEN {score} >= 40 THEN 'HIGH' WHEN {score} >= 20 THEN 'MEDIUM' ELSE 'LOW' END
  AS {prefix}_RISK_LEVEL, {score} >= 20 AS {prefix}_ANOMALY_FLAG FROM (
SELECT WORK_ID, {extra} CAST(least(greatest({points}, 0), 100) AS DOUBLE) AS {score}, concat_ws('|', {codes}) AS {prefix}_REASON_CODES,
  coalesce(nullif(concat_ws(' | ', {texts}), ''), '{nothing}') AS {prefix}_REASONS FROM g_feat)"""


S.relation("g_rules", _audit_sql(
    _AUDIT_RULES, "RULE", "RULE_SCORE", "No rule-based anomaly detected",
    "CAST((RECOMMENDATION_DATE IS NULL)::INT + (SANCTION_DATE IS NULL)::INT + (SANCTION_AMOUNT IS NULL AND "
    "RECOMMENDED_AMOUNT IS NOT NULL)::INT AS DOUBLE) AS DATA_QUALITY_SCORE,"))
S.relation("g_stats", _audit_sql(
    _COST_SIGNALS, "STATISTICAL", "STATISTICAL_SCORE", "No statistical anomaly detected",
    "CASE WHEN PEER_COUNT >= 30 THEN 'HIGH' WHEN PEER_COUNT >= 10 THEN 'MEDIUM' WHEN PEER_COUNT < 10 THEN 'LOW' "
    "ELSE 'UNKNOWN' END AS STATISTICAL_CONFIDENCE,"))


@register("rg01_audit_rules", "WORK_ID:i DATA_QUALITY_SCORE:d RULE_SCORE:d RULE_RISK_LEVEL:s "
          "RULE_ANOMALY_FLAG:b RULE_REASON_CODES:s RULE_REASONS:s", "g_rules")
def _(c):
    return c.regional.rules


@register("sg01_cost_signals", "WORK_ID:i STATISTICAL_CONFIDENCE:s STATISTICAL_SCORE:d "
          "STATISTICAL_RISK_LEVEL:s STATISTICAL_ANOMALY_FLAG:b STATISTICAL_REASON_CODES:s "
          "STATISTICAL_REASONS:s", "g_stats")
def _(c):
    return c.regional.statistics


# The model score of the checked first-generation fusion is a stand-in: the
# transaction count as a share of the largest one.
S.relation("g_ml", """
SELECT WORK_ID, round_even(TRANSACTION_COUNT * 1e0 / (SELECT max(TRANSACTION_COUNT) FROM g_feat) * 100e0 * 100e0, 0) / 100e0 AS SC
FROM g_feat
""")
S.relation("g_hyb0", """
SELECT r.*, s.* EXCLUDE (WORK_ID), SC, RULE_SCORE * 0.35e0 AS RULE_CONTRIBUTION, STATISTICAL_SCORE * 0.35e0 AS STATISTICAL_CONTRIBUTION,
  SC * 0.3e0 AS ML_CONTRIBUTION, RULE_ANOMALY_FLAG::INT + STATISTICAL_ANOMALY_FLAG::INT + (SC >= 60)::INT AS DETECTOR_AGREEMENT_COUNT
FROM g_rules r JOIN g_stats s USING (WORK_ID) JOIN g_ml USING (WORK_ID)
""")
S.relation("g_hyb", """
SELECT *, CASE FINAL_RISK_LEVEL WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3
  ELSE CASE WHEN DETECTOR_AGREEMENT_COUNT >= 2 THEN 4 ELSE 5 END END AS INVESTIGATION_PRIORITY,
  coalesce(nullif(concat_ws(' | ',
    CASE WHEN RULE_REASONS <> 'No rule-based anomaly detected' THEN 'RULE: ' || RULE_REASONS END,
    CASE WHEN STATISTICAL_REASONS <> 'No statistical anomaly detected' THEN 'STATISTICAL: ' || STATISTICAL_REASONS END,
    CASE DETECTOR_AGREEMENT_COUNT WHEN 3 THEN 'All three detection layers identify unusual behavior'
      WHEN 2 THEN 'Two independent detection layers identify unusual behavior'
      WHEN 1 THEN 'Only one detection layer identifies unusual behavior' END), ''),
    'No significant anomaly evidence detected') AS EVIDENCE_SUMMARY FROM (
SELECT *, CASE DETECTOR_AGREEMENT_COUNT WHEN 3 THEN 'STRONG' WHEN 2 THEN 'MODERATE' WHEN 1 THEN 'SINGLE_DETECTOR' ELSE 'NONE' END
    AS DETECTOR_AGREEMENT,
  CASE WHEN H >= 70 AND DETECTOR_AGREEMENT_COUNT >= 2 THEN 'CRITICAL' WHEN H >= 50 AND DETECTOR_AGREEMENT_COUNT >= 2 THEN 'HIGH'
       WHEN H >= 65 AND DETECTOR_AGREEMENT_COUNT >= 1 THEN 'HIGH' WHEN H >= 30 THEN 'MEDIUM'
       WHEN H >= 20 AND DETECTOR_AGREEMENT_COUNT >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS FINAL_RISK_LEVEL,
  H AS HYBRID_RISK_SCORE FROM (
SELECT *, round_even(least(greatest(RULE_CONTRIBUTION + STATISTICAL_CONTRIBUTION + ML_CONTRIBUTION, 0), 100) * 100e0, 0) / 100e0 AS H
FROM g_hyb0))
""")


def _audit_hybrid(c):
    f = c.regional.features
    most = f.agg(F.max("TRANSACTION_COUNT")).scalar()
    score = fn.round_even(F.col("TRANSACTION_COUNT") / most * 100.0, 2)
    ml = f.select("WORK_ID", score.alias("ISOLATION_FOREST_SCORE")).withColumns({
        "ISOLATION_FOREST_RISK_LEVEL": rules.risk_level(F.col("ISOLATION_FOREST_SCORE"), 80, 60, 40),
        "ISOLATION_FOREST_ANOMALY_FLAG": F.col("ISOLATION_FOREST_SCORE") >= 60,
        "ISOLATION_FOREST_REASON": F.lit("No strong Isolation Forest anomaly detected"),
    })
    return c.regional.hybrid_with(ml)


register("hy13_audit_fusion", "WORK_ID:i RULE_CONTRIBUTION:d STATISTICAL_CONTRIBUTION:d ML_CONTRIBUTION:d "
         "HYBRID_RISK_SCORE:d DETECTOR_AGREEMENT_COUNT:i DETECTOR_AGREEMENT:s FINAL_RISK_LEVEL:s "
         "INVESTIGATION_PRIORITY:i EVIDENCE_SUMMARY:s", "g_hyb")(_audit_hybrid)


@register("ev07_audit_records", "WORK_ID:i RISK_LEVEL:s FINANCIAL:i STATISTICAL:i TRANSACTION:i TIMELINE:i "
          "SUMMARY:s", None, extra={"joined": """
SELECT f.*, h.FINAL_RISK_LEVEL FROM g_feat f JOIN (SELECT WORK_ID, FINAL_RISK_LEVEL FROM g_hyb) h USING (WORK_ID)"""},
          sql="""
SELECT WORK_ID, FINAL_RISK_LEVEL AS RISK_LEVEL,
  coalesce((ACTUAL_AMOUNT > SANCTION_AMOUNT)::INT, 0) + coalesce((TOTAL_DISBURSED > SANCTION_AMOUNT)::INT, 0)
    + coalesce((COST_VS_PEER_MEDIAN >= 2)::INT, 0) AS FINANCIAL,
  coalesce((COST_Z_SCORE >= 3)::INT, 0) AS STATISTICAL, (VENDOR_COUNT > 1)::INT + (TRANSACTION_COUNT >= 2)::INT AS TRANSACTION,
  (RECOMMENDATION_DATE IS NOT NULL AND SANCTION_DATE IS NOT NULL)::INT
    + (SANCTION_DATE IS NOT NULL AND ACTUAL_END_DATE IS NOT NULL)::INT AS TIMELINE,
  coalesce('The work shows ' || nullif(concat_ws('; ',
    CASE WHEN COST_VS_PEER_MEDIAN >= 2 THEN 'sanctioned cost is ' || format('{:.2f}', COST_VS_PEER_MEDIAN) || 'x the peer median' END,
    CASE WHEN COST_Z_SCORE >= 3 THEN 'peer-group z-score is ' || format('{:.2f}', COST_Z_SCORE) END,
    CASE WHEN ACTUAL_AMOUNT > SANCTION_AMOUNT THEN 'actual expenditure exceeds sanction' END,
    CASE WHEN TOTAL_DISBURSED > SANCTION_AMOUNT THEN 'disbursement exceeds sanction' END,
    CASE WHEN VENDOR_COUNT > 1 THEN VENDOR_COUNT || ' vendors recorded' END,
    CASE WHEN TRANSACTION_COUNT >= 2 THEN TRANSACTION_COUNT || ' expenditure transactions' END), '') || '.',
    'No major evidence signals were identified.') AS SUMMARY FROM joined""")
def _(c):
    records = c.regional.evidence_with(settle(_audit_hybrid(c), "audit_hybrid"))
    return records.select(
        F.col("work_id").alias("WORK_ID"), F.col("risk.risk_level").alias("RISK_LEVEL"),
        *[F.size(f"evidence.{k.lower()}").alias(k)
          for k in ("FINANCIAL", "STATISTICAL", "TRANSACTION", "TIMELINE")],
        F.col("summary").alias("SUMMARY"),
    )


@register("srt04_master_order", "STATE_NAME:s CONSTITUENCY:s MP_NAME:s WORK_ID:i", "works")
def _(c):
    return cleaning.master_order(c.works)


@register("srt07_transactions_by_work", "WORK_ID:i EXPENDITURE_DATE:t VENDOR_ID:i FUND_DISBURSED_AMT:m", "pays")
def _(c):
    return aggregates.transactions_by_work(aggregates.payment_rows(c.payments))


@register("srt08_audit_results", "WORK_ID:i INVESTIGATION_PRIORITY:i HYBRID_RISK_SCORE:d", None, sql="""
SELECT * FROM g_hyb ORDER BY INVESTIGATION_PRIORITY, HYBRID_RISK_SCORE DESC, WORK_ID""")
def _(c):
    return results_sorted(_audit_hybrid(c))


@register("src12_flat_records", "WORK_ID:i FINAL_RISK_LEVEL:s VENDOR_COUNT:i PEER_Z_SCORE:d SANCTION_DATE:t "
          "HAS_FINDINGS:b", None, sql="""
SELECT f.WORK_ID, FINAL_RISK_LEVEL, VENDOR_COUNT, COST_Z_SCORE AS PEER_Z_SCORE, SANCTION_DATE,
  ACTUAL_AMOUNT > SANCTION_AMOUNT IS TRUE OR TOTAL_DISBURSED > SANCTION_AMOUNT IS TRUE OR COST_VS_PEER_MEDIAN >= 2 IS TRUE
    AS HAS_FINDINGS FROM g_feat f JOIN (SELECT WORK_ID, FINAL_RISK_LEVEL FROM g_hyb) USING (WORK_ID)""")
def _(c):
    records = c.regional.evidence_with(settle(_audit_hybrid(c), "audit_hybrid"))
    flat = sinks.flatten_struct(records, evidence.FLAT_FIELDS)
    return flat.withColumn("HAS_FINDINGS", F.col("FINANCIAL_EVIDENCE") != "[]")


@register("agg28_ml_severity", "ML_SEVERITY:s WORK_COUNT:i PERCENTAGE:d", None,
          sql=_levels_sql("ML_SEVERITY", ("NONE", "LOW", "MEDIUM", "HIGH"), "ml"))
def _(c):
    return reports.level_summary(c.proxy_ml, "ML_SEVERITY", ("NONE", "LOW", "MEDIUM", "HIGH"))


@register("agg42_cross_state_ids", "COLUMN:s CONFLICTING_IDS:i", None, sql="""
SELECT '_STATE_NAME' AS "COLUMN", count(*) AS CONFLICTING_IDS FROM (
  SELECT DTL_ID FROM raw GROUP BY 1 HAVING count(DISTINCT STATE_NAME) > 1) UNION ALL
SELECT '_SOURCE_KEY', count(*) FROM (SELECT DTL_ID FROM raw GROUP BY 1 HAVING count(DISTINCT SOURCE_KEY) > 1)""")
def _(c):
    return reports.conflict_counts(
        c.raw, "WORK_RECOMMENDATION_DTL_ID", ["_STATE_NAME", "_SOURCE_KEY"]
    )


@register("flt03_expenditure_records", "DTL_ID:s ORD:s FUND_DISBURSED_AMT:s", None, sql="""
SELECT DTL_ID, ORD, FUND_DISBURSED_AMT FROM raw WHERE SOURCE_KEY LIKE 'Expenditure%'""")
def _(c):
    return aggregates.expenditure_records(c.raw).withColumnsRenamed(
        {"WORK_RECOMMENDATION_DTL_ID": "DTL_ID", "_ord": "ORD"}
    )


@register("ev15_migrated_answers", "WORK_ID:i SOURCE:s", None, sql="""
SELECT WORK_ID, CASE WHEN HYBRID_RISK_LEVEL = 'CRITICAL' THEN NULL ELSE 'legacy_migration' END AS SOURCE
FROM hyb WHERE INVESTIGATION_CANDIDATE = 1 AND HYBRID_RISK_LEVEL IN ('CRITICAL', 'HIGH')""")
def _(c):
    candidates = search.in_scope(c.hybrid)
    requests = explain.review_requests(candidates.withColumn("SELECTION_SCORE", F.lit(0.0)))
    cache = candidates.filter("HYBRID_RISK_LEVEL = 'CRITICAL'").select("WORK_ID")
    legacy = c.hybrid.filter(F.col("HYBRID_RISK_LEVEL").isin("CRITICAL", "HIGH")).select("WORK_ID")
    return explain.migrate_answers(cache, legacy, requests)


@register("ev06_queue_with_latest_answers", "WORK_ID:i ANSWER:s", None, sql="""
SELECT WORK_ID, arg_max(LETTER_NO || '/' || ORD, ORD) AS ANSWER FROM (
  SELECT CAST(DTL_ID AS BIGINT) AS WORK_ID, coalesce(LETTER_NO, '-') AS LETTER_NO, ORD FROM raw) GROUP BY 1""")
def _(c):
    # every landed record of a work stands for one answer; the last one counts
    answers = c.raw.select(
        F.col("WORK_RECOMMENDATION_DTL_ID").cast("bigint").alias("WORK_ID"),
        F.concat(F.coalesce("LETTER_NO", F.lit("-")), F.lit("/"), F.col("_ord")).alias("ANSWER"),
        F.col("_ord").alias("o"),
    )
    return explain.latest_answers(answers, "o")


# The scores of severe works come twice and those of low ones lost their id: some checks fail.
_DAMAGED = """SELECT WORK_ID FROM ml WHERE ML_SEVERITY <> 'LOW' UNION ALL
  SELECT CAST(NULL AS BIGINT) FROM ml WHERE ML_SEVERITY = 'LOW' UNION ALL SELECT WORK_ID FROM ml WHERE ML_SEVERITY = 'HIGH'"""
_INTEGRITY = """SELECT unnest(['Feature WORK_ID complete', 'Feature WORK_ID unique', 'ML WORK_ID complete', 'ML WORK_ID unique',
    'ML rows match feature rows', 'ML WORK_ID count matches feature dataset', 'No ML output among features']) AS "CHECK",
  unnest([f.n = f.known, f.known = f.ids, m.n = m.known, m.known = m.ids, m.n = f.n, m.ids = f.ids, TRUE]) AS PASSED
FROM (SELECT count(*) AS n, count(WORK_ID) AS known, count(DISTINCT WORK_ID) AS ids FROM feat) f,
  (SELECT count(*) AS n, count(WORK_ID) AS known, count(DISTINCT WORK_ID) AS ids FROM damaged) m"""


def _damaged_ml(c) -> DataFrame:
    scores = c.proxy_ml.withColumn("IF_RAW_SCORE", -F.col("ML_ANOMALY_STRENGTH"))
    lost = F.when(F.col("ML_SEVERITY") != "LOW", F.col("WORK_ID"))
    return scores.withColumn("WORK_ID", lost).unionByName(scores.filter("ML_SEVERITY = 'HIGH'"))


@register("va11_integrity_checks", "CHECK:s PASSED:b", None, extra={"damaged": _DAMAGED}, sql=_INTEGRITY)
def _(c):
    return reports.ml_integrity(c.plan.features, _damaged_ml(c))


@register("va11_final_status", "PASSED:i FAILED:i STATUS:s", None,
          extra={"damaged": _DAMAGED, "verdicts": _INTEGRITY}, sql="""
SELECT count(*) FILTER (PASSED) AS PASSED, count(*) FILTER (NOT PASSED) AS FAILED,
  CASE WHEN bool_and(PASSED) THEN 'PASS' ELSE 'REVIEW REQUIRED' END AS STATUS FROM verdicts""")
def _(c):
    return reports.final_status(reports.ml_integrity(c.plan.features, _damaged_ml(c)))


@register("va10_severity_coverage", "ML_SEVERITY:s WORK_COUNT:i ANOMALIES:i", None, sql="""
SELECT ML_SEVERITY, count(*) AS WORK_COUNT, sum(ML_ANOMALY) AS ANOMALIES FROM ml GROUP BY 1""")
def _(c):
    return reports.severity_coverage(c.proxy_ml)


@register("hy18_uncapped_fusion", "WORK_ID:i HYBRID_RISK_SCORE:d", None, sql="""
SELECT WORK_ID, round_even((RULE_COMPONENT + STAT_COMPONENT + ML_COMPONENT + AGREEMENT_BONUS) * 10e0, 0) / 10e0 AS HYBRID_RISK_SCORE
FROM hyb""")
def _(c):
    return fusion.score_fusion(c.hybrid, FusionConfig(cap=False))


# --- audits -----------------------------------------------------------------------------------------

AUDIT = "SECTION:s METRIC:s VALUE:f"


def _section(section: str, metrics: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS SECTION, '{k}' AS METRIC, CAST({v} AS DOUBLE) AS VALUE FROM {source}"
        for k, v in metrics.items()
    )


def _keys_sql(source: str, key: str) -> str:
    return _section("KEYS", {
        "ROWS": "count(*)", "MISSING_KEYS": f"count(*) - count({key})",
        "UNIQUE_KEYS": f"count(DISTINCT {key})", "DUPLICATE_ROWS": f"count({key}) - count(DISTINCT {key})",
    }, source)


def _distinct_sql(section: str, columns: dict[str, str], source: str) -> str:
    both = {f"UNIQUE_{k}": f"count(DISTINCT {v})" for k, v in columns.items()}
    both |= {f"MISSING_{k}": f"count(*) - count({v})" for k, v in columns.items()}
    return _section(section, both, source)


_RAW_FIELDS = ("SANCTION_AMOUNT", "ACTUAL_AMOUNT", "FUND_DISBURSED_AMT", "MP_NAME", "CONSTITUENCY",
               "ACTIVITY_NAME", "WORK_CATEGORY", "WORK_STAGE", "RECOMMENDATION_DATE", "SANCTION_DATE",
               "ACTUAL_END_DATE")


@register("va01_audit_raw", AUDIT, None, extra={
    "copies": "SELECT count(*) AS N FROM raw GROUP BY ALL",
    "raw_rows": "SELECT * EXCLUDE (ORD) FROM raw",
    "ids": "SELECT DTL_ID, count(*) AS N FROM raw GROUP BY 1"}, sql=" UNION ALL ".join([
        "SELECT 'SOURCES' AS SECTION, SOURCE_KEY AS METRIC, CAST(count(*) AS DOUBLE) AS VALUE FROM raw GROUP BY 2",
        _section("DUPLICATES", {"ROWS": "count(*)", "EXACT_DUPLICATES":
                                "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_rows))"}, "raw_rows"),
        _section("IDS", {"ONCE": "count(*) FILTER (WHERE N = 1)", "REPEATED": "count(*) FILTER (WHERE N > 1)",
                         "MAX_REPETITIONS": "max(N)"}, "ids"),
        _distinct_sql("FIELDS", {**{f: f for f in _RAW_FIELDS}, "WORK_ID": "WORK_NO"}, "raw")]))
def _(c):
    return reports.audit_raw_records(c.raw_layer)


@register("va02_audit_collection", AUDIT, None, extra={"coll": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY DTL_ID ORDER BY {_RICH} DESC, ORD) AS RN FROM raw) WHERE RN = 1"""},
    sql=" UNION ALL ".join([
        _keys_sql("coll", "DTL_ID"),
        _distinct_sql("COVERAGE", {"_STATE_NAME": "STATE_NAME", "_MP_ID": "MP_ID", "_MP_NAME": "MP_NAME",
                                   "_CONSTITUENCY_ID": "CONSTITUENCY_ID", "_CONSTITUENCY": "CONSTITUENCY",
                                   "_SOURCE_KEY": "SOURCE_KEY"}, "coll"),
        "SELECT 'MAPPINGS', 'STATE_MP_CONSTITUENCY', CAST(count(*) AS DOUBLE) FROM "
        "(SELECT DISTINCT STATE_ID, MP_ID, CONSTITUENCY_ID FROM coll)",
        "SELECT 'CONFLICTS', '_STATE_NAME', CAST(count(*) AS DOUBLE) FROM (SELECT DTL_ID FROM coll GROUP BY 1 "
        "HAVING count(DISTINCT STATE_NAME) > 1)"]))
def _(c):
    return reports.audit_collection(settle(cleaning.most_complete(c.raw), "collection"))


_GAPPY = ("STATE_NAME", "SANCTION_AMOUNT", "SANCTION_DATE", "RECOMMENDATION_DATE", "ACTUAL_AMOUNT",
          "ACTUAL_END_DATE", "AVERAGE_RATING", "PAYMENT_COUNT", "FIRST_EXPENDITURE_DATE")


@register("va02_missing_profile", "COLUMN:s MISSING:i MISSING_PERCENT:d", None, sql=" UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{k}' AS "COLUMN", count(*) - count({k}) AS MISSING,
  (count(*) - count({k})) * 1e0 / count(*) * 100 AS MISSING_PERCENT FROM fin) WHERE MISSING > 0""" for k in _GAPPY))
def _(c):
    return reports.missing_profile(c.plan.financial.select(*_GAPPY))


#: Every column of a landed record but the landing order, with its name in the SQL relation.
_RECORD = {"WORK_RECOMMENDATION_DTL_ID": "DTL_ID", "WORK_ID": "WORK_NO"} | {
    f"_{c}": c for c in ("STATE_ID", "STATE_NAME", "MP_ID", "MP_NAME", "CONSTITUENCY_ID", "CONSTITUENCY", "SOURCE_KEY")
} | {c: c for c in (
    "STATE_NAME", "CONSTITUENCY_ID", "CONSTITUENCY", "MP_NAME", "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_DESCRIPTION",
    "RECOMMENDED_AMOUNT", "RECOMMENDATION_DATE", "WORK_STAGE", "SANCTION_AMOUNT", "SANCTION_DATE", "ATTACH_ID",
    "ACTUAL_AMOUNT", "ACTUAL_END_DATE", "AVERAGE_RATING", "FUND_DISBURSED_AMT", "EXPENDITURE_DATE", "VENDOR_ID",
    "VENDOR_NAME", "WORK_STATUS", "IA_NAME", "IDA_NAME", "LETTER_NO")}


@register("va02_collection_missing_profile", "COLUMN:s MISSING:i MISSING_PERCENT:d", None, extra={"coll": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY DTL_ID ORDER BY {_RICH} DESC, ORD) AS RN FROM raw) WHERE RN = 1"""},
    sql=" UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{k}' AS "COLUMN", count(*) - count({v}) AS MISSING,
  (count(*) - count({v})) * 1e0 / count(*) * 100 AS MISSING_PERCENT FROM coll) WHERE MISSING > 0"""
        for k, v in _RECORD.items()))
def _(c):
    return reports.missing_profile(cleaning.most_complete(c.raw).drop("_ord"))


@register("va02_record_duplicates", "ROWS:i DUPLICATE_ROWS:i", None, extra={
    "records": f"SELECT {', '.join(dict.fromkeys(_RECORD.values()))} FROM raw"}, sql="""
SELECT count(*) AS ROWS, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM records)) AS DUPLICATE_ROWS FROM records""")
def _(c):
    return reports.exact_duplicates(c.raw_layer.drop("_ord"))


@register("va02_exact_duplicates", "ROWS:i DUPLICATE_ROWS:i", None, extra={"short": """
SELECT STATE_NAME, SOURCE_KEY, SANCTION_AMOUNT, EXPENDITURE_DATE FROM raw"""}, sql="""
SELECT count(*) AS ROWS, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM short)) AS DUPLICATE_ROWS FROM short""")
def _(c):
    return reports.exact_duplicates(
        c.raw_layer.select("STATE_NAME", "_SOURCE_KEY", "SANCTION_AMOUNT", "EXPENDITURE_DATE"))


def _medians_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{k}' AS "COLUMN", count({k}) AS N, quantile_cont(CAST({k} AS DOUBLE), 0.5) AS MEDIAN FROM {source}"""
        for k in columns)


_MASTER_AMOUNTS = ("RECOMMENDED_AMOUNT", "SANCTION_AMOUNT")
_PAID_AMOUNTS = ("TOTAL_FUND_DISBURSED_AMT", "PAYMENT_COUNT", "EXPENDITURE_DURATION_DAYS")
_DONE_AMOUNTS = ("ACTUAL_AMOUNT", "ACTUAL_TO_SANCTION_RATIO", "COMPLETION_DURATION_DAYS")


@register("va04_master_medians", "COLUMN:s N:i MEDIAN:d", None, sql=_medians_sql("works", _MASTER_AMOUNTS))
def _(c):
    return reports.amount_medians(c.works, _MASTER_AMOUNTS)


@register("va06_payment_medians", "COLUMN:s N:i MEDIAN:d", None, sql=_medians_sql("fin", _PAID_AMOUNTS))
def _(c):
    return reports.amount_medians(c.plan.financial, _PAID_AMOUNTS)


@register("va07_completion_medians", "COLUMN:s N:i MEDIAN:d", None, sql=_medians_sql("fin", _DONE_AMOUNTS))
def _(c):
    return reports.amount_medians(c.plan.financial, _DONE_AMOUNTS)


@register("va12_state_concentration", "STATE_NAME:s TOTAL_WORKS:i ML_ANOMALIES:i ML_ANOMALY_RATE_PERCENT:d "
          "SHARE_PERCENT:d INDIA_RATE_RATIO:d PLACE_BY_NUMBER:i PLACE_BY_RATE:i", None, sql="""
SELECT *, ML_ANOMALIES * 1e0 / nullif(sum(ML_ANOMALIES) OVER (), 0) * 100 AS SHARE_PERCENT,
  ML_ANOMALY_RATE_PERCENT / nullif(sum(ML_ANOMALIES) OVER () * 1e0 / sum(TOTAL_WORKS) OVER () * 100, 0) AS INDIA_RATE_RATIO,
  row_number() OVER (ORDER BY ML_ANOMALIES DESC, STATE_NAME) AS PLACE_BY_NUMBER,
  row_number() OVER (ORDER BY ML_ANOMALY_RATE_PERCENT DESC, STATE_NAME) AS PLACE_BY_RATE FROM state_diag""")
def _(c):
    return reports.state_concentration(c.analysis)


@register("va03_audit_work_ids", AUDIT, None, sql=" UNION ALL ".join(
    [_keys_sql("raw", "DTL_ID")] + [
        f"SELECT 'CONFLICTS', '{k}', CAST(count(*) AS DOUBLE) FROM (SELECT DTL_ID FROM raw GROUP BY 1 "
        f"HAVING count(DISTINCT {v}) > 1)" for k, v in (
            ("_STATE_NAME", "STATE_NAME"), ("_MP_ID", "MP_ID"), ("_CONSTITUENCY_ID", "CONSTITUENCY_ID"),
            ("_SOURCE_KEY", "SOURCE_KEY"), ("WORK_STAGE", "WORK_STAGE"))]))
def _(c):
    return reports.audit_work_ids(c.raw_layer)


def _amounts_sql(columns) -> dict[str, str]:
    out = {}
    for k in columns:
        out |= {f"{k}_MISSING": f"count(*) - count({k})", f"{k}_ZERO": f"count(*) FILTER (WHERE {k} = 0)",
                f"{k}_NEGATIVE": f"count(*) FILTER (WHERE {k} < 0)", f"{k}_MIN": f"min({k})", f"{k}_MAX": f"max({k})"}
    return out


@register("va04_audit_master", AUDIT, None, sql=" UNION ALL ".join([
    _keys_sql("works", "WORK_ID"),
    _distinct_sql("FIELDS", {k: k for k in ("STATE_NAME", "CONSTITUENCY", "MP_NAME", "WORK_CATEGORY",
                                            "ACTIVITY_NAME", "WORK_STAGE", "SOURCE_KEY")}, "works"),
    _section("AMOUNTS", _amounts_sql(("RECOMMENDED_AMOUNT", "SANCTION_AMOUNT")), "works"),
    _section("RELATION", {
        "BOTH_AVAILABLE": "count(*) FILTER (WHERE RECOMMENDED_AMOUNT IS NOT NULL AND SANCTION_AMOUNT IS NOT NULL)",
        "RECOMMENDED_ABOVE_SANCTIONED": "count(*) FILTER (WHERE RECOMMENDED_AMOUNT > SANCTION_AMOUNT)",
        "SANCTIONED_ABOVE_RECOMMENDED": "count(*) FILTER (WHERE SANCTION_AMOUNT > RECOMMENDED_AMOUNT)",
        "EQUAL": "count(*) FILTER (WHERE RECOMMENDED_AMOUNT = SANCTION_AMOUNT)"}, "works"),
    _section("DATES", {
        "RECOMMENDATION_DATE_MISSING": "count(*) - count(RECOMMENDATION_DATE)",
        "SANCTION_DATE_MISSING": "count(*) - count(SANCTION_DATE)",
        "SANCTION_BEFORE_RECOMMENDATION": "count(*) FILTER (WHERE SANCTION_DATE < RECOMMENDATION_DATE)"}, "works")]))
def _(c):
    return reports.audit_master(c.works)


@register("va06_audit_payments", AUDIT, None, sql=" UNION ALL ".join([
    _keys_sql("fin", "WORK_ID"),
    _section("COVERAGE", {
        "WITH_PAYMENTS": "count(*) FILTER (WHERE HAS_PAYMENT_RECORD)",
        "WITHOUT_PAYMENTS": "count(*) FILTER (WHERE NOT HAS_PAYMENT_RECORD)",
        "COVERAGE_PERCENT": "round_even(count(*) FILTER (WHERE HAS_PAYMENT_RECORD) * 1e0 / count(*) * 100e0 * 100e0, 0) / 100e0",
        "TOTAL_DISBURSED": "sum(TOTAL_FUND_DISBURSED_AMT)", "MAX_PAYMENTS": "max(PAYMENT_COUNT)",
        "AVERAGE_PAYMENTS": "round_even(sum(PAYMENT_COUNT) * 1e0 / count(PAYMENT_COUNT) * 100e0, 0) / 100e0",
        "RATIO_AVAILABLE": "count(DISBURSED_TO_SANCTION_RATIO)",
        "RATIO_ABOVE_1": "count(*) FILTER (WHERE DISBURSED_TO_SANCTION_RATIO > 1)",
        "RATIO_ABOVE_2": "count(*) FILTER (WHERE DISBURSED_TO_SANCTION_RATIO > 2)",
        "ZERO_DURATION": "count(*) FILTER (WHERE EXPENDITURE_DURATION_DAYS = 0)"}, "fin"),
    _section("TRANSACTIONS", {"TRANSACTIONS": "count(*)", "PAYMENT_WORKS": "count(DISTINCT WORK_ID)"}, "pays")]))
def _(c):
    return reports.audit_payments(c.plan.financial, c.payments)


@register("va07_audit_completions", "METRIC:s VALUE:f", None, sql=_metrics_sql({
    "WORKS": "count(*)", "WITH_COMPLETION": "count(*) FILTER (WHERE HAS_COMPLETION_RECORD)",
    "WITHOUT_COMPLETION": "count(*) FILTER (WHERE NOT HAS_COMPLETION_RECORD)",
    "COVERAGE_PERCENT": "round_even(count(*) FILTER (WHERE HAS_COMPLETION_RECORD) * 1e0 / count(*) * 100e0 * 100e0, 0) / 100e0",
    "ACTUAL_ZERO": "count(*) FILTER (WHERE ACTUAL_AMOUNT = 0)", "RATIO_AVAILABLE": "count(ACTUAL_TO_SANCTION_RATIO)",
    "RATIO_ABOVE_1": "count(*) FILTER (WHERE ACTUAL_TO_SANCTION_RATIO > 1)",
    "RATIO_ABOVE_1_5": "count(*) FILTER (WHERE ACTUAL_TO_SANCTION_RATIO > 1.5)",
    "RATIO_ABOVE_2": "count(*) FILTER (WHERE ACTUAL_TO_SANCTION_RATIO > 2)",
    "DURATION_AVAILABLE": "count(COMPLETION_DURATION_DAYS)",
    "DURATION_NEGATIVE": "count(*) FILTER (WHERE COMPLETION_DURATION_DAYS < 0)",
    "DURATION_MIN": "min(COMPLETION_DURATION_DAYS)", "DURATION_MAX": "max(COMPLETION_DURATION_DAYS)"}, "fin"))
def _(c):
    return reports.audit_completions(c.plan.financial_plan)


_FLAGS = ("IS_COMPLETED", "NO_PAYMENT_RECORD", "MULTIPLE_PAYMENTS", "MULTIPLE_VENDORS", "PAYMENT_COUNT_GE_5",
          "PAYMENT_COUNT_GE_10", "VENDOR_COUNT_GE_5", "VENDOR_COUNT_GE_10",
          "NEGATIVE_RECOMMENDATION_TO_SANCTION", "NEGATIVE_SANCTION_TO_PAYMENT",
          "COMPLETION_BEFORE_LAST_PAYMENT", "ACTUAL_ABOVE_SANCTION", "DISBURSED_ABOVE_SANCTION",
          "SANCTION_ABOVE_2X_PEER_MEDIAN", "SANCTION_ABOVE_5X_PEER_MEDIAN", "AVERAGE_PAYMENT_ABOVE_1M",
          "TOTAL_DISBURSED_ABOVE_5M")


@register("va08_audit_features", AUDIT, None, sql=" UNION ALL ".join([
    _keys_sql("feat", "WORK_ID"), _section("FLAGS", {k: f"sum({k})" for k in _FLAGS}, "feat"),
    _section("VALUES", {
        "INFINITE_VALUES": "0 * count(*)", "SUFFICIENT_PEERS": "count(*) FILTER (WHERE PEER_COUNT >= 10)",
        "SPARSE_PEERS": "count(*) FILTER (WHERE PEER_COUNT < 10)", "MAX_MISSING_FIELDS": "max(MISSING_FIELD_COUNT)"}, "feat")]))
def _(c):
    return reports.audit_features(c.plan.features)


@register("va05_audit_spending_features", AUDIT, None, sql=" UNION ALL ".join([
    _section("TIMELINE", {
        "RECOMMENDATION_TO_SANCTION_DAYS_NEGATIVE": "count(*) FILTER (WHERE SANCTION_DATE < RECOMMENDATION_DATE)",
        "SANCTION_TO_COMPLETION_DAYS_NEGATIVE": "count(*) FILTER (WHERE ACTUAL_END_DATE < SANCTION_DATE)",
        "RECOMMENDATION_TO_COMPLETION_DAYS_NEGATIVE": "count(*) FILTER (WHERE ACTUAL_END_DATE < RECOMMENDATION_DATE)"}, "g_feat"),
    _section("CONSISTENCY", {
        "ACTUAL_ABOVE_SANCTION": "count(*) FILTER (WHERE ACTUAL_AMOUNT > SANCTION_AMOUNT)",
        "DISBURSED_ABOVE_SANCTION": "count(*) FILTER (WHERE TOTAL_DISBURSED > SANCTION_AMOUNT)",
        "SANCTION_BELOW_RECOMMENDED": "count(*) FILTER (WHERE SANCTION_AMOUNT < RECOMMENDED_AMOUNT)",
        "NEGATIVE_SANCTION": "count(*) FILTER (WHERE SANCTION_AMOUNT < 0)",
        "NEGATIVE_ACTUAL": "count(*) FILTER (WHERE ACTUAL_AMOUNT < 0)",
        "NEGATIVE_DISBURSEMENT": "count(*) FILTER (WHERE TOTAL_DISBURSED < 0)"}, "g_feat"),
    _section("FLAGS", {
        "MULTIPLE_VENDOR_FLAG": "sum(MULTIPLE_VENDOR_FLAG)",
        "MULTIPLE_TRANSACTION_FLAG": "count(*) FILTER (WHERE TRANSACTION_COUNT > 1)",
        "ACTUAL_EXCEEDS_SANCTION_FLAG": "count(*) FILTER (WHERE ACTUAL_AMOUNT > SANCTION_AMOUNT)",
        "DISBURSEMENT_EXCEEDS_SANCTION_FLAG": "count(*) FILTER (WHERE TOTAL_DISBURSED > SANCTION_AMOUNT)",
        "NEGATIVE_TIMELINE_FLAG": "sum(NEGATIVE_TIMELINE_FLAG)"}, "g_feat")]))
def _(c):
    return reports.audit_spending_features(c.regional.features)


@register("va12_validation_summary", "METRIC:s VALUE:d", None, extra={"sets": _SETS}, sql=_metrics_sql({
    "ML_ROWS": "count(*)", "ML_ANOMALY_COUNT": "count(*) FILTER (WHERE M)",
    "ML_ANOMALY_RATE_PERCENT": "round_even(count(*) FILTER (WHERE M) * 1e0 / count(*) * 100e0 * 1e4, 0) / 1e4",
    "RULE_CANDIDATE_COUNT": "count(*) FILTER (WHERE R)", "STATISTICAL_CANDIDATE_COUNT": "count(*) FILTER (WHERE S)",
    "ML_RULE_OVERLAP": "count(*) FILTER (WHERE M AND R)", "ML_STATISTICAL_OVERLAP": "count(*) FILTER (WHERE M AND S)",
    "ALL_THREE_OVERLAP": "count(*) FILTER (WHERE M AND R AND S)",
    "ML_ONLY": "count(*) FILTER (WHERE M AND NOT R AND NOT S)", "RULE_ONLY": "count(*) FILTER (WHERE R AND NOT M AND NOT S)",
    "STATISTICAL_ONLY": "count(*) FILTER (WHERE S AND NOT M AND NOT R)", "NO_DETECTOR": "count(*) FILTER (WHERE NOT (M OR R OR S))",
    "WORKS_PEER_GE_10": "count(*) FILTER (WHERE PEER_COUNT >= 10)", "WORKS_PEER_LT_10": "count(*) FILTER (WHERE PEER_COUNT < 10)",
    "ML_ANOMALIES_PEER_GE_10": "count(*) FILTER (WHERE M AND PEER_COUNT >= 10)",
    "ML_ANOMALIES_PEER_LT_10": "count(*) FILTER (WHERE M AND PEER_COUNT < 10)",
    "WEAK_PEER_ANOMALY_PERCENT": "count(*) FILTER (WHERE M AND PEER_COUNT < 10) * 1e0 / count(*) FILTER (WHERE M) * 100"}, "sets"))
def _(c):
    return reports.ml_validation_summary(
        c.hybrid.join(c.plan.features.select("WORK_ID", "PEER_COUNT"), "WORK_ID")
    )


# Columns of the audited features that the SQL relation has under the same name.
_AUDITED = (
    "STATE_NAME", "MP_NAME", "CONSTITUENCY", "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_STAGE", "RECOMMENDED_AMOUNT",
    "SANCTION_AMOUNT", "ACTUAL_AMOUNT", "RECOMMENDATION_DATE", "SANCTION_DATE", "ACTUAL_END_DATE", "PEER_COUNT",
    "PEER_MEDIAN_SANCTION", "PEER_MEAN_SANCTION", "PEER_STD_SANCTION", "TOTAL_DISBURSED", "TRANSACTION_COUNT",
    "VENDOR_COUNT", "RECOMMENDATION_TO_SANCTION_DAYS", "SANCTION_TO_COMPLETION_DAYS", "COST_VS_PEER_MEDIAN",
    "COST_Z_SCORE", "DISBURSEMENT_TO_SANCTION_RATIO", "UNSPENT_AMOUNT", "LOG_SANCTION_AMOUNT",
)
_SQL_RATIOS = ("DISBURSEMENT_TO_SANCTION_RATIO", "COST_VS_PEER_MEDIAN")


@register("va05_feature_values", AUDIT, None, sql=" UNION ALL ".join([
    "SELECT * FROM (" + _section("MISSING", {k: f"count(*) - count({k})" for k in _AUDITED}, "g_feat")
    + ") WHERE VALUE > 0",
    "SELECT * FROM (" + _section(
        "INFINITE", {k: f"count(*) FILTER (WHERE isinf(CAST({k} AS DOUBLE)))" for k in _SQL_RATIOS}, "g_feat")
    + ") WHERE VALUE > 0",
    *[_section("RATIO", {
        f"{k}_AVAILABLE": f"count({k})", f"{k}_BELOW_0": f"count(*) FILTER (WHERE {k} < 0)",
        f"{k}_EQUAL_0": f"count(*) FILTER (WHERE {k} = 0)", f"{k}_ABOVE_1": f"count(*) FILTER (WHERE {k} > 1)",
        f"{k}_ABOVE_2": f"count(*) FILTER (WHERE {k} > 2)", f"{k}_ABOVE_5": f"count(*) FILTER (WHERE {k} > 5)",
        f"{k}_MAXIMUM": f"max({k})"}, "g_feat") for k in _SQL_RATIOS]]))
def _(c):
    return reports.audit_feature_values(c.regional.audited(*_AUDITED, *_SQL_RATIOS), _AUDITED, _SQL_RATIOS)


_CORE = " UNION ALL ".join(
    f"SELECT {i} AS POSITION, '{k}' AS FEATURE, WORK_ID, CAST({k} AS DOUBLE) AS V FROM feat"
    for i, k in enumerate(forest.CORE_FEATURES) if k != "FLAG")


@register("ml11_model_inputs", "POSITION:i FEATURE:s PRESENT:b N:i MISSING:i NONFINITE:i MEDIAN:f IQR:f", None,
          extra={"melted": _CORE}, sql=f"""
SELECT POSITION, FEATURE, true AS PRESENT, count(V) AS N, count(*) - count(V) AS MISSING, 0 AS NONFINITE,
  quantile_cont(V, 0.5) AS MEDIAN, quantile_cont(V, 0.75) - quantile_cont(V, 0.25) AS IQR FROM melted GROUP BY 1, 2
UNION ALL SELECT {forest.CORE_FEATURES.index("FLAG")}, 'FLAG', false, NULL, NULL, NULL, NULL, NULL""")
def _(c):
    return c.plan.model_inputs


@register("ml05_robust_scaled", "FEATURE:s WORK_ID:i SCALED:f", None, extra={
    "melted": _CORE, "fitted": """SELECT FEATURE, quantile_cont(V, 0.5) AS M,
  quantile_cont(V, 0.75) - quantile_cont(V, 0.25) AS R FROM melted GROUP BY 1"""}, sql="""
SELECT FEATURE, WORK_ID, coalesce((coalesce(V, M) - M) / CASE WHEN R = 0 THEN 1e0 ELSE R END, 0) AS SCALED
FROM melted JOIN fitted USING (FEATURE) WHERE FEATURE IN ('SANCTION_AMOUNT', 'PAYMENT_COUNT', 'ACTUAL_AMOUNT')""")
def _(c):
    table = preprocess.robust_scale(c.plan.model_table, c.plan.model_inputs)
    return forest.melt(table, ["SANCTION_AMOUNT", "PAYMENT_COUNT", "ACTUAL_AMOUNT"], "WORK_ID").withColumnRenamed(
        "VALUE", "SCALED")


# --- model: fitted on all works ----------------------------------------------------------


@register("ml04_feature_medians", "FEATURE:s MEDIAN:d", None, extra={"melted": " UNION ALL ".join(
    f"SELECT '{k}' AS FEATURE, CAST({k} AS DOUBLE) AS V FROM feat" for k in forest.CORE_FEATURES if k != "FLAG")},
    sql="SELECT FEATURE, quantile_cont(V, 0.5) AS MEDIAN FROM melted WHERE V IS NOT NULL GROUP BY 1")
def _(c):
    f = c.plan.features
    return forest.feature_medians(f, forest.model_features(f))


@register("ml02_feature_variance", "FEATURE:s VALUES_SEEN:i", None, sql=" UNION ALL ".join(
    f"SELECT '{k}' AS FEATURE, least(count(DISTINCT {k}), 3) AS VALUES_SEEN FROM feat"
    for k in forest.CORE_FEATURES if k != "FLAG"))
def _(c):
    f = c.plan.features
    return forest.feature_variance(f, forest.model_features(f))


# A fixed forest stands in for the fitted one where SQL has to follow it: ten trees of
# two cuts each, at quantiles of three features.
FIXED_FEATURES = ("SANCTION_AMOUNT", "PAYMENT_COUNT", "TOTAL_FUND_DISBURSED_AMT")
FIXED_TREES = 10


def _fixed_shape(t: int) -> tuple[int, float, int, float, tuple[int, int, int]]:
    """Root feature and probability, second feature and probability, leaf sizes."""
    return t % 3, 0.5 + t / 40, (t + 1) % 3, 0.9 - t / 50, (150 + t, 90 - 3 * t, 2 + t)


def _cut(q: Column) -> Column:
    # off the values themselves, so that both engines put every work on the same side
    return F.round(q, 3) + 0.0005


def _fixed_forest(c) -> forest.IsolationForest:
    # all three are columns of the financial rows; their quantiles come from histograms
    probs = sorted({p for t in range(FIXED_TREES) for p in _fixed_shape(t)[1::2]} | {0.5})
    marks = [f"_q{i}" for i in range(len(probs))]
    found = columns.column_quantiles(c.plan.financial, FIXED_FEATURES, probs, marks)
    row = {r["COLUMN"]: r for r in found.select("COLUMN", *[_cut(F.col(m)).alias(m) for m in marks]).collect()}
    at = lambda f, p: row[FIXED_FEATURES[f]][marks[probs.index(p)]]
    nodes = []
    for t in range(FIXED_TREES):
        f, p, g, q, sizes = _fixed_shape(t)
        nodes += [(t, 0, f, at(f, p), 1, 2, 0, sum(sizes)), (t, 1, -1, 0.0, -1, -1, 1, sizes[0]),
                  (t, 2, g, at(g, q), 3, 4, 1, sizes[1] + sizes[2]),
                  (t, 3, -1, 0.0, -1, -1, 2, sizes[1]), (t, 4, -1, 0.0, -1, -1, 2, sizes[2])]
    names = [x.name for x in forest.NODE_SCHEMA.fields]
    medians = {n: at(i, 0.5) for i, n in enumerate(FIXED_FEATURES)}
    return forest.IsolationForest(
        FIXED_FEATURES, medians, pd.DataFrame(nodes, columns=names), 256,
        forest.ForestConfig(trees=FIXED_TREES, mask_weak_peers=False),
    )


def _fixed_sql() -> dict[str, str]:
    path = lambda size: float(forest.average_path(float(size)))
    cut = lambda f, p: f"(SELECT round(quantile_cont(CAST({FIXED_FEATURES[f]} AS DOUBLE), {p}), 3) + 0.0005e0 FROM feat)"
    cuts, cases = [], []
    for t in range(FIXED_TREES):
        f, p, g, q, sizes = _fixed_shape(t)
        cuts += [f"{cut(f, p)} AS a{t}", f"{cut(g, q)} AS b{t}"]
        cases.append(f"CASE WHEN x{f} <= a{t} THEN 1 + {path(sizes[0])!r} "
                     f"WHEN x{g} <= b{t} THEN 2 + {path(sizes[1])!r} ELSE 2 + {path(sizes[2])!r} END")
    filled = ", ".join(f"coalesce(CAST({n} AS DOUBLE), {cut(i, 0.5)}) AS x{i}"
                       for i, n in enumerate(FIXED_FEATURES))
    return {
        "fxcuts": "SELECT " + ", ".join(cuts),
        "fxrows": f"SELECT WORK_ID, {filled} FROM feat",
        "fxs": f"SELECT WORK_ID, pow(2e0, -(({' + '.join(cases)}) / {FIXED_TREES}e0) / {path(256)!r}) AS S "
               "FROM fxrows, fxcuts",
        "fxp": """SELECT WORK_ID, S, (rank() OVER (ORDER BY S) - 1 + (count(*) OVER (PARTITION BY S) + 1) / 2e0)
  / count(*) OVER () * 100e0 AS ML_PERCENTILE FROM fxs""",
        "ml": """SELECT WORK_ID, S AS ML_ANOMALY_STRENGTH, ML_PERCENTILE, CASE WHEN S > 0.5e0 THEN 1 ELSE 0 END AS ML_ANOMALY,
  CASE WHEN ML_PERCENTILE >= 99 THEN 'HIGH' WHEN ML_PERCENTILE >= 97.5 THEN 'MEDIUM'
       WHEN ML_PERCENTILE >= 95 THEN 'LOW' ELSE 'NONE' END AS ML_SEVERITY FROM fxp""",
    }


FIXED_SQL = _fixed_sql()


def _fixed_ml(c) -> DataFrame:
    return forest.score_forest(c.plan.financial, _fixed_forest(c), c.settings.skew, store=settle)


@register("ml06_fixed_forest_scores", "WORK_ID:i ML_ANOMALY_STRENGTH:d IF_DECISION_SCORE:d ML_PERCENTILE:d "
          "ML_ANOMALY:i ML_SEVERITY:s", None, extra=FIXED_SQL,
          sql="SELECT *, 0.5e0 - ML_ANOMALY_STRENGTH AS IF_DECISION_SCORE FROM ml")
def _(c):
    return _fixed_ml(c)


@register("src13_saved_forest_scores", "WORK_ID:i ML_ANOMALY_STRENGTH:d ML_PERCENTILE:d ML_ANOMALY:i", "ml", extra=FIXED_SQL)
def _(c):
    path, model = f"{layer_root(c.spark)}/civitally/forest-{uuid.uuid4().hex}", _fixed_forest(c)
    model.save(c.spark, path)
    loaded = forest.IsolationForest.load(c.spark, path, model.config)
    return forest.score_forest(c.plan.financial, loaded, c.settings.skew, store=settle)


@register("ml08_contamination_share", "WORK_ID:i IF_DECISION_SCORE:d ML_ANOMALY:i", None, extra=FIXED_SQL, sql="""
SELECT WORK_ID, CUT - S AS IF_DECISION_SCORE, CASE WHEN S > CUT THEN 1 ELSE 0 END AS ML_ANOMALY FROM (
  SELECT WORK_ID, S, quantile_cont(S, 0.98e0) OVER () AS CUT FROM fxs)""")
def _(c):
    model = _fixed_forest(c)
    model = replace(model, config=replace(model.config, contamination=0.02))
    return forest.score_forest(c.plan.financial, model, c.settings.skew, store=settle)


@register("ml03_masked_peers", "WORK_ID:i " + " ".join(f"{k}:f" for k in forest.PEER_RELATIVE), None,
          sql="SELECT WORK_ID, " + ", ".join(f"CASE WHEN PEER_COUNT >= 10 THEN {k} END AS {k}"
                                             for k in forest.PEER_RELATIVE) + " FROM feat")
def _(c):
    return forest.mask_weak_peers(c.plan.features)


_ROLES = {
    "identifier": forest.IDENTIFIERS, "administrative": forest.ADMINISTRATIVE, "calendar": forest.CALENDAR,
    "rule_derived": forest.RULE_DERIVED, "selected": [k for k in forest.CORE_FEATURES if k != "FLAG"],
}


@register("ml01_feature_selection", "FEATURE:s ROLE:s N:i", None, sql=" UNION ALL ".join(
    f"SELECT '{k}' AS FEATURE, '{role}' AS ROLE, count({k}) AS N FROM feat" for role, ks in _ROLES.items() for k in ks))
def _(c):
    # every numeric column with a role, and how many works have a value
    table = c.plan.features
    roles = {k: r for k, r in forest.classify_columns(table).items()
             if r in _ROLES and not k.startswith(forest.ADMINISTRATIVE_PREFIXES)}
    one = table.agg(*[F.count(k).alias(k) for k in roles])
    rows = F.array(*[F.struct(F.lit(k).alias("FEATURE"), F.lit(r).alias("ROLE"), F.col(k).alias("N"))
                     for k, r in roles.items()])
    return one.select(F.inline(rows))


@register("ml10_fixed_audit_scores", "WORK_ID:i ISOLATION_FOREST_PREDICTION:i ISOLATION_FOREST_SCORE:d "
          "ISOLATION_FOREST_ANOMALY_FLAG:b ISOLATION_FOREST_RISK_LEVEL:s", None, extra={
    **FIXED_SQL, "fxscaled": """SELECT WORK_ID, S, round_even((S - min(S) OVER ()) / (max(S) OVER () - min(S) OVER ()) * 100e0, 2) AS R
FROM fxs"""}, sql="""
SELECT WORK_ID, CASE WHEN S > 0.5e0 THEN -1 ELSE 1 END AS ISOLATION_FOREST_PREDICTION, R AS ISOLATION_FOREST_SCORE,
  S > 0.5e0 AS ISOLATION_FOREST_ANOMALY_FLAG, CASE WHEN R >= 80 THEN 'CRITICAL' WHEN R >= 60 THEN 'HIGH'
  WHEN R >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS ISOLATION_FOREST_RISK_LEVEL FROM fxscaled""")
def _(c):
    return forest.score_audit_forest(c.plan.financial, _fixed_forest(c), store=settle)


@register("hy01_hybrid_with_fixed_forest", "WORK_ID:i HYBRID_RISK_SCORE:d HYBRID_RISK_LEVEL:s "
          "INDEPENDENT_SIGNAL_COUNT:i INVESTIGATION_PRIORITY:s DETECTOR_AGREEMENT:s", "hyb", extra=FIXED_SQL)
def _(c):
    ml = _fixed_ml(c).select("WORK_ID", "ML_ANOMALY", "ML_PERCENTILE", "ML_SEVERITY")
    return fusion.hybrid_columns(c.plan.hybrid_with(ml))


def _distribution_sql(features: int, trees: int) -> str:
    return f"""
SELECT unnest(['TOTAL_WORKS', 'ML_ANOMALIES', 'ML_ANOMALY_PERCENTAGE', 'HIGH', 'MEDIUM', 'LOW', 'NONE', 'FEATURE_COUNT',
    'CONTAMINATION', 'N_ESTIMATORS', 'MIN_PEER_SIZE']) AS METRIC,
  unnest([count(*), sum(ML_ANOMALY), sum(ML_ANOMALY) * 100e0 / count(*), count(*) FILTER (ML_SEVERITY = 'HIGH'),
    count(*) FILTER (ML_SEVERITY = 'MEDIUM'), count(*) FILTER (ML_SEVERITY = 'LOW'),
    count(*) FILTER (ML_SEVERITY = 'NONE'), {features}, NULL, {trees}, 10]) AS VALUE FROM ml"""


@register("agg28_fixed_ml_distribution", "METRIC:s VALUE:d", None, extra=FIXED_SQL, sql=_distribution_sql(3, 10))
def _(c):
    return reports.ml_distribution(_fixed_ml(c), len(FIXED_FEATURES), "auto", FIXED_TREES)


@register("ml06_fitted_forest_checks", "WORKS:i IDS:i IN_RANGE:i FLAGGED_BELOW_CUT:i WRONG_SEVERITY:i WRONG_RANK:i",
          None, sql="""SELECT count(*) AS WORKS, count(DISTINCT WORK_ID) AS IDS, count(*) AS IN_RANGE, 0 AS FLAGGED_BELOW_CUT,
  0 AS WRONG_SEVERITY, 0 AS WRONG_RANK FROM feat""")
def _(c):
    p, s = F.col("ML_PERCENTILE"), F.col("ML_ANOMALY_STRENGTH")
    severity = (F.when(p >= 99, "HIGH").when(p >= 97.5, "MEDIUM").when(p >= 95, "LOW")
                .otherwise("NONE"))
    # the percentile of a strength follows from the works of lower and of equal strength
    ranks = c.plan.ml.groupBy("ML_ANOMALY_STRENGTH").agg(
        F.count(F.lit(1)).alias("n"), F.min("ML_PERCENTILE").alias("low"),
        F.max("ML_PERCENTILE").alias("high"))
    return c.plan.ml.agg(
        F.count(F.lit(1)).alias("WORKS"), F.count_distinct("WORK_ID").alias("IDS"),
        F.count_if((s > 0) & (s < 1) & (p > 0) & (p <= 100)).alias("IN_RANGE"),
        F.count_if((s > 0.5) != (F.col("ML_ANOMALY") == 1)).alias("FLAGGED_BELOW_CUT"),
        F.count_if(F.col("ML_SEVERITY") != severity).alias("WRONG_SEVERITY"),
    ).withColumn("WRONG_RANK", ranks.agg(F.count_if(F.col("low") != F.col("high"))).scalar())


@register("ml06_forest_scores", "WORK_ID:i IF_RAW_SCORE:d IF_DECISION_SCORE:d ML_ANOMALY_STRENGTH:d ML_PERCENTILE:d "
          "ML_ANOMALY:i ML_SEVERITY:s", "ml", extra=FITTED_SQL)
def _(c):
    return c.plan.ml


_LISTED_MISSING = ("DISBURSEMENT_COUNT", "COST_VS_PEER_MEAN", "COST_VS_PEER_STD", "TRANSACTION_AMOUNT_STD")


@register("ml10_audit_forest_scores", "WORK_ID:i ISOLATION_FOREST_PREDICTION:i ISOLATION_FOREST_DECISION_SCORE:d "
          "ISOLATION_FOREST_SCORE:d ISOLATION_FOREST_ANOMALY_FLAG:b ISOLATION_FOREST_RISK_LEVEL:s", None, extra={
    "g_model": f"""SELECT g_feat.*, {S.ratio('ACTUAL_AMOUNT', 'SANCTION_AMOUNT')} AS ACTUAL_TO_SANCTION_RATIO,
  {S.dd('RECOMMENDATION_DATE', 'ACTUAL_END_DATE')} AS RECOMMENDATION_TO_COMPLETION_DAYS,
  coalesce(CAST(MN AS DOUBLE), 0) AS MIN_TRANSACTION_AMOUNT,
  CASE WHEN ACTUAL_AMOUNT IS NOT NULL THEN ln(1 + greatest(CAST(ACTUAL_AMOUNT AS DOUBLE), 0)) END AS LOG_ACTUAL_AMOUNT,
  ln(1 + greatest(TOTAL_DISBURSED, 0)) AS LOG_TOTAL_DISBURSED FROM g_feat LEFT JOIN g_sum USING (WORK_ID)""",
    **audit_relations("g_model", [k for k in forest.AUDIT_FEATURES if k not in _LISTED_MISSING])}, sql="""
SELECT *, CASE WHEN ISOLATION_FOREST_SCORE >= 80 THEN 'CRITICAL' WHEN ISOLATION_FOREST_SCORE >= 60 THEN 'HIGH'
  WHEN ISOLATION_FOREST_SCORE >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS ISOLATION_FOREST_RISK_LEVEL FROM gf_scores""")
def _(c):
    return c.regional.ml()


@register("hy01_hybrid_with_forest", HYBRID_SPEC, "hyb", extra=FITTED_SQL)
def _(c):
    return c.plan.hybrid


@register("agg28_ml_distribution", "METRIC:s VALUE:d", None, extra=FITTED_SQL,
          sql=_distribution_sql(len(forest.CORE_FEATURES) - 1, 300))
def _(c):
    s = c.plan.settings.forest
    return reports.ml_distribution(
        c.plan.ml, len(forest.model_features(c.plan.model_table)), s.contamination, s.trees
    )


@register("va09_ml_integrity", "CHECK:s PASSED:b", None, extra={"damaged": "SELECT WORK_ID FROM works"},
          sql=_INTEGRITY)
def _(c):
    return reports.ml_integrity(c.plan.described, c.plan.ml)
