"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    attention, bpe, collocations, jaccard, licenses, line_dedup, packing, quality_rules, runs, toxicity,
    training_order, urlrules, vafile,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


@query("op1_quality_rules", quality_rules.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


@query("op2_line_dedup", line_dedup.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


@query("op3_training_order")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.records(training_order.shards(table(spark, sf_dir, "documents")))


@query("op4_attention_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return attention.score(docs, attention.train(docs, table(spark, sf_dir, "labels")))


@query("op5_residual_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op6_vector_approximation", vafile.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


@query("op7_license_scan", licenses.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.documents_as_files(table(spark, sf_dir, "documents")))


@query("op8_ngram_jaccard")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op9_noisy_or_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op10_bpe_round_trip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op11_url_rules", urlrules.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark, urlrules.RULES))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary(table(spark, sf_dir, "documents"))


@query("op13_phrase_collocations", collocations.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
