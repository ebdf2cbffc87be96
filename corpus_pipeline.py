"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. ``run`` writes each result as Parquet into the shared folder
and reads it again as the next stage's input, so a lost executor or a broken
run repeats one stage at most. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitally.llm import attention, jaccard, line_dedup, packing, quality_rules
from civitally.llm.common import hidden, table
from civitally.session import settle


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, their host's verdict included."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones of these, finds good."""
    return attention.keep(docs, attention.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that many of them share."""
    return line_dedup.drop_lines(docs)


def near_copies(
    spark: SparkSession, docs: DataFrame, sf_dir: str,
    words: int = jaccard.WORDS, percent: int = jaccard.PERCENT,
) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: texts
    whose shingles of ``words`` words are alike by ``percent`` or more. Documents
    without id stay. Where ids are repeated, each row is a document of its own: it goes
    only if it is a near copy itself, and of equal rows one stays (rows without words
    are near copies of nothing)."""
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if repeated.filter("n > 1").isEmpty():
        found = jaccard.join(docs, percent, words)
        gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
        return docs.join(gone, F.col("doc_id").cast("bigint") == F.col("gone"), "left_anti")
    row = hidden("row")
    rows = settle(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    ids = rows.filter("doc_id is not null").select(F.col(row).alias("row"), "doc_id", "text")
    found = settle(jaccard.join(
        ids.select(F.col("row").alias("doc_id"), "text"), percent, words
    ).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "pipeline-classes")
    best = found.join(ids.select("row", "doc_id"), "row").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), "row")).alias("best"))
    stays = best.select(F.col("best.row").alias(row))
    return rows.filter("doc_id is not null").join(stays, row, "left_semi").unionByName(
        rows.filter("doc_id is null")).drop(row)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("best_fit_packing", sequences),
]
#: The classifier, the tokenizer and the packing have no SQL form; tests compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
