"""Bounded training samples from the labels table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digits_of_id


def held_out(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from: crc32 of its id as text modulo
    ``folds`` is ``fold``. A missing id counts as the empty text."""
    return (digits_of_id(doc_id) % folds) == fold


def training_texts(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int
) -> DataFrame:
    """text and label (0 or 1) of at most ``limit`` labelled ids outside the held
    out fold, chosen by the hash of their id. Repeated labels of an id count by
    their majority; null labels and ids are not used. An id that is on several rows
    counts with one text, the one with the smallest hash. The list of ids is bounded
    by ``limit``, so it is broadcast."""
    wanted = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    wanted = wanted.filter(~held_out(folds, fold)).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")
    ).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    chosen = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # A minimum is aggregated before the shuffle, so a row repeated very often is sent once a task.
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return one.select("doc_id", F.col("least.text").alias("text"), "label")
