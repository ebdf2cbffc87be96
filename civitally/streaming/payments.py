"""Incremental reload of landed payments.

New landed files are picked up by a file stream that stops when it has caught
up; each micro-batch is one folder of the transaction table, so a repeated
batch overwrites itself and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import payment_rows, payment_summary
from ..operators.cleaning import dedup_payments, extract_payments
from ..sources.schemas import RAW_RECORD


def reload_payments(
    spark: SparkSession,
    landed: str,
    table: str,
    checkpoint: str,
    schema: T.StructType = RAW_RECORD,
) -> None:
    """Append the payments of newly landed JSON-lines files to the table."""
    stream = spark.readStream.schema(schema).json(landed)

    def append(batch: DataFrame, batch_id: int) -> None:
        extract_payments(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def transactions(spark: SparkSession, table: str) -> DataFrame:
    """All ingested payments; a payment landed twice keeps its first landing."""
    rows = payment_rows(spark.read.parquet(table)).filter(F.col("WORK_ID").isNotNull())
    return dedup_payments(rows, ["batch", "_ord"]).drop("batch")


def current_summary(spark: SparkSession, table: str) -> DataFrame:
    return payment_summary(transactions(spark, table), ["_ord"])
