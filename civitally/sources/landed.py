"""Readers for landed portal data: API payloads, JSON arrays, CSV tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import clean_id

RECORD = "map<string,string>"


def payload_records(payload: Column) -> Column:
    """Records of one API payload, as an array of string maps.

    A payload is a JSON list of records, or an object whose values are lists or
    JSON-encoded lists. Values that cannot be read as a list are skipped.
    """
    as_list = F.try_variant_get(F.try_parse_json(payload), "$", f"array<{RECORD}>")
    members = F.map_values(F.from_json(payload, "map<string,string>"))
    nested = F.flatten(
        F.filter(
            F.transform(
                members,
                lambda text: F.try_variant_get(F.try_parse_json(text), "$", f"array<{RECORD}>"),
            ),
            lambda records: records.isNotNull(),
        )
    )
    empty = F.array().cast(f"array<{RECORD}>")
    return F.coalesce(
        F.when(F.trim(payload).startswith("["), as_list).otherwise(nested), empty
    )


def flatten_payloads(
    payloads: DataFrame, column: str = "payload", file: str | None = None
) -> DataFrame:
    """One row per record with a ``record`` map; other columns are repeated.

    With the name of the column that holds the landed file, ``_ord`` is the
    record's landing position: the file, then the place in its payload. It does
    not depend on how the files are read.
    """
    others = [c for c in payloads.columns if c != column]
    records = payload_records(F.col(column))
    if file is None:
        return payloads.select(*others, F.explode(records).alias("record"))
    placed = payloads.select(*others, F.posexplode(records).alias("_place", "record"))
    place = F.lpad(F.col("_place").cast("string"), 12, "0")
    return placed.withColumn("_ord", F.concat_ws("#", file, place)).drop("_place")


def read_landed_records(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Landed responses to records with their fields and landing order."""
    rows = flatten_payloads(read_payloads(spark, path), file="landed_file")
    return project_records(rows, fields)


def project_records(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Turn the ``record`` map into columns."""
    others = [c for c in records.columns if c != "record"]
    return records.select(*others, *[F.col("record")[f].alias(f) for f in fields])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed API responses, one file per response, with their file name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.input_file_name().alias("landed_file")
    )


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = True
) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_csv_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """CSV with header; without a schema every column is text.

    A byte-order mark in front of the first header name is removed.
    """
    reader = (
        spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True)
        .option("escape", '"')
    )
    if schema is not None:
        return reader.schema(schema).option("enforceSchema", True).csv(path)
    df = reader.csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Column-pruned Parquet scan; absent columns are ignored."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns])


def combine_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Union of record batches with differing columns, columns sorted by name."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
    return merged.select(*sorted(merged.columns))


def work_like(records: DataFrame) -> DataFrame:
    """Rows that carry a work identifier."""
    ids = [c for c in ("WORK_ID", "WORK_RECOMMENDATION_DTL_ID") if c in records.columns]
    keep = F.lit(False)
    for c in ids:
        keep = keep | F.col(c).isNotNull()
    return records.filter(keep)


def tag_source(
    records: DataFrame, source_key: str, mapping: dict[str, object]
) -> DataFrame:
    """Stamp list name and state/representative/seat identity on every record."""
    names = {
        "_STATE_ID": "state_id", "_STATE_NAME": "state_name", "_MP_ID": "mp_id",
        "_MP_NAME": "mp_name", "_CONSTITUENCY_ID": "constituency_id",
        "_CONSTITUENCY": "constituency",
    }
    stamped = {column: F.lit(mapping[key]).cast("string") for column, key in names.items()}
    return records.withColumns({"_SOURCE_KEY": F.lit(source_key), **stamped})


def discover_mappings(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate (representative, seat) pairs confirmed by a returned record.

    A pair is confirmed when a record names the representative (ignoring case)
    and carries the seat id. Candidates keep one row per pair.
    """
    # one row per pair before the join, however many records name it
    seen = records.select(
        F.lower(F.trim("MP_NAME")).alias("_mp"), clean_id("CONSTITUENCY_ID").alias("_seat")
    ).distinct()
    named = candidates.withColumns(
        {"_mp": F.lower(F.trim("mp_name")), "_seat": F.col("constituency_id").cast("bigint")}
    )
    return (
        named.join(seen, ["_mp", "_seat"], "left_semi")
        .drop("_mp", "_seat")
        .dropDuplicates(["mp_id", "constituency_id"])
    )
