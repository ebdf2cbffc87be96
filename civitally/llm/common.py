"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hidden(name: str) -> str:
    """A column name that no input uses."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def cut(batches: Iterator[pa.RecordBatch], at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``at_once`` rows, so that few texts are held as Python
    objects and few are handed on at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            yield batch.slice(at, at_once)


def map_rows(
    df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], dict], at_once: int = 2000
) -> DataFrame:
    """``mapInArrow`` for a function that turns a batch into named columns. Batches
    are cut to ``at_once`` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, at_once):
            columns = rows(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def digits_of_id(column) -> object:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
