"""Writers. Every sink is a distributed write of one folder of part files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def order_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, the rest in their present order."""
    first = [c for c in preferred if c in df.columns]
    chosen = set(first)
    return df.select(*first, *[c for c in df.columns if c not in chosen])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nested columns are written as JSON text."""
    flat = [
        F.to_json(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = ()
) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line, absent values written as null. Parts are compressed:
    most of a landed record's text is field names and nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option(
        "compression", "gzip").json(path)


def _without_nan(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.StructType):
        inner = [_without_nan(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _without_nan(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _without_nan(v, kind.valueType))
    return value


def write_evidence_json(df: DataFrame, path: str) -> None:
    """Nested records as JSON that any reader takes: at every depth a number that JSON
    cannot hold (NaN, infinities) is written as null."""
    write_json(df.select(*[_without_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                           for f in df.schema.fields]), path)


def flatten_struct(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Select nested fields by path; arrays and structs become JSON text."""
    out = []
    for name, path in fields.items():
        column = df.select(path).schema.fields[0].dataType
        value = F.col(path)
        if isinstance(column, (T.ArrayType, T.StructType, T.MapType)):
            value = F.to_json(value)
        out.append(value.alias(name))
    return df.select(*out)
