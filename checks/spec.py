"""One column list drives both the Spark projection and the SQL projection.

A spec is ``"NAME:kind NAME:kind"`` with kinds i (whole number), d (double,
six decimals), m (money as double), s (text), t (date as text), b (boolean),
f (double with two decimals, for values that pass through std or interpolation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.split():
        name, _, kind = item.rpartition(":")
        out.append((name, kind))
    return out


def names(spec: str) -> list[str]:
    return [n for n, _ in parse(spec)]


def spark_select(df: DataFrame, spec: str) -> DataFrame:
    render = {
        "i": lambda c: c.cast("bigint"),
        "d": lambda c: F.rint(c.cast("double") * 1e6) / 1e6,
        "f": lambda c: F.rint(c.cast("double") * 1e2) / 1e2,
        "m": lambda c: c.cast("double"),
        "s": lambda c: c.cast("string"),
        "t": lambda c: c.cast("string"),
        "b": lambda c: c.cast("boolean"),
    }
    return df.select(*[render[k](F.col(n)).alias(n) for n, k in parse(spec)])


def sql_columns(spec: str) -> str:
    render = {
        "i": "CAST({c} AS BIGINT)",
        "d": "round_even(CAST({c} AS DOUBLE) * 1e6, 0) / 1e6",
        "f": "round_even(CAST({c} AS DOUBLE) * 1e2, 0) / 1e2",
        "m": "CAST({c} AS DOUBLE)",
        "s": "CAST({c} AS VARCHAR)",
        "t": "CAST({c} AS VARCHAR)",
        "b": "CAST({c} AS BOOLEAN)",
    }
    return ", ".join(
        render[k].format(c=f'"{n}"') + f' AS "{n}"' for n, k in parse(spec)
    )
