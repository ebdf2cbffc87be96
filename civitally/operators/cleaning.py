"""Typing, de-duplication and validation gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Skew
from ..functions.scalar import clean_date, clean_id, clean_money, clean_numeric, peer_label
from ..functions.scalar import strip_activity_prefix, total
from ..sources.schemas import MASTER_REQUIRED, PAYMENT_REQUIRED
from .ranking import attach_group_stats, first_per_key, running_number


class DataGateError(ValueError):
    """A table breaks a structural rule the next step relies on."""


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataGateError(f"{name}: missing required columns {missing}")
    return df


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent optional columns as typed NULLs."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """First of several possible column names that the table has."""
    return next((n for n in names if n in df.columns), None)


def key_profile(df: DataFrame, key: str) -> DataFrame:
    """ROWS, MISSING_KEYS, UNIQUE_KEYS and DUPLICATE_ROWS of a key column."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("ROWS"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("MISSING_KEYS"),
        F.count_if(known).alias("UNIQUE_KEYS"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("DUPLICATE_ROWS"),
    )


def require_unique_key(df: DataFrame, key: str = "WORK_ID", name: str = "table") -> DataFrame:
    """Raise when a key is missing or repeated."""
    profile = key_profile(df, key).first()
    if profile["MISSING_KEYS"]:
        raise DataGateError(f"{name}: {profile['MISSING_KEYS']} rows without {key}")
    if profile["DUPLICATE_ROWS"]:
        raise DataGateError(f"{name}: {profile['DUPLICATE_ROWS']} repeated {key} values")
    return df


def require_unique_keys(tables: dict[str, DataFrame], key: str = "WORK_ID") -> None:
    """Raise when a key is missing or repeated in any of the tables; one job."""
    tagged = [df.select(F.lit(n).alias("_table"), F.col(key)) for n, df in tables.items()]
    per_key = reduce(DataFrame.union, tagged).groupBy("_table", key).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = F.col(key).isNotNull()
    for row in per_key.groupBy("_table").agg(
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("repeated"),
    ).collect():
        if row["missing"]:
            raise DataGateError(f"{row['_table']}: {row['missing']} rows without {key}")
        if row["repeated"]:
            raise DataGateError(f"{row['_table']}: {row['repeated']} repeated {key} values")


def require_same_rows(before: DataFrame, after: DataFrame, name: str = "join") -> DataFrame:
    a, b = before.count(), after.count()
    if a != b:
        raise DataGateError(f"{name}: row count changed from {a} to {b}")
    return after


def quarantine(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a key, rows without one)."""
    return df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())


def exact_dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return first_per_key(df, [key], list(order))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, list(keys), list(order), last=True)


# Columns that identify one payment, and what to use without them.
PAYMENT_IDENTITY = ("WORK_ID", "VENDOR_ID", "FUND_DISBURSED_AMT", "PAYMENT_DATE", "EXPENDITURE_DATE")


def payment_identity(df: DataFrame, key: str = "WORK_ID") -> list[str]:
    wanted = [key, *PAYMENT_IDENTITY[1:]]
    present = [c for c in wanted if c in df.columns]
    return present or [key]


def dedup_payments(df: DataFrame, order: Sequence[str], key: str = "WORK_ID") -> DataFrame:
    """Keep the first of payments equal in every identity column present.

    NULLs compare equal.
    """
    return first_per_key(df, payment_identity(df, key), list(order))


def _filled(c: str) -> Column:
    text = F.col(c).cast("string")
    return (text.isNotNull() & ~text.isin("", "nan")).cast("int")


# Fields whose presence makes one landed record richer than another.
RICHNESS_FIELDS = ("SANCTION_AMOUNT", "ACTUAL_AMOUNT", "SANCTION_DATE", "ACTUAL_END_DATE", "WORK_STAGE")


def work_key() -> Column:
    """Detail id, else portal work number; blank and 0 count as absent."""
    def usable(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(~text.isin("", "0"), text)

    return F.coalesce(usable("WORK_RECOMMENDATION_DTL_ID"), usable("WORK_ID"))


def without_work_key(records: DataFrame) -> DataFrame:
    """Landed records that name no work."""
    return records.filter(work_key().isNull())


def most_complete(records: DataFrame, order: str = "_ord") -> DataFrame:
    """One record per work: the richest, the earliest landed among equals.

    The work key is the detail id, else the portal work number; rows without
    either are left to ``without_work_key``.
    """
    require_columns(records, [order], "landed records")
    keyed = records.withColumn("_work", work_key()).filter(F.col("_work").isNotNull())
    fields = [c for c in RICHNESS_FIELDS if c in records.columns]
    richness = total(_filled(c) for c in fields)
    return first_per_key(keyed, ["_work"], [-richness, order]).drop("_work")


def flag_possible_duplicates(
    payments: DataFrame, identity: Sequence[str], spread: str, skew: Skew = Skew()
) -> DataFrame:
    """POSSIBLE_DUPLICATE = 1 on every member of a repeated identity group."""
    groups = payments.groupBy(*identity).agg(F.count(F.lit(1)).alias("_copies"))
    return attach_group_stats(
        payments, groups, identity, size="_copies", spread=spread, skew=skew
    ).withColumn("POSSIBLE_DUPLICATE", (F.col("_copies") > 1).cast("int")).drop("_copies")


def number_transactions(payments: DataFrame, order: str, skew: Skew = Skew()) -> DataFrame:
    """TRANSACTION_ID 1..n in landing order (a unique numeric column)."""
    return running_number(payments, order, "TRANSACTION_ID", skew)


def fill_peer_keys(
    df: DataFrame, keys: Sequence[str], *, normalize_activity: bool = False
) -> DataFrame:
    def filled(k: str) -> Column:
        return peer_label(strip_activity_prefix(k) if k == "ACTIVITY_NAME" and normalize_activity else k)

    return df.withColumns({k: filled(k) for k in keys})


def api_value(c: str) -> Column:
    """Blank cells become NULL; everything else stays text."""
    return F.nullif(F.col(c), F.lit(""))


def build_work_master(collection: DataFrame) -> DataFrame:
    """Typed one-row-per-work master from the best landed records."""
    require_columns(collection, MASTER_REQUIRED, "work collection")
    df = with_optional(
        collection,
        {c: "string" for c in ("ATTACH_ID", "FILE_STATUS", "FLAG", "HOUSE_OF_PARLIAMENT",
                               "IDA_NAME", "LETTER_NO", "TENURE", "TENURE_START_DATE",
                               "TENURE_END_DATE", "_ord")},
    )
    typed = df.select(
        clean_id("WORK_RECOMMENDATION_DTL_ID").alias("WORK_ID"),
        clean_id("_STATE_ID").alias("STATE_ID"),
        F.coalesce("_STATE_NAME", "STATE_NAME").alias("STATE_NAME"),
        F.coalesce(clean_id("_CONSTITUENCY_ID"), clean_id("CONSTITUENCY_ID")).alias("CONSTITUENCY_ID"),
        F.coalesce("_CONSTITUENCY", "CONSTITUENCY").alias("CONSTITUENCY"),
        clean_id("_MP_ID").alias("MP_ID"),
        F.coalesce("_MP_NAME", "MP_NAME").alias("MP_NAME"),
        "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_DESCRIPTION", "WORK_STAGE",
        F.col("_SOURCE_KEY").alias("SOURCE_KEY"),
        clean_money("RECOMMENDED_AMOUNT").alias("RECOMMENDED_AMOUNT"),
        clean_money("SANCTION_AMOUNT").alias("SANCTION_AMOUNT"),
        clean_date("RECOMMENDATION_DATE").alias("RECOMMENDATION_DATE"),
        clean_date("SANCTION_DATE").alias("SANCTION_DATE"),
        clean_id("ATTACH_ID").alias("ATTACH_ID"),
        "FILE_STATUS", "FLAG", "HOUSE_OF_PARLIAMENT", "IDA_NAME", "LETTER_NO", "TENURE",
        clean_date("TENURE_START_DATE").alias("TENURE_START_DATE"),
        clean_date("TENURE_END_DATE").alias("TENURE_END_DATE"),
        "_ord",
    )
    with_id, _ = quarantine(typed, "WORK_ID")
    return keep_first(with_id, "WORK_ID", ["_ord"]).drop("_ord")


def master_order(master: DataFrame) -> DataFrame:
    """State, seat, representative, id; missing names last."""
    keys = ("STATE_NAME", "CONSTITUENCY", "MP_NAME", "WORK_ID")
    return master.orderBy(*[F.asc_nulls_last(k) for k in keys])


def extract_payments(records: DataFrame) -> DataFrame:
    """Typed payment rows: landed records that state an amount.

    Without a landing order no attribute could be told to be the first, so
    ``_ord`` is required.
    """
    require_columns(records, [*PAYMENT_REQUIRED, "_ord"], "raw records")
    df = with_optional(
        records,
        {c: "string" for c in ("ACTIVITY_NAME", "LETTER_NO", "IA_NAME", "IDA_NAME",
                               "HOUSE_OF_PARLIAMENT", "TENURE")},
    )
    return df.filter(F.col("FUND_DISBURSED_AMT").isNotNull()).select(
        clean_id("WORK_RECOMMENDATION_DTL_ID").alias("WORK_ID"),
        F.col("WORK_ID").alias("PORTAL_WORK_ID"),
        "STATE_NAME", "MP_NAME", "CONSTITUENCY", "ACTIVITY_NAME", "LETTER_NO",
        clean_money("FUND_DISBURSED_AMT").alias("FUND_DISBURSED_AMT"),
        clean_date("EXPENDITURE_DATE").alias("EXPENDITURE_DATE"),
        clean_id("VENDOR_ID").alias("VENDOR_ID"),
        "VENDOR_NAME", "IA_NAME", "IDA_NAME", "WORK_STATUS", "HOUSE_OF_PARLIAMENT", "TENURE",
        clean_id("_STATE_ID").alias("STATE_ID"), clean_id("_MP_ID").alias("MP_ID"),
        clean_id("_CONSTITUENCY_ID").alias("CONSTITUENCY_ID"),
        F.col("_SOURCE_KEY").alias("SOURCE_KEY"), "_ord",
    )


def extract_completions(
    records: DataFrame, completed_key: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Typed completion rows: Works Completed records with an actual amount."""
    df = with_optional(records, {"AVERAGE_RATING": "string"})
    done = df.filter((F.col("_SOURCE_KEY") == completed_key) & F.col("ACTUAL_AMOUNT").isNotNull())
    return done.select(
        clean_id("WORK_RECOMMENDATION_DTL_ID").alias("WORK_ID"),
        clean_money("ACTUAL_AMOUNT").alias("ACTUAL_AMOUNT"),
        clean_date("ACTUAL_END_DATE").alias("ACTUAL_END_DATE"),
        clean_numeric("AVERAGE_RATING").alias("AVERAGE_RATING"),
        *keep,
    )


def completion_conflicts(completions: DataFrame, key: str = "WORK_ID") -> DataFrame:
    """Works with several completion records: how many, and how many differ."""
    facts = [c for c in ("ACTUAL_AMOUNT", "ACTUAL_END_DATE", "AVERAGE_RATING")
             if c in completions.columns]
    versions = completions.groupBy(key, *facts).agg(F.count(F.lit(1)).alias("_n"))
    return versions.groupBy(key).agg(
        F.sum("_n").alias("RECORDS"), F.count(F.lit(1)).alias("VERSIONS")
    ).filter("RECORDS > 1")
