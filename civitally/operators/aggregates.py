"""Payment, completion and first-generation master aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Skew
from ..functions.scalar import clean_date, clean_id, clean_money, clean_text
from ..sources.schemas import COMPLETED, EXPENDITURE, RECOMMENDED, SANCTIONED
from .ranking import hot_keys, null_safe_join


def status_is(c: str, status: str) -> Column:
    return F.lower(F.trim(F.col(c))) == status


def first_present_value(c: Column, order: Sequence[Column]) -> Column:
    """First non-null value in the given order (deterministic)."""
    position = order[0] if len(order) == 1 else F.struct(*order)
    return F.min_by(c, F.when(c.isNotNull(), position))


# Attribute of the payment row -> column of the payment summary.
PAYMENT_ATTRIBUTES = {
    "PORTAL_WORK_ID": "PAYMENT_WORK_ID",
    "STATE_NAME": "PAYMENT_STATE_NAME",
    "MP_NAME": "PAYMENT_MP_NAME",
    "CONSTITUENCY": "PAYMENT_CONSTITUENCY",
    "ACTIVITY_NAME": "PAYMENT_ACTIVITY_NAME",
    "LETTER_NO": "PAYMENT_LETTER_NO",
    "IA_NAME": "PAYMENT_IA_NAME",
    "IDA_NAME": "PAYMENT_IDA_NAME",
    "WORK_STATUS": "PAYMENT_WORK_STATUS",
}


def payment_rows(payments: DataFrame) -> DataFrame:
    return payments.filter(F.col("FUND_DISBURSED_AMT").isNotNull())


def payment_summary(
    payments: DataFrame,
    order: Sequence[str],
    *,
    attributes: Sequence[str] | None = None,
) -> DataFrame:
    """One row per work: totals, dates, vendor counts, status counts, firsts.

    The total stays NULL when no amount of the work is readable. A work with very
    many payments shrinks in the tasks that read them; an attribute's first value is
    the smallest (order, value) pair. Vendors are counted beside it on two short
    columns each: their distinct rows would multiply the pairs as well. All are
    grouped and joined on the work id itself, so payments that come from a join on it
    are sent by it once.
    """
    chosen = PAYMENT_ATTRIBUTES if attributes is None else {
        k: v for k, v in PAYMENT_ATTRIBUTES.items() if k in attributes
    }
    present = {c: name for c, name in chosen.items() if c in payments.columns}
    totals = [
        F.sum("FUND_DISBURSED_AMT").cast("decimal(28,2)").alias("TOTAL_FUND_DISBURSED_AMT"),
        F.count("FUND_DISBURSED_AMT").alias("PAYMENT_COUNT"),
        F.min("EXPENDITURE_DATE").alias("FIRST_EXPENDITURE_DATE"),
        F.max("EXPENDITURE_DATE").alias("LAST_EXPENDITURE_DATE"),
        F.count_if(status_is("WORK_STATUS", "payment success")).alias("PAYMENT_SUCCESS_COUNT"),
        F.count_if(status_is("WORK_STATUS", "payment in-progress")).alias(
            "PAYMENT_IN_PROGRESS_COUNT"),
        *[
            F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_value"))))["_value"]
            .alias(name)
            for c, name in present.items()
        ],
    ]
    vendors = {"VENDOR_ID": "UNIQUE_VENDOR_COUNT", "VENDOR_NAME": "UNIQUE_VENDOR_NAME_COUNT"}
    known = payments.filter(F.col("WORK_ID").isNotNull())
    summary = known.groupBy("WORK_ID").agg(*totals)
    for c, name in vendors.items():
        summary = summary.join(distinct_values(known, "WORK_ID", c, name), "WORK_ID")
    # payments without a work id are one group
    rest = payments.filter(F.col("WORK_ID").isNull()).groupBy("WORK_ID")
    rest = null_safe_join(
        rest.agg(*totals), rest.agg(*[F.count_distinct(c).alias(name) for c, name in vendors.items()]),
        ["WORK_ID"], "inner",
    )
    return summary.unionByName(rest).select(
        "WORK_ID", "TOTAL_FUND_DISBURSED_AMT", "PAYMENT_COUNT", "FIRST_EXPENDITURE_DATE",
        "LAST_EXPENDITURE_DATE", "UNIQUE_VENDOR_COUNT", "PAYMENT_SUCCESS_COUNT",
        "PAYMENT_IN_PROGRESS_COUNT", "UNIQUE_VENDOR_NAME_COUNT", *present.values(),
    )


def distinct_values(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """How many different known values each key has; its rows need not share a task."""
    return rows.select(key, value).distinct().groupBy(key).agg(F.count(value).alias(out))


def transactions_by_work(payments: DataFrame) -> DataFrame:
    """Payments ordered by work and date, undated last."""
    return payments.orderBy(F.asc_nulls_last("WORK_ID"), F.asc_nulls_last("EXPENDITURE_DATE"))


# --- first generation -------------------------------------------------------

FIRST_TEXT_FIELDS = (
    "WORK_ID", "WORK_CATEGORY", "ACTIVITY_NAME", "STATE_NAME", "HOUSE_OF_PARLIAMENT", "IDA_NAME",
    "TENURE", "MP_NAME", "WORK_DESCRIPTION", "WORK_STAGE", "LETTER_NO", "CONSTITUENCY",
    "FILE_STATUS", "IA_NAME", "VENDOR_NAME", "WORK_STATUS", "CONSTITUENCY_ID", "_MP_ID",
    "VENDOR_ID",
)
FIRST_DATE_FIELDS = (
    "RECOMMENDATION_DATE", "SANCTION_DATE", "ACTUAL_END_DATE", "TENURE_START_DATE",
    "TENURE_END_DATE",
)
FIRST_MONEY_FIELDS = ("RECOMMENDED_AMOUNT", "SANCTION_AMOUNT", "ACTUAL_AMOUNT")
# Fields that a portal list gives together. A record that holds all of a
# group sends its landing position once for them; the results do not depend on it.
FIELDS_TOGETHER = (
    ("WORK_ID", "WORK_CATEGORY", "ACTIVITY_NAME", "STATE_NAME", "MP_NAME", "_MP_ID", "CONSTITUENCY",
     "CONSTITUENCY_ID"),
    ("WORK_DESCRIPTION", "RECOMMENDED_AMOUNT", "RECOMMENDATION_DATE"),
    ("WORK_STAGE", "SANCTION_AMOUNT"),
    ("ACTUAL_AMOUNT", "ACTUAL_END_DATE"),
    ("VENDOR_ID", "VENDOR_NAME", "WORK_STATUS", "LETTER_NO"),
    ("HOUSE_OF_PARLIAMENT", "TENURE", "TENURE_START_DATE", "TENURE_END_DATE"),
)
LIFECYCLE_FLAGS = {
    "IS_RECOMMENDED": RECOMMENDED, "IS_SANCTIONED": SANCTIONED, "IS_COMPLETED": COMPLETED,
    "HAS_EXPENDITURE_RECORD": EXPENDITURE,
}
LIFECYCLE_COUNTS = {
    "RECOMMENDED_RECORD_COUNT": RECOMMENDED, "SANCTIONED_RECORD_COUNT": SANCTIONED,
    "COMPLETED_RECORD_COUNT": COMPLETED, "EXPENDITURE_RECORD_COUNT": EXPENDITURE,
}


def consolidate_works(records: DataFrame, key: str = "WORK_RECOMMENDATION_DTL_ID") -> DataFrame:
    """Work master from all landed records of a work, in one aggregation.

    Each field takes its first meaningful value in landing order; lifecycle
    flags and record counts per portal list come from the same pass.
    """
    cleaned = {
        c: clean(c)
        for clean, names in ((clean_text, FIRST_TEXT_FIELDS), (clean_date, FIRST_DATE_FIELDS),
                             (clean_money, FIRST_MONEY_FIELDS))
        for c in names if c in records.columns
    }
    firsts, values = first_values(list(cleaned), FIELDS_TOGETHER, "_ord")
    lists = [
        F.max(F.coalesce(F.col("_SOURCE_KEY") == v, F.lit(False)).cast("int")).alias(k)
        for k, v in LIFECYCLE_FLAGS.items()
    ]
    lists += [F.count_if(F.col("_SOURCE_KEY") == v).alias(k) for k, v in LIFECYCLE_COUNTS.items()]
    keyed = records.select(
        clean_id(key).alias("_key"), "_ord", "_SOURCE_KEY", *[v.alias(c) for c, v in cleaned.items()]
    ).filter(F.col("_key").isNotNull())
    return keyed.groupBy("_key").agg(*firsts, *lists).select(
        F.col("_key").alias(key), *[v.alias(c) for c, v in values.items()],
        *LIFECYCLE_FLAGS, *LIFECYCLE_COUNTS,
    )


def first_values(
    fields: Sequence[str], together: Sequence[Sequence[str]], order: str
) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates, and from them each field's first non-null value by ``order``.

    A row that holds all fields of a group in ``together`` counts for them as one
    candidate, with its position sent once; what it holds of an incomplete group counts
    field by field. The earlier of both candidates is the field's first value.
    """
    at, placed = F.col(order).alias("_at"), F.col(order).isNotNull()
    aggregates, whole, of = [], {}, {}
    for i, names in enumerate([c for c in g if c in fields] for g in together):
        if len(names) > 1:
            whole[i] = reduce(Column.__and__, [F.col(c).isNotNull() for c in names])
            aggregates.append(F.min(F.when(placed & whole[i], F.struct(at, *names))).alias(f"_g{i}"))
            of |= dict.fromkeys(names, i)
    values = {}
    for c in fields:
        alone = placed & F.col(c).isNotNull()
        if c in of:
            alone = alone & ~whole[of[c]]
        aggregates.append(F.min(F.when(alone, F.struct(at, F.col(c).alias("_value")))).alias(f"_s_{c}"))
        one = F.col(f"_s_{c}")
        values[c] = one["_value"]
        if c in of:
            group = F.col(f"_g{of[c]}")
            values[c] = F.when(one.isNull() | (group["_at"] <= one["_at"]), group[c]).otherwise(one["_value"])
    return aggregates, values


def source_counts(records: DataFrame, key: str = "WORK_RECOMMENDATION_DTL_ID") -> DataFrame:
    """Landed record counts per work, one column per portal list."""
    names = {v: k for k, v in LIFECYCLE_COUNTS.items()}
    pivoted = (
        records.filter(F.col(key).isNotNull())
        .groupBy(key)
        .pivot("_SOURCE_KEY", list(names))
        .agg(F.count(F.lit(1)))
    )
    return pivoted.select(
        key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(k) for v, k in names.items()]
    )


def expenditure_records(records: DataFrame) -> DataFrame:
    return records.filter(F.col("_SOURCE_KEY") == EXPENDITURE)


def spending_summary(
    payments: DataFrame, key: str = "WORK_ID", *, once: bool = False, skew: Skew = Skew()
) -> DataFrame:
    """First-generation per-work payment summary; ``once`` counts equal rows once.

    The rows are sent by work one time, and vendors and dates are counted where they
    then lie. Works with more than ``hot_rows`` rows stay out of that: their distinct
    values are spread by expanded rows, which would triple all others.
    """
    amount = F.col("FUND_DISBURSED_AMT")
    totals = [
        F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(28,2)").alias("TOTAL_DISBURSED"),
        F.count(amount).alias("TRANSACTION_COUNT"),
        (F.sum(amount).cast("double") / F.nullif(F.count(amount), F.lit(0))).alias(
            "AVERAGE_TRANSACTION_AMOUNT"
        ),
        F.max(amount).alias("MAX_TRANSACTION_AMOUNT"),
        F.min(amount).alias("MIN_TRANSACTION_AMOUNT"),
    ]
    distinct = {"VENDOR_ID": "VENDOR_COUNT", "EXPENDITURE_DATE": "EXPENDITURE_DATE_COUNT"}
    known = payments.select(key, "FUND_DISBURSED_AMT", *distinct).filter(F.col(key).isNotNull())
    tagged = null_safe_join(known, hot_keys(known, [key], skew), [key], "left")
    usual = tagged.filter(F.col("_splits").isNull()).drop("_splits").repartition(F.col(key))
    hot = tagged.filter(F.col("_splits").isNotNull()).drop("_splits")
    if once:
        usual, hot = usual.distinct(), hot.distinct()
    summary = usual.groupBy(key).agg(*totals)
    for c, name in distinct.items():
        summary = summary.join(distinct_values(usual, key, c, name), key)
    return summary.unionByName(
        hot.groupBy(key).agg(*totals, *[F.count_distinct(c).alias(name) for c, name in distinct.items()])
    )
