"""Explicit schemas of the landed and derived layers."""

from __future__ import annotations

from pyspark.sql import types as T

# The four portal lists that define a work's lifecycle stage.
RECOMMENDED = "Works Recommended"
SANCTIONED = "Works Sanctioned"
COMPLETED = "Works Completed"
EXPENDITURE = "Expenditure on Completed and On-going Works as on Date"
SOURCE_LISTS = (RECOMMENDED, SANCTIONED, COMPLETED, EXPENDITURE)

RAW_TEXT_FIELDS = (
    "WORK_RECOMMENDATION_DTL_ID", "WORK_ID", "STATE_NAME", "CONSTITUENCY_ID", "CONSTITUENCY",
    "MP_NAME", "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_DESCRIPTION", "WORK_STAGE",
    "RECOMMENDED_AMOUNT", "SANCTION_AMOUNT", "ACTUAL_AMOUNT", "FUND_DISBURSED_AMT",
    "RECOMMENDATION_DATE", "SANCTION_DATE", "ACTUAL_END_DATE", "EXPENDITURE_DATE",
    "TENURE_START_DATE", "TENURE_END_DATE", "VENDOR_ID", "VENDOR_NAME", "WORK_STATUS",
    "IA_NAME", "IDA_NAME", "LETTER_NO", "ATTACH_ID", "FILE_STATUS", "FLAG",
    "HOUSE_OF_PARLIAMENT", "TENURE", "AVERAGE_RATING",
)
PROVENANCE_FIELDS = (
    "_SOURCE_KEY", "_STATE_ID", "_STATE_NAME", "_MP_ID", "_MP_NAME", "_CONSTITUENCY_ID",
    "_CONSTITUENCY",
)

RAW_RECORD = T.StructType(
    [T.StructField(name, T.StringType()) for name in RAW_TEXT_FIELDS + PROVENANCE_FIELDS]
    + [T.StructField("_ord", T.StringType())]
)

MONEY = T.DecimalType(18, 2)

WORK_MASTER = T.StructType(
    [
        T.StructField("WORK_ID", T.LongType(), False),
        T.StructField("STATE_ID", T.LongType()),
        T.StructField("STATE_NAME", T.StringType()),
        T.StructField("CONSTITUENCY_ID", T.LongType()),
        T.StructField("CONSTITUENCY", T.StringType()),
        T.StructField("MP_ID", T.LongType()),
        T.StructField("MP_NAME", T.StringType()),
        T.StructField("WORK_CATEGORY", T.StringType()),
        T.StructField("ACTIVITY_NAME", T.StringType()),
        T.StructField("WORK_DESCRIPTION", T.StringType()),
        T.StructField("WORK_STAGE", T.StringType()),
        T.StructField("SOURCE_KEY", T.StringType()),
        T.StructField("RECOMMENDED_AMOUNT", MONEY),
        T.StructField("SANCTION_AMOUNT", MONEY),
        T.StructField("RECOMMENDATION_DATE", T.DateType()),
        T.StructField("SANCTION_DATE", T.DateType()),
        T.StructField("ATTACH_ID", T.LongType()),
        T.StructField("FILE_STATUS", T.StringType()),
        T.StructField("FLAG", T.StringType()),
        T.StructField("HOUSE_OF_PARLIAMENT", T.StringType()),
        T.StructField("IDA_NAME", T.StringType()),
        T.StructField("LETTER_NO", T.StringType()),
        T.StructField("TENURE", T.StringType()),
        T.StructField("TENURE_START_DATE", T.DateType()),
        T.StructField("TENURE_END_DATE", T.DateType()),
    ]
)

MASTER_REQUIRED = (
    "WORK_RECOMMENDATION_DTL_ID", "STATE_NAME", "CONSTITUENCY_ID", "CONSTITUENCY", "MP_NAME",
    "WORK_CATEGORY", "ACTIVITY_NAME", "WORK_DESCRIPTION", "RECOMMENDED_AMOUNT",
    "SANCTION_AMOUNT", "RECOMMENDATION_DATE", "SANCTION_DATE", "WORK_STAGE", "_STATE_ID",
    "_STATE_NAME", "_MP_ID", "_MP_NAME", "_CONSTITUENCY_ID", "_CONSTITUENCY", "_SOURCE_KEY",
)
PAYMENT_REQUIRED = (
    "WORK_RECOMMENDATION_DTL_ID", "WORK_ID", "FUND_DISBURSED_AMT", "EXPENDITURE_DATE",
    "VENDOR_ID", "VENDOR_NAME", "WORK_STATUS", "STATE_NAME", "MP_NAME", "CONSTITUENCY",
)
