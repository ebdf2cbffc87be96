"""Works, payments and completions derived from the driver's order tables.

Orders stand for works, line items for payments, customers for the elected
representatives and nations for states. Gaps and outliers come from the data's
own attributes (price, balance, date), so every row of the tables is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import COMPLETED, EXPENDITURE, RECOMMENDED, SANCTIONED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns(
        {
            "_date": F.col("o_orderdate").cast("date"),
            "_day": F.dayofmonth(F.col("o_orderdate").cast("date")),
            "_month": F.month(F.col("o_orderdate").cast("date")),
        }
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per work with the work_master columns."""
    price = F.col("o_totalprice")
    seat = F.col("c_nationkey") * 100 + F.floor((F.col("c_acctbal") + 1000) / 1000)
    return (
        _orders(spark, sf_dir)
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("WORK_ID"),
            F.col("c_nationkey").cast("bigint").alias("STATE_ID"),
            F.when(F.col("n_name") != "NATION_24", F.col("n_name")).alias("STATE_NAME"),
            seat.cast("bigint").alias("CONSTITUENCY_ID"),
            F.concat(F.lit("SEAT "), seat.cast("bigint").cast("string")).alias("CONSTITUENCY"),
            F.when(F.col("c_acctbal") >= -900, F.col("o_custkey")).alias("MP_ID"),
            F.col("c_name").alias("MP_NAME"),
            F.col("o_orderpriority").alias("WORK_CATEGORY"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("ACTIVITY_NAME"),
            F.concat_ws(
                " ", "o_orderpriority", F.lit("works under"), "c_mktsegment", F.lit("for"), "c_name"
            ).alias("WORK_DESCRIPTION"),
            F.when(F.col("o_orderstatus") == "F", "Completed")
            .when(F.col("o_orderstatus") == "O", "Physical Inspection")
            .alias("WORK_STAGE"),
            F.when(price < 10000, RECOMMENDED)
            .when(F.col("o_orderstatus") == "F", COMPLETED)
            .otherwise(SANCTIONED)
            .alias("SOURCE_KEY"),
            _money(F.floor(price * (1 + F.col("_day") / 100.0))).alias("RECOMMENDED_AMOUNT"),
            F.when(price < 10000, None)
            .when(price > 490000, _money(F.floor(price * 12)))
            .otherwise(_money(price))
            .alias("SANCTION_AMOUNT"),
            F.when(
                F.col("_date") >= F.lit("1995-02-01").cast("date"),
                F.date_sub("_date", F.col("_day") - 3),
            ).alias("RECOMMENDATION_DATE"),
            F.when(F.col("_date") < F.lit("2001-07-01").cast("date"), F.col("_date")).alias(
                "SANCTION_DATE"
            ),
            F.when(F.col("_day") > 15, F.col("o_orderkey")).alias("ATTACH_ID"),
            F.col("o_orderstatus").alias("FILE_STATUS"),
        )
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per payment; (SRC_LINE, SRC_ITEM, VENDOR_ID, amount) orders them."""
    shift = F.col("l_linenumber") * 11 + F.col("l_quantity").cast("int") - 15
    return (
        table(spark, sf_dir, "lineitem")
        .join(
            table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .select(
            F.col("l_orderkey").alias("WORK_ID"),
            F.col("l_suppkey").alias("VENDOR_ID"),
            F.concat(F.lit("Vendor "), F.col("l_suppkey").cast("string")).alias("VENDOR_NAME"),
            _money(F.col("l_extendedprice")).alias("FUND_DISBURSED_AMT"),
            F.date_add(F.col("o_orderdate").cast("date"), shift).alias("EXPENDITURE_DATE"),
            F.when(F.col("l_returnflag") == "R", " Payment In-Progress")
            .otherwise("Payment Success")
            .alias("WORK_STATUS"),
            F.concat(F.lit("L-"), F.col("l_partkey").cast("string")).alias("LETTER_NO"),
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("AGENCY "), "l_linestatus")).alias(
                "IA_NAME"
            ),
            F.when(F.col("l_linestatus") == "F", F.concat(F.lit("DISTRICT "), "l_returnflag")).alias(
                "IDA_NAME"
            ),
            F.col("l_linenumber").alias("SRC_LINE"),
            F.col("l_partkey").alias("SRC_ITEM"),
        )
    )


PAYMENT_ORDER = ("SRC_LINE", "SRC_ITEM", "VENDOR_ID", "FUND_DISBURSED_AMT")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return (
        _orders(spark, sf_dir)
        .filter(F.col("o_orderstatus") == "F")
        .select(
            F.col("o_orderkey").alias("WORK_ID"),
            _money(F.floor(price * (0.90 + F.col("_month") / 100.0))).alias("ACTUAL_AMOUNT"),
            F.date_add(
                "_date", F.when(price > 495000, F.lit(900)).otherwise(F.col("_day") * 4)
            ).alias("ACTUAL_END_DATE"),
            F.floor(F.col("_day") / 7).cast("double").alias("AVERAGE_RATING"),
        )
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed records of the four portal lists, all values still text.

    Recommended rows of pending works are landed twice (a repeated batch), and
    some payment amounts are unreadable. ``_ord`` is a unique landing position.
    """
    work = works(spark, sf_dir)
    done = completions(spark, sf_dir)

    def text(c: str) -> Column:
        return F.col(c).cast("string").alias(c)

    def day(c: str) -> Column:
        return F.date_format(c, "dd-MM-yyyy").alias(c)

    def position(list_no: int, *parts: Column) -> Column:
        padded = [F.lpad(p.cast("string"), 14, "0") for p in parts]
        return F.concat(F.lit(str(list_no)), *padded).alias("_ord")

    identity = [
        text("WORK_ID").alias("WORK_RECOMMENDATION_DTL_ID"),
        F.concat(F.lit("WS/"), F.col("WORK_ID").cast("string")).alias("WORK_NO"),
        F.col("STATE_NAME"), text("CONSTITUENCY_ID"), F.col("CONSTITUENCY"), F.col("MP_NAME"),
        F.col("WORK_CATEGORY"), F.col("ACTIVITY_NAME"),
        F.col("STATE_ID").cast("string").alias("_STATE_ID"),
        F.col("STATE_NAME").alias("_STATE_NAME"),
        F.col("MP_ID").cast("string").alias("_MP_ID"),
        F.col("MP_NAME").alias("_MP_NAME"),
        F.col("CONSTITUENCY_ID").cast("string").alias("_CONSTITUENCY_ID"),
        F.col("CONSTITUENCY").alias("_CONSTITUENCY"),
    ]

    def tagged(df: DataFrame, list_no: int, source: str, *extra: Column) -> DataFrame:
        return df.select(
            *identity, *extra, F.lit(source).alias("_SOURCE_KEY"),
            position(list_no, F.col("WORK_ID")),
        ).withColumnRenamed("WORK_NO", "WORK_ID")

    recommended_fields = [
        F.col("WORK_DESCRIPTION"), text("RECOMMENDED_AMOUNT"), day("RECOMMENDATION_DATE"),
    ]
    recommended = tagged(work, 1, RECOMMENDED, *recommended_fields)
    repeated = tagged(
        work.filter(F.col("FILE_STATUS") == "P"), 5, RECOMMENDED, *recommended_fields
    )
    sanctioned = tagged(
        work.filter(F.col("SANCTION_AMOUNT").isNotNull()), 2, SANCTIONED,
        F.col("WORK_STAGE"), text("SANCTION_AMOUNT"), day("SANCTION_DATE"), text("ATTACH_ID"),
    )
    completed = tagged(
        work.join(done, "WORK_ID"), 3, COMPLETED,
        F.col("WORK_STAGE"), text("SANCTION_AMOUNT"), text("ACTUAL_AMOUNT"),
        day("ACTUAL_END_DATE"), text("AVERAGE_RATING"),
    )
    money = payments(spark, sf_dir).join(
        work.select("WORK_ID", "STATE_ID", "STATE_NAME", "CONSTITUENCY_ID", "CONSTITUENCY",
                    "MP_ID", "MP_NAME", "WORK_CATEGORY", "ACTIVITY_NAME"),
        "WORK_ID",
    )
    spent = money.select(
        *identity,
        F.when(F.col("VENDOR_ID") == 13, "n/a").otherwise(F.col("FUND_DISBURSED_AMT").cast("string"))
        .alias("FUND_DISBURSED_AMT"),
        day("EXPENDITURE_DATE"), text("VENDOR_ID"), F.col("VENDOR_NAME"), F.col("WORK_STATUS"),
        F.col("IA_NAME"), F.col("IDA_NAME"), F.col("LETTER_NO"),
        F.lit(EXPENDITURE).alias("_SOURCE_KEY"),
        position(
            4, F.col("WORK_ID"), F.col("SRC_LINE"), F.col("SRC_ITEM"), F.col("VENDOR_ID"),
            (F.col("FUND_DISBURSED_AMT") * 100).cast("bigint"),
        ),
    ).withColumnRenamed("WORK_NO", "WORK_ID")
    merged = recommended
    for part in (sanctioned, completed, spent, repeated):
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged
