"""SQL twins: the same tables and results written as DuckDB SQL.

Relations are common table expressions over the driver's tables; ``query``
puts together the ones a result needs.
"""

from __future__ import annotations

import re

from .spec import sql_columns

RELATIONS: dict[str, str] = {}


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql.strip()


def with_relations(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with every relation it mentions, directly or not."""
    extra = extra or {}
    pool = {**RELATIONS, **extra}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        body = pool[name]
        words = set(re.findall(r"[a-z_0-9]+", body))
        for other in pool:
            if other != name and other in words:
                visit(other)
        order.append(name)

    for name in pool:
        if name in set(re.findall(r"[a-z_0-9]+", sql)):
            visit(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{pool[n]}\n)" for n in order)
    return f"WITH {ctes}\n{sql}"


def query(spec: str, source: str, extra: dict[str, str] | None = None, tail: str = "") -> str:
    return with_relations(f"SELECT {sql_columns(spec)} FROM {source} {tail}", extra)


def ratio(a: str, b: str) -> str:
    return (
        f"CASE WHEN CAST({b} AS DOUBLE) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"
    )


def dd(a: str, b: str) -> str:
    return f"date_diff('day', {a}, {b})"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def mean(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0)"


def median(c: str) -> str:
    return f"quantile_cont(CAST({c} AS DOUBLE), 0.5)"


def money(x: str, places: int = 2) -> str:
    return f"coalesce('₹' || format('{{:,.{places}f}}', CAST({x} AS DOUBLE)), 'Not available')"


def number(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN {x} IS NULL THEN 'Not available' WHEN {d} = floor({d}) "
        f"THEN format('{{:,.0f}}', {d}) ELSE format('{{:,.2f}}', {d}) END"
    )


def day_count(x: str) -> str:
    return f"coalesce(format('{{:,.0f}}', CAST({x} AS DOUBLE)) || ' days', 'Not available')"


def percent(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    return (
        f"coalesce(format('{{:.1f}}', CASE WHEN {d} BETWEEN 0 AND 1 THEN {d} * 100 ELSE {d} END) "
        f"|| '%', 'Not available')"
    )


# --- source layer ---------------------------------------------------------------

relation("ord", """
SELECT *, CAST(o_orderdate AS DATE) AS d,
       CAST(day(CAST(o_orderdate AS DATE)) AS INTEGER) AS dom,
       CAST(month(CAST(o_orderdate AS DATE)) AS INTEGER) AS mon
FROM orders
""")

relation("works", """
SELECT o_orderkey AS WORK_ID, CAST(c_nationkey AS BIGINT) AS STATE_ID,
       CASE WHEN n_name <> 'NATION_24' THEN n_name END AS STATE_NAME,
       CAST(c_nationkey * 100 + floor((c_acctbal + 1000) / 1000) AS BIGINT) AS CONSTITUENCY_ID,
       'SEAT ' || CAST(CAST(c_nationkey * 100 + floor((c_acctbal + 1000) / 1000) AS BIGINT) AS VARCHAR)
         AS CONSTITUENCY,
       CASE WHEN c_acctbal >= -900 THEN o_custkey END AS MP_ID, c_name AS MP_NAME,
       o_orderpriority AS WORK_CATEGORY,
       CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS ACTIVITY_NAME,
       o_orderpriority || ' works under ' || c_mktsegment || ' for ' || c_name AS WORK_DESCRIPTION,
       CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Physical Inspection' END
         AS WORK_STAGE,
       CASE WHEN o_totalprice < 10000 THEN 'Works Recommended'
            WHEN o_orderstatus = 'F' THEN 'Works Completed' ELSE 'Works Sanctioned' END AS SOURCE_KEY,
       CAST(floor(o_totalprice * (1 + dom / 100e0)) AS DECIMAL(18,2)) AS RECOMMENDED_AMOUNT,
       CASE WHEN o_totalprice < 10000 THEN NULL
            WHEN o_totalprice > 490000 THEN CAST(floor(o_totalprice * 12) AS DECIMAL(18,2))
            ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS SANCTION_AMOUNT,
       CASE WHEN d >= DATE '1995-02-01' THEN d - (dom - 3) END AS RECOMMENDATION_DATE,
       CASE WHEN d < DATE '2001-07-01' THEN d END AS SANCTION_DATE,
       CASE WHEN dom > 15 THEN o_orderkey END AS ATTACH_ID, o_orderstatus AS FILE_STATUS
FROM ord JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")

relation("pays", """
SELECT l_orderkey AS WORK_ID, l_suppkey AS VENDOR_ID,
       'Vendor ' || CAST(l_suppkey AS VARCHAR) AS VENDOR_NAME,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS FUND_DISBURSED_AMT,
       CAST(o_orderdate AS DATE) + (l_linenumber * 11 + CAST(l_quantity AS INTEGER) - 15)
         AS EXPENDITURE_DATE,
       CASE WHEN l_returnflag = 'R' THEN ' Payment In-Progress' ELSE 'Payment Success' END
         AS WORK_STATUS,
       'L-' || CAST(l_partkey AS VARCHAR) AS LETTER_NO,
       CASE WHEN l_returnflag <> 'N' THEN 'AGENCY ' || l_linestatus END AS IA_NAME,
       CASE WHEN l_linestatus = 'F' THEN 'DISTRICT ' || l_returnflag END AS IDA_NAME,
       l_linenumber AS SRC_LINE, l_partkey AS SRC_ITEM
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")

relation("dones", """
SELECT o_orderkey AS WORK_ID,
       CAST(floor(o_totalprice * (0.90e0 + mon / 100e0)) AS DECIMAL(18,2)) AS ACTUAL_AMOUNT,
       d + CAST(CASE WHEN o_totalprice > 495000 THEN 900 ELSE dom * 4 END AS INTEGER)
         AS ACTUAL_END_DATE,
       CAST(floor(dom / 7e0) AS DOUBLE) AS AVERAGE_RATING
FROM ord WHERE o_orderstatus = 'F'
""")

_IDENT = """CAST(WORK_ID AS VARCHAR) AS DTL_ID, 'WS/' || CAST(WORK_ID AS VARCHAR) AS WORK_NO,
  STATE_ID, STATE_NAME, CONSTITUENCY_ID, CONSTITUENCY, MP_ID, MP_NAME, WORK_CATEGORY, ACTIVITY_NAME"""


def _pos(n: int, *parts: str) -> str:
    return f"'{n}' || " + " || ".join(f"lpad(CAST({p} AS VARCHAR), 14, '0')" for p in parts)


def _raw_part(source: str, n: int, key: str, where: str = "", **cols: str) -> str:
    all_cols = ("WORK_DESCRIPTION", "RECOMMENDED_AMOUNT", "RECOMMENDATION_DATE", "WORK_STAGE",
                "SANCTION_AMOUNT", "SANCTION_DATE", "ATTACH_ID", "ACTUAL_AMOUNT",
                "ACTUAL_END_DATE", "AVERAGE_RATING", "FUND_DISBURSED_AMT", "EXPENDITURE_DATE",
                "VENDOR_ID", "VENDOR_NAME", "WORK_STATUS", "IA_NAME", "IDA_NAME", "LETTER_NO")
    listed = ", ".join(f"{cols.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in all_cols)
    return (f"SELECT {_IDENT}, {listed}, '{key}' AS SOURCE_KEY, {_pos(n, *cols.pop('_ord').split(','))}"
            f" AS ORD FROM {source} {where}")


def _text(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def _day(c: str) -> str:
    return f"strftime({c}, '%d-%m-%Y')"


_REC = dict(WORK_DESCRIPTION="WORK_DESCRIPTION", RECOMMENDED_AMOUNT=_text("RECOMMENDED_AMOUNT"),
            RECOMMENDATION_DATE=_day("RECOMMENDATION_DATE"), _ord="WORK_ID")
_EXP = "Expenditure on Completed and On-going Works as on Date"
relation("raw", "\nUNION ALL\n".join([
    _raw_part("works", 1, "Works Recommended", **_REC),
    _raw_part("works", 5, "Works Recommended", "WHERE FILE_STATUS = 'P'", **_REC),
    _raw_part("works", 2, "Works Sanctioned", "WHERE SANCTION_AMOUNT IS NOT NULL",
              WORK_STAGE="WORK_STAGE", SANCTION_AMOUNT=_text("SANCTION_AMOUNT"),
              SANCTION_DATE=_day("SANCTION_DATE"), ATTACH_ID=_text("ATTACH_ID"), _ord="WORK_ID"),
    _raw_part("works JOIN dones USING (WORK_ID)", 3, "Works Completed",
              WORK_STAGE="WORK_STAGE", SANCTION_AMOUNT=_text("SANCTION_AMOUNT"),
              ACTUAL_AMOUNT=_text("ACTUAL_AMOUNT"), ACTUAL_END_DATE=_day("ACTUAL_END_DATE"),
              AVERAGE_RATING=_text("AVERAGE_RATING"), _ord="WORK_ID"),
    _raw_part("pays JOIN (SELECT WORK_ID, STATE_ID, STATE_NAME, CONSTITUENCY_ID, CONSTITUENCY, MP_ID,"
              " MP_NAME, WORK_CATEGORY, ACTIVITY_NAME FROM works) USING (WORK_ID)", 4, _EXP,
              FUND_DISBURSED_AMT="CASE WHEN VENDOR_ID = 13 THEN 'n/a' ELSE CAST(FUND_DISBURSED_AMT AS VARCHAR) END",
              EXPENDITURE_DATE=_day("EXPENDITURE_DATE"), VENDOR_ID=_text("VENDOR_ID"),
              VENDOR_NAME="VENDOR_NAME", WORK_STATUS="WORK_STATUS", IA_NAME="IA_NAME",
              IDA_NAME="IDA_NAME", LETTER_NO="LETTER_NO",
              _ord="WORK_ID,SRC_LINE,SRC_ITEM,VENDOR_ID,CAST(FUND_DISBURSED_AMT * 100 AS BIGINT)"),
]))

# --- payments, completion, features ------------------------------------------------

_ORD = "ROW(SRC_LINE, SRC_ITEM, VENDOR_ID, FUND_DISBURSED_AMT)"


def _first(c: str, order: str = _ORD) -> str:
    return f"arg_min({c}, {order}) FILTER (WHERE {c} IS NOT NULL)"


relation("pay_agg", f"""
SELECT WORK_ID, sum(FUND_DISBURSED_AMT) AS TOTAL_FUND_DISBURSED_AMT,
       count(FUND_DISBURSED_AMT) AS PAYMENT_COUNT,
       min(EXPENDITURE_DATE) AS FIRST_EXPENDITURE_DATE, max(EXPENDITURE_DATE) AS LAST_EXPENDITURE_DATE,
       count(DISTINCT VENDOR_ID) AS UNIQUE_VENDOR_COUNT,
       count(DISTINCT VENDOR_NAME) AS UNIQUE_VENDOR_NAME_COUNT,
       count(*) FILTER (WHERE lower(trim(WORK_STATUS)) = 'payment success') AS PAYMENT_SUCCESS_COUNT,
       count(*) FILTER (WHERE lower(trim(WORK_STATUS)) = 'payment in-progress')
         AS PAYMENT_IN_PROGRESS_COUNT,
       {_first('LETTER_NO')} AS PAYMENT_LETTER_NO, {_first('IA_NAME')} AS PAYMENT_IA_NAME,
       {_first('IDA_NAME')} AS PAYMENT_IDA_NAME, {_first('WORK_STATUS')} AS PAYMENT_WORK_STATUS
FROM pays WHERE FUND_DISBURSED_AMT IS NOT NULL GROUP BY WORK_ID
""")

relation("fin", f"""
SELECT *, PAYMENT_COUNT IS NOT NULL AND PAYMENT_COUNT > 0 AS HAS_PAYMENT_RECORD,
  {ratio('TOTAL_FUND_DISBURSED_AMT', 'SANCTION_AMOUNT')} AS DISBURSED_TO_SANCTION_RATIO,
  SANCTION_AMOUNT - TOTAL_FUND_DISBURSED_AMT AS REMAINING_SANCTION_AMOUNT,
  {dd('FIRST_EXPENDITURE_DATE', 'LAST_EXPENDITURE_DATE')} AS EXPENDITURE_DURATION_DAYS,
  CASE WHEN {dd('FIRST_EXPENDITURE_DATE', 'LAST_EXPENDITURE_DATE')} > 0
       THEN PAYMENT_COUNT * 1e0 / {dd('FIRST_EXPENDITURE_DATE', 'LAST_EXPENDITURE_DATE')} * 100 END
    AS PAYMENTS_PER_100_DAYS,
  ACTUAL_AMOUNT IS NOT NULL AS HAS_COMPLETION_RECORD,
  {ratio('ACTUAL_AMOUNT', 'SANCTION_AMOUNT')} AS ACTUAL_TO_SANCTION_RATIO,
  {ratio('ACTUAL_AMOUNT', 'RECOMMENDED_AMOUNT')} AS ACTUAL_TO_RECOMMENDED_RATIO,
  {ratio('ACTUAL_AMOUNT', 'TOTAL_FUND_DISBURSED_AMT')} AS ACTUAL_VS_DISBURSED_RATIO,
  {dd('RECOMMENDATION_DATE', 'ACTUAL_END_DATE')} AS COMPLETION_DURATION_DAYS,
  {dd('SANCTION_DATE', 'ACTUAL_END_DATE')} AS SANCTION_TO_COMPLETION_DAYS
FROM works LEFT JOIN pay_agg USING (WORK_ID) LEFT JOIN dones USING (WORK_ID)
""")

relation("state_st", f"""
SELECT STATE_NAME, count(*) AS STATE_WORK_COUNT,
  coalesce(sum(RECOMMENDED_AMOUNT), 0) AS STATE_TOTAL_RECOMMENDED,
  coalesce(sum(SANCTION_AMOUNT), 0) AS STATE_TOTAL_SANCTIONED,
  coalesce(sum(TOTAL_FUND_DISBURSED_AMT), 0) AS STATE_TOTAL_DISBURSED,
  {mean('SANCTION_AMOUNT')} AS STATE_AVG_WORK_COST
FROM fin WHERE STATE_NAME IS NOT NULL GROUP BY 1
""")
relation("mp_st", f"""
SELECT MP_ID, count(*) AS MP_WORK_COUNT,
  coalesce(sum(RECOMMENDED_AMOUNT), 0) AS MP_TOTAL_RECOMMENDED,
  coalesce(sum(SANCTION_AMOUNT), 0) AS MP_TOTAL_SANCTIONED,
  coalesce(sum(TOTAL_FUND_DISBURSED_AMT), 0) AS MP_TOTAL_DISBURSED,
  {mean('SANCTION_AMOUNT')} AS MP_AVG_SANCTION_AMOUNT,
  {median('SANCTION_AMOUNT')} AS MP_MEDIAN_SANCTION_AMOUNT
FROM fin WHERE MP_ID IS NOT NULL GROUP BY 1
""")
relation("seat_st", f"""
SELECT CONSTITUENCY_ID, count(*) AS CONSTITUENCY_WORK_COUNT,
  coalesce(sum(SANCTION_AMOUNT), 0) AS CONSTITUENCY_TOTAL_SANCTIONED,
  coalesce(sum(TOTAL_FUND_DISBURSED_AMT), 0) AS CONSTITUENCY_TOTAL_DISBURSED,
  {mean('SANCTION_AMOUNT')} AS CONSTITUENCY_AVG_SANCTION
FROM fin WHERE CONSTITUENCY_ID IS NOT NULL GROUP BY 1
""")
relation("keyed", """
SELECT * EXCLUDE (STATE_NAME, WORK_CATEGORY, ACTIVITY_NAME), STATE_NAME AS RAW_STATE,
  trim(coalesce(STATE_NAME, 'UNKNOWN')) AS STATE_NAME,
  trim(coalesce(WORK_CATEGORY, 'UNKNOWN')) AS WORK_CATEGORY,
  trim(coalesce(ACTIVITY_NAME, 'UNKNOWN')) AS ACTIVITY_NAME
FROM fin
""")
relation("peer_st", f"""
SELECT STATE_NAME, WORK_CATEGORY, ACTIVITY_NAME, count(*) AS PEER_COUNT,
  {median('SANCTION_AMOUNT')} AS PEER_MEDIAN_SANCTION, {mean('SANCTION_AMOUNT')} AS PEER_MEAN_SANCTION,
  stddev_samp(CAST(SANCTION_AMOUNT AS DOUBLE)) AS PEER_STD_SANCTION,
  {median('TOTAL_FUND_DISBURSED_AMT')} AS PEER_MEDIAN_DISBURSED
FROM keyed GROUP BY 1, 2, 3
""")
relation("cat_st", "SELECT WORK_CATEGORY, count(*) AS CATEGORY_WORK_COUNT FROM keyed GROUP BY 1")
relation("act_st", "SELECT ACTIVITY_NAME, count(*) AS ACTIVITY_WORK_COUNT FROM keyed GROUP BY 1")

_QUALITY = ("WORK_DESCRIPTION", "WORK_STAGE", "RECOMMENDED_AMOUNT", "SANCTION_AMOUNT",
            "RECOMMENDATION_DATE", "SANCTION_DATE", "TOTAL_FUND_DISBURSED_AMT",
            "FIRST_EXPENDITURE_DATE", "LAST_EXPENDITURE_DATE", "ACTUAL_AMOUNT", "ACTUAL_END_DATE")
_MISSING = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _QUALITY)

relation("feat0", f"""
SELECT k.*, s.* EXCLUDE (STATE_NAME), m.* EXCLUDE (MP_ID), c.* EXCLUDE (CONSTITUENCY_ID),
  p.* EXCLUDE (STATE_NAME, WORK_CATEGORY, ACTIVITY_NAME), g.CATEGORY_WORK_COUNT, a.ACTIVITY_WORK_COUNT,
  {_MISSING} AS MISSING_FIELD_COUNT,
  {dd('RECOMMENDATION_DATE', 'SANCTION_DATE')} AS RECOMMENDATION_TO_SANCTION_DAYS,
  {dd('SANCTION_DATE', 'FIRST_EXPENDITURE_DATE')} AS SANCTION_TO_FIRST_PAYMENT_DAYS,
  {dd('RECOMMENDATION_DATE', 'FIRST_EXPENDITURE_DATE')} AS RECOMMENDATION_TO_FIRST_PAYMENT_DAYS,
  {dd('LAST_EXPENDITURE_DATE', 'ACTUAL_END_DATE')} AS LAST_PAYMENT_TO_COMPLETION_DAYS,
  {dd('RECOMMENDATION_DATE', 'ACTUAL_END_DATE')} AS RECOMMENDATION_TO_COMPLETION_DAYS
FROM keyed k LEFT JOIN state_st s ON k.RAW_STATE = s.STATE_NAME LEFT JOIN mp_st m ON k.MP_ID = m.MP_ID
  LEFT JOIN seat_st c ON k.CONSTITUENCY_ID = c.CONSTITUENCY_ID
  LEFT JOIN peer_st p ON k.STATE_NAME = p.STATE_NAME AND k.WORK_CATEGORY = p.WORK_CATEGORY
    AND k.ACTIVITY_NAME = p.ACTIVITY_NAME
  LEFT JOIN cat_st g ON k.WORK_CATEGORY = g.WORK_CATEGORY
  LEFT JOIN act_st a ON k.ACTIVITY_NAME = a.ACTIVITY_NAME
""")

relation("feat1", f"""
SELECT *, RECOMMENDED_AMOUNT - SANCTION_AMOUNT AS RECOMMENDED_TO_SANCTION_DIFFERENCE,
  {ratio('SANCTION_AMOUNT', 'RECOMMENDED_AMOUNT')} AS SANCTION_TO_RECOMMENDED_RATIO,
  {ratio('TOTAL_FUND_DISBURSED_AMT', 'RECOMMENDED_AMOUNT')} AS DISBURSED_TO_RECOMMENDED_RATIO,
  {ratio('REMAINING_SANCTION_AMOUNT', 'SANCTION_AMOUNT')} AS REMAINING_SANCTION_RATIO,
  {ratio('TOTAL_FUND_DISBURSED_AMT', 'PAYMENT_COUNT')} AS AVERAGE_PAYMENT_AMOUNT,
  {ratio('PAYMENT_SUCCESS_COUNT', 'PAYMENT_COUNT')} AS PAYMENT_SUCCESS_RATIO,
  {ratio('PAYMENT_IN_PROGRESS_COUNT', 'PAYMENT_COUNT')} AS PAYMENT_IN_PROGRESS_RATIO,
  {ratio('PAYMENT_COUNT', 'UNIQUE_VENDOR_COUNT')} AS PAYMENTS_PER_VENDOR,
  CASE WHEN EXPENDITURE_DURATION_DAYS > 0 THEN PAYMENT_COUNT * 1e0 / EXPENDITURE_DURATION_DAYS * 30 END
    AS PAYMENTS_PER_30_DAYS,
  CASE WHEN EXPENDITURE_DURATION_DAYS > 0
       THEN CAST(TOTAL_FUND_DISBURSED_AMT AS DOUBLE) / EXPENDITURE_DURATION_DAYS END
    AS DISBURSED_PER_EXPENDITURE_DAY,
  {flag('HAS_COMPLETION_RECORD')} AS IS_COMPLETED, {flag('ACTUAL_AMOUNT IS NOT NULL')} AS HAS_ACTUAL_AMOUNT,
  {flag('ACTUAL_END_DATE IS NOT NULL')} AS HAS_ACTUAL_END_DATE,
  ACTUAL_AMOUNT - SANCTION_AMOUNT AS ACTUAL_MINUS_SANCTION,
  ACTUAL_AMOUNT - TOTAL_FUND_DISBURSED_AMT AS ACTUAL_MINUS_DISBURSED,
  TOTAL_FUND_DISBURSED_AMT - ACTUAL_AMOUNT AS DISBURSED_MINUS_ACTUAL,
  {flag('NOT HAS_PAYMENT_RECORD')} AS NO_PAYMENT_RECORD,
  {flag('PAYMENT_COUNT > 1')} AS MULTIPLE_PAYMENTS, {flag('UNIQUE_VENDOR_COUNT > 1')} AS MULTIPLE_VENDORS,
  {flag('PAYMENT_COUNT >= 5')} AS PAYMENT_COUNT_GE_5, {flag('PAYMENT_COUNT >= 10')} AS PAYMENT_COUNT_GE_10,
  {flag('UNIQUE_VENDOR_COUNT >= 5')} AS VENDOR_COUNT_GE_5,
  {flag('UNIQUE_VENDOR_COUNT >= 10')} AS VENDOR_COUNT_GE_10,
  1 - MISSING_FIELD_COUNT / 11e0 AS DATA_COMPLETENESS_RATIO,
  {flag('RECOMMENDATION_TO_SANCTION_DAYS < 0')} AS NEGATIVE_RECOMMENDATION_TO_SANCTION,
  {flag('SANCTION_TO_FIRST_PAYMENT_DAYS < 0')} AS NEGATIVE_SANCTION_TO_PAYMENT,
  {flag('LAST_PAYMENT_TO_COMPLETION_DAYS < 0')} AS COMPLETION_BEFORE_LAST_PAYMENT,
  CASE WHEN LAST_PAYMENT_TO_COMPLETION_DAYS < 0 THEN -LAST_PAYMENT_TO_COMPLETION_DAYS END
    AS PAYMENT_AFTER_REPORTED_COMPLETION_DAYS,
  {flag('ACTUAL_AMOUNT > SANCTION_AMOUNT')} AS ACTUAL_ABOVE_SANCTION,
  {flag('TOTAL_FUND_DISBURSED_AMT > SANCTION_AMOUNT')} AS DISBURSED_ABOVE_SANCTION,
  year(RECOMMENDATION_DATE) AS RECOMMENDATION_YEAR, month(RECOMMENDATION_DATE) AS RECOMMENDATION_MONTH,
  year(SANCTION_DATE) AS SANCTION_YEAR, year(FIRST_EXPENDITURE_DATE) AS FIRST_PAYMENT_YEAR,
  year(ACTUAL_END_DATE) AS COMPLETION_YEAR,
  {ratio('SANCTION_AMOUNT', 'PEER_MEDIAN_SANCTION')} AS SANCTION_TO_PEER_MEDIAN,
  {ratio('TOTAL_FUND_DISBURSED_AMT', 'PEER_MEDIAN_DISBURSED')} AS DISBURSED_TO_PEER_MEDIAN,
  CASE WHEN PEER_STD_SANCTION > 0
       THEN (CAST(SANCTION_AMOUNT AS DOUBLE) - PEER_MEAN_SANCTION) / PEER_STD_SANCTION END
    AS SANCTION_PEER_Z_SCORE
FROM feat0
""")

relation("feat", f"""
SELECT *, abs(SANCTION_PEER_Z_SCORE) AS ABS_PEER_COST_Z_SCORE,
  {flag('SANCTION_TO_PEER_MEDIAN > 2')} AS SANCTION_ABOVE_2X_PEER_MEDIAN,
  {flag('SANCTION_TO_PEER_MEDIAN > 5')} AS SANCTION_ABOVE_5X_PEER_MEDIAN,
  {flag('DISBURSED_TO_PEER_MEDIAN > 2')} AS DISBURSED_ABOVE_2X_PEER_MEDIAN,
  {flag('AVERAGE_PAYMENT_AMOUNT > 1000000')} AS AVERAGE_PAYMENT_ABOVE_1M,
  {flag('TOTAL_FUND_DISBURSED_AMT > 5000000')} AS TOTAL_DISBURSED_ABOVE_5M
FROM feat1
""")

# --- rules -------------------------------------------------------------------------

# Rule name -> (condition, category, strength, points, wording, verify only).
RULES = {
    "RULE_SANCTION_ABOVE_2X_PEER": (
        "PEER_COUNT >= 10 AND SANCTION_TO_PEER_MEDIAN > 2", "Financial", "MODERATE", 20,
        "Sanction amount is more than 2x the median sanction amount of comparable peer works.", 0),
    "RULE_SANCTION_ABOVE_5X_PEER": (
        "PEER_COUNT >= 10 AND SANCTION_TO_PEER_MEDIAN > 5", "Financial", "STRONG", 35,
        "Sanction amount is more than 5x the median sanction amount of comparable peer works.", 0),
    "RULE_PEER_Z_ABOVE_3": (
        "PEER_COUNT >= 10 AND SANCTION_PEER_Z_SCORE > 3", "Financial", "MODERATE", 20,
        "Sanction amount is more than 3 standard deviations above the comparable peer mean.", 0),
    "RULE_PEER_Z_ABOVE_5": (
        "PEER_COUNT >= 10 AND SANCTION_PEER_Z_SCORE > 5", "Financial", "STRONG", 35,
        "Sanction amount is more than 5 standard deviations above the comparable peer mean.", 0),
    "RULE_ACTUAL_ABOVE_SANCTION": (
        "ACTUAL_AMOUNT > SANCTION_AMOUNT", "Financial", "STRONG", 35,
        "Reported actual expenditure exceeds the sanctioned amount.", 0),
    "RULE_DISBURSED_ABOVE_SANCTION": (
        "TOTAL_FUND_DISBURSED_AMT > SANCTION_AMOUNT", "Financial", "STRONG", 35,
        "Total recorded disbursement exceeds the sanctioned amount.", 0),
    "RULE_HIGH_PAYMENT_COUNT": (
        "PAYMENT_COUNT >= 5", "Payment", "MODERATE", 10,
        "Work has at least 5 recorded payment transactions.", 0),
    "RULE_VERY_HIGH_PAYMENT_COUNT": (
        "PAYMENT_COUNT >= 10", "Payment", "STRONG", 20,
        "Work has at least 10 recorded payment transactions.", 0),
    "RULE_MULTIPLE_VENDORS": (
        "UNIQUE_VENDOR_COUNT >= 5", "Payment", "MODERATE", 10,
        "Work has payments associated with at least 5 vendors.", 0),
    "RULE_MANY_VENDORS": (
        "UNIQUE_VENDOR_COUNT >= 10", "Payment", "STRONG", 20,
        "Work has payments associated with at least 10 vendors.", 0),
    "RULE_HIGH_PAYMENT_FREQUENCY": (
        "PAYMENT_COUNT > 1 AND PAYMENTS_PER_30_DAYS > 3", "Payment", "MODERATE", 10,
        "Payment activity exceeds 3 recorded payments per 30 expenditure days.", 0),
    "RULE_VERY_HIGH_PAYMENT_FREQUENCY": (
        "PAYMENT_COUNT > 1 AND PAYMENTS_PER_30_DAYS > 6", "Payment", "STRONG", 20,
        "Payment activity exceeds 6 recorded payments per 30 expenditure days.", 0),
    "RULE_RECOMMENDATION_BEFORE_SANCTION_VIOLATION": (
        "RECOMMENDATION_TO_SANCTION_DAYS < 0", "Timeline", "STRONG", 30,
        "Recorded sanction date occurs before the recommendation date.", 0),
    "RULE_PAYMENT_BEFORE_SANCTION": (
        "SANCTION_TO_FIRST_PAYMENT_DAYS < 0", "Timeline", "STRONG", 30,
        "Recorded expenditure occurs before the sanction date.", 0),
    "RULE_COMPLETION_BEFORE_LAST_PAYMENT": (
        "COMPLETION_BEFORE_LAST_PAYMENT = 1", "Timeline", "VERIFY", 0,
        "Reported completion date precedes the last recorded payment; verify because the dates "
        "may represent different administrative events.", 1),
    "RULE_HIGH_IN_PROGRESS_RATIO": (
        "PAYMENT_IN_PROGRESS_RATIO > 0.5", "Payment Status", "WEAK", 5,
        "More than half of the recorded payment transactions are currently marked as in progress.", 0),
    "RULE_LOW_DATA_COMPLETENESS": (
        "DATA_COMPLETENESS_RATIO < 0.5", "Data Quality", "VERIFY", 0,
        "More than half of the selected analytical fields are missing; verify the underlying "
        "record.", 1),
}


def _texts(book: dict, keep=lambda r: True, name: bool = False) -> str:
    parts = ", ".join(
        f"CASE WHEN {n} = 1 THEN '{n if name else r[4]}' END" for n, r in book.items() if keep(r)
    )
    return f"concat_ws(' | ', {parts})"


def _points(names: list[str], book: dict) -> list[str]:
    return [f"{n} * {book[n][3]}" for n in names]


def _of(category: str, book: dict) -> list[str]:
    return [n for n, r in book.items() if r[1] == category and not r[5]]


def _severity(score: str) -> str:
    return (f"CASE WHEN {score} >= 60 THEN 'HIGH' WHEN {score} >= 30 THEN 'MEDIUM' "
            f"WHEN {score} > 0 THEN 'LOW' ELSE 'NONE' END")


relation("rules0", "SELECT *, " + ", ".join(
    f"{flag(r[0])} AS {n}" for n, r in RULES.items()) + " FROM feat")
relation("rules1", f"""
SELECT *, greatest({', '.join(_points(_of('Financial', RULES), RULES))}) AS RULE_FINANCIAL_SCORE,
  least({' + '.join(_points(_of('Payment', RULES), RULES))}, 30) AS RULE_PAYMENT_SCORE,
  greatest({', '.join(_points(_of('Timeline', RULES), RULES))}) AS RULE_TIMELINE_SCORE,
  RULE_HIGH_IN_PROGRESS_RATIO * 5 AS RULE_PAYMENT_STATUS_SCORE
FROM rules0
""")
relation("rules2", f"""
SELECT *, {flag('RULE_FINANCIAL_SCORE > 0')} + {flag('RULE_PAYMENT_SCORE > 0')}
  + {flag('RULE_TIMELINE_SCORE > 0')} AS RULE_CATEGORY_COUNT FROM rules1
""")
relation("rules3", """
SELECT *, CASE WHEN RULE_CATEGORY_COUNT >= 3 THEN 10 WHEN RULE_CATEGORY_COUNT >= 2 THEN 5 ELSE 0 END
  AS RULE_DIVERSITY_BONUS FROM rules2
""")
relation("rules4", """
SELECT *, least(RULE_FINANCIAL_SCORE + RULE_PAYMENT_SCORE + RULE_TIMELINE_SCORE
  + RULE_PAYMENT_STATUS_SCORE + RULE_DIVERSITY_BONUS, 100) AS RULE_SCORE FROM rules3
""")
relation("scored_rules", f"""
SELECT *, {_severity('RULE_SCORE')} AS RULE_SEVERITY, {' + '.join(RULES)} AS RULE_TRIGGER_COUNT,
  {' + '.join(n for n, r in RULES.items() if r[2] == 'STRONG')} AS STRONG_RULE_COUNT,
  {' + '.join(n for n, r in RULES.items() if r[5])} AS VERIFICATION_FLAG_COUNT,
  {flag('RULE_SCORE > 0')} AS RULE_CANDIDATE, {_texts(RULES, name=True)} AS RULE_FLAGS,
  {_texts(RULES)} AS RULE_REASONS, {_texts(RULES, lambda r: r[5])} AS RULE_VERIFICATION_NOTES
FROM rules4
""")

# --- statistics --------------------------------------------------------------------

relation("loo", """
SELECT a.WORK_ID, count(*) AS OTHERS,
  quantile_cont(CAST(b.SANCTION_AMOUNT AS DOUBLE), 0.25) AS Q1,
  quantile_cont(CAST(b.SANCTION_AMOUNT AS DOUBLE), 0.5) AS Q2,
  quantile_cont(CAST(b.SANCTION_AMOUNT AS DOUBLE), 0.75) AS Q3
FROM keyed a JOIN keyed b ON a.STATE_NAME = b.STATE_NAME AND a.WORK_CATEGORY = b.WORK_CATEGORY
  AND a.ACTIVITY_NAME = b.ACTIVITY_NAME AND a.WORK_ID <> b.WORK_ID
WHERE a.SANCTION_AMOUNT IS NOT NULL AND b.SANCTION_AMOUNT IS NOT NULL
GROUP BY a.WORK_ID HAVING count(*) >= 10
""")
relation("loo_mean", """
SELECT a.WORK_ID, CAST(sum(b.SANCTION_AMOUNT) AS DOUBLE) / count(b.SANCTION_AMOUNT) AS M
FROM keyed a JOIN keyed b ON a.STATE_NAME = b.STATE_NAME AND a.WORK_CATEGORY = b.WORK_CATEGORY
  AND a.ACTIVITY_NAME = b.ACTIVITY_NAME AND a.WORK_ID <> b.WORK_ID
GROUP BY a.WORK_ID HAVING count(b.SANCTION_AMOUNT) >= 10
""")
relation("limits", """
SELECT quantile_cont(CAST(PAYMENT_COUNT AS DOUBLE), 0.99) FILTER (WHERE PAYMENT_COUNT > 0) AS PAY_HI,
  quantile_cont(CAST(PAYMENT_COUNT AS DOUBLE), 0.995) FILTER (WHERE PAYMENT_COUNT > 0) AS PAY_X,
  quantile_cont(CAST(UNIQUE_VENDOR_COUNT AS DOUBLE), 0.99) FILTER (WHERE UNIQUE_VENDOR_COUNT > 0) AS VEN_HI,
  quantile_cont(CAST(UNIQUE_VENDOR_COUNT AS DOUBLE), 0.995) FILTER (WHERE UNIQUE_VENDOR_COUNT > 0) AS VEN_X,
  quantile_cont(PAYMENTS_PER_30_DAYS, 0.99) FILTER (WHERE PAYMENTS_PER_30_DAYS > 0) AS FREQ_HI,
  quantile_cont(PAYMENTS_PER_30_DAYS, 0.995) FILTER (WHERE PAYMENTS_PER_30_DAYS > 0) AS FREQ_X,
  quantile_cont(CAST(COMPLETION_DURATION_DAYS AS DOUBLE), 0.25)
    FILTER (WHERE COMPLETION_DURATION_DAYS >= 0) AS DUR_Q1,
  quantile_cont(CAST(COMPLETION_DURATION_DAYS AS DOUBLE), 0.75)
    FILTER (WHERE COMPLETION_DURATION_DAYS >= 0) AS DUR_Q3,
  quantile_cont(DATA_COMPLETENESS_RATIO, 0.10) AS COMP_LOW,
  count(*) FILTER (WHERE PAYMENT_COUNT > 0) AS PAY_N, count(*) FILTER (WHERE UNIQUE_VENDOR_COUNT > 0) AS VEN_N,
  count(*) FILTER (WHERE PAYMENTS_PER_30_DAYS > 0) AS FREQ_N,
  count(*) FILTER (WHERE COMPLETION_DURATION_DAYS >= 0) AS DUR_N, count(DATA_COMPLETENESS_RATIO) AS COMP_N
FROM feat
""")
relation("stats0", f"""
SELECT f.*, STATE_NAME || ' | ' || WORK_CATEGORY || ' | ' || ACTIVITY_NAME AS STAT_PEER_GROUP,
  PEER_COUNT AS STAT_PEER_COUNT, loo_mean.M AS STAT_LOO_PEER_MEAN_SANCTION, loo.Q1 AS STAT_PEER_Q1,
  loo.Q2 AS STAT_PEER_MEDIAN, loo.Q3 AS STAT_PEER_Q3, loo.Q3 - loo.Q1 AS STAT_PEER_IQR,
  CASE WHEN loo.Q2 > 0 THEN CAST(SANCTION_AMOUNT AS DOUBLE) / loo.Q2 END AS STAT_SANCTION_TO_PEER_MEDIAN
FROM feat f LEFT JOIN loo USING (WORK_ID) LEFT JOIN loo_mean USING (WORK_ID)
""")

_L = "(SELECT {} FROM limits)"


def _lim(c: str) -> str:
    return _L.format(c)


_IQR = "STAT_PEER_COUNT >= 10 AND STAT_PEER_IQR > 0 AND CAST(SANCTION_AMOUNT AS DOUBLE) > STAT_PEER_Q3 + {} * STAT_PEER_IQR"
_TAIL = "is in the extreme upper tail of the observed distribution."
_BEYOND = "is beyond the 99.5th percentile of the observed distribution."
# Signal name -> (condition, category, strength, points, wording, verify only).
SIGNALS = {
    "STAT_SANCTION_ABOVE_PEER_IQR": (
        _IQR.format(1.5), "Financial", "MODERATE", 20,
        "Sanction amount exceeds the robust 1.5×IQR upper boundary of comparable works.", 0),
    "STAT_SANCTION_EXTREME_PEER_IQR": (
        _IQR.format(3), "Financial", "STRONG", 35,
        "Sanction amount exceeds the robust 3×IQR upper boundary of comparable works.", 0),
    "STAT_SANCTION_ABOVE_5X_PEER_MEDIAN": (
        "STAT_PEER_COUNT >= 10 AND STAT_SANCTION_TO_PEER_MEDIAN > 5", "Financial", "STRONG", 35,
        "Sanction amount is more than 5x the leave-one-out peer median.", 0),
    "STAT_PAYMENT_COUNT_OUTLIER": (
        f"PAYMENT_COUNT > {_lim('PAY_HI')} AND PAYMENT_COUNT > 1", "Payment Behavior", "MODERATE", 10,
        f"Payment transaction count {_TAIL}", 0),
    "STAT_PAYMENT_COUNT_EXTREME": (
        f"PAYMENT_COUNT > {_lim('PAY_X')} AND PAYMENT_COUNT > 1", "Payment Behavior", "STRONG", 20,
        f"Payment transaction count {_BEYOND}", 0),
    "STAT_VENDOR_COUNT_OUTLIER": (
        f"UNIQUE_VENDOR_COUNT > {_lim('VEN_HI')} AND UNIQUE_VENDOR_COUNT > 1", "Payment Behavior",
        "MODERATE", 10, f"Unique vendor count {_TAIL}", 0),
    "STAT_VENDOR_COUNT_EXTREME": (
        f"UNIQUE_VENDOR_COUNT > {_lim('VEN_X')} AND UNIQUE_VENDOR_COUNT > 1", "Payment Behavior",
        "STRONG", 20, f"Unique vendor count {_BEYOND}", 0),
    "STAT_PAYMENT_FREQUENCY_OUTLIER": (
        f"PAYMENTS_PER_30_DAYS > {_lim('FREQ_HI')} AND PAYMENT_COUNT > 1", "Payment Behavior",
        "MODERATE", 10, f"Payment frequency {_TAIL}", 0),
    "STAT_PAYMENT_FREQUENCY_EXTREME": (
        f"PAYMENTS_PER_30_DAYS > {_lim('FREQ_X')} AND PAYMENT_COUNT > 1", "Payment Behavior",
        "STRONG", 20, f"Payment frequency {_BEYOND}", 0),
    "STAT_COMPLETION_DURATION_OUTLIER": (
        f"COMPLETION_DURATION_DAYS > {_lim('DUR_Q3 + 1.5 * (DUR_Q3 - DUR_Q1)')}", "Timeline",
        "MODERATE", 10, "Completion duration is above the robust 1.5×IQR upper boundary.", 0),
    "STAT_COMPLETION_DURATION_EXTREME": (
        f"COMPLETION_DURATION_DAYS > {_lim('DUR_Q3 + 3 * (DUR_Q3 - DUR_Q1)')}", "Timeline",
        "STRONG", 20, "Completion duration is above the robust 3×IQR upper boundary.", 0),
    "STAT_LOW_DATA_COMPLETENESS": (
        f"DATA_COMPLETENESS_RATIO <= {_lim('COMP_LOW')}", "Data Quality", "VERIFY", 0,
        "Data completeness is within the lowest 10% of the observed dataset; verify source "
        "completeness.", 1),
}


def _sub(part: str) -> str:
    return f"greatest(STAT_{part}_OUTLIER * 10, STAT_{part}_EXTREME * 20)"


_SUBS = [_sub("PAYMENT_COUNT"), _sub("VENDOR_COUNT"), _sub("PAYMENT_FREQUENCY")]
relation("stats1", "SELECT *, " + ", ".join(
    f"{flag(r[0])} AS {n}" for n, r in SIGNALS.items()) + " FROM stats0")
relation("stats2", f"""
SELECT *, greatest({', '.join(_points(_of('Financial', SIGNALS), SIGNALS))}) AS STAT_FINANCIAL_SCORE,
  greatest(STAT_COMPLETION_DURATION_OUTLIER * 10, STAT_COMPLETION_DURATION_EXTREME * 20)
    AS STAT_TIMELINE_SCORE,
  {' + '.join(flag(s + ' > 0') for s in _SUBS)} AS STAT_PAYMENT_SUBSIGNAL_COUNT,
  greatest({', '.join(_SUBS)}) AS PAY_BASE
FROM stats1
""")
relation("stats3", """
SELECT *, CASE WHEN STAT_PAYMENT_SUBSIGNAL_COUNT >= 3 THEN 5 WHEN STAT_PAYMENT_SUBSIGNAL_COUNT >= 2
  THEN 3 ELSE 0 END AS STAT_PAYMENT_CORROBORATION_BONUS FROM stats2
""")
relation("stats4", """
SELECT *, least(PAY_BASE + STAT_PAYMENT_CORROBORATION_BONUS, 35) AS STAT_PAYMENT_BEHAVIOR_SCORE FROM stats3
""")
_AREAS = ("STAT_FINANCIAL_SCORE", "STAT_PAYMENT_BEHAVIOR_SCORE", "STAT_TIMELINE_SCORE")
relation("stats5", f"SELECT *, {' + '.join(flag(a + ' > 0') for a in _AREAS)} AS STAT_CATEGORY_COUNT FROM stats4")
relation("stats6", """
SELECT *, CASE WHEN STAT_CATEGORY_COUNT >= 3 THEN 10 WHEN STAT_CATEGORY_COUNT >= 2 THEN 5 ELSE 0 END
  AS STAT_DIVERSITY_BONUS FROM stats5
""")
relation("stats7", f"SELECT *, least({' + '.join(_AREAS)} + STAT_DIVERSITY_BONUS, 100) AS STAT_SCORE FROM stats6")
relation("scored_stats", f"""
SELECT *, {_severity('STAT_SCORE')} AS STAT_SEVERITY, {' + '.join(SIGNALS)} AS STAT_TRIGGER_COUNT,
  {' + '.join(flag(a + ' >= 20') for a in _AREAS)} AS STAT_STRONG_RULE_COUNT,
  STAT_LOW_DATA_COMPLETENESS AS STAT_VERIFICATION_FLAG_COUNT, {flag('STAT_SCORE > 0')} AS STAT_CANDIDATE,
  {_texts(SIGNALS, name=True)} AS STAT_FLAGS, {_texts(SIGNALS, lambda r: not r[5])} AS STAT_REASONS,
  {_texts(SIGNALS, lambda r: r[5])} AS STAT_VERIFICATION_NOTES
FROM stats7
""")

# --- fusion ------------------------------------------------------------------------
# The forest's percentile cannot be written in SQL; the checked fusion uses the
# percentile rank of the disbursed total in its place.

relation("proxy0", """
SELECT WORK_ID, coalesce(CAST(TOTAL_FUND_DISBURSED_AMT AS DOUBLE), 0) AS S FROM fin
""")
relation("proxy", """
SELECT WORK_ID, S, (rank() OVER (ORDER BY S) - 1 + (count(*) OVER (PARTITION BY S) + 1) / 2e0)
  / count(*) OVER () * 100e0 AS ML_PERCENTILE FROM proxy0
""")
relation("ml", """
SELECT WORK_ID, S AS ML_ANOMALY_STRENGTH, ML_PERCENTILE,
  CASE WHEN ML_PERCENTILE >= 97.5 THEN 1 ELSE 0 END AS ML_ANOMALY,
  CASE WHEN ML_PERCENTILE >= 99 THEN 'HIGH' WHEN ML_PERCENTILE >= 97.5 THEN 'MEDIUM'
       WHEN ML_PERCENTILE >= 95 THEN 'LOW' ELSE 'NONE' END AS ML_SEVERITY FROM proxy
""")
relation("rule_rank", """
SELECT WORK_ID, (rank() OVER (ORDER BY RULE_SCORE) - 1 + (count(*) OVER (PARTITION BY RULE_SCORE) + 1) / 2e0)
  / count(*) OVER () * 100e0 AS R FROM scored_rules WHERE RULE_CANDIDATE = 1
""")
relation("stat_rank", """
SELECT WORK_ID, (rank() OVER (ORDER BY STAT_SCORE) - 1 + (count(*) OVER (PARTITION BY STAT_SCORE) + 1) / 2e0)
  / count(*) OVER () * 100e0 AS R FROM scored_stats WHERE STAT_CANDIDATE = 1
""")
relation("hyb0", f"""
SELECT f.*, r.RULE_SCORE, r.RULE_SEVERITY, r.RULE_CANDIDATE, r.STRONG_RULE_COUNT, s.STAT_SCORE,
  s.STAT_SEVERITY, s.STAT_CANDIDATE, m.ML_PERCENTILE, m.ML_SEVERITY, m.ML_ANOMALY,
  m.ML_ANOMALY AS ML_CANDIDATE, m.ML_ANOMALY_STRENGTH,
  coalesce(rr.R, 0) AS RULE_SCORE_CALIBRATED, coalesce(sr.R, 0) AS STAT_SCORE_CALIBRATED,
  m.ML_PERCENTILE AS ML_SCORE_CALIBRATED, {flag('f.PEER_COUNT >= 10')} AS PEER_DATA_SUFFICIENT,
  CASE WHEN f.MISSING_FIELD_COUNT = 0 THEN 'HIGH' WHEN f.MISSING_FIELD_COUNT = 1 THEN 'MEDIUM' ELSE 'LOW' END
    AS DATA_QUALITY_TIER,
  r.RULE_CANDIDATE + s.STAT_CANDIDATE + m.ML_ANOMALY AS INDEPENDENT_SIGNAL_COUNT
FROM feat f JOIN scored_rules r USING (WORK_ID) JOIN scored_stats s USING (WORK_ID) JOIN ml m USING (WORK_ID)
  LEFT JOIN rule_rank rr USING (WORK_ID) LEFT JOIN stat_rank sr USING (WORK_ID)
""")
relation("hyb1", """
SELECT *, CASE WHEN PEER_DATA_SUFFICIENT = 1 THEN 'STANDARD' ELSE 'SPARSE_PEER' END AS SCORE_REGIME,
  round_even(RULE_SCORE_CALIBRATED * 0.35e0 * 100e0, 0) / 100e0 AS RULE_COMPONENT,
  CASE WHEN PEER_DATA_SUFFICIENT = 1
       THEN round_even(STAT_SCORE_CALIBRATED * 0.35e0 * 100e0, 0) / 100e0 ELSE 0e0 END AS STAT_COMPONENT,
  round_even(ML_SCORE_CALIBRATED * 0.30e0 * 100e0, 0) / 100e0 AS ML_COMPONENT,
  CASE WHEN INDEPENDENT_SIGNAL_COUNT >= 3 THEN 10e0 WHEN INDEPENDENT_SIGNAL_COUNT >= 2 THEN 5e0 ELSE 0e0 END
    AS AGREEMENT_BONUS
FROM hyb0
""")
relation("hyb2", """
SELECT *, round_even(least(RULE_COMPONENT + STAT_COMPONENT + ML_COMPONENT + AGREEMENT_BONUS, 100e0) * 10e0, 0)
  / 10e0 AS HYBRID_RISK_SCORE FROM hyb1
""")


def _tier(*labels: str) -> str:
    return (f"CASE WHEN INDEPENDENT_SIGNAL_COUNT = 3 OR HYBRID_RISK_SCORE >= 90.4e0 THEN '{labels[0]}' "
            f"WHEN HYBRID_RISK_SCORE >= 56.5e0 THEN '{labels[1]}' WHEN HYBRID_RISK_SCORE >= 35e0 "
            f"THEN '{labels[2]}' WHEN HYBRID_RISK_SCORE > 0 THEN '{labels[3]}' ELSE '{labels[4]}' END")


relation("hyb", f"""
SELECT *, {_tier('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NONE')} AS HYBRID_RISK_LEVEL,
  {_tier('P1', 'P2', 'P3', 'P4', 'P0')} AS INVESTIGATION_PRIORITY,
  CASE INDEPENDENT_SIGNAL_COUNT WHEN 3 THEN 'RULE + STATISTICAL + ML' WHEN 2 THEN 'TWO METHODS AGREE'
       WHEN 1 THEN 'ONE METHOD' ELSE 'NO SIGNAL' END AS DETECTOR_AGREEMENT,
  concat_ws(' + ', CASE WHEN RULE_CANDIDATE = 1 THEN 'RULE' END,
    CASE WHEN STAT_CANDIDATE = 1 THEN 'STATISTICAL' END, CASE WHEN ML_CANDIDATE = 1 THEN 'ML' END)
    AS DETECTOR_SET,
  {flag('INDEPENDENT_SIGNAL_COUNT > 0')} AS INVESTIGATION_CANDIDATE
FROM hyb2
""")

# --- evidence ------------------------------------------------------------------------


def _say(c: str, label: str, render, cond: str = "") -> str:
    test = f"{c} IS NOT NULL" + (f" AND {cond}" if cond else "")
    return f"CASE WHEN {test} THEN '{label}: ' || {render(c)} || '.' END"


def _plain(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


_FACTS = ", ".join([
    _say("RECOMMENDED_AMOUNT", "Recommended amount", money),
    _say("SANCTION_AMOUNT", "Sanction amount", money),
    _say("ACTUAL_AMOUNT", "Reported actual expenditure", money),
    _say("TOTAL_FUND_DISBURSED_AMT", "Recorded fund disbursement", money),
    _say("ACTUAL_TO_SANCTION_RATIO", "Actual-to-sanction ratio", percent),
    _say("DISBURSED_TO_SANCTION_RATIO", "Disbursed-to-sanction ratio", percent),
    _say("PAYMENT_COUNT", "Payment transaction count", number),
    _say("UNIQUE_VENDOR_COUNT", "Unique vendor count", number),
    _say("PAYMENT_SUCCESS_COUNT", "Successful payment count", number),
    _say("PAYMENT_IN_PROGRESS_COUNT", "In-progress payment count", number),
    _say("PAYMENTS_PER_30_DAYS", "Payments per 30 days", number),
    _say("PAYMENTS_PER_100_DAYS", "Payments per 100 days", number),
    _say("RECOMMENDATION_DATE", "Recommendation date", _plain),
    _say("SANCTION_DATE", "Sanction date", _plain),
    _say("FIRST_EXPENDITURE_DATE", "First recorded payment date", _plain),
    _say("ACTUAL_END_DATE", "Reported completion date", _plain),
    _say("LAST_EXPENDITURE_DATE", "Last recorded payment date", _plain),
    _say("COMPLETION_DURATION_DAYS", "Reported completion duration", day_count),
    "CASE WHEN PAYMENT_AFTER_REPORTED_COMPLETION_DAYS > 0 THEN 'Recorded payment activity occurred ' || "
    + day_count("PAYMENT_AFTER_REPORTED_COMPLETION_DAYS") + " || ' after reported completion.' END",
    _say("PEER_COUNT", "Peer-group size used by the feature set", number),
    _say("PEER_MEDIAN_SANCTION", "Peer median sanction amount", money, "PEER_COUNT >= 10"),
    _say("PEER_MEAN_SANCTION", "Peer mean sanction amount", money, "PEER_COUNT >= 10"),
    _say("SANCTION_PEER_Z_SCORE", "Sanction peer z-score", number, "PEER_COUNT >= 10"),
    _say("DATA_COMPLETENESS_RATIO", "Recorded data completeness", percent),
    _say("MISSING_FIELD_COUNT", "Missing-field count", number),
    "CASE WHEN ATTACH_ID IS NOT NULL THEN 'Attachment identifier is present.' "
    "ELSE 'Attachment identifier is not present in the available record.' END",
    _say("FILE_STATUS", "File status", _plain),
])
_CHECKS = [
    ("PAYMENT_COUNT >= 5", "Verify the individual payment transactions and supporting payment records."),
    ("UNIQUE_VENDOR_COUNT >= 5",
     "Verify vendor identities, work orders, and supporting procurement records."),
    ("PAYMENT_AFTER_REPORTED_COMPLETION_DAYS > 0",
     "Verify the reported completion date against payment and measurement records."),
    ("ACTUAL_TO_SANCTION_RATIO > 1",
     "Verify reported actual expenditure against the sanctioned amount."),
    ("DISBURSED_TO_SANCTION_RATIO > 1", "Verify recorded disbursement against the sanctioned amount."),
    ("PEER_COUNT < 10", "Peer comparison is weak because fewer than 10 comparable works are available."),
    ("DATA_COMPLETENESS_RATIO < 0.60",
     "Verify missing source fields before drawing strong conclusions from this record."),
    ("TRUE", "Confirm findings against original government records and supporting documents."),
]


def _numbered() -> str:
    parts, before = [], "0"
    for cond, text in _CHECKS:
        parts.append(f"CASE WHEN {cond} THEN CAST({before} + 1 AS VARCHAR) || '. {text}' END")
        before = f"{before} + CASE WHEN {cond} THEN 1 ELSE 0 END"
    return f"concat_ws(' ', {', '.join(parts)})"


relation("queue", f"""
SELECT *, {ratio('RECOMMENDED_AMOUNT', 'SANCTION_AMOUNT')} AS RECOMMENDED_TO_SANCTION_RATIO,
  {ratio('SANCTION_AMOUNT', 'PEER_MEDIAN_SANCTION')} AS SANCTION_TO_PEER_MEDIAN_CALCULATED,
  concat_ws(' ', {_FACTS}) AS FACTUAL_EVIDENCE, {_numbered()} AS VERIFICATION_FLAGS,
  concat_ws('; ',
    CASE WHEN RULE_CANDIDATE = 1 THEN 'Rule detector produced a candidate signal with score '
      || format('{{:.1f}}', CAST(RULE_SCORE AS DOUBLE)) END,
    CASE WHEN STAT_CANDIDATE = 1 THEN 'Statistical detector produced a candidate signal with score '
      || format('{{:.1f}}', CAST(STAT_SCORE AS DOUBLE)) END,
    CASE WHEN ML_CANDIDATE = 1 THEN 'Isolation Forest produced an ML anomaly signal at the '
      || format('{{:.2f}}', ML_PERCENTILE) || 'th percentile' END) || '.' AS DETECTOR_EVIDENCE,
  STATE_NAME || ' | ' || CONSTITUENCY || ' | MP: ' || MP_NAME || '. Hybrid risk level: '
    || HYBRID_RISK_LEVEL || '; hybrid score: ' || {number('HYBRID_RISK_SCORE')}
    || '; detector agreement: ' || DETECTOR_AGREEMENT || '. This record is an investigation candidate '
    || 'requiring verification, not a finding of fraud or corruption.' AS INVESTIGATION_SUMMARY,
  FIRST_EXPENDITURE_DATE AS FIRST_PAYMENT_DATE, LAST_EXPENDITURE_DATE AS LAST_PAYMENT_DATE,
  ACTUAL_END_DATE AS COMPLETION_DATE, DATA_COMPLETENESS_RATIO AS DATA_COMPLETENESS
FROM hyb WHERE INVESTIGATION_CANDIDATE = 1
""")
