"""Null-safe numeric, date and flag expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Date layouts found in landed records and the shape of each.
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    "dd-MMM-yyyy": r"^\d{2}-[A-Za-z]{3}-\d{4}$",
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
}


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_numeric(c: ColumnLike) -> Column:
    """Text to double; anything that is not a finite number becomes NULL."""
    value = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def clean_money(c: ColumnLike) -> Column:
    return F.trim(col(c).cast("string")).try_cast("decimal(18,2)")


def clean_id(c: ColumnLike) -> Column:
    """Work ids arrive as ``209175`` or ``209175.0``."""
    return clean_numeric(c).cast("bigint")


def clean_date(c: ColumnLike, formats: Mapping[str, str] = DATE_FORMATS) -> Column:
    """Text to date by its explicit layout; unreadable text becomes NULL.

    The shape picks the layout, so a value is parsed once and a wrong layout
    never costs a failed parse.
    """
    text = F.trim(col(c).cast("string"))
    out = F.lit(None).cast("date")
    for layout, shape in formats.items():
        parsed = F.try_to_timestamp(text, F.lit(layout)).cast("date")
        out = F.when(text.rlike(shape), parsed).otherwise(out)
    return out


def clean_text(c: ColumnLike) -> Column:
    """Trimmed text; blanks and the words nan/none/null count as missing."""
    text = F.trim(col(c).cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)


def finite(c: ColumnLike) -> Column:
    return F.when(F.abs(col(c)) != float("inf"), col(c))


def peer_label(c: ColumnLike, missing: str = "UNKNOWN") -> Column:
    return F.trim(F.coalesce(col(c).cast("string"), F.lit(missing)))


def strip_activity_prefix(c: ColumnLike) -> Column:
    """Drop the ``WS/<mp>/<year>/<id>-`` prefix that makes activities unique."""
    return F.regexp_replace(col(c), r"^WS/[^/]+/[^/]+/\d+-", "")


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """``num / den`` where the denominator is positive, else NULL."""
    d = col(den).cast("double")
    return F.when(d > 0, col(num).cast("double") / d)


def days(start: ColumnLike, end: ColumnLike) -> Column:
    return F.datediff(col(end), col(start))


def flag(condition: Column) -> Column:
    """Boolean to 0/1 where an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def round_even(c: ColumnLike, places: int) -> Column:
    """Round half to even on the scaled double."""
    scale = float(10**places)
    return F.rint(col(c).cast("double") * scale) / scale


def missing_count(columns: Iterable[ColumnLike]) -> Column:
    parts = [col(c).isNull().cast("int") for c in columns]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def log_amount(c: ColumnLike) -> Column:
    value = col(c).cast("double")
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def total(columns: Iterable[Column]) -> Column:
    result = F.lit(0)
    for c in columns:
        result = result + c
    return result


def name_key(c: ColumnLike) -> Column:
    """Lookup key that ignores case, punctuation and the &/and spelling."""
    return F.regexp_replace(F.replace(F.lower(col(c)), F.lit("&"), F.lit("and")), "[^a-z0-9]", "")
