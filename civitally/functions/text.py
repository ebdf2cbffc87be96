"""Text rendering, reason lists and JSON fields."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import ColumnLike, col

MISSING = "Not available"


def money(c: ColumnLike, places: int = 2) -> Column:
    """``₹1,234.50``, or ``Not available``."""
    text = F.format_number(col(c).cast("double"), places)
    return F.coalesce(F.concat(F.lit("₹"), text), F.lit(MISSING))


def number(c: ColumnLike) -> Column:
    """Whole numbers without decimals, others with two."""
    x = col(c).cast("double")
    return F.when(x.isNull(), MISSING).when(x == F.floor(x), F.format_number(x, 0)).otherwise(
        F.format_number(x, 2)
    )


def day_count(c: ColumnLike) -> Column:
    text = F.format_number(col(c).cast("double"), 0)
    return F.coalesce(F.concat(text, F.lit(" days")), F.lit(MISSING))


def percent(c: ColumnLike) -> Column:
    """One decimal; fractions 0..1 are scaled by 100, larger values are not."""
    x = col(c).cast("double")
    scaled = F.when(x.between(0.0, 1.0), x * 100.0).otherwise(x)
    return F.coalesce(F.concat(fixed(scaled, 1), F.lit("%")), F.lit(MISSING))


def fixed(c: ColumnLike, places: int) -> Column:
    """Fixed decimals without thousands separators."""
    return F.replace(F.format_number(col(c).cast("double"), places), F.lit(","), F.lit(""))


def when_present(c: ColumnLike, *parts: Column | str) -> Column:
    """Concatenated sentence, NULL (and so skipped by concat_ws) if ``c`` is."""
    pieces = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.when(col(c).isNotNull(), F.concat(*pieces))


def joined(separator: str, items: Iterable[tuple[Column, str]]) -> Column:
    """Texts of the conditions that hold, in the given order."""
    return F.concat_ws(separator, *[F.when(cond, F.lit(text)) for cond, text in items])


def numbered(items: Sequence[Column]) -> Column:
    """Distinct non-null texts as ``1. a 2. b``."""
    kept = F.array_distinct(F.array_compact(F.array(*items)))
    lines = F.transform(
        kept, lambda text, i: F.concat((i + 1).cast("string"), F.lit(". "), text)
    )
    return F.array_join(lines, " ")


def group_label(columns: Iterable[ColumnLike]) -> Column:
    return F.concat_ws(" | ", *[col(c) for c in columns])


def answer_json(c: ColumnLike) -> Column:
    """Outermost ``{...}`` of a reviewer answer, code fences removed."""
    text = F.trim(col(c))
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(body != "", body).otherwise(text)


def json_list(c: ColumnLike) -> Column:
    """JSON array of texts in a cell; missing or malformed cells give []."""
    parsed = F.from_json(col(c), "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def fingerprint(*columns: ColumnLike) -> Column:
    """SHA-256 of the JSON form of the given fields."""
    return F.sha2(F.to_json(F.struct(*[col(c) for c in columns])), 256)
