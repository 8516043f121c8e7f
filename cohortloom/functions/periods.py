"""Period texts, months and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Six-digit month formats: the shape of a valid text, and where month and year start in it.
_SIX_DIGITS = {
    "MMyyyy": ("^(0[1-9]|1[0-2])(?!0000)[0-9]{4}$", 1, 3),
    "yyyyMM": ("^(?!0000)[0-9]{4}(0[1-9]|1[0-2])$", 5, 1),
}


def is_period(col: Column, fmt: str = "MMyyyy") -> Column:
    """Whether a text names a period.

    For the six-digit formats this looks at the text once, which matters in a
    filter: Spark evaluates a filter and the projection after it separately.
    """
    if fmt in _SIX_DIGITS:
        return F.coalesce(col.rlike(_SIX_DIGITS[fmt][0]), F.lit(False))
    return parse_period(col, fmt).isNotNull()


def parse_period(col: Column, fmt: str = "MMyyyy") -> Column:
    """First day of the period named by a text, NULL for anything malformed."""
    if fmt not in _SIX_DIGITS:
        return F.try_to_date(col, fmt).cast("timestamp_ntz")
    return F.when(col.rlike(_SIX_DIGITS[fmt][0]), _first_day(col, fmt)).cast("timestamp_ntz")


def valid_period(col: Column, fmt: str = "MMyyyy") -> Column:
    """`parse_period` for rows that passed `is_period`: the text is not matched again."""
    if fmt not in _SIX_DIGITS:
        return parse_period(col, fmt)
    return _first_day(col, fmt).cast("timestamp_ntz")


def _first_day(col: Column, fmt: str) -> Column:
    _, month_at, year_at = _SIX_DIGITS[fmt]
    month = F.substring(col, month_at, 2).try_cast("int")
    year = F.substring(col, year_at, 4).try_cast("int")
    return F.make_date(year, month, F.lit(1))


def yyyymm(col: Column) -> Column:
    """A date or timestamp as the integer YYYYMM."""
    return F.year(col) * 100 + F.month(col)


def month_start(col: Column) -> Column:
    return F.trunc(col.cast("date"), "month").cast("timestamp_ntz")
