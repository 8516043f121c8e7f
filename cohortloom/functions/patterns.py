"""Text classes that column profiling looks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text classes of the column profile.
NUMERIC = r"^-?\d+(\.\d+)?$"
SIX_DIGITS = r"^\d{6}$"
SHORT_CODE = r"^[A-Z0-9]{1,3}$"

# The text classes of the field profile.
YEAR_MONTH = r"^[0-9]{6}$"
TERMINATION_STRICT = r"^(0[1-9]|1[5-6]|0[2-3]|09|96)$"

# The looser classes used to confirm code fields.
DELINQUENCY = r"^(0|[1-9][0-9]{0,2}|R|XX)$"
TERMINATION = r"^(0?1|0?2|0?3|0?9|15|16|96)$"


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also where it is NULL)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def match_ratio(col: Column, pattern: str) -> Column:
    """Share of the rows whose text matches; NULL counts as no match."""
    return F.avg(flag(col.cast("string").rlike(pattern)))
