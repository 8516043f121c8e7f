"""Missing values and tolerant casts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Texts that mean "missing".
NULL_TOKENS = ("", "NA", "NULL", "null")
MISSING_SENTINELS = ("", "nan", "<NA>")


def is_blank(col: Column) -> Column:
    """True for NULL and for the empty text; never NULL."""
    return col.isNull() | (col == F.lit(""))


def tokens_to_null(col: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    return F.when(~col.isin(*tokens), col)


def _not_nan(number: Column) -> Column:
    return F.nanvl(number, F.lit(None).cast("double"))


def to_double(col: Column) -> Column:
    """Number in a text, NULL when it is not one; never NaN, never an error.

    Spark's cast also reads Java literals such as `1d` and `1.5f`; these are
    texts here, not numbers. (`inf` is a number that ends in a letter.)
    """
    text = F.trim(col.cast("string"))
    java_literal = F.substring(text, -1, 1).isin("d", "D", "f", "F")
    infinite = F.lower(text).endswith("inf")
    return _not_nan(F.when(~java_literal | infinite, text).try_cast("double"))


def to_int(col: Column) -> Column:
    """Whole number in a text, fractions rounded half away from zero."""
    return F.round(to_double(col)).try_cast("int")


def double_of(df: DataFrame, name: str) -> Column:
    """A column as a number: parsed from a text, cast (never by way of a text) from a number."""
    col = F.col(name)
    if not isinstance(df.schema[name].dataType, NumericType):
        return to_double(col)
    return _not_nan(col.cast("double"))


def int_of(df: DataFrame, name: str) -> Column:
    return F.round(double_of(df, name)).try_cast("int")
