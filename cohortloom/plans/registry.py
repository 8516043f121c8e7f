"""Collects query functions and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name."""

        def add(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return add


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison between engines.

    Two engines add doubles in different orders, so a mean that lies exactly
    between two decimals may fall on either side. A shift of a thousandth of
    the last digit, the same in both engines, moves such values off the tie.
    """
    x = F.col(col) if isinstance(col, str) else col
    return F.round(x.cast("double") + F.lit(10.0 ** -(digits + 3)), digits)


def rounded_sql(expression: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE) + 1e-{digits + 3}, {digits})"
