"""Numeric expressions and small aggregate expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1073741824


def drawdown_ratio(high: Column, low: Column) -> Column:
    """(high - low) / high, NULL unless high is positive."""
    return F.when(high > 0, (high - low) / high)


def zscore(x: Column, mu: Column, sd: Column) -> Column:
    """Standard score; a missing value scores as the mean, a constant column as 0."""
    return F.when(sd.isNull() | (sd == 0), F.lit(0.0)).otherwise((F.coalesce(x, mu) - mu) / sd)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def vector_norm(columns: list[Column]) -> Column:
    """Euclidean length over columns; a NULL counts as 0."""
    return F.sqrt(total([F.coalesce(c * c, F.lit(0.0)) for c in columns]))


def linear_combination(columns: list[Column], weights: list[float]) -> Column:
    return total([c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])


def pair_correlation(x: Column, y: Column, min_rows: int = 2) -> Column:
    """Pearson correlation over the rows where both are present.

    NULL when fewer than `min_rows` such rows exist or a side is constant
    there (Spark's own `corr` raises an error for a constant side).
    """
    both = x.isNotNull() & y.isNotNull()
    spread_x = F.stddev_pop(F.when(both, x))
    spread_y = F.stddev_pop(F.when(both, y))
    enough = F.count(F.when(both, F.lit(1))) >= min_rows
    varied = (spread_x > 0) & (spread_y > 0)
    return F.when(enough & varied, F.covar_pop(x, y) / (spread_x * spread_y))


def to_gib(size: Column) -> Column:
    return F.round(size / F.lit(GIB), 2)
