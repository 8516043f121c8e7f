"""Names of columns and features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_with_prefix(df: DataFrame, prefixes: str | Iterable[str]) -> list[str]:
    wanted = (prefixes,) if isinstance(prefixes, str) else tuple(prefixes)
    return [c for c in df.columns if c.startswith(wanted)]


def feature_family(feature: Column) -> Column:
    """`mean_num_price` -> `mean`."""
    return F.split(feature, "_")[0]


def feature_base(feature: Column) -> Column:
    """`mean_num_price` -> `price`; NULL when the name has no such shape."""
    found = F.regexp_extract(feature, "^[a-z]+_(?:num|cat|txt)_(.+)$", 1)
    return F.when(found != "", found)


def distinct_tokens(text: Column, pattern: str) -> Column:
    """All different matches of a pattern in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
