"""One aggregate over many columns, returned as one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Stat = Callable[[str], Column]

# A table of at most this many collected rows may be sent to every task.
MAX_BROADCAST_ROWS = 4096


def broadcast_rows(
    df: DataFrame, rows: Sequence[Row | tuple], schema: StructType | str
) -> DataFrame:
    """Collected rows as a table for joins with `df`; broadcast while they are few.

    Spark does not know the size of such a table and might shuffle the large
    side by a key with few values. Their number is known here, so the hint is
    safe; above the limit the join is left to Spark.
    """
    table = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST_ROWS else table


def tidy_aggregate(
    df: DataFrame,
    columns: Sequence[str],
    stats: dict[str, Stat],
    key: str = "feature",
    by: Sequence[str] = (),
) -> DataFrame:
    """Statistics of every column in a single pass, as rows `(by..., key, stats...)`.

    A scan per column would read the table as often as it has columns; here
    the plan has one scan, one partial and one final aggregate.
    """
    per_column = [
        F.struct(F.lit(c).alias(key), *[stat(c).alias(name) for name, stat in stats.items()])
        for c in columns
    ]
    grouped = df.groupBy(*by).agg(F.array(*per_column).alias("_rows"))
    return grouped.select(*by, F.inline("_rows"))


def melt(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    key: str = "feature",
    value: str = "value",
    dtype: str = "double",
) -> DataFrame:
    """Columns to rows `(keep..., key, value)`, all values of one type."""
    cells = [
        F.struct(F.lit(c).alias(key), F.col(f"`{c}`").cast(dtype).alias(value)) for c in columns
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


def value_frequencies(df: DataFrame, columns: Sequence[str], key: str = "col") -> DataFrame:
    """How often each different value (as text) occurs in each column, NULL included.

    The counts are combined before the shuffle, so a value that fills a third
    of a column crosses the network once per task.
    """
    long = melt(df, columns, key=key, dtype="string")
    return long.groupBy(key, "value").agg(F.count("*").alias("n"))
