"""Data-quality reports and plain counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import is_blank
from cohortloom.functions.periods import month_start, parse_period
from cohortloom.operators.tidy import tidy_aggregate


def distinct_count(col: Column | str, exact: bool) -> Column:
    return F.count_distinct(col) if exact else F.approx_count_distinct(col)


def partition_quality(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    period: str,
    period_format: str = "MMyyyy",
    exact: bool = False,
) -> DataFrame:
    """Per partition: rows, entities, period range, blank keys and blank periods."""
    parsed = parse_period(F.col(period), period_format)
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("n_rows"),
            distinct_count(entity, exact).alias("n_entities"),
            F.min(parsed).alias("min_period"),
            F.max(parsed).alias("max_period"),
            F.count_if(is_blank(F.col(entity))).alias("null_entity"),
            F.count_if(is_blank(F.col(period))).alias("null_period"),
        )
        .orderBy(*keys)
    )


def coverage(
    df: DataFrame, entity: str, period: str, period_format: str = "MMyyyy", exact: bool = False
) -> DataFrame:
    parsed = parse_period(F.col(period), period_format)
    return df.agg(
        F.count("*").alias("n_rows"),
        distinct_count(entity, exact).alias("n_entities"),
        F.min(parsed).alias("min_period"),
        F.max(parsed).alias("max_period"),
    )


def duplicate_keys(
    df: DataFrame, keys: Sequence[str], pair: Sequence[str], exact: bool = False
) -> DataFrame:
    """Per partition: rows, different key pairs, and the surplus. A NULL part makes no pair."""
    joined = reduce(
        lambda a, b: F.concat(a, F.lit("|"), b), [F.col(c).cast("string") for c in pair]
    )
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n_rows"), distinct_count(joined, exact).alias("n_pairs"))
        .withColumn("n_duplicates", F.col("n_rows") - F.col("n_pairs"))
        .orderBy(*keys)
    )


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of NULL or empty values per column over all rows, worst first."""
    columns = list(columns or df.columns)

    def ratio(c: str) -> Column:
        return F.avg(F.when(is_blank(F.col(f"`{c}`").cast("string")), 1.0).otherwise(0.0))

    return tidy_aggregate(df, columns, {"null_ratio": ratio}, key="col").orderBy(
        F.desc("null_ratio"), "col"
    )


def value_counts(
    df: DataFrame, column: str, k: int | None = 30, include_null: bool = True
) -> DataFrame:
    """Values of a column with their counts, most frequent first; NULL is a value too."""
    rows = df if include_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return ordered if k is None else ordered.limit(k)


def heavy_hitters(
    df: DataFrame, column: str, k: int = 30, buckets: int = 1 << 16, probes: int = 256
) -> DataFrame:
    """`value_counts` of the k most frequent values, without shuffling all different values.

    Every value belongs to a bucket by its hash, and occurs at most as often as
    its bucket holds rows. One pass counts the buckets (a fixed number of
    counters per task). The values of the `probes` fullest buckets are counted;
    the k-th of them bounds the k-th of all from below. A value of a bucket with
    fewer rows than that bound cannot be among the k, so only the values of the
    other buckets are counted, exactly. Where all values are about equally
    frequent nothing can be left out, and all are counted.
    """
    values = df.select(F.col(column).alias("value")).withColumn(
        "_bucket", F.pmod(F.xxhash64(F.col("value")), F.lit(buckets)).cast("int")
    )
    sizes = values.groupBy("_bucket").count().orderBy(F.desc("count")).collect()  # one row per bucket
    first = [r["_bucket"] for r in sizes[:probes]]

    def counts(chosen: Sequence[int]) -> DataFrame:
        rows = values.where(F.col("_bucket").isin(list(chosen))) if len(chosen) < len(sizes) else values
        return rows.groupBy("value").agg(F.count("*").alias("n"))

    found = counts(first).orderBy(F.desc("n")).limit(k).collect()
    least = found[-1]["n"] if len(found) == k else 0
    reach = [r["_bucket"] for r in sizes if r["count"] >= least]
    return counts(reach).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def merge_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """Counts from several sources added up by value; absent values count 0."""
    together = reduce(lambda a, b: a.unionByName(b), parts)
    return together.groupBy("value").agg(F.sum("n").alias("n"))


def rows_by_month(df: DataFrame, period: str) -> DataFrame:
    return (
        df.groupBy(month_start(F.col(period)).alias("month"))
        .agg(F.count("*").alias("n_rows"))
        .orderBy("month")
    )


def temporal_range(df: DataFrame, entity: str, period: str, exact: bool = False) -> DataFrame:
    return df.agg(
        F.min(period).alias("min_period"),
        F.max(period).alias("max_period"),
        F.count("*").alias("n_rows"),
        distinct_count(entity, exact).alias("n_entities"),
    )


def column_range(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    return df.agg(
        F.min(column).alias("min_value"),
        F.max(column).alias("max_value"),
        distinct_count(column, exact).alias("n_unique"),
    )


def group_sizes(
    df: DataFrame, keys: Sequence[str], entity: str, exact: bool = False
) -> DataFrame:
    """Rows and entities per group."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n_rows"), distinct_count(entity, exact).alias("n_entities"))
        .orderBy(*keys)
    )
