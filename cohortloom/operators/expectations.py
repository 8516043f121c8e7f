"""Checks of result tables, each returned as a row.

Columns: check, subject, severity ('error' or 'warning'), status ('pass' or
'fail'), observed, expected, detail.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortloom.sources.inventory import list_files
from cohortloom.sources.tables import missing_columns

TOLERANCE = 1e-12
SHARE_TOLERANCE = 0.01


def _result(
    check: str, subject: str, severity: str, passed: Column, observed: Column,
    expected: Column, detail: Column | None = None,
) -> list[Column]:
    return [
        F.lit(check).alias("check"),
        F.lit(subject).alias("subject"),
        F.lit(severity).alias("severity"),
        F.when(passed, "pass").otherwise("fail").alias("status"),
        observed.cast("double").alias("observed"),
        expected.cast("double").alias("expected"),
        (detail if detail is not None else F.lit("")).alias("detail"),
    ]


def expect_columns(
    df: DataFrame, wanted: Sequence[str], subject: str, severity: str = "error"
) -> DataFrame:
    """All wanted columns exist. Looks at the schema only."""
    absent = missing_columns(df, wanted)
    row = _result(
        "columns", subject, severity, F.lit(not absent), F.lit(len(absent)), F.lit(0),
        F.lit(",".join(absent)),
    )
    return df.sparkSession.range(1).select(*row)


def expect_between(
    df: DataFrame, column: str, low: float, high: float, subject: str, severity: str = "error"
) -> DataFrame:
    """No value outside [low, high], and at least one value. Observed: values outside."""
    x = F.col(column)
    outside = F.count_if((x < low - TOLERANCE) | (x > high + TOLERANCE) | F.isnan(x))
    passed = (outside == 0) & (F.count(x) > 0)
    return df.agg(
        *_result("between", f"{subject}.{column}", severity, passed, outside, F.lit(0))
    )


def expect_min_rows(
    df: DataFrame, minimum: int, subject: str, severity: str = "error"
) -> DataFrame:
    n = F.count("*")
    return df.agg(*_result("min_rows", subject, severity, n >= minimum, n, F.lit(minimum)))


def expect_total_equal(
    sizes: DataFrame, column: str, rows_of: DataFrame, subject: str, severity: str = "warning"
) -> DataFrame:
    """The sizes add up to the number of rows of another table."""
    n_rows = rows_of.agg(F.count("*").alias("n")).scalar()
    summed = sizes.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))
    return summed.select(
        *_result("total", subject, severity, F.col("total") == n_rows, F.col("total"), n_rows)
    )


def expect_group_sum(
    df: DataFrame, keys: Sequence[str], column: str, expected: float, subject: str,
    tolerance: float = SHARE_TOLERANCE, severity: str = "warning",
) -> DataFrame:
    """The values of each group add up to `expected`. Observed: groups that do not."""
    sums = df.groupBy(*keys).agg(F.sum(column).alias("s"))
    off = F.count_if(F.col("s").isNull() | (F.abs(F.col("s") - expected) > tolerance))
    return sums.agg(
        *_result("group_sum", f"{subject}.{column}", severity, off == 0, off, F.lit(0))
    )


def expect_best_at_least(
    df: DataFrame, column: str, by: str, minimum: float, subject: str, severity: str = "error"
) -> DataFrame:
    """The value of `column` in the row with the largest `by` is at least `minimum`."""
    best = F.max_by(column, by)
    return df.agg(
        *_result("best", f"{subject}.{column}", severity, best >= minimum, best, F.lit(minimum))
    )


def expect_outputs(spark, root: str, expected: Sequence[str], severity: str = "error") -> DataFrame:
    """Every expected file or table folder below `root` exists and is not empty."""
    base = root.rstrip("/")
    wanted = spark.createDataFrame([(name,) for name in expected], "output string")
    files = list_files(spark, base)
    below = F.regexp_replace(F.regexp_extract("path", rf"\Q{base}\E/(.*)$", 1), "^/+", "")
    placed = files.select(below.alias("place"), "bytes")
    # A file belongs to every folder above it; as a key this makes it an equi-join.
    parts = F.split("place", "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")
    )
    sized = placed.select(F.explode(folders).alias("output"), "bytes").groupBy("output").agg(
        F.sum("bytes").alias("bytes")
    )
    found = wanted.join(sized, "output", "left")
    size = F.coalesce(F.col("bytes"), F.lit(0))
    row = _result("output", "", severity, size > 0, size, F.lit(1))
    row[1] = F.col("output").alias("subject")
    return found.select(*row)


@dataclass(frozen=True)
class Between:
    """As `expect_between`, for `write_checked`."""

    column: str
    low: float
    high: float
    severity: str = "error"


@dataclass(frozen=True)
class MinRows:
    """As `expect_min_rows`."""

    minimum: int
    severity: str = "error"


@dataclass(frozen=True)
class Total:
    """The values of a column add up to a known number, within the tolerance of shares."""

    column: str
    expected: float
    severity: str = "warning"


Check = Between | MinRows | Total


def _metrics(check: Check, i: int) -> list[Column]:
    if isinstance(check, Between):
        x = F.col(check.column)
        off = F.count_if((x < check.low - TOLERANCE) | (x > check.high + TOLERANCE) | F.isnan(x))
        return [off.alias(f"off_{i}"), F.count(x).alias(f"n_{i}")]
    if isinstance(check, MinRows):
        return [F.count("*").alias(f"n_{i}")]
    return [F.coalesce(F.sum(F.col(check.column).cast("double")), F.lit(0.0)).alias(f"sum_{i}")]


def _judged(check: Check, i: int, subject: str, got: dict) -> tuple:
    if isinstance(check, Between):
        passed = got[f"off_{i}"] == 0 and got[f"n_{i}"] > 0
        row = ("between", f"{subject}.{check.column}", passed, got[f"off_{i}"], 0)
    elif isinstance(check, MinRows):
        row = ("min_rows", subject, got[f"n_{i}"] >= check.minimum, got[f"n_{i}"], check.minimum)
    else:
        total = got[f"sum_{i}"]
        passed = abs(total - check.expected) <= SHARE_TOLERANCE
        row = ("total", f"{subject}.{check.column}", passed, total, check.expected)
    name, what, passed, observed, expected = row
    return name, what, check.severity, "pass" if passed else "fail", float(observed), float(expected), ""


RESULT_SCHEMA = (
    "check string, subject string, severity string, status string, observed double, expected double, detail string"
)


def write_checked(
    df: DataFrame, write: Callable[[DataFrame], None], checks: Sequence[Check], subject: str
) -> DataFrame:
    """Write a table and check it in the same job: one row per check, in the usual columns.

    The metrics are taken from the rows on their way to `write`, which must run
    one job over all of them; the table is not read again. Checks that need
    groups (`expect_group_sum`) stay with the stored table.
    """
    watch = Observation()
    measures = [m for i, check in enumerate(checks) for m in _metrics(check, i)]
    write(df.observe(watch, *measures) if measures else df)
    got = watch.get if measures else {}
    rows = [_judged(check, i, subject, got) for i, check in enumerate(checks)]
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def run_expectations(results: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), results)


def summarise(results: DataFrame) -> DataFrame:
    """Number of checks per severity and status."""
    return results.groupBy("severity", "status").agg(F.count("*").alias("n_checks"))


def verdict(results: DataFrame) -> DataFrame:
    """One row: failed errors, failed warnings, and 'pass' unless an error failed."""
    failed = F.col("status") == "fail"
    errors = F.count_if(failed & (F.col("severity") == "error"))
    warnings = F.count_if(failed & (F.col("severity") == "warning"))
    return results.agg(
        errors.alias("errors"),
        warnings.alias("warnings"),
        F.when(errors == 0, "pass").otherwise("fail").alias("verdict"),
    )


def cross_layer_counts(panel: DataFrame, features: DataFrame, entity: str, period: str,
                       exact: bool = False) -> DataFrame:
    """Rows, entities and period range of the panel beside the rows of the feature table."""
    distinct = F.count_distinct(entity) if exact else F.approx_count_distinct(entity)
    n_features = features.agg(F.count("*").alias("n")).scalar()
    return panel.agg(
        F.count("*").alias("panel_rows"),
        distinct.alias("panel_entities"),
        F.min(period).alias("min_period"),
        F.max(period).alias("max_period"),
    ).withColumn("feature_rows", n_features)
