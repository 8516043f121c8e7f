"""Exact quantiles of groups of any size, and the summaries built on them.

Spark's `percentile` keeps every different value of a group in the memory of
one task. `exact_quantiles` gives the same numbers (linear interpolation)
without that: a mergeable sketch first brackets each wanted rank, then only
counts and the few values inside the brackets are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.tidy import tidy_aggregate
from cohortloom.session import materialise

SKETCH_ACCURACY = 10_000


def _brackets(data: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Per group: its size, and for each rank a value surely below and one surely above it.

    The sketch errs by at most n / accuracy ranks; the bracket is four times
    as wide. Groups no larger than the accuracy are not bracketed at all.
    """
    slack = 4.0 / SKETCH_ACCURACY
    cuts = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = data.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", [float(c) for c in cuts], SKETCH_ACCURACY).alias("_cuts"),
    )
    large = F.col("_n") > SKETCH_ACCURACY
    targets = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("prob"),
                F.when(large, F.col("_cuts")[i]).alias("low"),
                F.when(large, F.col("_cuts")[i + len(probs)]).alias("high"),
            )
            for i, p in enumerate(probs)
        ]
    )
    return sketch.select(*by, "_n", targets.alias("_targets"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Rows `(by..., prob, n, value)`: the quantiles of the present values of each group.

    The input is read twice, so pass a stored table rather than a long plan.
    A group without values gives no row.
    """
    by, probs = list(by), list(probs)
    v = F.col(value).cast("double")
    data = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    keys = {c: f"_key_{c}" for c in by}
    brackets = _brackets(data, by, probs).withColumnsRenamed(keys)
    # Stored, so that the sketch is made once and the join is planned by its size.
    brackets = materialise(brackets, "brackets")
    if by:
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
        matched = data.join(brackets, same).drop(*keys.values())
    else:
        whole = brackets.select(F.struct("_n", "_targets").alias("s")).scalar()
        matched = data.withColumn("_s", whole).select("_v", "_s.*")
    probed = matched.select(*by, "_v", "_n", F.explode("_targets").alias("_t"))
    inside = probed.where(F.col("_t.high").isNull() | (F.col("_v") <= F.col("_t.high")))
    # Values below a bracket are only counted: together they are one NULL value.
    counted = (
        inside.select(
            *by,
            F.col("_t.prob").alias("prob"),
            "_n",
            F.when(F.col("_t.low").isNull() | (F.col("_v") >= F.col("_t.low")), F.col("_v")).alias(
                "_v"
            ),
        )
        .groupBy(*by, "prob", "_n", "_v")
        .agg(F.count("*").alias("_c"))
    )
    up_to = Window.partitionBy(*by, "prob").orderBy(F.asc_nulls_first("_v"))
    ranked = counted.withColumn(
        "_end", F.sum("_c").over(up_to.rowsBetween(Window.unboundedPreceding, 0))
    )
    rank = (F.col("_n") - 1) * F.col("prob")
    low_rank, high_rank = F.floor(rank), F.ceil(rank)
    low = F.min(F.when(F.col("_end") > low_rank, F.col("_v")))
    high = F.min(F.when(F.col("_end") > high_rank, F.col("_v")))
    below = F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_end"))), F.lit(0))
    picked = ranked.groupBy(*by, "prob", "_n").agg(
        low.alias("_low"), high.alias("_high"), below.alias("_below"), F.max("_end").alias("_top")
    )
    step = F.col("_high") - F.col("_low")
    found = F.col("_low") + step * (rank - low_rank)
    # A rank outside its bracket would give a wrong number without a sign of it.
    inside = (F.col("_below") <= low_rank) & (F.col("_top") > high_rank)
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    return picked.select(
        *by, "prob", F.col("_n").alias("n"), F.when(inside, found).otherwise(missed).alias("value")
    )


def quantile_columns(
    quantiles: DataFrame, names: dict[float, str], by: Sequence[str] = ()
) -> DataFrame:
    """The quantile rows of each group as one row with a column per quantile."""
    wanted = [
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in names.items()
    ]
    return quantiles.groupBy(*by).agg(*wanted)


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max of a column, as rows `(stat, value)`."""
    x = F.col(column).cast("double")
    stats = {
        "count": F.count(x).cast("double"),
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "min": F.min(x),
        "max": F.max(x),
    }
    cells = [F.struct(F.lit(n).alias("stat"), s.alias("value")) for n, s in stats.items()]
    basic = df.agg(F.array(*cells).alias("_rows")).select(F.inline("_rows"))
    middle = exact_quantiles(df, column, [0.25, 0.5, 0.75]).select(
        F.format_string("%d%%", (F.col("prob") * 100).cast("int")).alias("stat"), "value"
    )
    return basic.unionByName(middle)


def group_summary(
    df: DataFrame,
    value: str,
    by: str,
    quantiles: dict[float, str] | None = None,
) -> DataFrame:
    """Per group: count, mean, sd, min, chosen quantiles and max of a value."""
    names = quantiles or {0.5: "p50", 0.9: "p90", 0.95: "p95", 0.99: "p99"}
    x = F.col(value)
    basic = df.groupBy(by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
    )
    found = quantile_columns(exact_quantiles(df, value, list(names), [by]), names, [by])
    return basic.join(found, by, "left")


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: quartiles and the whiskers, the outermost values within 1.5 IQR of the box."""
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    quartiles = quantile_columns(exact_quantiles(df, value, list(names), [by]), names, [by])
    x = F.col(value)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    within = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    quartiles = materialise(quartiles, "quartiles")
    return (
        df.where(x.isNotNull())
        .join(quartiles, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(F.min(F.when(within, x)).alias("low_whisker"),
             F.max(F.when(within, x)).alias("high_whisker"))
    )


def histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """Counts over bins of equal width from the least to the largest value; no empty bins."""
    x = F.col(value).cast("double")
    present = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    bounds = present.agg(
        F.struct(F.min("_x").alias("low"), F.max("_x").alias("high")).alias("b")
    ).scalar()
    placed = present.withColumn("_b", bounds).select("_x", "_b.low", "_b.high")
    width = (F.col("high") - F.col("low")) / bins
    position = F.floor(F.try_divide(F.col("_x") - F.col("low"), width))
    bin_of = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1))
    return (
        placed.groupBy(bin_of.cast("int").alias("bin"), "low", width.alias("width"))
        .agg(F.count("*").alias("n"))
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("left"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("right"),
            "n",
        )
    )


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Sketched quantiles of many columns in one pass: rows `(feature, quantiles)`."""
    def sketch(c: str) -> Column:
        return F.percentile_approx(F.col(f"`{c}`"), [float(p) for p in probs], accuracy)

    return tidy_aggregate(df, columns, {"quantiles": sketch})
