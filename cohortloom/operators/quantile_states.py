"""Quantile sketches per batch that are stored and merged, and a check of their ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_SIZE = 400
# Fixed value: the sketch's double-sided rank error at size k is about 2.446 / k ** 0.9433, at 99 %.
ERROR_SCALE, ERROR_POWER = 2.446, 0.9433


def rank_error(size: int = SKETCH_SIZE) -> float:
    """The normalised rank error that a quantile of a sketch stays within in 99 of 100 cases."""
    return ERROR_SCALE / size**ERROR_POWER


def quantile_sketches(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), size: int = SKETCH_SIZE
) -> DataFrame:
    """(keys..., one sketch per column): NULL and NaN are left out."""
    sketches = []
    for c in columns:
        x = F.col(c).cast("double")
        sketches.append(F.kll_sketch_agg_double(F.nanvl(x, F.lit(None)), F.lit(size)).alias(c))
    return df.groupBy(*keys).agg(*sketches)


def merged_sketches(
    sketches: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), size: int = SKETCH_SIZE
) -> DataFrame:
    return sketches.groupBy(*keys).agg(
        *(F.kll_merge_agg_double(F.col(c), F.lit(size)).alias(c) for c in columns)
    )


def sketch_quantiles(
    merged: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys..., feature, prob, n, value): quantiles of every sketch; none for one without values."""
    cells = []
    for c in columns:
        n = F.kll_sketch_get_n_double(F.col(c))
        for p in probs:
            value = F.when(n > 0, F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(p))))
            cells.append(
                F.struct(
                    F.lit(c).alias("feature"), F.lit(float(p)).alias("prob"), n.alias("n"), value.alias("value")
                )
            )
    found = merged.select(*keys, F.explode(F.array(*cells)).alias("cell"))
    return found.select(*keys, "cell.*").where("n > 0")


def exact_ranks(df: DataFrame, quantiles: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`quantiles` (feature, prob, n, value) with the shares of values below and up to each value.

    The quantiles are a small report; they reach the rows as one constant, and every
    row adds to fixed counters: one pass, no join, no shuffle of rows.
    """
    wanted = quantiles.select("feature", "prob", "n", "value").collect()
    counters = []
    for i, r in enumerate(wanted):
        x = F.nanvl(F.col(r["feature"]).cast("double"), F.lit(None))
        counters += [F.count_if(x < r["value"]).alias(f"below_{i}"), F.count_if(x <= r["value"]).alias(f"upto_{i}")]
    if not counters:
        return quantiles.select("*", F.lit(0.0).alias("below"), F.lit(0.0).alias("upto"))
    totals = df.agg(*counters).first()
    rows = [
        (r["feature"], r["prob"], r["n"], r["value"], totals[f"below_{i}"] / r["n"], totals[f"upto_{i}"] / r["n"])
        for i, r in enumerate(wanted)
    ]
    schema = "feature string, prob double, n bigint, value double, below double, upto double"
    return df.sparkSession.createDataFrame(rows, schema)
