"""Evidence for choosing features: missing values, redundancy, outliers, ranking, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.names import feature_base, feature_family
from cohortloom.functions.numeric import pair_correlation, zscore
from cohortloom.operators.quantiles import exact_quantiles, quantile_columns
from cohortloom.operators.tidy import melt, tidy_aggregate

# Limits of the feature selection and of the evidence tables.
MAX_NULL_RATIO = 0.20
MIN_SD = 1e-12
MIN_PAIR_ROWS = 500
MIN_OUTLIER_ROWS = 1000


def _null_ratio(c: str) -> Column:
    return F.avg(F.when(F.col(f"`{c}`").isNull(), 1.0).otherwise(0.0))


def feature_missingness(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of entities without each feature, with its family and base; worst first."""
    return (
        tidy_aggregate(features, columns, {"null_ratio": _null_ratio})
        .withColumn("family", feature_family(F.col("feature")))
        .withColumn("base", feature_base(F.col("feature")))
        .orderBy(F.desc("null_ratio"), "feature")
    )


def missingness_by_family(missing: DataFrame) -> DataFrame:
    return (
        missing.groupBy("family")
        .agg(
            F.count("*").alias("n_features"),
            F.avg("null_ratio").alias("avg_null_ratio"),
            F.max("null_ratio").alias("max_null_ratio"),
        )
        .orderBy("avg_null_ratio", "family")
    )


def feature_stats(
    features: DataFrame, columns: Sequence[str], exact: bool = False
) -> DataFrame:
    """Per feature: null ratio, mean, sd, 1st and 99th percentile, base.

    Percentiles are sketched in the same single pass. `exact` computes them
    exactly in two further passes.
    """
    stats = {
        "null_ratio": _null_ratio,
        "mean": lambda c: F.avg(F.col(f"`{c}`")),
        "std": lambda c: F.stddev_samp(F.col(f"`{c}`")),
    }
    if not exact:
        for name, p in (("p01", 0.01), ("p99", 0.99)):
            stats[name] = lambda c, p=p: F.percentile_approx(F.col(f"`{c}`"), p)
    table = tidy_aggregate(features, columns, stats)
    if exact:
        tails = exact_quantiles(melt(features, columns), "value", [0.01, 0.99], ["feature"])
        tails = quantile_columns(tails, {0.01: "p01", 0.99: "p99"}, ["feature"])
        table = table.join(tails, "feature", "left")
    return table.withColumn("base", feature_base(F.col("feature")))


def within_base_correlation(
    features: DataFrame,
    bases: Sequence[str],
    others: Sequence[str] = ("std", "min", "max"),
    min_rows: int = MIN_PAIR_ROWS,
) -> DataFrame:
    """Correlation of each base's mean with its other summaries, over complete pairs.

    NULL with fewer than `min_rows` pairs, for a constant side, and for a
    summary that the table does not have.
    """
    present = set(features.columns)

    def correlation(base: str, other: str) -> Column:
        a, b = f"mean_num_{base}", f"{other}_num_{base}"
        if b not in present:
            return F.lit(None).cast("double")
        return pair_correlation(F.col(a), F.col(b), min_rows)

    stats = {
        f"corr_mean_{other}": (lambda base, other=other: correlation(base, other))
        for other in others
    }
    known = [b for b in bases if f"mean_num_{b}" in present]
    return tidy_aggregate(features, known, stats, key="base")


def correlation_summary(correlations: DataFrame) -> DataFrame:
    """Mean and median of each correlation column. The table has one row per base."""
    columns = [c for c in correlations.columns if c.startswith("corr_")]
    return correlations.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in columns],
        *[F.percentile(c, 0.5).alias(f"median_{c}") for c in columns],
    )


def outlier_rates(
    features: DataFrame, columns: Sequence[str], min_rows: int = MIN_OUTLIER_ROWS
) -> DataFrame:
    """Share of each feature's values below its 1st or above its 99th percentile."""
    tails = exact_quantiles(melt(features, columns), "value", [0.01, 0.99], ["feature"])
    limits = {
        r["feature"]: (r["p01"], r["p99"])
        for r in quantile_columns(
            tails.where(F.col("n") >= min_rows), {0.01: "p01", 0.99: "p99"}, ["feature"]
        ).collect()  # one row per feature
    }

    def rate(c: str) -> Column:
        x, (low, high) = F.col(f"`{c}`"), limits[c]
        return F.avg(F.when(x.isNotNull(), F.when((x < low) | (x > high), 1.0).otherwise(0.0)))

    kept = [c for c in columns if c in limits]
    if not kept:
        schema = "feature string, extreme_rate double, family string"
        return features.sparkSession.createDataFrame([], schema)
    table = tidy_aggregate(features, kept, {"extreme_rate": rate})
    return table.withColumn("family", feature_family(F.col("feature")))


def outliers_by_family(rates: DataFrame) -> DataFrame:
    return (
        rates.groupBy("family")
        .agg(
            F.avg("extreme_rate").alias("avg_extreme_rate"),
            F.max("extreme_rate").alias("max_extreme_rate"),
            F.count("*").alias("n_features"),
        )
        .orderBy("avg_extreme_rate", "family")
    )


def rank_features(stats: DataFrame, norms: DataFrame, norm: str = "loading_norm") -> DataFrame:
    """Score (1 - null ratio) * sd * loading norm, best first. `norms` is keyed by `feature`."""
    weight = F.coalesce(F.col("std"), F.lit(0.0)) * F.coalesce(F.col(norm), F.lit(0.0))
    return (
        stats.join(norms.select("feature", norm), "feature")
        .withColumn("score", (1 - F.col("null_ratio")) * weight)
        .orderBy(F.desc("score"), "feature")
    )


def select_features(
    stats: DataFrame,
    max_null: float = MAX_NULL_RATIO,
    min_sd: float = MIN_SD,
    mode: str = "filtered",
) -> DataFrame:
    """`stats` with `keep` and `decision`. The mode 'all' keeps every feature."""
    constant = F.col("std").isNull() | (F.col("std") <= min_sd)
    sparse = F.col("null_ratio") > max_null
    if mode == "all":
        decision = F.lit("KEEP")
    elif mode == "filtered":
        # The wording of the decisions. A constant is reported first.
        decision = (
            F.when(constant, "EXCLUDE_constante_std0")
            .when(sparse, f"EXCLUDE_missingness_gt_{max_null}")
            .otherwise("KEEP")
        )
    else:
        raise ValueError(f"unknown mode: {mode}")
    return stats.withColumn("decision", decision).withColumn("keep", F.col("decision") == "KEEP")


def kept_features(decisions: DataFrame) -> list[str]:
    """Names of the kept features; an error when there are none. Reads one row per feature."""
    names = sorted(r["feature"] for r in decisions.where("keep").select("feature").collect())
    if not names:
        raise ValueError("no feature passed the selection")
    return names


def _moments(features: DataFrame, columns: Sequence[str], spread) -> Column:
    """Mean and spread of the columns as one struct, from one aggregate, usable in any row.

    It is a scalar subquery: computed once, then a constant of every task. No
    join and no second copy of the table is involved.
    """
    cells = []
    for c in columns:
        cells += [F.avg(f"`{c}`").alias(f"mu_{c}"), spread(f"`{c}`").alias(f"sd_{c}")]
    return features.agg(F.struct(*cells).alias("m")).scalar()


def zscore_matrix(
    features: DataFrame,
    entity: str,
    columns: Sequence[str],
    ddof: int = 1,
    prefix: str = "z_",
) -> DataFrame:
    """Key and standardised features: mean-imputed, 0 for a constant feature.

    `ddof=1` divides by the sample standard deviation, `ddof=0` by the
    population one.
    """
    spread = F.stddev_samp if ddof else F.stddev_pop
    with_stats = features.select(entity, *[f"`{c}`" for c in columns]).withColumn(
        "_m", _moments(features, columns, spread)
    )
    return with_stats.select(
        entity,
        *[
            zscore(F.col(f"`{c}`"), F.col("_m")[f"mu_{c}"], F.col("_m")[f"sd_{c}"]).alias(
                f"{prefix}{c}"
            )
            for c in columns
        ],
    )


def impute_mean(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of the columns replaced by the column means, other columns unchanged."""
    chosen = set(columns)
    with_stats = features.withColumn("_m", _moments(features, columns, F.stddev_samp))
    return with_stats.select(
        *[
            F.coalesce(F.col(f"`{c}`").cast("double"), F.col("_m")[f"mu_{c}"]).alias(c)
            if c in chosen
            else F.col(f"`{c}`")
            for c in features.columns
        ]
    )
