"""Delinquency-style risk of entities, and of clusters over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import double_of, int_of
from cohortloom.functions.numeric import drawdown_ratio

# Months of delinquency from which an entity counts as ever 30,
# 60, 90 or 180 days late.
THRESHOLDS = {"ever_30": 1, "ever_60": 2, "ever_90": 3, "ever_180": 6}


def risk_metrics(
    panel: DataFrame,
    entity: str,
    period: str,
    delinquency: str,
    balance: str,
    rate: str,
    thresholds: dict[str, int] | None = None,
) -> DataFrame:
    """One row per entity: period range, worst delinquency, flags, rate, balances.

    A missing or non-numeric delinquency counts as current. Every state is a
    fixed-size number, so the aggregate hashes and combines before its shuffle.
    """
    limits = thresholds or THRESHOLDS
    base = panel.where(F.col(entity).isNotNull()).select(
        F.col(entity),
        F.col(period).cast("timestamp_ntz").alias("_period"),
        F.coalesce(int_of(panel, delinquency), F.lit(0)).alias("_dq"),
        double_of(panel, balance).alias("_upb"),
        double_of(panel, rate).alias("_rate"),
    )
    found = base.groupBy(entity).agg(
        F.min("_period").alias("first_period"),
        F.max("_period").alias("last_period"),
        F.max("_dq").alias("max_dq"),
        F.avg("_rate").alias("avg_rate"),
        F.max("_upb").alias("max_upb"),
        F.min("_upb").alias("min_upb"),
        F.max(F.when(F.col("_upb") == 0, 1).otherwise(0)).alias("terminated_upb0"),
    )
    # Reaching a threshold once is the same as the maximum reaching it.
    flags = [
        F.when(F.col("max_dq") >= n, 1).otherwise(0).alias(name) for name, n in limits.items()
    ]
    return found.select(
        entity,
        "first_period",
        "last_period",
        "max_dq",
        *flags,
        "avg_rate",
        "max_upb",
        "min_upb",
        "terminated_upb0",
        drawdown_ratio(F.col("max_upb"), F.col("min_upb")).alias("amortization_ratio"),
    )


def rates_by_cluster(
    metrics: DataFrame, labels: DataFrame, entity: str, cluster: str = "cluster",
    flags: Sequence[str] = tuple(THRESHOLDS),
) -> DataFrame:
    """Entities and mean risk per cluster."""
    joined = metrics.join(labels.select(entity, cluster), entity)
    return (
        joined.groupBy(cluster)
        .agg(
            F.count("*").alias("n_entities"),
            *[F.avg(f).alias(f"{f}_rate") for f in flags],
            F.avg("terminated_upb0").alias("terminated_rate"),
            F.avg("avg_rate").alias("avg_rate"),
            F.avg("max_upb").alias("avg_max_upb"),
            F.avg("amortization_ratio").alias("avg_amort_ratio"),
        )
        .orderBy(cluster)
    )


def cohort_by_first_year(
    metrics: DataFrame, labels: DataFrame, entity: str, cluster: str = "cluster"
) -> DataFrame:
    """Entities by the year of their first period and their cluster."""
    joined = metrics.select(entity, "first_period").join(labels.select(entity, cluster), entity)
    return (
        joined.groupBy(F.year("first_period").cast("bigint").alias("first_year"), cluster)
        .agg(F.count("*").alias("n_entities"))
        .orderBy("first_year", cluster)
    )


def cluster_year_counts(
    panel: DataFrame, labels: DataFrame, entity: str, period: str, cluster: str = "cluster"
) -> DataFrame:
    """Different entities with a row in each calendar year, by cluster.

    The panel is reduced to one row per entity and year before the join, so
    the join never sees the panel's own size or skew.
    """
    seen = (
        panel.where(F.col(entity).isNotNull() & F.col(period).isNotNull())
        .select(entity, F.year(period).cast("bigint").alias("year"))
        .distinct()
    )
    return (
        seen.join(labels.select(entity, cluster), entity)
        .groupBy("year", cluster)
        .agg(F.count("*").alias("n_entities"))
        .orderBy("year", cluster)
    )


def with_share(counts: DataFrame, group: str = "year", n: str = "n_entities") -> DataFrame:
    """`counts` with the total of its group and the share of it. Counts are a small report."""
    within = Window.partitionBy(group)
    total = F.sum(n).over(within)
    return counts.withColumn("total_year", total).withColumn(
        "share", F.try_divide(F.col(n), F.col("total_year"))
    )


def cluster_share_by_year(
    panel: DataFrame, labels: DataFrame, entity: str, period: str, cluster: str = "cluster"
) -> DataFrame:
    return with_share(cluster_year_counts(panel, labels, entity, period, cluster))


def share_pivot(
    shares: DataFrame, clusters: Sequence[int] | None = None, cluster: str = "cluster"
) -> DataFrame:
    """Years by clusters, share as value, 0 where a cluster is absent.

    Naming the clusters saves the job that would look them up.
    """
    values = list(clusters) if clusters is not None else None
    table = shares.groupBy("year").pivot(cluster, values).agg(F.sum("share"))
    renamed = {c: f"cluster_{c}" for c in table.columns if c != "year"}
    return table.withColumnsRenamed(renamed).na.fill(0.0).orderBy("year")
