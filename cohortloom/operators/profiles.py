"""What the clusters look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_sizes(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labels.groupBy(cluster).agg(F.count("*").alias("n_entities")).orderBy(cluster)


def cluster_profile(
    values: DataFrame,
    labels: DataFrame,
    entity: str,
    columns: Sequence[str],
    cluster: str = "cluster",
) -> DataFrame:
    """Mean of each column per cluster."""
    joined = values.select(entity, *columns).join(labels.select(entity, cluster), entity)
    return joined.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns]).orderBy(cluster)


def profile_zscores(
    profile: DataFrame, columns: Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """Each cluster's means against the spread of the cluster means; NULL when they are equal."""
    moments = profile.agg(
        F.struct(
            *[F.avg(c).alias(f"mu_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns],
        ).alias("m")
    ).scalar()
    m = F.col("_m")
    return profile.withColumn("_m", moments).select(
        cluster,
        *[
            F.try_divide(F.col(c) - m[f"mu_{c}"], m[f"sd_{c}"]).alias(f"z_{c}")
            for c in columns
        ],
    )


def full_profile(
    sizes: DataFrame, *profiles: DataFrame, cluster: str = "cluster"
) -> DataFrame:
    """Sizes and any number of profiles side by side."""
    out = sizes
    for p in profiles:
        out = out.join(p, cluster, "left")
    return out


def top_loadings(loadings: DataFrame, k: int = 6) -> DataFrame:
    """The k features with the largest absolute loading of each component."""
    size = F.abs(F.col("loading"))
    order = Window.partitionBy("component").orderBy(F.desc("abs_loading"), "feature")
    return (
        loadings.withColumn("abs_loading", size)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .orderBy("component", "place")
    )
