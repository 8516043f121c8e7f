"""One wide row of features per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.tidy import melt
from cohortloom.sources.tables import gathered_by_partition


def near_entity(panel: DataFrame, entity: str) -> DataFrame:
    """The same rows, those of an entity next to each other, in pieces of the advisory partition size.

    For wide states of many entities: where an entity's rows lie in all tasks, a task
    holds and sends a state for about every row. The rows themselves are smaller, and once
    they have met, a task sends one state for all of them. An entity with a large share of
    the rows is split over tasks by its size. Stored, the rows serve any number of passes.
    """
    # Dealt by the entity itself, a later aggregate would take a piece for all of its rows.
    near = panel.withColumn("_near", F.pmod(F.xxhash64(entity), F.lit(1 << 16)).cast("int"))
    return gathered_by_partition(near, ["_near"]).drop("_near")


def numeric_summary(column: str) -> list[Column]:
    x = F.col(column)
    return [
        F.avg(x).alias(f"mean_{column}"),
        F.stddev_samp(x).alias(f"std_{column}"),
        F.min(x).alias(f"min_{column}"),
        F.max(x).alias(f"max_{column}"),
    ]


def code_spans(
    panel: DataFrame, entity: str, period: str, coded: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """First and last period of every value of every coded column, per entity (and `within`).

    All states are fixed-size, so this hashes rather than sorts the panel, and
    an entity that holds a large share of the rows is combined before the
    shuffle and spread over tasks by its values.
    """
    cells = melt(panel, coded, keep=[entity, period, *within], key="_column", dtype="string")
    return (
        cells.where(F.col("value").isNotNull())
        .groupBy(entity, *within, "_column", "value")
        .agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    )


def code_features(
    panel: DataFrame, entity: str, period: str, coded: Sequence[str]
) -> DataFrame:
    """First, last and number of different present values of each coded column, per entity."""
    return features_of_spans(code_spans(panel, entity, period, coded), entity, coded)


def features_of_spans(spans: DataFrame, entity: str, coded: Sequence[str]) -> DataFrame:
    """The code features from one row per entity, column and value.

    At equal periods the smaller value is the first and the larger the last.
    """
    wide = []
    for c in coded:
        here = F.col("_column") == c
        start = F.when(here, F.struct("_first", "value"))
        end = F.when(here, F.struct("_last", "value"))
        wide += [
            F.min(start)["value"].alias(f"first_{c}"),
            F.max(end)["value"].alias(f"last_{c}"),
            F.count_if(here).alias(f"nunique_{c}"),
        ]
    return spans.groupBy(entity).agg(*wide)


def entity_features(
    panel: DataFrame,
    entity: str = "entity_id",
    period: str = "period_date",
    numeric: Sequence[str] | None = None,
    coded: Sequence[str] | None = None,
) -> DataFrame:
    """Rows, period range, and summaries of all `num_*`, `cat_*` and `txt_*` columns per entity.

    Numbers and codes are summarised apart, each reading only its own columns:
    numbers in one hash aggregate, codes by way of their different values. The
    two results have one row per entity and are joined on it. With many entities pass
    the rows as `near_entity` leaves them.
    """
    numeric = [c for c in panel.columns if c.startswith("num_")] if numeric is None else numeric
    if coded is None:
        coded = [c for c in panel.columns if c.startswith(("cat_", "txt_"))]
    wide = [
        F.count("*").alias("n_months"),
        F.min(period).alias("min_period"),
        F.max(period).alias("max_period"),
    ]
    for c in numeric:
        wide += numeric_summary(c)
    numbers = panel.groupBy(entity).agg(*wide)
    if not coded:
        return numbers
    codes = code_features(panel, entity, period, coded).withColumnRenamed(entity, "_entity")
    key, other = F.col(entity), F.col("_entity")
    # A plain equality keeps the partitioning of both aggregates: no further shuffle.
    # Rows without an entity are one row on either side and are joined apart; their
    # filter reaches the scan.
    named = numbers.where(key.isNotNull()).join(codes, key == other, "left")
    nameless = numbers.where(key.isNull()).join(codes.where(other.isNull()), F.lit(True), "left")
    joined = named.unionByName(nameless)
    return joined.drop("_entity").fillna(0, [f"nunique_{c}" for c in coded])
