"""Entity features that grow with the panel: mergeable states per entity and batch.

A batch is any part of the panel that is loaded or replaced as a whole (a quarter,
a member file). Its rows are summarised once, to one row of numbers per entity and
one row per different code, and stored under the batch's own folder. Features come
from the stored states of all batches: a late quarter costs one pass over that
quarter, and loading a batch again replaces its states.

Spreads are kept as sums of squared deviations from the batch's own mean and merged
by the pairwise update, so nothing is lost by subtracting large sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.features import code_spans, features_of_spans
from cohortloom.sources.tables import gathered_by_partition, write_table

NUMBERS = "numbers"
CODES = "codes"


def number_states(
    panel: DataFrame, entity: str, period: str, numeric: Sequence[str], batch: str | None = None
) -> DataFrame:
    """Per entity (and batch): n_months, min_period, max_period, and for every column a struct
    (n, mean, m2, low, high) of its present values; m2 is the sum of squared deviations.

    With many entities pass the rows as `near_entity` leaves them."""
    keys = [entity] if batch is None else [entity, batch]
    wide = [
        F.count("*").alias("n_months"),
        F.min(period).alias("min_period"),
        F.max(period).alias("max_period"),
    ]
    for c in numeric:
        x = F.col(c).cast("double")
        state = F.struct(
            F.count(x).alias("n"),
            F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
        )
        wide.append(state.alias(c))
    return panel.groupBy(*keys).agg(*wide)


def _both(a: Column, b: Column) -> Column:
    """One state from two: counts add up, the spread gains what the means are apart."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    return F.struct(
        n.alias("n"),
        (a["mean"] + apart * share).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"),
        F.least(a["low"], b["low"]).alias("low"),
        F.greatest(a["high"], b["high"]).alias("high"),
    )


def merge_numbers(
    states: DataFrame, entity: str, numeric: Sequence[str], order: str | None = None
) -> DataFrame:
    """One state per entity from one per entity and batch, folded in the order of `order`.

    An entity's list has as many items as there are batches, whatever the panel's size.
    """
    none = "CAST(NULL AS DOUBLE)"
    start = F.expr(f"named_struct('n', 0L, 'mean', 0.0D, 'm2', 0.0D, 'low', {none}, 'high', {none})")
    place = F.col(order) if order else F.lit(0)
    listed = F.array_sort(F.collect_list(F.struct(place.alias("_place"), "min_period", *numeric)))
    together = states.groupBy(entity).agg(
        F.sum("n_months").alias("n_months"),
        F.min("min_period").alias("min_period"),
        F.max("max_period").alias("max_period"),
        listed.alias("_states"),
    )
    folded = [F.aggregate(F.col("_states")[c], start, _both).alias(c) for c in numeric]
    return together.select(entity, "n_months", "min_period", "max_period", *folded)


def number_features(states: DataFrame, entity: str, numeric: Sequence[str]) -> DataFrame:
    """mean, std, min and max of every column, from one state per entity."""
    wide = []
    for c in numeric:
        n = F.col(c)["n"]
        wide += [
            F.when(n > 0, F.col(c)["mean"]).alias(f"mean_{c}"),
            F.when(n > 1, F.sqrt(F.col(c)["m2"] / (n - 1))).alias(f"std_{c}"),
            F.col(c)["low"].alias(f"min_{c}"),
            F.col(c)["high"].alias(f"max_{c}"),
        ]
    return states.select(entity, "n_months", "min_period", "max_period", *wide)


def code_states(
    panel: DataFrame, entity: str, period: str, coded: Sequence[str], batch: str | None = None
) -> DataFrame:
    """First and last period of every code of every column, per entity (and batch)."""
    return code_spans(panel, entity, period, coded, [batch] if batch else ())


def merge_codes(states: DataFrame, entity: str) -> DataFrame:
    return states.groupBy(entity, "_column", "value").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )


def save_states(
    panel: DataFrame,
    root: str,
    batch: str,
    entity: str = "entity_id",
    period: str = "period_date",
    numeric: Sequence[str] = (),
    coded: Sequence[str] = (),
) -> None:
    """Summarise every batch in `panel` and replace those batches' states below `root`.

    `batch` names a column. Batches that are not in `panel` stay as they are, so
    rows that come late for a batch must come with the batch's other rows. Each of
    the two tables is replaced on its own: after a failure between them, the same
    call puts both right. The panel is read twice: pass a stored table, with many
    entities as `near_entity` leaves it.
    """
    numbers = number_states(panel, entity, period, numeric, batch)
    write_table(
        gathered_by_partition(numbers, [batch]), f"{root}/{NUMBERS}", [batch], mode="replace_partitions"
    )
    if coded:
        codes = code_states(panel, entity, period, coded, batch)
        write_table(
            gathered_by_partition(codes, [batch]), f"{root}/{CODES}", [batch], mode="replace_partitions"
        )


def load_features(
    spark: SparkSession,
    root: str,
    batch: str,
    entity: str = "entity_id",
    numeric: Sequence[str] = (),
    coded: Sequence[str] = (),
) -> DataFrame:
    """The same columns as `entity_features`, from the stored states of all batches."""
    states = spark.read.parquet(f"{root}/{NUMBERS}")
    wide = number_features(merge_numbers(states, entity, numeric, batch), entity, numeric)
    if not coded:
        return wide
    spans = merge_codes(spark.read.parquet(f"{root}/{CODES}"), entity)
    codes = features_of_spans(spans, entity, coded).withColumnRenamed(entity, "_entity")
    joined = wide.join(codes, F.col(entity).eqNullSafe(F.col("_entity")), "left").drop("_entity")
    return joined.fillna(0, [f"nunique_{c}" for c in coded])
