"""The typed entity-by-period panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import to_double, to_int
from cohortloom.functions.periods import is_period, parse_period
from cohortloom.roles import Roles


def build_panel(
    df: DataFrame,
    roles: Roles,
    ids: DataFrame | None = None,
    keep: Column | None = None,
    period_format: str = "MMyyyy",
    extra: list[str] | None = None,
    entity_name: str = "entity_id",
) -> DataFrame:
    """All-text rows to typed rows: parsed period, `cat_*`, `txt_*` and `num_*` columns.

    Rows with an unreadable period or year are left out. The entities can be
    restricted by a predicate (`keep`, evaluated on the scan) or by a table of
    ids, whose ids need not be unique. A semi-join on ids is cheaper for Spark
    than an inner one: it broadcasts or skew-splits as sizes turn out, and its
    runtime filter on the ids prunes the panel before any shuffle.
    """
    if keep is not None:
        df = df.where(keep)
    if ids is not None:
        named = ids.select(F.col(ids.columns[0]).alias(roles.entity))
        df = df.join(named, roles.entity, "left_semi")
    year = to_int(F.col("year"))
    df = df.where(is_period(F.col(roles.period), period_format) & year.isNotNull())
    return df.select(
        F.col(roles.entity).alias(entity_name),
        F.col(roles.period).alias("period_raw"),
        parse_period(F.col(roles.period), period_format).alias("period_date"),
        year.alias("year"),
        F.col("quarter"),
        *[F.col(c).alias(f"cat_{c}") for c in roles.codes],
        *[F.col(c).alias(f"txt_{c}") for c in roles.text],
        *[to_double(F.col(c)).alias(f"num_{c}") for c in roles.numeric],
        *(extra or []),
    )


def restrict_to(panel: DataFrame, ids: DataFrame, entity: str) -> DataFrame:
    """Rows of the panel whose entity is listed."""
    return panel.join(ids.select(entity), entity, "left_semi")
