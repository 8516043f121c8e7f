"""Renaming, casting and aligning the columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from cohortloom.roles import Roles
from cohortloom.sources.inventory import partition_value


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first columns under new names; further columns are left out."""
    if len(df.columns) < len(names):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def align_schema(
    df: DataFrame, columns: Sequence[str], dtype: str | DataType = "string"
) -> DataFrame:
    """Exactly these columns in this order; absent ones are NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{c}`").cast(dtype) if c in present else F.lit(None).cast(dtype)).alias(c)
            for c in columns
        ]
    )


def with_partition_columns(df: DataFrame, keys: Sequence[str] = ("year", "quarter")) -> DataFrame:
    """Partition values from the path of the file each row was read from."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[partition_value(path, k).alias(k) for k in keys])


def select_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """The role-selected all-text table: key, codes, numbers, texts, partition columns."""
    return align_schema(df, roles.all_columns())


def key_first(df: DataFrame, key: str, renamed: dict[str, str] | None = None) -> DataFrame:
    """The key as first column, others in order and under their new names."""
    new = renamed or {}
    rest = [F.col(f"`{c}`").alias(new.get(c, c)) for c in df.columns if c != key]
    return df.select(F.col(f"`{key}`").alias(new.get(key, key)), *rest)
