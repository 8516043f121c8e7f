"""A join to one row per key that stays even when some keys hold very many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys with more than this share of all rows are hot; there are fewer than 1 / share of them.
HOT_SHARE = 0.001


def attach(rows: DataFrame, lookup: DataFrame, key: str, n: str, spread: Column) -> DataFrame:
    """`rows` with the other columns of `lookup`, NULL where it lacks the key.

    `lookup` is a stored table with one row per value of `key` (NULL counts as a
    value) and in `n` the number of rows with it. Values with more than a
    thousandth of all rows are fewer than a thousand, whatever the input: they
    are sent to every task. The rows so answered go through the other join under
    `spread`, a column that differs between rows, so that no task gets all rows of
    one value; nothing in it matches them there. The column `n` is left out.
    """
    total = lookup.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > HOT_SHARE * total
    values = [c for c in lookup.columns if c not in (key, n)]
    few = lookup.filter(hot).select(key, *values).collect()
    schema = lookup.select(key, *values).schema
    near = F.broadcast(rows.sparkSession.createDataFrame(few, schema))
    near = near.select(
        F.col(key).alias("__near"), F.struct(*values).alias("__found"), F.lit(True).alias("__hot")
    )
    far = lookup.filter(~hot).select(
        F.col(key).alias("__far"), F.lit(0).alias("__zero"), F.struct(*values).alias("__other")
    )
    salt = F.when(F.col("__hot"), F.hash(spread).bitwiseOR(F.lit(1))).otherwise(0)
    met = rows.join(near, F.col(key).eqNullSafe(F.col("__near")), "left").withColumn("__salt", salt)
    same = F.col(key).eqNullSafe(F.col("__far")) & (F.col("__salt") == F.col("__zero"))
    met = met.join(far.hint("shuffle_hash"), same, "left")
    both = F.coalesce("__found", "__other")
    return met.select(*rows.columns, *(both[v].alias(v) for v in values))


def meet(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """`rows` joined with a stored `lookup` that has one row per value of `keys`, and in `n` how often it occurs.

    As in `attach`, the few values with very many rows are sent to every task, and
    their rows stay where they are; only the other rows are shuffled.
    """
    keys = list(keys)
    total = lookup.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > HOT_SHARE * total
    few = F.broadcast(rows.sparkSession.createDataFrame(lookup.filter(hot).collect(), lookup.schema))
    near = rows.join(few, keys)
    far = rows.join(few.select(*keys), keys, "left_anti").join(lookup.filter(~hot), keys)
    return near.unionByName(far)
