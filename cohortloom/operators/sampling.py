"""Deterministic samples and splits. The same rows are chosen on every run and every cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.hashing import ORDER_BITS, hash_bucket, hash_order

# 150 of 10,000 buckets, that is 1.5 % of the entities.
SAMPLE_BUCKETS = 10_000
SAMPLE_THRESHOLD = 150

_BIN_BITS = 12


def in_sample(
    entity: Column,
    buckets: int = SAMPLE_BUCKETS,
    threshold: int = SAMPLE_THRESHOLD,
    portable: bool = False,
) -> Column:
    """Predicate form of the entity sample: a filter on the scan, without join or shuffle."""
    return hash_bucket(entity, buckets, portable) < threshold


def sample_entities(
    df: DataFrame,
    entity: str,
    buckets: int = SAMPLE_BUCKETS,
    threshold: int = SAMPLE_THRESHOLD,
    portable: bool = False,
) -> DataFrame:
    """The different entities of the sample. Filtered before the shuffle of `distinct`."""
    key = F.col(entity)
    chosen = key.isNotNull() & in_sample(key, buckets, threshold, portable)
    return df.select(entity).where(chosen).distinct()


def sample_parameters(ids: DataFrame, buckets: int, threshold: int) -> DataFrame:
    """The one-row record that is stored with a sample."""
    return ids.agg(
        F.lit(buckets).alias("buckets"),
        F.lit(threshold).alias("threshold"),
        F.lit(threshold / buckets).alias("fraction"),
        F.count("*").alias("n_entities"),
    )


def sample_rows(
    df: DataFrame,
    n: int,
    keys: Sequence[str],
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """Exactly `n` rows (all, when there are fewer), chosen by the hash of their keys.

    The keys must tell rows apart. A first pass counts the rows per range of
    the hash (a fixed number of ranges) to find the range in which the sample
    ends. Rows below it are taken by a filter; only the rows of that one range
    are sorted, so no task ever sorts the table or the whole sample.
    """
    order = hash_order([F.col(k) for k in keys], seed, portable)
    hashed = df.withColumn("_order", order)
    bin_of = F.shiftright("_order", ORDER_BITS - _BIN_BITS)
    counts = hashed.groupBy(bin_of.alias("bin")).count().orderBy("bin").collect()
    taken, edge = 0, None
    for row in counts:  # at most 2 ** _BIN_BITS rows
        if taken + row["count"] > n:
            edge = row["bin"]
            break
        taken += row["count"]
    if edge is None:
        return df
    below = hashed.where(bin_of < edge)
    rest = hashed.where(bin_of == edge).orderBy("_order", *keys).limit(n - taken)
    return below.unionByName(rest).drop("_order")


def sample_strata(
    df: DataFrame,
    strata: Sequence[str],
    n: int,
    keys: Sequence[str],
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """The `n` rows of every stratum (all, if fewer) whose keys have the smallest hashes.

    A reservoir that can be merged: the sample of several parts' samples is the
    sample of the whole, whatever the parts. Each task keeps n rows per stratum
    before the shuffle, so a stratum with most of the rows costs no more than
    others. The keys must tell rows apart.
    """
    order = Window.partitionBy(*strata).orderBy("_order", *keys)
    hashed = df.withColumn("_order", hash_order([F.col(k) for k in keys], seed, portable))
    placed = hashed.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
    return placed.drop("_order", "_place")


def split_rows(
    df: DataFrame,
    keys: Sequence[str],
    train_percent: int = 80,
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """`df` with a column `part`, 'train' or 'validation', fixed by the keys and the seed."""
    order = hash_order([F.col(k) for k in keys], seed, portable)
    in_train = F.pmod(order, F.lit(100).cast("bigint")) < train_percent
    return df.withColumn("part", F.when(in_train, "train").otherwise("validation"))
