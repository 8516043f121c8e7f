"""Distinct entities at every level of time without reading the panel again.

Exact: every entity gets a dense number once; the entities of a cell (a quarter and a
cluster, say) are a set of bits, cut into pieces of fixed size. Pieces of several cells
are united by OR, so a year, or the whole time, costs a pass over the pieces only, and
a late quarter adds its own.

Approximate: one small sketch per cell, united in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.tidy import broadcast_rows

# Numbers within one piece of 2 ** 15 bits (Spark's bitmap functions fix this size).
NUMBERING_BUCKETS = 1024
SKETCH_BITS = 12
# Fixed value: the standard error of a united sketch with m = 2 ** bits registers is 1.04 / sqrt(m).
SKETCH_ERROR = 1.04


def dense_numbers(entities: DataFrame, entity: str, buckets: int = NUMBERING_BUCKETS) -> DataFrame:
    """(entity, number) with the numbers 1..n of the different present entities.

    Entities are numbered within hash buckets, and every bucket starts where the
    one before ended: no task sorts all entities. The driver sees one count per
    bucket. Store the result: later entities may be given higher numbers, those
    in use must stay.
    """
    bucket = F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")
    found = entities.select(entity).where(F.col(entity).isNotNull()).distinct()
    placed = found.withColumn("_bucket", bucket)
    order = Window.partitionBy("_bucket").orderBy(entity)
    placed = placed.withColumn("_place", F.row_number().over(order))
    starts, before = [], 0
    for row in found.groupBy(bucket.alias("b")).count().orderBy("b").collect():
        starts.append((row["b"], before))
        before += row["count"]
    table = broadcast_rows(entities, starts, "_bucket int, _start bigint")
    number = (F.col("_start") + F.col("_place")).alias("number")
    return placed.join(table, "_bucket").select(entity, number)


def bitmaps(rows: DataFrame, number: str, keys: Sequence[str]) -> DataFrame:
    """(keys..., piece, bits): the numbers met in every cell, one row per piece with any."""
    piece = F.bitmap_bucket_number(F.col(number)).alias("piece")
    bit = F.bitmap_bit_position(F.col(number))
    return rows.where(F.col(number).isNotNull()).groupBy(*keys, piece).agg(
        F.bitmap_construct_agg(bit).alias("bits")
    )


def united(pieces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The pieces of coarser cells: fewer keys than before."""
    return pieces.groupBy(*keys, "piece").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(pieces: DataFrame, keys: Sequence[str] = (), name: str = "n_entities") -> DataFrame:
    """The number of different entities of every cell."""
    n = F.sum(F.bitmap_count(F.col("bits"))).alias(name)
    return united(pieces, keys).groupBy(*keys).agg(n)


def distinct_levels(
    pieces: DataFrame, levels: Sequence[Sequence[str]], keys: Sequence[str], name: str = "n_entities"
) -> DataFrame:
    """Counts at several levels, one under the other; keys that a level lacks are NULL."""
    types = dict(pieces.dtypes)
    found = None
    for level in levels:
        own = counted(pieces, list(level), name)
        shown = [F.col(k) if k in level else F.lit(None).cast(types[k]).alias(k) for k in keys]
        own = own.select(F.lit("+".join(level) or "all").alias("level"), *shown, name)
        found = own if found is None else found.unionByName(own)
    return found


def distinct_sketches(rows: DataFrame, entity: str, keys: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """(keys..., sketch, n_rows): a distinct-count sketch of every cell."""
    return rows.groupBy(*keys).agg(
        F.hll_sketch_agg(F.col(entity), F.lit(bits)).alias("sketch"), F.count("*").alias("n_rows")
    )


def sketched(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., estimate, n_rows) of coarser cells, from stored sketches."""
    return sketches.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"),
        F.sum("n_rows").alias("n_rows"),
    )


def within_error(estimate: Column, exact: Column, bits: int = SKETCH_BITS, deviations: float = 4.0) -> Column:
    """Whether an estimate lies within so many standard errors of the exact count."""
    error = SKETCH_ERROR / (2.0 ** (bits / 2))
    return F.abs(estimate - exact) <= F.lit(deviations * error) * exact + 0.5
