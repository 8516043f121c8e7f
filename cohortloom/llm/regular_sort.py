"""Exact ranks by parallel sorting with regular samples.

Every partition sorts its rows (a run) and gives every w-th of them. The samples of
all runs, sorted, give splitters at regular places. Rows go to the segment between
two splitters that they belong to, segments are sorted locally, and the counts of
the segments before give every row its exact rank. Between two samples of a run lie
w - 1 rows, so a segment of s samples cannot hold more than (s + runs) * w rows,
whatever the keys are.

Only segments that reach into the wanted ranks are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import materialise

# Samples per segment or run, whichever are more.
OVERSAMPLING = 16
SEGMENT_ROWS = 4_000_000


def _regular_samples(rows: DataFrame, keys: Sequence[str], step: int) -> np.ndarray:
    """Every step-th row of every sorted run, as an array (samples, keys)."""
    names = list(keys)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            first = (step - 1 - seen) % step
            seen += batch.num_rows
            yield batch.take(pa.array(np.arange(first, batch.num_rows, step)))

    schema = ", ".join(f"`{n}` long" for n in names)
    found = rows.select(*names).sortWithinPartitions(*names).mapInArrow(pick, schema).toArrow()
    return np.column_stack([c.to_numpy() for c in found.columns]).reshape(-1, len(names))


def splitters(samples: np.ndarray, segments: int) -> np.ndarray:
    """The samples at regular places of their order, one fewer than segments."""
    ordered = samples[np.lexsort(samples.T[::-1])]
    if not len(ordered):
        return ordered
    places = np.arange(1, segments) * len(ordered) // segments
    return ordered[places]


def segment_of(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many splitters are at most each row's keys, by one sort of both."""
    both = np.concatenate((cuts, keys))
    mark = np.arange(len(both)) >= len(cuts)
    order = np.lexsort((mark, *both.T[::-1]))
    before = np.cumsum(~mark[order])
    found = np.empty(len(both), np.int64)
    found[order] = before
    return found[len(cuts) :]


def _with_segments(rows: DataFrame, keys: Sequence[str], cuts: np.ndarray, wanted: str) -> DataFrame:
    """`rows` with `__segment`, -1 where the column `wanted` is false."""
    sent = rows.sparkSession.sparkContext.broadcast(cuts)
    schema = T.StructType([*rows.schema, T.StructField("__segment", T.IntegerType())])
    at = [rows.columns.index(k) for k in keys]
    flag = rows.columns.index(wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, -1, np.int32)
            chosen = np.flatnonzero(batch.column(flag).to_numpy(zero_copy_only=False).astype(bool))
            own = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at])
            found[chosen] = segment_of(own[chosen], sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], schema.names)

    return rows.mapInArrow(place, schema)


def _numbered(rows: DataFrame, keys: Sequence[str], before: np.ndarray, take: int, rank: str) -> DataFrame:
    """Exchanged by segment, sorted, and numbered on from the rows of earlier segments."""
    schema = T.StructType([*rows.schema, T.StructField(rank, T.LongType())])
    at = rows.columns.index("__segment")
    sent = rows.sparkSession.sparkContext.broadcast(before)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_rank: dict[int, int] = {}
        for batch in batches:
            segment = batch.column(at).to_numpy()
            ranks = np.empty(batch.num_rows, np.int64)
            edges = np.flatnonzero(np.diff(segment, prepend=-2, append=-2))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                s = int(segment[a])
                first = next_rank.get(s, int(sent.value[s]) + 1)
                ranks[a:b] = np.arange(first, first + b - a)
                next_rank[s] = first + int(b - a)
            drawn = pa.array(ranks, pa.int64(), mask=ranks > take)
            yield pa.RecordBatch.from_arrays([*batch.columns, drawn], schema.names)

    dealt = rows.repartitionById(max(len(before), 1), F.col("__segment"))
    return dealt.sortWithinPartitions("__segment", *keys).mapInArrow(count, schema)


def exact_ranks(
    rows: DataFrame,
    keys: Sequence[str],
    wanted: str,
    share: tuple[int, int] = (1, 1),
    rank: str = "rank",
    segments: int | None = None,
) -> DataFrame:
    """`rows` with the rank (from 1) of those of the first ones that `share` takes, else NULL.

    `rows` is a stored table. `keys` are columns of whole numbers without NULL,
    compared ascending in turn; they must tell all wanted rows apart. Rows whose
    boolean `wanted` is false or NULL are not ranked. Of n wanted rows the first
    floor(n * share[0] / share[1]) get a rank. The driver sees the samples, about
    sixteen per segment or run, and one count per segment.
    """
    spark = rows.sparkSession
    flagged = rows.withColumn(wanted, F.coalesce(F.col(wanted), F.lit(False)))
    chosen = flagged.filter(wanted)
    per_run = chosen.select(F.spark_partition_id().alias("run")).groupBy("run").count()
    facts = per_run.agg(F.sum("count").alias("n"), F.count("*").alias("runs")).first()
    n, runs = facts["n"] or 0, max(facts["runs"], 1)
    take = n * share[0] // share[1]
    if not take:
        return rows.withColumn(rank, F.lit(None).cast("long"))
    if segments is None:
        dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
        segments = max(dealt, -(-n // SEGMENT_ROWS))
    step = max(1, n // (OVERSAMPLING * max(segments, runs)))
    cuts = splitters(_regular_samples(chosen, keys, step), segments)
    placed = materialise(_with_segments(flagged, keys, cuts, wanted), "segments")
    sizes = np.zeros(len(cuts) + 1, np.int64)
    for segment, size in placed.filter("__segment >= 0").groupBy("__segment").count().collect():
        sizes[segment] = size
    before = np.cumsum(sizes) - sizes
    last = int(np.flatnonzero(before < take)[-1])
    reached = F.col("__segment").between(0, last)
    drawn = _numbered(placed.filter(reached), keys, before[: last + 1], take, rank)
    rest = placed.filter(~reached).withColumn(rank, F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*rows.columns, rank)
