"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each quantised by its own k centroids; a
vector lies in the cell of its two centroids. A query visits cells by ascending
sum of the distances of its halves to the cell's centroids: with both lists of
distances sorted, a heap holds the border of the pairs visited so far. It stops
when the visited cells hold the wanted number of entries; their vectors are
compared with the query exactly, in double precision.

For the distances, every vector gets one more component that brings its length
to the longest one, and a query a zero there: the nearest by distance is then
the one with the largest inner product.

Equal vectors are one entry that keeps its smallest ids, as many as an answer can
hold, so a vector met very often costs no more than any other. Cells are joined
to buckets of bounded size for the comparison, and a cell with more entries than
that is spread over several buckets. Queries travel in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.blocks import bounded_batches
from cohortloom.session import materialise


@dataclass
class Index:
    """Centroids of the halves, the square of the longest length, and the entries' cells."""

    first: np.ndarray
    second: np.ndarray
    longest: float
    counts: np.ndarray
    bucket: np.ndarray
    spread: np.ndarray
    n_buckets: int

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)


def _k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        for j in np.flatnonzero(n):
            centres[j] = x[near == j].mean(axis=0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(far, 0)


def _halves(x: np.ndarray, longest: float, query: bool) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
    return x[:, :cut], np.column_stack((x[:, cut:], rest))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def visit_cells(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells by ascending a[i] + b[j] until they hold `wanted` entries."""
    at_a, at_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = np.sort(a).tolist(), np.sort(b).tolist()
    held = counts.tolist()
    heap = [(a[0] + b[0], 0, 0)]
    found, total = [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        cell = at_a[i] * len(b) + at_b[j]
        if held[cell]:
            found.append(cell)
            total += held[cell]
        # (i, j + 1) always follows (i, j); (i + 1, 0) opens the next row.
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def usable(vector: Column) -> Column:
    """Not NULL, and no component NULL or not finite, and not all zero."""
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """Distinct vectors: name (two hashes), vector and up to `most` smallest ids, ascending.

    Vectors of another than the commonest length take no part.
    """
    taken = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    taken = taken.filter(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = taken.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows"))
    top = sizes.orderBy(F.desc("rows"), "n").first()
    taken = taken.filter(F.size("vec") == (top["n"] if top else 0))
    named = taken.select("id", "vec", F.xxhash64("vec").alias("v1"), F.xxhash64(F.lit(1), "vec").alias("v2"))
    # Repeated rows: an id counts once per vector.
    named = named.dropDuplicates(["v1", "v2", "id"])
    place = Window.partitionBy("v1", "v2").orderBy("id")
    few = named.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)
    return few.groupBy("v1", "v2").agg(
        F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")
    )


def build(found: DataFrame, bucket_rows: int, max_sample: int, max_k: int, seed: int) -> Index | None:
    """Centroids from at most `max_sample` entries chosen by hash; cell counts from all."""
    size = found.agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("longest"),
    ).first()
    n = size["n"]
    if not n:
        return None
    steps = 1 << 30
    part = found.filter(F.pmod("v1", F.lit(steps)) <= min(steps, int(max_sample / n * steps) + 1))
    sample = _matrix(part.select("vec").limit(max_sample).toArrow().column(0).combine_chunks())
    if not len(sample):
        sample = _matrix(found.select("vec").limit(max_sample).toArrow().column(0).combine_chunks())
    k = max(2, min(max_k, math.isqrt(n // 2)))
    one, two = _halves(sample, size["longest"], False)
    first, second = _k_means(one, k, 12, seed), _k_means(two, k, 12, seed + 1)
    index = Index(first, second, size["longest"], np.zeros(0), np.zeros(0), np.zeros(0), 0)
    counts = np.zeros(index.cells, np.int64)
    for row in assign(found, index).groupBy("cell").agg(F.count("*").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    # Cells in order fill buckets; a larger cell takes several of its own.
    spread = np.maximum(-(-counts // bucket_rows), 1)
    bucket = np.zeros(index.cells, np.int64)
    at, held = 0, 0
    for cell in range(index.cells):
        if held and (held + counts[cell] > bucket_rows or spread[cell] > 1):
            at, held = at + 1, 0
        bucket[cell] = at
        held += counts[cell]
        if spread[cell] > 1:
            at, held = at + int(spread[cell]), 0
    index.counts, index.bucket, index.spread, index.n_buckets = counts, bucket, spread, at + 1
    return index


def assign(found: DataFrame, index: Index) -> DataFrame:
    """Entries with their cell and, if the index has them, bucket."""
    sent = found.sparkSession.sparkContext.broadcast(index)
    schema = "v1 long, v2 long, vec array<double>, ids array<long>, cell int, bucket int"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = _halves(_matrix(batch.column(2)), index.longest, False)
            cell = _distances(one, index.first).argmin(axis=1) * len(index.second)
            cell += _distances(two, index.second).argmin(axis=1)
            bucket = np.zeros(len(cell), np.int64)
            if len(index.counts):
                own = batch.column(1).to_numpy() % index.spread[cell]
                bucket = index.bucket[cell] + own
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(bucket.astype(np.int32))],
                ["v1", "v2", "vec", "ids", "cell", "bucket"],
            )

    return found.select("v1", "v2", "vec", "ids").mapInArrow(place, schema)


def _visits(queries: DataFrame, index: Index, wanted: int) -> DataFrame:
    """Per batch of queries and bucket visited: the queries' numbers, vectors and cells.

    A row holds the queries of one batch that visit any cell of the bucket, as
    packed arrays: names, vectors, and (query place, cell) pairs.
    """
    sent = queries.sparkSession.sparkContext.broadcast(index)
    schema = "bucket int, names binary, vectors binary, places binary, cells binary"

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                x = _matrix(batch.column(2))
                names = np.column_stack([batch.column(i).to_numpy() for i in (0, 1)])
                one, two = _halves(x, index.longest, True)
                a, b = _distances(one, index.first), _distances(two, index.second)
                seen = [visit_cells(a[i], b[i], index.counts, wanted) for i in range(len(x))]
                place = np.repeat(np.arange(len(x)), [len(s) for s in seen])
                cell = np.concatenate([np.array(s, np.int64) for s in seen])
                # A spread cell lies in several buckets; all of them are visited.
                times = index.spread[cell]
                place, cell = np.repeat(place, times), np.repeat(cell, times)
                ahead = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                bucket = index.bucket[cell] + ahead
                order = np.argsort(bucket, kind="stable")
                place, cell, bucket = place[order], cell[order], bucket[order]
                rows = []
                for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                    own, new = np.unique(place[part], return_inverse=True)
                    rows.append(
                        (
                            int(bucket[part[0]]),
                            names[own].tobytes(),
                            x[own].tobytes(),
                            new.astype(np.int32).tobytes(),
                            cell[part].astype(np.int32).tobytes(),
                        )
                    )
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                    ["bucket", "names", "vectors", "places", "cells"],
                )

    return queries.select("v1", "v2", "vec").mapInArrow(travel, schema)


def _best(scores: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """Columns of the k largest scores of every row, ties to the smaller id, and everything tied at the cut."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above = scores > cut
    tied = scores == cut
    order = np.argsort(ids, kind="stable")
    room = k - above.sum(axis=1, keepdims=True)
    ranked = np.zeros(scores.shape, bool)
    ranked[:, order] = np.cumsum(tied[:, order], axis=1) <= room
    return above | (tied & ranked)


def _compared(visits: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The k best entries of every bucket for every query that visits it."""
    schema = "v1 long, v2 long, score double, ids array<long>"
    joined = visits.join(buckets, "bucket").select(
        "names", "vectors", "places", "cells", "entry_cells", "entry_vecs", "entry_ids"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names, vectors, places, cells = (batch.column(i)[r].as_buffer() for i in range(4))
                names = np.frombuffer(names, np.int64).reshape(-1, 2)
                x = np.frombuffer(vectors, float).reshape(len(names), -1)
                places, cells = np.frombuffer(places, np.int32), np.frombuffer(cells, np.int32)
                entry_cells = batch.column(4)[r].values.to_numpy()
                entry_vecs = _matrix(batch.column(5)[r].values)
                entry_ids = batch.column(6)[r].values
                least = np.array([i[0] for i in entry_ids.to_pylist()])
                scores = np.full((len(x), len(entry_cells)), -np.inf)
                order = np.argsort(cells, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                    inside = np.flatnonzero(entry_cells == cells[part[0]])
                    if len(inside):
                        own = places[part]
                        scores[np.ix_(own, inside)] = x[own] @ entry_vecs[inside].T
                good = _best(scores, k, least) & (scores > -np.inf)
                query, entry = np.nonzero(good)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[query, 0]),
                        pa.array(names[query, 1]),
                        pa.array(scores[query, entry]),
                        entry_ids.take(pa.array(entry)),
                    ],
                    ["v1", "v2", "score", "ids"],
                )

    return joined.mapInArrow(compare, schema)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    fraction: float = 0.7,
    least_entries: int = 0,
    bucket_rows: int = 8192,
    max_sample: int = 20_000,
    max_k: int = 64,
    seed: int = 5,
) -> DataFrame:
    """(query_id, rank, <key>, score): the k rows found nearest to every query row but itself.

    Queries are the rows of `vectors` for which `is_query` holds. A query visits
    cells until they hold `fraction` of all entries, twice the answer's length and
    `least_entries` at least; with a fraction of 1 the result is exact. Nearest first, ties to the smaller
    id, ranks from 1; all candidates if there are fewer than k. NULL and zero
    vectors, those with NULL or non-finite components, and NULL ids take no
    part. Of an id with several vectors each is a candidate and a query. An
    empty table, or one without queries, gives no row.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    found = materialise(entries(vectors, key, vector, k + 1), "entries")
    index = build(found, bucket_rows, max_sample, max_k, seed)
    if index is None:
        empty = "query_id long, rank int, " + f"`{key}` long, score double"
        return spark.createDataFrame([], empty)
    placed = materialise(assign(found, index), "cells")
    asked = vectors.filter(is_query).select(
        F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vec")
    )
    asked = asked.select(
        "query_id", F.xxhash64("vec").alias("v1"), F.xxhash64(F.lit(1), "vec").alias("v2")
    )
    asked = asked.filter("query_id IS NOT NULL").distinct()
    distinct = found.join(asked.select("v1", "v2").distinct(), ["v1", "v2"], "left_semi")
    wanted = max(least_entries, 2 * (k + 1), math.ceil(fraction * int(index.counts.sum())))
    visits = _visits(distinct, index, wanted)
    buckets = placed.groupBy("bucket").agg(
        F.collect_list(F.struct("cell", "vec", "ids")).alias("rows")
    )
    buckets = buckets.select(
        "bucket",
        F.col("rows.cell").alias("entry_cells"),
        F.col("rows.vec").alias("entry_vecs"),
        F.col("rows.ids").alias("entry_ids"),
    )
    hits = materialise(_compared(visits, buckets, k + 1), "hits")
    # Entries of one query: the k + 1 best of all buckets, before ids are listed.
    place = Window.partitionBy("v1", "v2").orderBy(F.desc("score"), F.col("ids")[0])
    hits = hits.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
    answers = asked.join(hits.select("v1", "v2", "score", "ids"), ["v1", "v2"])
    answers = answers.select("query_id", "score", F.explode("ids").alias(key))
    answers = answers.filter(F.col(key) != F.col("query_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    answers = answers.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", key, "score")
