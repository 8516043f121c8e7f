"""Exact silhouette with Euclidean distance.

All distances between n points cannot be avoided for the Euclidean form, but
they need not exist at once: points are hashed into blocks, every pair of
blocks is met once, in tiles of matrix arithmetic, and gives one row of
distance sums for each of its points. A point is sent once to every block, so
blocks are few: MIN_BLOCKS of them, up to as many rows as a block may hold, and
what is sent grows with the rows alone. Memory per pair of blocks is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.lloyd import SLOT_SCHEMA, matrix, packed, slots, squared_distances
from cohortloom.operators.sampling import sample_strata
from cohortloom.operators.tidy import broadcast_rows

# Rows of a tile, and of a block while there are fewer than MIN_BLOCKS.
BLOCK_ROWS = 1024
MIN_BLOCKS = 16
# Doubles of a block at most: 65,536 rows of 64 components.
BLOCK_VALUES = 1 << 22
# Above this the distances of all pairs are refused unless asked for.
MAX_EXACT_ROWS = 1_000_000


def _distance_sums(n_clusters: int):
    """Task body: for each point of a pair of blocks, its summed distances to the other block's per cluster.

    `n_clusters` is the number of (labelling, cluster) slots; `slots` holds
    for every point one slot per labelling.
    """

    def side(table: pa.Table):
        x = matrix(table.column("x").combine_chunks())
        member = np.zeros((len(x), n_clusters))
        slots = matrix(table.column("slots").combine_chunks()).astype(int)
        np.put_along_axis(member, slots, 1.0, axis=1)
        return x, member

    def body(pair: pa.Table) -> pa.Table:
        of = pair.column("block").to_numpy()
        number = pair.column("a")[0].as_py(), pair.column("b")[0].as_py()
        same = number[0] == number[1]
        left = pair.filter(pa.array(of == number[0]))
        right = left if same else pair.filter(pa.array(of == number[1]))
        a, of_a = side(left)
        b, of_b = (a, of_a) if same else side(right)
        if same:
            points = left.column("point").to_numpy()
        middle = a.mean(axis=0) if len(a) else 0.0
        a = a - middle
        b = a if same else b - middle
        long_a, long_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
        sums_a, sums_b = np.zeros((len(a), n_clusters)), np.zeros((len(b), n_clusters))
        for i in range(0, len(a), BLOCK_ROWS):
            rows = slice(i, i + BLOCK_ROWS)
            for j in range(i if same else 0, len(b), BLOCK_ROWS):
                others = slice(j, j + BLOCK_ROWS)
                far = a[rows] @ b[others].T
                far *= -2.0
                far += long_a[rows, None]
                far += long_b[None, others]
                np.sqrt(np.maximum(far, 0.0, out=far), out=far)
                if same:
                    far[points[rows][:, None] == points[others][None, :]] = 0.0
                sums_a[rows] += far @ of_b[others]
                if not same or j > i:  # a tile of the diagonal has both directions
                    sums_b[others] += far.T @ of_a[rows]
        parts = [(left, sums_a + sums_b)] if same else [(left, sums_a), (right, sums_b)]
        return pa.concat_tables(
            pa.table([t.column("point"), t.column("slots"), lists(sums)], ["point", "slots", "sums"])
            for t, sums in parts
        )

    def lists(sums: np.ndarray) -> pa.Array:
        ends = np.arange(len(sums) + 1, dtype=np.int32) * n_clusters
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))

    return body


def _as_array(features: str | Sequence[str]):
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def _blocks(n: int, first, block_rows: int | None) -> int:
    """The number of blocks for n rows, of which `first` holds the number of components."""
    if block_rows is not None:
        return max(1, math.ceil(n / block_rows))
    most = max(BLOCK_ROWS, BLOCK_VALUES // max(first[0], 1)) if first else BLOCK_ROWS
    return max(1, min(MIN_BLOCKS, math.ceil(n / BLOCK_ROWS)), math.ceil(n / most))


def silhouette_squared(df: DataFrame, features: str | Sequence[str], label: str) -> float:
    """Mean silhouette with squared Euclidean distance, over all rows in linear time.

    A different number from `silhouette`; the two must not be compared.
    """
    rows = df.dropna(subset=[label]).select(
        array_to_vector(_as_array(features)).alias("features"),
        F.col(label).cast("double").alias("prediction"),
    )
    return ClusteringEvaluator().evaluate(rows)


def silhouette(
    df: DataFrame,
    key: str,
    features: str | Sequence[str],
    labels: Sequence[str],
    block_rows: int | None = None,
    per_point: bool = False,
    max_rows: int | None = MAX_EXACT_ROWS,
) -> DataFrame:
    """Mean silhouette of each labelling: rows `(labelling, n_clusters, silhouette)`.

    `features` is an array column or a list of numeric columns; `labels` are
    label columns. The distances are computed once for all labellings. Blocks
    have about `block_rows` rows, by default as many as keep what is sent and
    held within bounds. The key identifies a row. A point alone in its cluster scores 0. `per_point`
    returns `(key, labelling, cluster, silhouette)` instead. The input is read
    several times: pass a stored table. Tables of more than `max_rows` rows are
    an error, as the work grows with their square: `silhouette_estimate` is for
    them. None lifts the bound.
    """
    df = df.dropna(subset=list(labels))
    # Clusters per labelling: a small report. It gives every (labelling,
    # cluster) its slot in the vector of distance sums.
    cells = F.array(
        *[F.struct(F.lit(c).alias("labelling"), F.col(c).alias("cluster")) for c in labels]
    )
    sizes = df.select(F.inline(cells)).groupBy("labelling", "cluster").count()
    sizes = sizes.orderBy("labelling", "cluster").collect()
    slot_of = {(r["labelling"], r["cluster"]): i for i, r in enumerate(sizes)}
    n = sum(r["count"] for r in sizes if r["labelling"] == labels[0])
    if max_rows is not None and n > max_rows:
        raise ValueError(f"{n} rows are too many for all pairs; use silhouette_estimate, or max_rows=None")
    blocks = _blocks(n, df.select(F.size(_as_array(features))).first(), block_rows)

    def slot(c: str):
        known = [(v, i) for (labelling, v), i in slot_of.items() if labelling == c]
        pairs = [F.lit(part) for v, i in known for part in (v, i)]
        return F.create_map(*pairs)[F.col(c)] if pairs else F.lit(None).cast("int")

    points = df.select(
        F.col(key).alias("point"),
        _as_array(features).alias("x"),
        F.array(*[slot(c) for c in labels]).alias("slots"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"),
    )
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = points.withColumn("other", every_block)
    pairs = met.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    dtype = dict(points.dtypes)["point"]
    sums = pairs.drop("other").groupBy("a", "b").applyInArrow(
        _distance_sums(len(slot_of)), f"point {dtype}, slots array<int>, sums array<double>"
    )
    described = [
        (slot_of[(r["labelling"], r["cluster"])], r["labelling"], r["cluster"], r["count"])
        for r in sizes
    ]
    cluster_type = dict(df.dtypes)[labels[0]]
    slots = broadcast_rows(
        df, described, f"slot int, labelling string, cluster {cluster_type}, size bigint"
    )
    per_slot = (
        sums.select("point", "slots", F.posexplode("sums").alias("slot", "distance"))
        .groupBy("point", "slot", F.array_contains("slots", F.col("slot")).alias("is_own"))
        .agg(F.sum("distance").alias("distance"))
        .join(slots, "slot")
    )
    is_own = F.col("is_own")
    scored = per_slot.groupBy("point", "labelling").agg(
        F.max(F.when(is_own, F.col("cluster"))).alias("own"),
        F.max(F.when(is_own, F.col("size"))).alias("own_size"),
        F.max(F.when(is_own, F.try_divide(F.col("distance"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~is_own, F.col("distance") / F.col("size"))).alias("b"),
    )
    width = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    score = F.when(F.col("own_size") > 1, F.coalesce(width, F.lit(0.0))).otherwise(0.0)
    per_row = scored.select(
        F.col("point").alias(key), "labelling", F.col("own").alias("cluster"), score.alias("silhouette")
    )
    if per_point:
        return per_row
    counts = slots.groupBy("labelling").agg(F.count("*").alias("n_clusters"))
    means = per_row.groupBy("labelling").agg(F.avg("silhouette").alias("silhouette"))
    return means.join(counts, "labelling").select("labelling", "n_clusters", "silhouette")


def silhouette_estimate(
    df: DataFrame,
    key: str,
    features: str | Sequence[str],
    label: str,
    per_cluster: int = 200,
    seed: int = 42,
) -> DataFrame:
    """Euclidean silhouette from a sample of each cluster: (cluster, n_rows, n_sampled, silhouette, std_error).

    The sampled rows' silhouettes are exact: every row of the table adds its
    distances to them, in one linear pass. Only the mean over a cluster is an
    estimate, with the standard error of a sample without replacement (0 where a
    cluster is taken whole). The row with cluster NULL is the mean over all rows.
    Rows without a label take no part. The sample, `per_cluster` rows for each of
    the clusters, is held by the driver and every task. The key identifies a row;
    pass a stored table.
    """
    spark = df.sparkSession
    rows = df.dropna(subset=[label]).select(
        F.col(key).alias("key"), _as_array(features).alias("x"), F.col(label).alias("cluster")
    )
    sizes = rows.groupBy("cluster").count().orderBy("cluster").collect()
    number = {r["cluster"]: i for i, r in enumerate(sizes)}
    schema = f"cluster {dict(df.dtypes)[label]}, n_rows bigint, n_sampled bigint, silhouette double, std_error double"
    if not sizes:
        return spark.createDataFrame([], schema)
    taken = sample_strata(rows, ["cluster"], per_cluster, ["key"], seed).collect()
    middle = np.mean([r["x"] for r in taken], axis=0)
    points = np.array([r["x"] for r in taken]) - middle
    own = np.array([number[r["cluster"]] for r in taken])
    n, s = len(sizes), len(taken)
    sent = spark.sparkContext.broadcast((points, middle, number))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, middle, number = sent.value
        whole = np.zeros((n, s))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                far = np.sqrt(squared_distances(matrix(part.column(0)) - middle, points))
                member = np.zeros((part.num_rows, n))
                member[np.arange(part.num_rows), [number[c] for c in part.column(1).to_pylist()]] = 1.0
                whole += member.T @ far
        yield packed(whole.ravel())

    total = slots(rows.select("x", "cluster").mapInArrow(add, SLOT_SCHEMA), n * s).reshape(n, s)
    size = np.array([r["count"] for r in sizes], float)
    mine = np.arange(n)[:, None] == own
    inside = (total * mine).sum(axis=0) / np.maximum(size[own] - 1, 1)
    outside = np.where(mine, np.inf, total / size[:, None]).min(axis=0) if n > 1 else inside
    widest = np.maximum(inside, outside)
    score = np.where((widest > 0) & (size[own] > 1), (outside - inside) / np.where(widest > 0, widest, 1), 0.0)
    found, mean, variance = [], 0.0, 0.0
    for r, i in zip(sizes, range(n)):
        part = score[own == i]
        left = 1.0 - len(part) / size[i]
        error = math.sqrt(part.var(ddof=1) / len(part) * max(left, 0.0)) if len(part) > 1 else 0.0
        found.append((r["cluster"], int(size[i]), len(part), float(part.mean()), error))
        weight = size[i] / size.sum()
        mean, variance = mean + weight * float(part.mean()), variance + (weight * error) ** 2
    found.append((None, int(size.sum()), s, float(mean), math.sqrt(variance)))
    return spark.createDataFrame(found, schema)
