"""k-means segmentation: sweeps over k, comparison of spaces, final fits, assignment."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.evidence import zscore_matrix
from cohortloom.operators.latent import assemble
from cohortloom.operators.lloyd import CentreSet, fit_sets, label, silhouettes
from cohortloom.operators.sampling import sample_rows
from cohortloom.operators.tree import Tree, grow
from cohortloom.session import materialise

# The range of k and the seed of the sweeps.
K_RANGE = range(2, 13)
SEED = 42


def standardise(df: DataFrame, entity: str, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """Key and standardised columns under their old names; population sd by default."""
    return zscore_matrix(df, entity, columns, ddof=ddof, prefix="")


def standard_vectors(df: DataFrame, entity: str, space: str | Sequence[str]) -> DataFrame:
    """Key and `vector`: the standardised space (population sd).

    A space is a list of columns, whose missing values count as the mean, or
    the name of one array column, which is complete.
    """
    if not isinstance(space, str):
        return assemble(standardise(df, entity, space), space).select(entity, "vector")
    raw = df.select(entity, array_to_vector(F.col(space).cast("array<double>")).alias("_raw"))
    n = raw.agg(F.count("_raw")).first()[0]  # reads no more than the fit below does
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)
    model = scaler.fit(raw)  # divides by the sample sd
    stretch = Vectors.dense([math.sqrt(n / (n - 1)) if n > 1 else 1.0] * model.mean.size)
    to_population = ElementwiseProduct(
        scalingVec=stretch, inputCol="_scaled", outputCol="vector"
    )
    return to_population.transform(model.transform(raw)).select(entity, "vector")


def axis_names(space: str | Sequence[str], size: int) -> list[str]:
    return [f"{space}_{i}" for i in range(size)] if isinstance(space, str) else list(space)


def fit_kmeans(vectors: DataFrame, k: int, n_init: int = 1, seed: int = SEED) -> KMeansModel:
    """The best of `n_init` fits by within-cluster cost. `vectors` should be cached or stored."""
    best = None
    for restart in range(n_init):
        model = KMeans(k=k, seed=seed + restart, featuresCol="vector", predictionCol="cluster").fit(
            vectors
        )
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best


def label_with(model: KMeansModel, vectors: DataFrame, output: str = "cluster") -> DataFrame:
    return model.setPredictionCol(output).transform(vectors)


@dataclass(frozen=True)
class Segmentation:
    """Labels `(entity, cluster)` and centroids `(cluster, feature, value)`.

    Clusters are numbered by size, largest first.
    """

    labels: DataFrame
    centroids: DataFrame
    cost: float


def kmeans_fit(
    df: DataFrame,
    entity: str,
    columns: str | Sequence[str],
    k: int,
    n_init: int = 50,
    seed: int = SEED,
) -> Segmentation:
    """Final segmentation of all entities in the standardised space of `columns`."""
    spark = df.sparkSession
    vectors = standard_vectors(df, entity, columns).persist()
    try:
        model = fit_kmeans(vectors, k, n_init, seed)
        sizes = model.summary.clusterSizes
        by_size = sorted(range(len(sizes)), key=lambda c: (-sizes[c], c))
        rank = {old: new for new, old in enumerate(by_size)}
        renumber = F.create_map(*[F.lit(v) for pair in rank.items() for v in pair])
        labels = label_with(model, vectors).select(
            entity, renumber[F.col("cluster")].cast("int").alias("cluster")
        )
        labels = materialise(labels, "labels")
        centers = [
            (rank[i], name, float(value))
            for i, center in enumerate(model.clusterCenters())
            for name, value in zip(axis_names(columns, len(center)), center)
        ]
        cost = float(model.summary.trainingCost)
    finally:
        vectors.unpersist()
    centroids = spark.createDataFrame(centers, "cluster int, feature string, value double")
    return Segmentation(labels, centroids, cost)


@dataclass(frozen=True)
class Sweep:
    """All spaces' rows (space, key, x), the best fit of every space and k, and the report."""

    points: DataFrame
    fits: dict[tuple[str, int], CentreSet]
    report: DataFrame

    def labels(self, space: str, k: int, entity: str) -> DataFrame:
        """(entity, cluster) by the fit of the sweep itself, clusters numbered by size."""
        fit = self.fits[space, k]
        by_size = sorted(range(fit.k), key=lambda c: (-fit.counts[c], c))
        own = self.points.where(F.col("space") == space)
        return label(own, fit.centres[by_size], entity, dict(own.dtypes)["key"])


def space_points(
    df: DataFrame, entity: str, columns: str | Sequence[str], space: str, fit_n: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Rows (space, key, x) of a standardised space; `fit_n` takes that many sampled rows."""
    chosen = df.select(entity, *([columns] if isinstance(columns, str) else columns))
    if fit_n is not None:
        chosen = sample_rows(chosen, fit_n, [entity], seed)
    vectors = standard_vectors(chosen, entity, columns)
    return vectors.select(
        F.lit(space).alias("space"), F.col(entity).alias("key"), vector_to_array("vector").alias("x")
    )


def sweep(
    spaces: dict[str, tuple[DataFrame, str | Sequence[str]]],
    entity: str,
    ks: Iterable[int] = K_RANGE,
    n_init: int = 3,
    seed: int = SEED,
    fit_n: int | None = None,
) -> Sweep:
    """k-means for every space and k over all rows, all fits moved on in the same passes.

    The silhouette uses squared Euclidean distances, whose mean over a cluster
    follows from the cluster's sums: every row is scored, for all fits in one pass.
    The report has rows `(space, k, silhouette, cost, n_scored)`.
    """
    rows = [space_points(t, entity, columns, s, fit_n, seed) for s, (t, columns) in spaces.items()]
    points = materialise(reduce(DataFrame.unionByName, rows), "sweep")
    ks = list(ks)
    fits = fit_sets(points, list(spaces), ks, n_init, seed)
    order = list(fits)
    scores = silhouettes(points, [fits[o] for o in order]) if order else []
    report = [
        (space, k, score, fits[space, k].cost, int(fits[space, k].counts.sum()))
        for (space, k), score in zip(order, scores)
    ]
    schema = "space string, k int, silhouette double, cost double, n_scored bigint"
    return Sweep(points, fits, points.sparkSession.createDataFrame(report, schema))


def silhouette_sweep(
    df: DataFrame,
    entity: str,
    columns: str | Sequence[str],
    space: str = "space",
    ks: Iterable[int] = K_RANGE,
    n_init: int = 3,
    seed: int = SEED,
    fit_n: int | None = None,
) -> DataFrame:
    """The report of `sweep` for one space. `fit_n` fits and scores that many sampled rows."""
    return sweep({space: (df, columns)}, entity, ks, n_init, seed, fit_n).report


def compare_spaces(
    spaces: dict[str, tuple[DataFrame, Sequence[str]]], entity: str, **options
) -> DataFrame:
    """The sweep of every space, one under the other. A space is a table and its columns."""
    return sweep(spaces, entity, **options).report


def best_per_group(
    report: DataFrame, group: str = "space", score: str = "silhouette", tie: str = "k"
) -> DataFrame:
    """The best row of each group, best group first; ties go to the smaller k."""
    best = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return (
        report.withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") == 1)
        .drop("_place")
        .orderBy(F.desc(score), group)
    )


def winner(report: DataFrame) -> tuple[str, int]:
    """Space and k with the best silhouette. Reads one row."""
    row = best_per_group(report).first()
    return row["space"], row["k"]


def grow_tree(
    df: DataFrame, entity: str, columns: str | Sequence[str], k: int, seed: int = SEED
) -> tuple[DataFrame, Tree]:
    """The standardised rows (space, key, x), stored, and their cluster tree with k leaves."""
    points = materialise(space_points(df, entity, columns, "tree"), "tree")
    return points, grow(points, k, seed)


def bisecting_sweep(
    df: DataFrame,
    entity: str,
    columns: Sequence[str],
    ks: Iterable[int] = K_RANGE,
    seed: int = SEED,
) -> DataFrame:
    """Divisive clustering of all rows: rows `(k, n_leaves, cost)` down one tree, cut at every k."""
    ks = list(ks)
    _, tree = grow_tree(df, entity, columns, max(ks), seed)
    rows = []
    for k in ks:
        splits = tree.splits(k - 1)
        leaves = {1} if tree.nodes else set()
        for node in splits:
            leaves = (leaves - {node.name}) | set(node.children)
        rows.append((k, len(leaves), float(sum(tree.nodes[n].cost for n in leaves))))
    return df.sparkSession.createDataFrame(rows, "k int, n_leaves int, cost double")


def centroids_of(df: DataFrame, features: str, label: str) -> DataFrame:
    """Mean vector of each cluster of an array column: rows `(cluster, center)`."""
    vector = array_to_vector(F.col(features).cast("array<double>"))
    means = df.groupBy(F.col(label).alias("cluster")).agg(Summarizer.mean(vector).alias("m"))
    return means.select("cluster", vector_to_array("m").alias("center"))


def centroid_silhouette(df: DataFrame, features: str, label: str) -> DataFrame:
    """`df` with `own`, `other` and `silhouette`: Euclidean distances to centroids.

    own is the distance to the mean of the row's cluster, other that to the
    nearest other mean, and the silhouette (other - own) / max(own, other), 0
    where both are 0 or the cluster is the only one. Linear in the rows; the
    exact form over all pairs is in `silhouette`.
    """
    table = centroids_of(df, features, label)
    table = table.agg(F.collect_list(F.struct("cluster", "center")).alias("c")).scalar()
    x = F.col(features)

    def distance(center):
        gaps = F.zip_with(x, center, lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g))

    def to(wanted):
        picked = F.filter("_centroids", wanted)
        return F.array_min(F.transform(picked, lambda c: distance(c["center"])))

    found = df.withColumn("_centroids", table)
    found = found.withColumn("own", to(lambda c: c["cluster"] == F.col(label)))
    found = found.withColumn("other", to(lambda c: c["cluster"] != F.col(label)))
    width = F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other"))
    return found.withColumn("silhouette", F.coalesce(width, F.lit(0.0))).drop("_centroids")


def nearest_centroid(
    df: DataFrame, features: str, centroids: DataFrame, output: str = "cluster"
) -> DataFrame:
    """`df` with the nearest centroid and the distance to it; ties go to the smaller cluster.

    The centroids, one row per cluster, reach every task as one constant
    (a scalar subquery); rows are neither joined nor multiplied.
    """
    table = centroids.agg(F.collect_list(F.struct("cluster", "center")).alias("c")).scalar()
    x = F.col(features)

    def squared(center):
        gaps = F.zip_with(x, center, lambda a, b: (a - b) * (a - b))
        return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)

    options = F.transform(
        F.col("_centroids"),
        lambda c: F.struct(F.sqrt(squared(c["center"])).alias("distance"), c["cluster"].alias("cluster")),
    )
    return (
        df.withColumn("_centroids", table)
        .withColumn("_best", F.array_min(options))
        .withColumn(output, F.col("_best.cluster"))
        .withColumn("distance", F.col("_best.distance"))
        .drop("_centroids", "_best")
    )
