"""Covariances, principal components, rotated factors and reconstruction error.

The passes over the rows run on Spark (`pyspark.ml`); only matrices with one
row and column per feature reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.functions.numeric import linear_combination, total
from cohortloom.operators.evidence import impute_mean, zscore_matrix

_MATRIX_SCHEMA = "feature_a string, feature_b string, {value} double"


def assemble(df: DataFrame, columns: Sequence[str], output: str = "vector") -> DataFrame:
    """Columns packed into one vector column; a missing value is an error."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def _long_matrix(spark: SparkSession, names: Sequence[str], matrix, value: str) -> DataFrame:
    rows = [
        (a, b, None if np.isnan(matrix[i, j]) else float(matrix[i, j]))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return spark.createDataFrame(rows, _MATRIX_SCHEMA.format(value=value))


def _correlate(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix of a vector column (NaN beside a constant) and population sds."""
    summary = vectors.select(
        Summarizer.metrics("std", "count").summary(F.col("vector")).alias("s")
    ).select("s.std", "s.count")
    found = summary.first()
    n = found["count"]
    sd = found["std"].toArray() * np.sqrt((n - 1) / n)
    matrix = Correlation.corr(vectors, "vector").first()[0].toArray()
    constant = sd == 0
    matrix[constant, :] = np.nan
    matrix[:, constant] = np.nan
    return matrix, sd


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], impute: bool = True
) -> DataFrame:
    """Rows `(feature_a, feature_b, r)`; NULL beside a constant feature.

    Reads the rows several times: pass a stored table rather than a long plan.
    """
    filled = impute_mean(df.select(*columns), columns) if impute else df.select(*columns)
    matrix, _ = _correlate(assemble(filled, columns))
    return _long_matrix(df.sparkSession, columns, matrix, "r")


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population covariances as rows `(feature_a, feature_b, cov)`.

    Computed from the correlations and the population standard deviations, so
    that large means do not cancel digits.
    """
    matrix, sd = _correlate(assemble(df.select(*columns), columns))
    scaled = np.nan_to_num(matrix, nan=0.0) * np.outer(sd, sd)
    return _long_matrix(df.sparkSession, columns, scaled, "cov")


def covariance_to_correlation(cov: DataFrame) -> DataFrame:
    """Covariance rows to correlation rows; NULL where a variance is 0."""
    diagonal = cov.where(F.col("feature_a") == F.col("feature_b"))
    left = diagonal.select("feature_a", F.col("cov").alias("_va"))
    right = diagonal.select("feature_b", F.col("cov").alias("_vb"))
    spread = F.sqrt(F.col("_va") * F.col("_vb"))
    return (
        cov.join(left, "feature_a")
        .join(right, "feature_b")
        .select("feature_a", "feature_b", F.try_divide(F.col("cov"), spread).alias("r"))
    )


def implied_correlation(loadings: DataFrame) -> DataFrame:
    """Correlations that a loading table `(feature, component, loading)` implies.

    Off the diagonal the sum over components of the products of two loadings;
    on the diagonal 1, the rest being each feature's own variance.
    """
    a = loadings.select(F.col("feature").alias("feature_a"), "component", F.col("loading").alias("la"))
    b = loadings.select(F.col("feature").alias("feature_b"), "component", F.col("loading").alias("lb"))
    shared = F.sum(F.col("la") * F.col("lb"))
    same = F.col("feature_a") == F.col("feature_b")
    return (
        a.join(b, "component")
        .groupBy("feature_a", "feature_b")
        .agg(shared.alias("_s"))
        .select("feature_a", "feature_b", F.when(same, 1.0).otherwise(F.col("_s")).alias("r"))
    )


def srmr(observed: DataFrame, implied: DataFrame) -> DataFrame:
    """sqrt(2 / (p (p + 1)) * sum of squared differences over pairs i <= j); one row."""
    other = implied.select("feature_a", "feature_b", F.col("r").alias("_r"))
    upper = observed.join(other, ["feature_a", "feature_b"]).where(
        F.col("feature_a") <= F.col("feature_b")
    )
    p = F.count_distinct("feature_a")
    squares = F.sum(F.pow(F.coalesce(F.col("r") - F.col("_r"), F.lit(0.0)), 2))
    return upper.agg(
        p.alias("n_features"), F.sqrt(F.try_divide(squares * 2.0, p * (p + 1))).alias("srmr")
    )


@dataclass(frozen=True)
class PcaFit:
    """Principal components of standardised features.

    `weights` has one row per feature and one column per component; `signs`
    turns each component so that its largest loading is positive.
    """

    model: PCAModel
    features: list[str]
    weights: np.ndarray
    signs: np.ndarray
    ratios: np.ndarray

    @property
    def k(self) -> int:
        return self.weights.shape[1]


def component_signs(weights: np.ndarray) -> np.ndarray:
    """+1 or -1 per column, such that the first of the largest entries becomes positive."""
    size = np.abs(weights)
    leading = (size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
    return np.where(weights[leading, np.arange(weights.shape[1])] < 0, -1.0, 1.0)


def fit_pca(z: DataFrame, columns: Sequence[str], k: int | None = None) -> PcaFit:
    """Components of standardised (and so centred) columns. Two passes over the rows."""
    columns = list(columns)
    k = min(k or len(columns), len(columns))
    vectors = assemble(z.select(*columns), columns)
    model = PCA(k=k, inputCol="vector", outputCol="component").fit(vectors)
    raw = model.pc.toArray()
    signs = component_signs(raw)
    return PcaFit(model, columns, raw * signs, signs, model.explainedVariance.toArray())


def component_names(k: int, prefix: str = "PC") -> list[str]:
    return [f"{prefix}{i + 1}" for i in range(k)]


def cumulative(table: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> Column:
    """Running total of a value over a report with one row per component."""
    window = Window.partitionBy(*by).orderBy(order)
    return F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))


def explained_variance(spark: SparkSession, fit: PcaFit, name: str = "pca") -> DataFrame:
    """Rows `(model, component, pve, pve_cum)`."""
    rows = [(name, i + 1, float(r)) for i, r in enumerate(fit.ratios)]
    table = spark.createDataFrame(rows, "model string, component int, pve double")
    return table.withColumn("pve_cum", cumulative(table, "pve", "component", ["model"]))


def loading_table(
    spark: SparkSession, weights: np.ndarray, features: Sequence[str], prefix: str = "PC"
) -> DataFrame:
    """A loading matrix as rows `(feature, component, loading)`."""
    names = component_names(weights.shape[1], prefix)
    rows = [
        (f, c, float(weights[i, j]))
        for i, f in enumerate(features)
        for j, c in enumerate(names)
    ]
    return spark.createDataFrame(rows, "feature string, component string, loading double")


def pca_loadings(spark: SparkSession, fit: PcaFit) -> DataFrame:
    return loading_table(spark, fit.weights, fit.features)


def pca_scores(z: DataFrame, entity: str, fit: PcaFit, m: int | None = None) -> DataFrame:
    """Key and component scores PC1..PCm. The projection runs inside the JVM."""
    names = component_names(m or fit.k)
    projected = fit.model.transform(assemble(z, fit.features))
    values = vector_to_array("component")
    return projected.select(
        entity, *[(values[i] * F.lit(float(fit.signs[i]))).alias(n) for i, n in enumerate(names)]
    )


def loading_norms(loadings: DataFrame, components: Sequence[str] | None = None) -> DataFrame:
    """Length of each feature's loadings over the chosen components, largest first."""
    if components is not None:
        loadings = loadings.where(F.col("component").isin(*components))
    return (
        loadings.groupBy("feature")
        .agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("loading_norm"))
        .orderBy(F.desc("loading_norm"), "feature")
    )


def compare_feature_sets(
    features: DataFrame, entity: str, sets: dict[str, Sequence[str]], k: int = 20
) -> DataFrame:
    """Explained variance of several feature sets, one under the other."""
    spark = features.sparkSession
    reports = None
    for name, columns in sets.items():
        z = zscore_matrix(features, entity, columns)
        fit = fit_pca(z, [f"z_{c}" for c in columns], k)
        report = explained_variance(spark, fit, name)
        reports = report if reports is None else reports.unionByName(report)
    return reports


def varimax_rotation(loadings: np.ndarray, sweeps: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Orthogonal matrix that makes the loadings simple (varimax, rows normalised).

    Kaiser's planar form: every pair of columns is turned by the angle that is
    best for the pair, until no pair moves. The input is one row per feature.
    """
    lengths = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    current = loadings / np.where(lengths == 0, 1.0, lengths)
    p, m = current.shape
    rotation = np.eye(m)
    for _ in range(sweeps):
        largest = 0.0
        for i in range(m - 1):
            for j in range(i + 1, m):
                x, y = current[:, i], current[:, j]
                u, v = x * x - y * y, 2 * x * y
                numerator = 2 * (u @ v) - 2 * u.sum() * v.sum() / p
                denominator = (u @ u) - (v @ v) - (u.sum() ** 2 - v.sum() ** 2) / p
                angle = np.arctan2(numerator, denominator) / 4
                if abs(angle) <= tolerance:
                    continue
                largest = max(largest, abs(angle))
                turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                current[:, [i, j]] = current[:, [i, j]] @ turn
                rotation[:, [i, j]] = rotation[:, [i, j]] @ turn
        if largest <= tolerance:
            break
    return rotation


@dataclass(frozen=True)
class FactorFit:
    """Rotated factors: loadings (feature x factor) and the rotation of the components."""

    features: list[str]
    loadings: np.ndarray
    rotation: np.ndarray


def fit_varimax(fit: PcaFit, m: int = 10, scale_loadings: bool = False) -> FactorFit:
    """Varimax over the first `m` components.

    By default the unit-length component weights are rotated. With
    `scale_loadings` each is first multiplied by the root of its eigenvalue.
    """
    m = min(m, fit.k)
    base = fit.weights[:, :m]
    if scale_loadings:
        base = base * np.sqrt(fit.ratios[:m] * len(fit.features))
    rotation = varimax_rotation(base)
    return FactorFit(fit.features, base @ rotation, rotation)


def factor_scores(scores: DataFrame, entity: str, factors: FactorFit) -> DataFrame:
    """Key and factor scores F1..Fm: the component scores times the rotation."""
    m = factors.rotation.shape[0]
    components = [F.col(c) for c in component_names(m)]
    return scores.select(
        entity,
        *[
            linear_combination(components, list(factors.rotation[:, j])).alias(name)
            for j, name in enumerate(component_names(m, "F"))
        ],
    )


def factor_loadings(spark: SparkSession, factors: FactorFit) -> DataFrame:
    return loading_table(spark, factors.loadings, factors.features, "F")


def variance_by_factor(loadings: DataFrame) -> DataFrame:
    """Rows `(component, ss_loading, proportion, cumulative)` of a loading table."""
    squares = loadings.groupBy("component").agg(
        F.sum(F.col("loading") * F.col("loading")).alias("ss_loading")
    )
    whole = loadings.agg(F.sum(F.col("loading") * F.col("loading")).alias("t")).scalar()
    number = F.regexp_extract("component", r"(\d+)$", 1).try_cast("int")
    shares = squares.withColumn(
        "proportion", F.try_divide(F.col("ss_loading"), whole)
    ).withColumn("_number", number)
    # One row per component: the window has no more rows than the table has features.
    in_order = Window.orderBy("_number", "component").rowsBetween(Window.unboundedPreceding, 0)
    return shares.withColumn("cumulative", F.sum("proportion").over(in_order)).drop("_number")


def reconstruction_error(z: DataFrame, entity: str, fit: PcaFit, k: int | None = None) -> DataFrame:
    """Key, the first k component scores, and each row's mean squared error without the others.

    The components are orthonormal, so what a row loses by keeping k of them
    is its squared length minus that of its scores; decoding is not needed.
    """
    k = k or fit.k
    projected = fit.model.transform(assemble(z, fit.features))
    values = vector_to_array("component")
    kept = [values[i] * F.lit(float(fit.signs[i])) for i in range(k)]
    length = total([F.col(f"`{c}`") * F.col(f"`{c}`") for c in fit.features])
    lost = length - total([s * s for s in kept])
    return projected.select(
        entity,
        *[s.alias(name) for s, name in zip(kept, component_names(k, "z"))],
        F.greatest(lost / len(fit.features), F.lit(0.0)).alias("recon_mse"),
    )
