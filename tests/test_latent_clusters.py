import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import clustering as cl
from cohortloom.operators import evidence as ev
from cohortloom.operators import latent as lat
from cohortloom.operators import profiles as pr
from cohortloom.operators.silhouette import silhouette

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 2))
    mixed = base @ np.array([[1.0, 0.8, 0.1, 0.0], [0.0, 0.2, 0.9, 1.0]])
    return mixed + 0.3 * rng.normal(size=(300, 4))


@pytest.fixture(scope="module")
def table(spark, matrix):
    rows = [(i, *map(float, r)) for i, r in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in NAMES)).cache()


@pytest.fixture(scope="module")
def z(table):
    return ev.zscore_matrix(table, "id", NAMES, prefix="").cache()


def as_matrix(long, value):
    cells = {(r["feature_a"], r["feature_b"]): r[value] for r in long.collect()}
    return np.array([[cells[a, b] for b in NAMES] for a in NAMES])


def test_correlation_and_covariance_equal_numpy(table, matrix):
    r = lat.correlation_matrix(table, NAMES)
    cov = lat.covariance_matrix(table, NAMES)
    np.testing.assert_allclose(as_matrix(r, "r"), np.corrcoef(matrix.T), atol=1e-10)
    np.testing.assert_allclose(as_matrix(cov, "cov"), np.cov(matrix.T, bias=True), atol=1e-10)
    again = lat.covariance_to_correlation(cov)
    np.testing.assert_allclose(as_matrix(again, "r"), np.corrcoef(matrix.T), atol=1e-10)


def test_constant_feature_has_no_correlation(table):
    with_constant = table.withColumn("k", F.lit(7.0))
    found = {(r[0], r[1]): r[2] for r in lat.correlation_matrix(with_constant, ["a", "k"]).collect()}
    assert found["a", "a"] == pytest.approx(1.0)
    assert found["a", "k"] is None and found["k", "k"] is None
    zero = lat.covariance_to_correlation(lat.covariance_matrix(with_constant, ["a", "k"]))
    assert {(r[0], r[1]): r[2] for r in zero.collect()}["k", "k"] is None


def test_srmr_equals_its_formula(spark, table, matrix):
    loadings = lat.loading_table(spark, np.array([[0.9], [0.8], [0.3], [0.1]]), NAMES)
    found = lat.srmr(lat.correlation_matrix(table, NAMES), lat.implied_correlation(loadings)).first()
    l = np.array([0.9, 0.8, 0.3, 0.1])
    implied = np.outer(l, l)
    np.fill_diagonal(implied, 1.0)
    upper = np.triu_indices(4)
    squares = ((np.corrcoef(matrix.T) - implied)[upper] ** 2).sum()
    assert found["srmr"] == pytest.approx(np.sqrt(2 / 20 * squares))


def test_pca_equals_numpy(spark, z, matrix):
    standard = (matrix - matrix.mean(0)) / matrix.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.corrcoef(matrix.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * lat.component_signs(vectors)
    fit = lat.fit_pca(z, NAMES)
    np.testing.assert_allclose(fit.ratios, values / 4, atol=1e-10)
    np.testing.assert_allclose(fit.weights, vectors, atol=1e-8)
    report = lat.explained_variance(spark, fit, "m").orderBy("component").collect()
    assert report[-1]["pve_cum"] == pytest.approx(1.0)
    scores = {r["id"]: list(r)[1:] for r in lat.pca_scores(z, "id", fit).collect()}
    np.testing.assert_allclose([scores[i] for i in range(300)], standard @ vectors, atol=1e-8)
    norms = {r["feature"]: r["loading_norm"] for r in lat.loading_norms(lat.pca_loadings(spark, fit), ["PC1", "PC2"]).collect()}
    assert norms["a"] == pytest.approx(np.sqrt((vectors[0, :2] ** 2).sum()))
    # Encoding with two components, decoded by hand.
    kept = standard @ vectors[:, :2]
    expected = ((standard - kept @ vectors[:, :2].T) ** 2).mean(axis=1)
    errors = {r["id"]: r["recon_mse"] for r in lat.reconstruction_error(z, "id", fit, 2).collect()}
    np.testing.assert_allclose([errors[i] for i in range(300)], expected, atol=1e-8)


def test_varimax_is_orthogonal_and_improves(spark, z):
    fit = lat.fit_pca(z, NAMES)
    factors = lat.fit_varimax(fit, 2)
    np.testing.assert_allclose(factors.rotation @ factors.rotation.T, np.eye(2), atol=1e-10)

    def simplicity(loadings):
        rows = loadings / np.sqrt((loadings**2).sum(axis=1, keepdims=True))
        return (rows**2).var(axis=0).sum()

    best = simplicity(factors.loadings)
    assert best >= simplicity(fit.weights[:, :2])
    for angle in np.linspace(0, np.pi, 50):
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        assert simplicity(fit.weights[:, :2] @ turn) <= best + 1e-9
    # Unit-length weights: every factor has the same sum of squares.
    shares = lat.variance_by_factor(lat.factor_loadings(spark, factors)).orderBy("component").collect()
    assert [r["ss_loading"] for r in shares] == pytest.approx([1.0, 1.0])
    assert shares[-1]["cumulative"] == pytest.approx(1.0)
    scaled = lat.fit_varimax(fit, 2, scale_loadings=True)
    assert (scaled.loadings**2).sum() == pytest.approx(4 * fit.ratios[:2].sum())


def test_cumulative_factor_share_counts_to_ten(spark):
    loadings = lat.loading_table(spark, np.eye(11), [f"f{i}" for i in range(11)], "F")
    found = {r["component"]: r["cumulative"] for r in lat.variance_by_factor(loadings).collect()}
    assert found["F2"] == pytest.approx(2 / 11) and found["F11"] == pytest.approx(1.0)


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) if o != own)
        scores.append((b - a) / max(a, b))
    return np.array(scores)


@pytest.mark.parametrize("block_rows", [40, 1000])
def test_silhouette_equals_brute_force(spark, matrix, block_rows):
    """Two labellings at once, one with a lone point; several blocks and one block."""
    first = (matrix[:, 0] > 0).astype(int)
    second = (np.arange(300) % 3 + 1).astype(int)
    second[0] = 9
    rows = [(i, [float(v) for v in r], int(first[i]), int(second[i])) for i, r in enumerate(matrix)]
    table = spark.createDataFrame(rows, "id long, x array<double>, first int, second int")
    found = {
        r["labelling"]: (r["n_clusters"], r["silhouette"])
        for r in silhouette(table, "id", "x", ["first", "second"], block_rows).collect()
    }
    assert found["first"] == (2, pytest.approx(brute_silhouette(matrix, first).mean(), abs=1e-9))
    assert found["second"] == (4, pytest.approx(brute_silhouette(matrix, second).mean(), abs=1e-9))
    points = silhouette(table, "id", "x", ["second"], block_rows, per_point=True).collect()
    assert {r["id"]: r["silhouette"] for r in points}[0] == 0.0


def test_silhouette_of_identical_points(spark):
    rows = [(i, [1.0], i % 2) for i in range(10)]
    table = spark.createDataFrame(rows, "id long, x array<double>, c int")
    assert silhouette(table, "id", "x", ["c"]).first()["silhouette"] == 0.0


def test_all_pairs_of_a_large_table_are_refused(spark):
    rows = [(i, [float(i)], i % 2) for i in range(30)]
    table = spark.createDataFrame(rows, "id long, x array<double>, c int")
    with pytest.raises(ValueError, match="silhouette_estimate"):
        silhouette(table, "id", "x", ["c"], max_rows=29)
    assert silhouette(table, "id", "x", ["c"], max_rows=30).count() == 1


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centers = np.array([[0, 0], [10, 0], [0, 10]])
    rows = []
    for c, n in enumerate((20, 60, 40)):
        rows += [(f"{c}-{i}", *map(float, centers[c] + rng.normal(size=2))) for i in range(n)]
    return spark.createDataFrame(rows, "id string, x double, y double").cache()


def test_final_kmeans_numbers_clusters_by_size(blobs):
    fit = cl.kmeans_fit(blobs, "id", ["x", "y"], 3, n_init=2)
    assert pr.cluster_sizes(fit.labels).collect() == [(0, 60), (1, 40), (2, 20)]
    mixed = fit.labels.groupBy("cluster").agg(F.count_distinct(F.substring("id", 1, 1)).alias("n"))
    assert {r["n"] for r in mixed.collect()} == {1}
    assert fit.centroids.count() == 6


def test_sweep_finds_the_three_blobs(blobs):
    report = cl.silhouette_sweep(blobs, "id", ["x", "y"], "s", ks=range(2, 5), n_init=1)
    assert cl.winner(report) == ("s", 3)
    costs = [r["cost"] for r in report.orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)
    sampled = cl.silhouette_sweep(blobs, "id", ["x", "y"], ks=[3], fit_n=90, n_init=1)
    assert -1 <= sampled.first()["silhouette"] <= 1


def test_array_space_equals_column_space(blobs):
    arrays = blobs.select("id", F.array("x", "y").alias("v"))
    one = cl.kmeans_fit(blobs, "id", ["x", "y"], 3, n_init=1)
    other = cl.kmeans_fit(arrays, "id", "v", 3, n_init=1)
    assert one.cost == pytest.approx(other.cost)
    flat = {(r[0], r[1]): r[2] for r in one.centroids.collect()}
    names = {"v_0": "x", "v_1": "y"}
    for r in other.centroids.collect():
        assert flat[r["cluster"], names[r["feature"]]] == pytest.approx(r["value"])


def test_bisecting_cost_falls(blobs):
    costs = [r["cost"] for r in cl.bisecting_sweep(blobs, "id", ["x", "y"], [2, 3, 4]).collect()]
    assert costs == sorted(costs, reverse=True)


def test_nearest_centroid_and_ties(spark):
    points = spark.createDataFrame([("p", [0.0, 0.0]), ("q", [5.0, 0.0])], "id string, v array<double>")
    centers = spark.createDataFrame([(2, [1.0, 0.0]), (1, [-1.0, 0.0])], "cluster int, center array<double>")
    found = {r["id"]: (r["cluster"], r["distance"]) for r in cl.nearest_centroid(points, "v", centers).collect()}
    assert found == {"p": (1, 1.0), "q": (2, 4.0)}


def test_best_per_group_breaks_ties_by_k(spark):
    rows = [("s", 2, 0.5), ("s", 3, 0.5), ("t", 2, 0.1), ("t", 4, 0.9)]
    report = spark.createDataFrame(rows, "space string, k int, silhouette double")
    assert [(r["space"], r["k"]) for r in cl.best_per_group(report).collect()] == [("t", 4), ("s", 2)]


def test_profiles(spark):
    values = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", 8.0, 5.0)], "id string, x double, k double")
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "id string, cluster int")
    profile = pr.cluster_profile(values, labels, "id", ["x", "k"])
    z = {r["cluster"]: r for r in pr.profile_zscores(profile, ["x", "k"]).collect()}
    assert z[1]["z_x"] == pytest.approx(np.sqrt(0.5)) and z[0]["z_k"] is None
    full = pr.full_profile(pr.cluster_sizes(labels), profile, pr.profile_zscores(profile, ["x", "k"]))
    assert full.count() == 2 and full.columns[:3] == ["cluster", "n_entities", "x"]
    loadings = spark.createDataFrame([("f", "F1", -0.9), ("g", "F1", 0.5), ("h", "F1", 0.1)], "feature string, component string, loading double")
    assert [r["feature"] for r in pr.top_loadings(loadings, 2).collect()] == ["f", "g"]
