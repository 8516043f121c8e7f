import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector

from cohortloom.operators import clustering as cl
from cohortloom.operators import lloyd
from cohortloom.operators.tree import grow, tree_labels, tree_table
from cohortloom.session import materialise


def blobs(n=1500, d=3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 4
    return centres[rng.integers(0, 6, n)] + rng.normal(size=(n, d))


def stored(spark, x, space="s", name="points"):
    rows = [(space, str(i), v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "space string, key string, x array<double>")
    return materialise(frame.repartition(5), name)


def test_sums_and_costs_of_a_pass_are_exact(spark):
    x, y = blobs(), blobs(400, 2, 5)
    points = stored(spark, x).unionByName(stored(spark, y, "t"))
    sets = [lloyd.CentreSet("s", x[:4].copy()), lloyd.CentreSet("t", y[:3].copy()), lloyd.CentreSet("s", x[:1].copy())]
    lloyd.one_round(points, sets)
    for s, data in zip(sets, (x, y, x), strict=True):
        near, far = lloyd.nearest(data, s.centres)
        assert s.counts.tolist() == np.bincount(near, minlength=s.k).tolist()
        assert s.cost == pytest.approx(far.sum())
        assert np.allclose(s.sums, np.stack([data[near == j].sum(axis=0) for j in range(s.k)]))
        assert np.allclose(s.squares, [(data[near == j] ** 2).sum() for j in range(s.k)])


def test_batched_fits_cost_no_more_than_separate_ones(spark):
    x = blobs(3000, 4)
    points = stored(spark, x)
    fits = lloyd.fit_sets(points, ["s"], range(2, 8), 2, 42)
    vectors = points.select(array_to_vector("x").alias("vector")).persist()
    scores = lloyd.silhouettes(points, list(fits.values()))
    for (_, k), score in zip(fits, scores, strict=True):
        model = KMeans(k=k, seed=42, featuresCol="vector").fit(vectors)
        assert fits["s", k].cost <= model.summary.trainingCost * 1.001
        labelled = lloyd.label(points, fits["s", k].centres, "key", "string", "prediction")
        rows = points.join(labelled, "key").select(array_to_vector("x").alias("features"), "prediction")
        assert score == pytest.approx(ClusteringEvaluator().evaluate(rows), abs=1e-9)
    vectors.unpersist()


def test_sweep_of_odd_spaces(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 1.0), ("c", None)], "id string, v double")
    report = cl.silhouette_sweep(frame, "id", ["v"], ks=[2, 3]).collect()
    assert [(r["k"], r["silhouette"], r["cost"], r["n_scored"]) for r in report] == [(2, 0.0, 0.0, 4), (3, 0.0, 0.0, 4)]
    assert cl.silhouette_sweep(frame.limit(0), "id", ["v"], ks=[2]).count() == 0


def plain_tree(x, k, tree):
    """Sizes and costs by following the tree's own centres, row by row."""
    at = np.ones(len(x), int)
    for node in tree.splits(k - 1):
        for i in np.flatnonzero(at == node.name):
            far = ((x[i] - node.centres) ** 2).sum(axis=1)
            at[i] = node.children[int(far[1] < far[0])]
    return at


def test_tree_nests_heights_fall_and_labels_follow_the_path(spark):
    x = blobs(900)
    points = stored(spark, x)
    tree = grow(points, 7)
    table = {r["node"]: r for r in tree_table(tree, spark).collect()}
    assert len(table) == 13 and [n.order for n in tree.splits()] == list(range(6))
    heights = [n.cost for n in tree.splits()]
    assert heights == sorted(heights, reverse=True)
    labels = tree_labels(points, tree, "id", "string", [1, 2, 4, 7]).collect()
    by_k = {k: {int(r["id"]): r["node"] for r in labels if r["k"] == k} for k in (1, 2, 4, 7)}
    for k, own in by_k.items():
        expected = plain_tree(x, k, tree)
        assert [own[i] for i in range(len(x))] == expected.tolist() and len(set(own.values())) == k
        for name in set(own.values()):
            rows = x[expected == name]
            assert table[name]["size"] == len(rows)
            assert table[name]["height"] == pytest.approx(((rows - rows.mean(axis=0)) ** 2).sum())
    for name, row in table.items():
        if row["parent"] is not None:
            assert row["height"] <= table[row["parent"]]["height"]
    assert all(len({by_k[4][i] for i, n in by_k[7].items() if n == name}) == 1 for name in set(by_k[7].values()))


def test_tree_finds_the_best_cuts_of_a_line(spark):
    x = np.concatenate((np.arange(40), 100 + np.arange(30), 1000 + np.arange(20) * 2)).astype(float)[:, None]
    tree = grow(stored(spark, x), 3)
    assert sorted(n.size for n in tree.nodes.values() if n.order is None) == [20, 30, 40]


def test_tree_of_equal_rows_one_row_and_none(spark):
    same = grow(stored(spark, np.ones((50, 2))), 4)
    assert [(n.size, n.cost) for n in same.nodes.values()] == [(50, 0.0)]
    two = grow(stored(spark, np.array([[0.0, 0.0]] * 30 + [[1.0, 0.0]])), 5)
    assert sorted(n.size for n in two.nodes.values()) == [1, 30, 31]
    assert grow(stored(spark, np.zeros((0, 2))), 3).nodes == {}
    zero = grow(stored(spark, np.zeros((3, 2))), 2)
    assert zero.nodes[1].size == 3


@pytest.mark.parametrize("heavier", [-1.0, 1.0])
def test_splits_of_one_column_are_its_best_cuts(spark, heavier):
    """Three groups of nearly the same size: which side the middle one joins is no matter for a sample."""
    rng = np.random.default_rng(3)
    groups = np.concatenate((np.repeat([-1.0, 0.0, 1.0], 20_000), np.repeat(heavier, 30)))
    x = np.round(groups + rng.uniform(-0.01, 0.01, len(groups)), 4)
    tree = grow(stored(spark, x[:, None], name="line"), 4)
    for node in tree.splits():
        own = np.sort(x[tree.descend(x[:, None], node.order) == node.name])
        n1, t1 = np.arange(1, len(own)), np.cumsum(own)[:-1]
        gain = t1**2 / n1 + (own.sum() - t1) ** 2 / (len(own) - n1)
        gain[np.diff(own) <= 0] = 0.0
        cut = int(gain.argmax()) + 1
        assert [tree.nodes[c].size for c in node.children] == [cut, len(own) - cut]
