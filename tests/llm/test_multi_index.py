import numpy as np
from pyspark.sql import functions as F

from cohortloom.llm import multi_index
from cohortloom.llm.queries import registry


def exact(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        scores = x @ x[at]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_whole_search_is_exact_with_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=10).tolist()) for i in range(700)]
    hot = rng.normal(size=10).tolist()
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(
        multi_index.nearest(frame, F.col("vec_id") % 20 == 0, fraction=1.0, least_entries=1, bucket_rows=50)
    )
    expected = exact(rows, range(0, 700, 20), 20)
    assert set(found) == set(expected)
    for q, own in found.items():
        assert np.allclose([s for _, s in own], [s for _, s in expected[q]], atol=1e-12)
        assert [v for v, _ in own] == [v for v, _ in expected[q]]


def recall(found, expected):
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in found)
    return hits / sum(len(expected[q]) for q in found)


def test_recall_at_the_settings_of_the_query(spark):
    for sf in ("sf0.01", "sf0.1"):
        folder = f"/root/testdata/{sf}"
        rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
        found = got(registry.queries["op2_nearest_vectors"](spark, folder))
        data = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
        expected = exact(data, sorted(found), 20)
        assert recall(found, expected) >= 0.9
        scores = {q: dict(own) for q, own in exact(data, sorted(found)[:5], len(data)).items()}
        assert all(abs(scores[q][v] - s) < 1e-9 for q in scores for v, s in found[q])


def test_recall_on_many_random_vectors(spark):
    """Without any clusters, the hardest case for an index; many cells, several buckets."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = got(multi_index.nearest(frame, F.col("vec_id") % 200 == 0, bucket_rows=1000))
    expected = exact(list(enumerate(x)), sorted(found), 20)
    assert recall(found, expected) >= 0.9


def test_all_candidates_if_fewer(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(15)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(multi_index.nearest(frame, F.col("vec_id") == 0))
    assert [v for v, _ in found[0]] == list(range(14, 0, -1))


def test_cells_come_by_ascending_sum():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    counts = rng.integers(0, 3, 63)
    found = multi_index.visit_cells(a, b, counts, 10**9)
    sums = (a[:, None] + b[None, :]).ravel()
    assert found == [c for c in np.argsort(sums) if counts[c]]
    some = multi_index.visit_cells(a, b, counts, 12)
    assert counts[some].sum() >= 12 > counts[some[:-1]].sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]),
        (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (40, []),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.selectExpr("*", "'x' AS rank", "'y' AS score", "1 AS query_id")
    found = got(multi_index.nearest(frame, F.col("vec_id") % 20 == 0))
    assert found == {0: [(1, 0.5), (20, 0.0)], 20: [(1, 0.5), (0, 0.0)]}
    assert multi_index.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.nearest(frame, F.lit(False)).count() == 0
