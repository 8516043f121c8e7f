import numpy as np
import pytest

from cohortloom.llm import vector_codes
from cohortloom.llm.queries import registry
from tests.compare import connect, differences


def plain(rows, parts, entries, rounds, scale=1024.0):
    """Every part compared with every entry in every round."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    x = np.floor(np.array([r[1] for r in rows], float) * scale).astype(np.int64)
    at = vector_codes.cuts(x.shape[1], parts)
    books, codes, error = [], [], np.zeros(len(x), np.int64)
    for a, b in zip(at[:-1], at[1:], strict=True):
        own, book = x[:, a:b], x[:entries, a:b].copy()
        for turn in range(rounds + 1):
            far = ((own[:, None, :] - book[None]) ** 2).sum(axis=2)
            code = far.argmin(axis=1)
            if turn < rounds:
                for j in np.unique(code):
                    book[j] = own[code == j].sum(axis=0) // (code == j).sum()
        books.append(book)
        codes.append(code)
        error += far.min(axis=1)
    text = ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))]
    return sorted((r[0], t, int(e)) for r, t, e in zip(rows, text, error, strict=True)), books


@pytest.mark.parametrize("step", [1.0, 4.0])
def test_equals_full_rescans_with_many_ties_and_copies(spark, step):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 10) / step).tolist()) for i in range(900)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    found, books = vector_codes.compress(frame, parts=3, entries=40, rounds=5, scale=step)
    expected, plain_books = plain(rows, 3, 40, 5, step)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert all((a == b).all() for a, b in zip(books.parts, plain_books, strict=True))


def test_only_moved_entries_are_compared_again():
    rng = np.random.default_rng(4)
    x, old = rng.integers(0, 9, (500, 3)), rng.integers(0, 9, (30, 3))
    code, far = vector_codes.rescan(x, old)
    new = old.copy()
    new[[4, 17]] += 1
    moved = (new != old).any(axis=1)
    got, best, compared = vector_codes.reassign(x, new, moved, code, far)
    expected, least = vector_codes.rescan(x, new)
    assert (got == expected).all() and (best == least).all()
    lost = int(moved[code].sum())
    assert compared == lost * 30 + (500 - lost) * 2
    same = vector_codes.reassign(x, new, np.zeros(30, bool), got, best)
    assert (same[0] == got).all() and same[2] == 0


def test_large_components_stay_exact():
    most = vector_codes.limit(8)
    x = np.array([[most] * 8, [-most] * 8, [most - 1] * 8])
    far = vector_codes.distances(x, x)
    assert far[0, 1] == 8 * (2 * most) ** 2 and far[0, 2] == 8
    assert vector_codes.to_integers(np.array([[1e300, -1e300]]), 1024.0)[0, 0] == vector_codes.limit(2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.5, 1.0, 0.0], 1), (2, None, 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1),
        (5, [None, 0.0, 0.0, 0.0], 1), (6, [1.0], 1), (7, [], 2), (None, [0.0, 0.0, 0.0, 0.0], None),
        (8, [0.0, 0.0, 0.0, 0.0], None), (1, [0.5, -0.5, 1.0, 0.0], 1), (9, [9.0, 9.0, 9.0, 9.0], 2),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame = frame.selectExpr("*", "'x' AS code", "'y' AS error", "'z' AS key", "1 AS __n")
    codes, books = vector_codes.compress(frame, keep=["label"], entries=2, rounds=2, parts=4)
    found = vector_codes.label_errors(codes, "label")
    got = {(r["vec_id"], r["label"]): (r["code"], r["error"], r["label_error"]) for r in found.collect()}
    assert found.count() == 5 and {k[0] for k in got} == {1, 8, 9, None}
    assert got[(8, None)][2] == got[(None, None)][2] == got[(8, None)][1] + got[(None, None)][1]
    assert all(len(b) == 2 for b in books.parts)
    none, empty_books = vector_codes.compress(frame.limit(0), keep=["label"])
    assert vector_codes.label_errors(none, "label").count() == 0
    assert [b.size for b in empty_books.parts] == [0, 0, 0, 0]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op13_vector_codes"
    assert differences(registry.queries[name](spark, sf), connect(sf), registry.sql[name]) is None
