import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators import quantiles as q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_small_groups_equal_numpy(spark, xs):
    table = spark.createDataFrame([(x,) for x in xs], "x double")
    found = {r["prob"]: r["value"] for r in q.exact_quantiles(table, "x", PROBS).collect()}
    for p in PROBS:
        assert found[p] == pytest.approx(np.quantile(xs, p), rel=1e-9, abs=1e-9)


def test_large_skewed_groups_equal_numpy(spark):
    """Bracketed groups: one value fills a third of the rows, tails are long, sizes differ."""
    rng = np.random.default_rng(3)
    groups = {"hot": rng.lognormal(0, 3, 60_000), "mild": rng.normal(0, 1, 25_000), "few": rng.normal(5, 1, 7)}
    groups["hot"][::3] = 1.5
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("hot", float("nan"))]
    table = spark.createDataFrame(rows, "g string, x double")
    found = q.exact_quantiles(table, "x", PROBS, ["g"]).collect()
    assert len(found) == 3 * len(PROBS)
    for r in found:
        xs = groups[r["g"]]
        assert r["n"] == len(xs)
        assert r["value"] == pytest.approx(np.quantile(xs, r["prob"]), rel=1e-12)


def test_a_rank_outside_its_bracket_is_an_error(spark, monkeypatch):
    right = q._brackets

    def shifted(data, by, probs):
        moved = F.transform("_targets", lambda t: t.withField("low", t["low"] + 1e4).withField("high", t["high"] + 1e4))
        return right(data, by, probs).withColumn("_targets", moved)

    table = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    assert q.exact_quantiles(table, "x", [0.5], ["g"]).count() == 2
    monkeypatch.setattr(q, "_brackets", shifted)
    with pytest.raises(Exception, match="outside its bracket"):
        q.exact_quantiles(table, "x", [0.5], ["g"]).collect()


def test_many_groups(spark):
    table = spark.range(3000).select((F.col("id") % 100).alias("g"), F.col("id").alias("x"))
    found = {r["g"]: r["value"] for r in q.exact_quantiles(table, "x", [0.5], ["g"]).collect()}
    assert len(found) == 100
    assert found[7] == np.median(np.arange(7, 3000, 100))


def test_no_values_give_no_rows(spark):
    table = spark.createDataFrame([(None,)], "x double")
    assert q.exact_quantiles(table, "x", [0.5]).count() == 0


def test_describe(spark):
    table = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    found = {r["stat"]: r["value"] for r in q.describe(table, "x").collect()}
    assert found["count"] == 4 and found["25%"] == 1.75 and found["max"] == 4.0
    assert found["std"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))


def test_box_whiskers_leave_outliers_out(spark):
    rows = [("a", float(i)) for i in range(1, 12)] + [("a", 100.0)]
    found = q.box_stats(spark.createDataFrame(rows, "g string, x double"), "x", "g").first()
    assert found["high_whisker"] == 11.0 and found["low_whisker"] == 1.0


def test_histogram_of_a_constant_and_of_the_maximum(spark):
    constant = spark.createDataFrame([(7.0,)] * 5, "x double")
    assert [(r["bin"], r["n"]) for r in q.histogram(constant, "x").collect()] == [(0, 5)]
    line = spark.range(0, 61).select(F.col("id").cast("double").alias("x"))
    found = {r["bin"]: r["n"] for r in q.histogram(line, "x").collect()}
    assert sum(found.values()) == 61 and found[59] == 2 and max(found) == 59
