import pytest
from pyspark.sql import functions as F

from cohortloom.operators.sampling import (
    in_sample,
    sample_entities,
    sample_parameters,
    sample_rows,
    split_rows,
)


@pytest.mark.parametrize("n", [0, 1, 17, 500, 4999, 5000, 9000])
@pytest.mark.parametrize("portable", [True, False])
def test_sample_has_exactly_n_different_rows(spark, n, portable):
    rows = spark.range(5000).withColumn("v", F.col("id") * 2)
    found = [r["id"] for r in sample_rows(rows, n, ["id"], portable=portable).collect()]
    assert len(found) == len(set(found)) == min(n, 5000)


def test_sample_does_not_depend_on_partitioning(spark):
    rows = spark.range(2000)
    one = {r[0] for r in sample_rows(rows.repartition(1), 100, ["id"]).collect()}
    many = {r[0] for r in sample_rows(rows.repartition(13), 100, ["id"]).collect()}
    other = {r[0] for r in sample_rows(rows, 100, ["id"], seed=1).collect()}
    assert one == many and one != other


def test_sample_with_a_hot_key_still_has_n_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert sample_rows(rows, 1500, ["k"]).count() == 1500


def test_entities_are_sampled_whole(spark):
    panel = spark.range(20_000).select((F.col("id") % 1000).cast("string").alias("e"))
    ids = sample_entities(panel, "e", buckets=100, threshold=10)
    n = ids.count()
    assert 60 <= n <= 140
    kept = panel.where(in_sample(F.col("e"), 100, 10))
    assert kept.count() == 20 * n and kept.select("e").distinct().count() == n
    record = sample_parameters(ids, 100, 10).first()
    assert record["fraction"] == 0.1 and record["n_entities"] == n


def test_null_entities_are_never_sampled(spark):
    rows = spark.createDataFrame([(None,), ("a",)], "e string")
    found = [r[0] for r in sample_entities(rows, "e", buckets=1, threshold=1).collect()]
    assert found == ["a"]


def test_split_is_about_four_fifths(spark):
    counts = dict(split_rows(spark.range(10_000), ["id"]).groupBy("part").count().collect())
    assert counts["train"] + counts["validation"] == 10_000
    assert 7800 < counts["train"] < 8200
