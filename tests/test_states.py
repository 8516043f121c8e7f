import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import states as st
from cohortloom.operators.features import entity_features, near_entity
from cohortloom.session import scratch_path

HOW = {"numeric": ["num_x", "num_y"], "coded": ["cat_s"]}


def panel(spark, n=2000):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        entity = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        x = rng.choice([None, 1e9 + rng.random(), 1e9])
        rows.append(
            (entity, datetime.datetime(2020, rng.randrange(1, 13), 1), rng.choice("1234"), x, 7.0 if entity == "a" else None,
             rng.choice(["u", "v", None]))
        )
    rows.append(("single", datetime.datetime(2020, 5, 1), "9", 3.0, None, None))
    return spark.createDataFrame(
        rows, "entity_id string, period_date timestamp_ntz, part string, num_x double, num_y double, cat_s string"
    )


def by_entity(frame):
    return {r["entity_id"]: r.asDict() for r in frame.collect()}


def assert_same(found, expected):
    assert found.columns == expected.columns
    got, wanted = by_entity(found), by_entity(expected)
    assert got.keys() == wanted.keys()
    for entity, row in wanted.items():
        for name, value in row.items():
            if isinstance(value, float):
                assert got[entity][name] == pytest.approx(value, rel=1e-9, abs=1e-6), (entity, name)
            else:
                assert got[entity][name] == value, (entity, name)


def test_batches_in_any_order_give_the_features_of_the_whole(spark):
    rows = panel(spark).persist()
    whole = entity_features(rows, **HOW)
    root = scratch_path(spark, "states-test")
    st.save_states(rows.where("part IN ('3', '9')"), root, "part", **HOW)
    st.save_states(rows.where("part IN ('1', '2', '4') AND num_x IS NOT NULL"), root, "part", **HOW)
    st.save_states(rows.where("part IN ('1', '2', '4')"), root, "part", **HOW)
    assert_same(st.load_features(spark, root, "part", **HOW), whole)
    st.save_states(rows.where("part = '2'"), root, "part", **HOW)
    assert_same(st.load_features(spark, root, "part", **HOW), whole)


def test_spread_of_close_large_values_survives_merging(spark):
    rng = np.random.default_rng(2)
    values = 1e12 + rng.normal(size=300)
    rows = [("e", datetime.datetime(2020, 1, 1), str(i % 40), float(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "entity_id string, period_date timestamp_ntz, part string, num_x double")
    states = st.number_states(frame, "entity_id", "period_date", ["num_x"], "part")
    merged = st.merge_numbers(states, "entity_id", ["num_x"], "part")
    row = st.number_features(merged, "entity_id", ["num_x"]).first()
    # Two passes over the exact values; adding up squares would give garbage here.
    assert row["std_num_x"] == pytest.approx(float(np.std(values, ddof=1)), rel=1e-3)


def test_empty_panel_and_missing_numbers(spark):
    rows = panel(spark)
    empty = st.number_states(rows.limit(0), "entity_id", "period_date", ["num_x"], "part")
    assert st.merge_numbers(empty, "entity_id", ["num_x"], "part").count() == 0
    lost = rows.withColumn("num_x", F.lit(None).cast("double"))
    states = st.number_states(lost, "entity_id", "period_date", ["num_x"], "part")
    found = st.number_features(st.merge_numbers(states, "entity_id", ["num_x"]), "entity_id", ["num_x"])
    assert {tuple(r)[4:] for r in found.collect()} == {(None, None, None, None)}


def test_rows_of_many_entities_meet_before_their_states(spark):
    """A task sends one state for an entity's rows, and a large entity is split over tasks."""
    rows = spark.range(40_000).selectExpr("concat('e', id % 4000) AS e", "CAST(id AS DOUBLE) AS x")
    near = near_entity(rows.repartition(8), "e").withColumn("task", F.spark_partition_id())
    assert near.groupBy("e").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] == 1
    plan = near_entity(rows, "e").groupBy("e").agg(F.avg("x"))._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert "REBALANCE_PARTITIONS_BY_COL" in physical and "ENSURE_REQUIREMENTS" in physical
