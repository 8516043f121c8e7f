import datetime
import math

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import evidence as ev
from cohortloom.operators.features import code_features, entity_features
from cohortloom.operators.panel import build_panel, restrict_to
from cohortloom.operators.shape import align_schema, key_first, rename_positional, select_roles
from cohortloom.roles import Roles

ROLES = Roles("id", "period", numeric=["amount"], codes=["state"], text=["bank"], drop=["junk"])


def raw(spark):
    rows = [
        ("a", "012020", "1.5", "0", "north", "2020", "Q1", "x"),
        ("a", "022020", None, "R", "north", "2020", "Q1", "x"),
        ("a", "132020", "9", "0", "north", "2020", "Q1", "x"),
        ("a", "", "9", "0", "north", "2020", "Q1", "x"),
        ("b", "032020", "XX", None, "south", "2020", "Q1", "x"),
        ("c", "042020", "2", "1", "south", "bad", "Q2", "x"),
    ]
    names = ["id", "period", "amount", "state", "bank", "year", "quarter", "junk"]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_panel_is_typed_and_drops_bad_rows(spark):
    panel = build_panel(raw(spark), ROLES, entity_name="id")
    assert panel.columns == [
        "id", "period_raw", "period_date", "year", "quarter", "cat_state", "txt_bank", "num_amount",
    ]
    found = {(r["id"], r["period_date"].month): r["num_amount"] for r in panel.collect()}
    assert found == {("a", 1): 1.5, ("a", 2): None, ("b", 3): None}


def test_panel_of_listed_entities_and_of_a_predicate(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "whatever string")
    by_table = build_panel(raw(spark), ROLES, ids=ids)
    by_filter = build_panel(raw(spark), ROLES, keep=F.col("id") == "a")
    assert by_table.count() == by_filter.count() == 2
    named = ids.withColumnRenamed("whatever", "entity_id")
    assert restrict_to(build_panel(raw(spark), ROLES), named, "entity_id").count() == 2


def test_schema_shaping(spark):
    table = raw(spark)
    silver = select_roles(table.drop("bank"), ROLES)
    assert silver.columns == ["id", "period", "state", "amount", "bank", "year", "quarter"]
    assert {t for _, t in silver.dtypes} == {"string"}
    assert silver.where(F.col("bank").isNotNull()).count() == 0
    assert rename_positional(table, ["k", "p"]).columns == ["k", "p"]
    with pytest.raises(ValueError):
        rename_positional(table.select("id"), ["k", "p"])
    assert align_schema(table, ["year", "new"]).columns == ["year", "new"]
    assert key_first(table.select("period", "id"), "id", {"id": "key"}).columns == ["key", "period"]


def panel_rows(spark):
    day = datetime.datetime
    rows = [
        ("a", day(2020, 1, 1), 1.0, None),
        ("a", day(2020, 2, 1), 3.0, "y"),
        ("a", day(2020, 2, 1), None, "x"),
        ("a", day(2020, 3, 1), 5.0, None),
        ("b", day(2020, 5, 1), 2.0, None),
        (None, day(2020, 6, 1), 4.0, "z"),
    ]
    return spark.createDataFrame(
        rows, "entity_id string, period_date timestamp_ntz, num_x double, cat_s string"
    )


def test_features_of_ties_nulls_and_single_rows(spark):
    found = {r["entity_id"]: r for r in entity_features(panel_rows(spark)).collect()}
    a, b, nobody = found["a"], found["b"], found[None]
    assert (a["n_months"], a["mean_num_x"], a["std_num_x"]) == (4, 3.0, 2.0)
    # The NULL at the first month is passed over; at the tie the smaller is first.
    assert (a["first_cat_s"], a["last_cat_s"], a["nunique_cat_s"]) == ("x", "y", 2)
    assert b["std_num_x"] is None and b["first_cat_s"] is None and b["nunique_cat_s"] == 0
    assert nobody["first_cat_s"] == "z"
    assert entity_features(panel_rows(spark).limit(0)).count() == 0


def test_a_hot_entity_is_combined_before_the_shuffle(spark):
    """A third of the rows belong to one entity; what crosses the shuffle does not grow with them."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("entity_id"),
        F.lit(datetime.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("period_date"),
        (F.col("id") % 5).cast("string").alias("cat_s"),
    )
    found = code_features(rows, "entity_id", "period_date", ["cat_s"]).where("entity_id = 'hot'")
    row = found.first()
    assert (row["first_cat_s"], row["last_cat_s"], row["nunique_cat_s"]) == ("0", "4", 5)
    plan = rows.sparkSession._jvm.PythonSQLUtils.explainString(
        code_features(rows, "entity_id", "period_date", ["cat_s"])._jdf.queryExecution(), "simple"
    )
    assert "partial_min" in plan and "BatchEvalPython" not in plan


FEATURES = (
    "entity_id string, mean_num_a double, std_num_a double, min_num_a double, max_num_a double,"
    " mean_num_k double"
)


def features(spark, n=1200):
    rows = [
        (str(i), None if i % 4 == 0 else float(i), float(i % 7), float(i), float(2 * i), 7.0)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, FEATURES)


def test_selection_rules_and_their_order(spark):
    stats = ev.feature_stats(features(spark), ["mean_num_a", "mean_num_k", "max_num_a"])
    found = {r["feature"]: r["decision"] for r in ev.select_features(stats).collect()}
    assert found == {
        "mean_num_a": "EXCLUDE_missingness_gt_0.2",
        "mean_num_k": "EXCLUDE_constante_std0",
        "max_num_a": "KEEP",
    }
    assert ev.kept_features(ev.select_features(stats)) == ["max_num_a"]
    assert len(ev.kept_features(ev.select_features(stats, mode="all"))) == 3
    with pytest.raises(ValueError):
        ev.kept_features(ev.select_features(stats.where("feature = 'mean_num_k'")))
    with pytest.raises(ValueError):
        ev.select_features(stats, mode="other")


def test_redundancy_guards(spark):
    table = features(spark)
    found = {r["base"]: r for r in ev.within_base_correlation(table, ["a", "k", "absent"]).collect()}
    assert set(found) == {"a", "k"}
    assert found["a"]["corr_mean_max"] == pytest.approx(1.0)
    assert found["k"]["corr_mean_std"] is None  # no such column
    few = ev.within_base_correlation(table.limit(100), ["a"]).first()
    assert few["corr_mean_max"] is None  # fewer than 500 pairs


def test_outlier_rates_need_enough_values(spark):
    found = {r["feature"]: r for r in ev.outlier_rates(features(spark), ["mean_num_a", "max_num_a"]).collect()}
    assert set(found) == {"max_num_a"}  # mean_num_a has 900 values
    assert found["max_num_a"]["extreme_rate"] == pytest.approx(24 / 1200)
    assert ev.outlier_rates(features(spark, 10), ["max_num_a"]).count() == 0


def test_zscores_survive_constant_and_missing(spark):
    z = ev.zscore_matrix(features(spark), "entity_id", ["mean_num_a", "mean_num_k"])
    row = {r["entity_id"]: r for r in z.collect()}["0"]
    assert row["z_mean_num_a"] == 0.0 and row["z_mean_num_k"] == 0.0
    spread = z.agg(F.avg("z_mean_num_a"), F.stddev_samp("z_mean_num_a")).first()
    assert abs(spread[0]) < 1e-12 and spread[1] == pytest.approx(math.sqrt(899 / 1199))


def test_imputation_keeps_other_columns(spark):
    table = features(spark, 8)
    filled = ev.impute_mean(table, ["mean_num_a"])
    assert filled.columns == table.columns
    assert filled.where("entity_id = '0'").first()["mean_num_a"] == pytest.approx((1 + 2 + 3 + 5 + 6 + 7) / 6)


def test_rows_without_an_entity_are_one_row(spark):
    rows = [("a", 1, 2.0, "x"), (None, 1, 3.0, "y"), (None, 2, 5.0, "z"), ("b", 1, None, None)]
    panel = spark.createDataFrame(rows, "entity_id string, period_date int, num_v double, cat_c string")
    found = {r["entity_id"]: r for r in entity_features(panel).collect()}
    assert set(found) == {"a", "b", None}
    assert (found[None]["n_months"], found[None]["mean_num_v"]) == (2, 4.0)
    assert (found[None]["first_cat_c"], found[None]["last_cat_c"], found[None]["nunique_cat_c"]) == ("y", "z", 2)
    assert found["b"]["nunique_cat_c"] == 0 and found["b"]["first_cat_c"] is None
