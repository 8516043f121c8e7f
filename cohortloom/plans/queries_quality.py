"""Registered queries: data quality, plain counts, expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import expectations as ex
from cohortloom.operators import quality as q
from cohortloom.plans.registry import Registry, rounded, rounded_sql
from cohortloom.plans.star_panel import (
    BASE_SQL,
    FEATURES_SQL,
    LABELS_SQL,
    PANEL_SQL,
    labels,
    numeric_features,
    panel,
    table,
    text_rows,
)

registry = Registry()
query = registry.query

_PARSED = (
    "CASE WHEN regexp_matches(period_raw, '^[0-9]{6}$') THEN try_strptime(period_raw, '%m%Y') END"
)


def _typed_year(rows):
    return rows.withColumn("year", F.col("year").cast("bigint"))


@query(
    f"WITH {BASE_SQL} SELECT year, quarter, count(*) AS n_rows,"
    f" count(DISTINCT entity_id) AS n_entities, min({_PARSED}) AS min_period,"
    f" max({_PARSED}) AS max_period,"
    " CAST(sum(CASE WHEN entity_id IS NULL OR entity_id = '' THEN 1 ELSE 0 END) AS BIGINT)"
    " AS null_entity,"
    " CAST(sum(CASE WHEN period_raw IS NULL OR period_raw = '' THEN 1 ELSE 0 END) AS BIGINT)"
    " AS null_period FROM base GROUP BY year, quarter"
)
def partition_quality(spark, sf_dir):
    rows = _typed_year(text_rows(spark, sf_dir))
    return q.partition_quality(rows, ["year", "quarter"], "entity_id", "period_raw", exact=True)


@query(
    f"WITH {BASE_SQL} SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities,"
    f" min({_PARSED}) AS min_period, max({_PARSED}) AS max_period FROM base"
)
def global_coverage(spark, sf_dir):
    return q.coverage(text_rows(spark, sf_dir), "entity_id", "period_raw", exact=True)


@query(
    f"WITH {BASE_SQL} SELECT year, quarter, count(*) AS n_rows,"
    " count(DISTINCT entity_id || '|' || period_raw) AS n_pairs,"
    " count(*) - count(DISTINCT entity_id || '|' || period_raw) AS n_duplicates"
    " FROM base GROUP BY year, quarter"
)
def duplicate_keys(spark, sf_dir):
    rows = _typed_year(text_rows(spark, sf_dir))
    return q.duplicate_keys(rows, ["year", "quarter"], ["entity_id", "period_raw"], exact=True)


_TEXT_COLUMNS = [
    "entity_id", "period_raw", "flag", "status", "quantity", "price", "tax", "disc", "const",
    "priority", "dq_code", "upb", "rate",
]


def _missing_sql(c: str) -> str:
    blank = f"CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = '' THEN 1.0 ELSE 0.0 END"
    return f"SELECT '{c}' AS col, {rounded_sql(f'avg({blank})')} AS null_ratio FROM base"


@query(f"WITH {BASE_SQL} " + " UNION ALL ".join(_missing_sql(c) for c in _TEXT_COLUMNS))
def missingness_by_column(spark, sf_dir):
    found = q.missing_by_column(text_rows(spark, sf_dir), _TEXT_COLUMNS)
    return found.select("col", rounded("null_ratio").alias("null_ratio"))


@query(
    f"WITH {PANEL_SQL} SELECT cat_status AS value, count(*) AS n FROM panel GROUP BY 1"
    " ORDER BY n DESC, value LIMIT 30"
)
def value_counts_topk(spark, sf_dir):
    return q.value_counts(panel(spark, sf_dir), "cat_status")


@query(
    "SELECT value, CAST(sum(n) AS BIGINT) AS n FROM ("
    "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL"
    " SELECT l_linestatus, count(*) FROM lineitem GROUP BY 1 UNION ALL"
    " SELECT o_orderstatus, count(*) FROM orders GROUP BY 1) GROUP BY value"
)
def merged_counts(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return q.merge_counts(
        [
            q.value_counts(lines, "l_returnflag", k=None),
            q.value_counts(lines, "l_linestatus", k=None),
            q.value_counts(orders, "o_orderstatus", k=None),
        ]
    )


@query(
    f"WITH {PANEL_SQL} SELECT CAST(date_trunc('month', period_date) AS TIMESTAMP) AS month,"
    " count(*) AS n_rows FROM panel GROUP BY 1"
)
def rows_by_month(spark, sf_dir):
    return q.rows_by_month(panel(spark, sf_dir), "period_date")


@query(
    f"WITH {PANEL_SQL} SELECT min(period_date) AS min_period, max(period_date) AS max_period,"
    " count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM panel"
)
def temporal_range(spark, sf_dir):
    return q.temporal_range(panel(spark, sf_dir), "entity_id", "period_date", exact=True)


@query(
    "SELECT min(value) AS min_value, max(value) AS max_value, count(DISTINCT value) AS n_unique"
    " FROM events"
)
def column_range(spark, sf_dir):
    return q.column_range(table(spark, sf_dir, "events"), "value", exact=True)


@query(
    "SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_entities FROM events"
    " GROUP BY event_type"
)
def group_sizes(spark, sf_dir):
    return q.group_sizes(table(spark, sf_dir, "events"), ["event_type"], "user_id", exact=True)


def _checks(spark, sf_dir):
    rows = panel(spark, sf_dir)
    features = numeric_features(spark, sf_dir)
    sizes = labels(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n_entities"))
    shares = sizes.select(
        "cluster", (F.col("n_entities") / sizes.agg(F.sum("n_entities")).scalar()).alias("share")
    )
    return ex.run_expectations(
        [
            ex.expect_columns(features, ["entity_id", "n_months", "mean_num_price"], "features"),
            ex.expect_columns(rows, ["entity_id", "absent"], "panel", severity="warning"),
            ex.expect_min_rows(features, 100, "features"),
            ex.expect_between(rows, "num_disc", 0.0, 0.1, "panel"),
            ex.expect_between(rows, "num_quantity", 5.0, 40.0, "panel", severity="warning"),
            ex.expect_total_equal(sizes, "n_entities", labels(spark, sf_dir), "sizes"),
            ex.expect_group_sum(shares.withColumn("all", F.lit(1)), ["all"], "share", 1.0, "sizes"),
            ex.expect_best_at_least(sizes, "cluster", "n_entities", 0, "sizes"),
        ]
    )


_CHECKS_SQL = (
    f"WITH {FEATURES_SQL}, {LABELS_SQL}, sizes AS (SELECT cluster, count(*) AS n_entities"
    " FROM labels_of GROUP BY cluster), checks AS ("
    "SELECT 'columns' AS \"check\", 'features' AS subject, 'error' AS severity, 'pass' AS status,"
    " 0.0::DOUBLE AS observed, 0.0::DOUBLE AS expected, '' AS detail"
    " UNION ALL SELECT 'columns', 'panel', 'warning', 'fail', 1, 0, 'absent'"
    " UNION ALL SELECT 'min_rows', 'features', 'error', CASE WHEN count(*) >= 100 THEN 'pass'"
    " ELSE 'fail' END, count(*), 100, '' FROM features"
    " UNION ALL SELECT 'between', 'panel.num_disc', 'error', CASE WHEN"
    " count(*) FILTER (WHERE num_disc < 0 - 1e-12 OR num_disc > 0.1 + 1e-12) = 0 AND"
    " count(num_disc) > 0 THEN 'pass' ELSE 'fail' END,"
    " count(*) FILTER (WHERE num_disc < 0 - 1e-12 OR num_disc > 0.1 + 1e-12), 0, '' FROM panel"
    " UNION ALL SELECT 'between', 'panel.num_quantity', 'warning', CASE WHEN"
    " count(*) FILTER (WHERE num_quantity < 5 OR num_quantity > 40) = 0 THEN 'pass' ELSE 'fail'"
    " END, count(*) FILTER (WHERE num_quantity < 5 OR num_quantity > 40), 0, '' FROM panel"
    " UNION ALL SELECT 'total', 'sizes', 'warning', CASE WHEN (SELECT sum(n_entities) FROM sizes)"
    " = (SELECT count(*) FROM labels_of) THEN 'pass' ELSE 'fail' END,"
    " (SELECT sum(n_entities) FROM sizes), (SELECT count(*) FROM labels_of), ''"
    " UNION ALL SELECT 'group_sum', 'sizes.share', 'warning', CASE WHEN"
    " abs(sum(n_entities / (SELECT sum(n_entities) FROM sizes)) - 1) <= 0.01 THEN 'pass' ELSE"
    " 'fail' END, CASE WHEN abs(sum(n_entities / (SELECT sum(n_entities) FROM sizes)) - 1)"
    " <= 0.01 THEN 0 ELSE 1 END, 0, '' FROM sizes"
    " UNION ALL SELECT 'best', 'sizes.cluster', 'error', CASE WHEN arg_max(cluster, n_entities)"
    " >= 0 THEN 'pass' ELSE 'fail' END, arg_max(cluster, n_entities), 0, '' FROM sizes)"
)


@query(_CHECKS_SQL + " SELECT * FROM checks")
def expectations(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(
    _CHECKS_SQL + " SELECT severity, status, count(*) AS n_checks FROM checks"
    " GROUP BY severity, status"
)
def expectation_summary(spark, sf_dir):
    return ex.summarise(_checks(spark, sf_dir))


@query(
    _CHECKS_SQL + " SELECT count(*) FILTER (WHERE status = 'fail' AND severity = 'error') AS errors,"
    " count(*) FILTER (WHERE status = 'fail' AND severity = 'warning') AS warnings,"
    " CASE WHEN count(*) FILTER (WHERE status = 'fail' AND severity = 'error') = 0 THEN 'pass'"
    " ELSE 'fail' END AS verdict FROM checks"
)
def expectation_verdict(spark, sf_dir):
    return ex.verdict(_checks(spark, sf_dir))


@query(
    f"WITH {FEATURES_SQL} SELECT count(*) AS panel_rows,"
    " count(DISTINCT entity_id) AS panel_entities, min(period_date) AS min_period,"
    " max(period_date) AS max_period, (SELECT count(*) FROM features) AS feature_rows FROM panel"
)
def cross_layer_counts(spark, sf_dir):
    rows = panel(spark, sf_dir)
    features = numeric_features(spark, sf_dir)
    return ex.cross_layer_counts(rows, features, "entity_id", "period_date", exact=True)
