"""Registered queries: risk of entities, risk and stability of clusters, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import profiles as pr
from cohortloom.operators import risk as rk
from cohortloom.operators.clustering import best_per_group as best
from cohortloom.operators.quantiles import box_stats as boxes
from cohortloom.operators.quantiles import group_summary
from cohortloom.plans.registry import Registry, rounded, rounded_sql
from cohortloom.plans.star_panel import (
    FEATURES_SQL,
    LABELS_SQL,
    PANEL_SQL,
    VARIED,
    labels,
    numeric_features,
    panel,
)
from cohortloom.session import materialise

registry = Registry()
query = registry.query

_DQ = "coalesce(TRY_CAST(dq_code AS INTEGER), 0)"
_METRICS_SQL = (
    f"{PANEL_SQL}, metrics AS (SELECT entity_id, min(period_date) AS first_period,"
    f" max(period_date) AS last_period, max({_DQ}) AS max_dq,"
    + "".join(
        f" max(CASE WHEN {_DQ} >= {n} THEN 1 ELSE 0 END) AS {name},"
        for name, n in rk.THRESHOLDS.items()
    )
    + " avg(rate) AS avg_rate, max(upb) AS max_upb, min(upb) AS min_upb,"
    " max(CASE WHEN upb = 0 THEN 1 ELSE 0 END) AS terminated_upb0,"
    " CASE WHEN max(upb) > 0 THEN (max(upb) - min(upb)) / max(upb) END AS amortization_ratio"
    " FROM panel GROUP BY entity_id)"
)
_FLAGS = list(rk.THRESHOLDS)


def _metrics(spark, sf_dir):
    return rk.risk_metrics(
        panel(spark, sf_dir), "entity_id", "period_date", "dq_code", "upb", "rate"
    )


_ROUNDED_METRICS = {"avg_rate": 6, "max_upb": 4, "min_upb": 4, "amortization_ratio": 6}


@query(
    f"WITH {_METRICS_SQL} SELECT entity_id, first_period, last_period, max_dq, "
    + ", ".join(_FLAGS)
    + ", terminated_upb0, "
    + ", ".join(f"{rounded_sql(c, d)} AS {c}" for c, d in _ROUNDED_METRICS.items())
    + " FROM metrics"
)
def risk_metrics(spark, sf_dir):
    found = _metrics(spark, sf_dir)
    return found.select(
        *[
            rounded(c, _ROUNDED_METRICS[c]).alias(c) if c in _ROUNDED_METRICS else c
            for c in found.columns
        ]
    )


_RATES = {f"{f}_rate": f for f in _FLAGS} | {
    "terminated_rate": "terminated_upb0",
    "avg_rate": "avg_rate",
    "avg_max_upb": "max_upb",
    "avg_amort_ratio": "amortization_ratio",
}


@query(
    f"WITH {_METRICS_SQL}, {LABELS_SQL} SELECT cluster, count(*) AS n_entities, "
    + ", ".join(
        f"{rounded_sql(f'avg(metrics.{c})', 4 if c == 'max_upb' else 6)} AS {n}"
        for n, c in _RATES.items()
    )
    + " FROM metrics JOIN labels_of USING (entity_id) GROUP BY cluster"
)
def cluster_risk_rates(spark, sf_dir):
    found = rk.rates_by_cluster(_metrics(spark, sf_dir), labels(spark, sf_dir), "entity_id")
    return found.select(
        "cluster", "n_entities",
        *[rounded(c, 4 if c == "avg_max_upb" else 6).alias(c) for c in _RATES],
    )


@query(
    f"WITH {_METRICS_SQL}, {LABELS_SQL} SELECT year(first_period) AS first_year, cluster,"
    " count(*) AS n_entities FROM metrics JOIN labels_of USING (entity_id) GROUP BY 1, 2"
)
def cohort_by_first_year(spark, sf_dir):
    return rk.cohort_by_first_year(_metrics(spark, sf_dir), labels(spark, sf_dir), "entity_id")


_COUNTS_SQL = (
    f"WITH {PANEL_SQL}, {LABELS_SQL}, counts AS (SELECT year(period_date) AS year, cluster,"
    " count(DISTINCT entity_id) AS n_entities FROM panel JOIN labels_of USING (entity_id)"
    " GROUP BY 1, 2), totals AS (SELECT year, CAST(sum(n_entities) AS BIGINT) AS total_year"
    " FROM counts GROUP BY year)"
)


@query(f"{_COUNTS_SQL} SELECT year, cluster, n_entities FROM counts")
def cluster_year_counts(spark, sf_dir):
    return rk.cluster_year_counts(
        panel(spark, sf_dir), labels(spark, sf_dir), "entity_id", "period_date"
    )


def _shares(spark, sf_dir):
    return rk.cluster_share_by_year(
        panel(spark, sf_dir), labels(spark, sf_dir), "entity_id", "period_date"
    )


@query(
    f"{_COUNTS_SQL} SELECT year, cluster, n_entities, total_year,"
    f" {rounded_sql('n_entities / total_year')} AS share FROM counts JOIN totals USING (year)"
)
def cluster_year_share(spark, sf_dir):
    return _shares(spark, sf_dir).withColumn("share", rounded("share"))


@query(
    f"{_COUNTS_SQL} SELECT year, "
    + ", ".join(
        rounded_sql(
            f"coalesce(sum(CASE WHEN cluster = {c} THEN n_entities / total_year END), 0)"
        )
        + f" AS cluster_{c}"
        for c in range(3)
    )
    + " FROM counts JOIN totals USING (year) GROUP BY year"
)
def cluster_share_pivot(spark, sf_dir):
    found = rk.share_pivot(_shares(spark, sf_dir), clusters=[0, 1, 2])
    return found.select("year", *[rounded(f"cluster_{c}").alias(f"cluster_{c}") for c in range(3)])


@query(f"WITH {LABELS_SQL} SELECT cluster, count(*) AS n_entities FROM labels_of GROUP BY cluster")
def cluster_sizes(spark, sf_dir):
    return pr.cluster_sizes(labels(spark, sf_dir))


_PROFILE_SQL = (
    f"WITH {FEATURES_SQL}, {LABELS_SQL}, profile AS (SELECT cluster, "
    + ", ".join(f"avg({c}) AS {c}" for c in VARIED)
    + " FROM features JOIN labels_of USING (entity_id) GROUP BY cluster)"
)


def _profile(spark, sf_dir):
    features = numeric_features(spark, sf_dir)
    return pr.cluster_profile(features, labels(spark, sf_dir), "entity_id", VARIED)


def _digits(c: str) -> int:
    return 4 if c.endswith("price") else 6


@query(
    f"{_PROFILE_SQL} SELECT cluster, "
    + ", ".join(f"{rounded_sql(c, _digits(c))} AS {c}" for c in VARIED)
    + " FROM profile"
)
def cluster_profile(spark, sf_dir):
    found = _profile(spark, sf_dir)
    return found.select("cluster", *[rounded(c, _digits(c)).alias(c) for c in VARIED])


_PROFILE_Z_SQL = (
    f"{_PROFILE_SQL}, moments AS (SELECT "
    + ", ".join(f"avg({c}) AS mu_{c}, nullif(stddev_samp({c}), 0) AS sd_{c}" for c in VARIED)
    + " FROM profile), zscores AS (SELECT cluster, "
    + ", ".join(f"({c} - mu_{c}) / sd_{c} AS z_{c}" for c in VARIED)
    + " FROM profile, moments)"
)


@query(
    f"{_PROFILE_Z_SQL} SELECT cluster, "
    + ", ".join(f"{rounded_sql(f'z_{c}', 5)} AS z_{c}" for c in VARIED)
    + " FROM zscores"
)
def cluster_profile_z(spark, sf_dir):
    found = pr.profile_zscores(_profile(spark, sf_dir), VARIED)
    return found.select("cluster", *[rounded(f"z_{c}", 5).alias(f"z_{c}") for c in VARIED])


@query(
    f"{_PROFILE_Z_SQL}, sizes AS (SELECT cluster, count(*) AS n_entities FROM labels_of"
    " GROUP BY cluster) SELECT cluster, n_entities, "
    + ", ".join(f"{rounded_sql(c, _digits(c))} AS {c}" for c in VARIED)
    + ", "
    + ", ".join(f"{rounded_sql(f'z_{c}', 5)} AS z_{c}" for c in VARIED)
    + " FROM sizes LEFT JOIN profile USING (cluster) LEFT JOIN zscores USING (cluster)"
)
def profile_full(spark, sf_dir):
    profile = _profile(spark, sf_dir)
    sizes = pr.cluster_sizes(labels(spark, sf_dir))
    full = pr.full_profile(sizes, profile, pr.profile_zscores(profile, VARIED))
    return full.select(
        "cluster", "n_entities",
        *[rounded(c, _digits(c)).alias(c) for c in VARIED],
        *[rounded(f"z_{c}", 5).alias(f"z_{c}") for c in VARIED],
    )


# The squared distance of an entity's mean quantity from the overall mean
# stands for an error per entity.
_ERRORS_SQL = (
    f"WITH {FEATURES_SQL}, {LABELS_SQL}, mu AS (SELECT avg(mean_num_quantity) AS m FROM features),"
    " errors AS (SELECT entity_id, cluster, power(mean_num_quantity - m, 2) AS error"
    " FROM features JOIN labels_of USING (entity_id), mu)"
)


def _errors(spark, sf_dir):
    features = numeric_features(spark, sf_dir, ["quantity"]).select("entity_id", "mean_num_quantity")
    mean = features.agg(F.avg("mean_num_quantity")).scalar()
    error = F.pow(F.col("mean_num_quantity") - mean, 2)
    joined = features.join(labels(spark, sf_dir), "entity_id")
    return materialise(joined.select("entity_id", "cluster", error.alias("error")), "errors")


_SUMMARY = {"mean": "avg(error)", "std": "stddev_samp(error)", "min_value": "min(error)"} | {
    f"p{p}": f"quantile_cont(error, {p / 100})" for p in (50, 90, 95, 99)
} | {"max_value": "max(error)"}


@query(
    f"{_ERRORS_SQL} SELECT cluster, count(error) AS n, "
    + ", ".join(f"{rounded_sql(e)} AS {n}" for n, e in _SUMMARY.items())
    + " FROM errors GROUP BY cluster"
)
def error_summary_by_cluster(spark, sf_dir):
    found = group_summary(_errors(spark, sf_dir), "error", "cluster")
    return found.select("cluster", "n", *[rounded(c).alias(c) for c in _SUMMARY])


_BOX = ["q1", "median", "q3", "low_whisker", "high_whisker"]


@query(
    f"{_ERRORS_SQL}, quartiles AS (SELECT cluster, quantile_cont(error, 0.25) AS q1,"
    " quantile_cont(error, 0.5) AS median, quantile_cont(error, 0.75) AS q3 FROM errors"
    " GROUP BY cluster), found AS (SELECT cluster, q1, median, q3,"
    " min(error) FILTER (WHERE error BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"
    " AS low_whisker,"
    " max(error) FILTER (WHERE error BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"
    " AS high_whisker FROM errors JOIN quartiles USING (cluster) GROUP BY ALL)"
    " SELECT cluster, " + ", ".join(f"{rounded_sql(c)} AS {c}" for c in _BOX) + " FROM found"
)
def box_stats(spark, sf_dir):
    found = boxes(_errors(spark, sf_dir), "error", "cluster")
    return found.select("cluster", *[rounded(c).alias(c) for c in _BOX])


@query(
    "SELECT event_type, user_id, total FROM (SELECT event_type, user_id, total, row_number() OVER"
    " (PARTITION BY event_type ORDER BY total DESC, user_id) AS place FROM (SELECT event_type,"
    f" user_id, {rounded_sql('sum(value)', 3)} AS total FROM events GROUP BY 1, 2))"
    " WHERE place = 1"
)
def best_per_group(spark, sf_dir):
    """The user with the largest total of each event type."""
    totals = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .groupBy("event_type", "user_id")
        .agg(rounded(F.sum("value"), 3).alias("total"))
    )
    return best(totals, "event_type", "total", "user_id")
