"""Registered queries: entity features and the evidence for choosing among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import evidence as ev
from cohortloom.operators import states as st
from cohortloom.operators.features import entity_features as build_features
from cohortloom.operators.features import near_entity
from cohortloom.operators.quantiles import describe, histogram
from cohortloom.plans.registry import Registry, rounded, rounded_sql
from cohortloom.plans.star_panel import (
    BASES,
    FAMILIES,
    FEATURES_SQL,
    PANEL_SQL,
    VARIED,
    features_sql,
    numeric_features,
    panel,
)
from cohortloom.session import materialise, scratch_path

registry = Registry()
query = registry.query

_WIDE = [f"{f}_num_{b}" for b in BASES for f in FAMILIES]
# With the sparse feature, whose missing values exceed the selection limit.
_BASES_RARE = [*BASES, "rare"]
_WIDE_RARE = [f"{f}_num_{b}" for b in _BASES_RARE for f in FAMILIES]
_MEANS_RARE = [f"mean_num_{b}" for b in _BASES_RARE]
_RARE_SQL = PANEL_SQL + ", " + features_sql(_BASES_RARE)


def _digits(feature: str) -> int:
    return 4 if feature.endswith(("price", "rare")) else 6


_NUMERIC = [f"num_{b}" for b in BASES]
_CODED = ["cat_flag", "cat_status", "txt_priority"]


def _coded_sql(columns) -> str:
    return ", ".join(
        f"arg_min({c}, row(period_date, {c})) AS first_{c}, arg_max({c}, row(period_date, {c}))"
        f" AS last_{c}, count(DISTINCT {c}) AS nunique_{c}"
        for c in columns
    )


@query(
    f"WITH {FEATURES_SQL}, coded AS (SELECT entity_id, {_coded_sql(_CODED)} FROM panel"
    " GROUP BY entity_id) SELECT entity_id, n_months, min_period, max_period, "
    + ", ".join(f"{rounded_sql(c, _digits(c))} AS {c}" for c in _WIDE)
    + ", "
    + ", ".join(f"{k}_{c}" for c in _CODED for k in ("first", "last", "nunique"))
    + " FROM features JOIN coded USING (entity_id)"
)
def entity_features(spark, sf_dir):
    rows = panel(spark, sf_dir, orders=True).select("entity_id", "period_date", *_NUMERIC, *_CODED)
    wide = build_features(materialise(near_entity(rows, "entity_id"), "panel"))
    return wide.select(
        *[rounded(c, _digits(c)).alias(c) if c in _WIDE else c for c in wide.columns]
    )


@query(
    f"WITH {PANEL_SQL} SELECT entity_id, count(*) AS n_months, min(period_date) AS min_period,"
    f" max(period_date) AS max_period, {_coded_sql(['cat_status'])} FROM panel GROUP BY entity_id"
)
def first_last_values(spark, sf_dir):
    """First and last present code per entity; missing codes at either end are passed over."""
    return build_features(panel(spark, sf_dir), numeric=[], coded=["cat_status"])


@query(
    f"WITH {PANEL_SQL} SELECT entity_id, CAST(year AS VARCHAR) AS batch, count(*) AS n_months, min(period_date) AS min_period,"
    " max(period_date) AS max_period, "
    + ", ".join(
        f"count({c}) AS n_{c}, {rounded_sql(f'coalesce(avg({c}), 0)', _digits(c))} AS mean_{c},"
        f" {rounded_sql(f'coalesce(var_pop({c}) * count({c}), 0)', 1 if c == 'num_price' else 6)} AS m2_{c},"
        f" min({c}) AS low_{c}, max({c}) AS high_{c}"
        for c in _NUMERIC
    )
    + " FROM panel GROUP BY ALL"
)
def feature_states(spark, sf_dir):
    """The mergeable state of every entity and year."""
    rows = panel(spark, sf_dir).withColumn("batch", F.col("year").cast("string"))
    rows = near_entity(rows.select("entity_id", "batch", "period_date", *_NUMERIC), "entity_id")
    found = st.number_states(rows, "entity_id", "period_date", _NUMERIC, "batch")
    wide = []
    for c in _NUMERIC:
        state = F.col(c)
        wide += [
            state["n"].alias(f"n_{c}"),
            rounded(state["mean"], _digits(c)).alias(f"mean_{c}"),
            rounded(state["m2"], 1 if c == "num_price" else 6).alias(f"m2_{c}"),
            state["low"].alias(f"low_{c}"),
            state["high"].alias(f"high_{c}"),
        ]
    return found.select("entity_id", "batch", "n_months", "min_period", "max_period", *wide)


@query(
    f"WITH {FEATURES_SQL}, coded AS (SELECT entity_id, {_coded_sql(_CODED)} FROM panel"
    " GROUP BY entity_id) SELECT entity_id, n_months, min_period, max_period, "
    + ", ".join(f"{rounded_sql(c, _digits(c))} AS {c}" for c in _WIDE)
    + ", "
    + ", ".join(f"{k}_{c}" for c in _CODED for k in ("first", "last", "nunique"))
    + " FROM features JOIN coded USING (entity_id)"
)
def incremental_features(spark, sf_dir):
    """Years loaded in two steps, the second with a late year and a year corrected.

    The first load has a wrong version of one year (every second row is missing)
    and lacks another; the second replaces the one and adds the other. The states
    must then give the features of the whole panel.
    """
    rows = panel(spark, sf_dir, orders=True)
    rows = rows.select("entity_id", "period_date", "year", "line_no", *_NUMERIC, *_CODED)
    rows = materialise(near_entity(rows, "entity_id"), "panel")
    rows = rows.withColumn("batch", F.col("year").cast("string"))
    root = scratch_path(spark, "states")
    late, wrong = F.col("year") == 1994, F.col("year") == 1996
    how = {"numeric": _NUMERIC, "coded": _CODED}
    st.save_states(rows.where(~late & ~(wrong & (F.col("line_no") % 2 == 0))), root, "batch", **how)
    st.save_states(rows.where(late | wrong), root, "batch", **how)
    wide = st.load_features(spark, root, "batch", **how)
    return wide.select(
        *[rounded(c, _digits(c)).alias(c) if c in _WIDE else c for c in wide.columns]
    )


@query(
    f"WITH {FEATURES_SQL}, stats AS (SELECT CAST(n_months AS DOUBLE) AS x FROM features)"
    " SELECT 'count' AS stat, CAST(count(x) AS DOUBLE) AS value FROM stats UNION ALL SELECT 'mean',"
    f" {rounded_sql('avg(x)')} FROM stats UNION ALL SELECT 'std', {rounded_sql('stddev_samp(x)')}"
    " FROM stats UNION ALL SELECT 'min', min(x) FROM stats UNION ALL SELECT 'max', max(x)"
    " FROM stats UNION ALL SELECT '25%', quantile_cont(x, 0.25) FROM stats UNION ALL"
    " SELECT '50%', quantile_cont(x, 0.5) FROM stats UNION ALL SELECT '75%',"
    " quantile_cont(x, 0.75) FROM stats"
)
def describe_n_months(spark, sf_dir):
    counts = panel(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n_months"))
    found = describe(materialise(counts, "months"), "n_months")
    return found.select("stat", rounded("value").alias("value"))


def _missing_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio,"
        f" '{c.split('_')[0]}' AS family, '{c.split('_')[2]}' AS base FROM features"
        for c in _WIDE_RARE
    )
    return f"WITH {_RARE_SQL}, missing AS ({rows})"


@query(
    _missing_sql()
    + f" SELECT feature, {rounded_sql('null_ratio')} AS null_ratio, family, base FROM missing"
)
def feature_missingness(spark, sf_dir):
    found = ev.feature_missingness(numeric_features(spark, sf_dir, _BASES_RARE), _WIDE_RARE)
    return found.withColumn("null_ratio", rounded("null_ratio"))


@query(
    _missing_sql()
    + f" SELECT family, count(*) AS n_features, {rounded_sql('avg(null_ratio)')} AS avg_null_ratio,"
    f" {rounded_sql('max(null_ratio)')} AS max_null_ratio FROM missing GROUP BY family"
)
def missingness_by_family(spark, sf_dir):
    missing = ev.feature_missingness(numeric_features(spark, sf_dir, _BASES_RARE), _WIDE_RARE)
    return ev.missingness_by_family(missing).select(
        "family", "n_features", rounded("avg_null_ratio").alias("avg_null_ratio"),
        rounded("max_null_ratio").alias("max_null_ratio"),
    )


_STATS_SQL = f"WITH {_RARE_SQL}, stats AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio,"
    f" avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}, 0.01) AS p01,"
    f" quantile_cont({c}, 0.99) AS p99, '{c.split('_')[2]}' AS base FROM features"
    for c in _MEANS_RARE
) + ")"
_STATS = ["null_ratio", "mean", "std", "p01", "p99"]


@query(
    _STATS_SQL + " SELECT feature, base, "
    + ", ".join(f"{rounded_sql(c, 4)} AS {c}" for c in _STATS) + " FROM stats"
)
def feature_stats(spark, sf_dir):
    features = materialise(numeric_features(spark, sf_dir, _BASES_RARE), "features")
    found = ev.feature_stats(features, _MEANS_RARE, exact=True)
    return found.select("feature", "base", *[rounded(c, 4).alias(c) for c in _STATS])


@query()
def feature_stats_sketch(spark, sf_dir):
    return ev.feature_stats(numeric_features(spark, sf_dir, _BASES_RARE), _MEANS_RARE)


def _pair_sql(a: str, b: str) -> str:
    both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return (
        f"CASE WHEN count(*) {both} >= 500 AND stddev_pop({a}) {both} > 0"
        f" AND stddev_pop({b}) {both} > 0 THEN covar_pop({a}, {b})"
        f" / (stddev_pop({a}) {both} * stddev_pop({b}) {both}) END"
    )


_CORR_SQL = f"WITH {_RARE_SQL}, corrs AS (" + " UNION ALL ".join(
    f"SELECT '{b}' AS base, "
    + ", ".join(
        f"{_pair_sql(f'mean_num_{b}', f'{o}_num_{b}')} AS corr_mean_{o}" for o in FAMILIES[1:]
    )
    + " FROM features"
    for b in _BASES_RARE
) + ")"
_CORRS = [f"corr_mean_{o}" for o in FAMILIES[1:]]


def _correlations(spark, sf_dir):
    features = numeric_features(spark, sf_dir, _BASES_RARE)
    return ev.within_base_correlation(features, _BASES_RARE)


@query(_CORR_SQL + " SELECT base, " + ", ".join(f"{rounded_sql(c)} AS {c}" for c in _CORRS) + " FROM corrs")
def within_base_corr(spark, sf_dir):
    return _correlations(spark, sf_dir).select("base", *[rounded(c).alias(c) for c in _CORRS])


@query(
    _CORR_SQL + " SELECT "
    + ", ".join(
        f"{rounded_sql(f'avg({c})')} AS avg_{c}, {rounded_sql(f'quantile_cont({c}, 0.5)')}"
        f" AS median_{c}"
        for c in _CORRS
    )
    + " FROM corrs"
)
def corr_summary(spark, sf_dir):
    found = ev.correlation_summary(_correlations(spark, sf_dir))
    return found.select(*[rounded(c).alias(c) for c in found.columns])


# Rounded first: a value that equals its percentile must do so in both engines.
_OUTLIER_SQL = f"WITH {_RARE_SQL}, steady AS (SELECT " + ", ".join(
    f"{rounded_sql(c, _digits(c))} AS {c}" for c in _WIDE_RARE
) + " FROM features), tails AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _WIDE_RARE
) + " FROM steady), rates AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN 1.0 ELSE 0.0 END)"
    f" AS extreme_rate, '{c.split('_')[0]}' AS family FROM steady, tails"
    f" WHERE {c} IS NOT NULL HAVING count(*) >= 1000"
    for c in _WIDE_RARE
) + ")"


def _rates(spark, sf_dir):
    features = numeric_features(spark, sf_dir, _BASES_RARE)
    steady = features.select(*[rounded(c, _digits(c)).alias(c) for c in _WIDE_RARE])
    return ev.outlier_rates(materialise(steady, "features"), _WIDE_RARE)


@query(
    _OUTLIER_SQL
    + f" SELECT feature, {rounded_sql('extreme_rate')} AS extreme_rate, family FROM rates"
)
def outlier_rates(spark, sf_dir):
    return _rates(spark, sf_dir).withColumn("extreme_rate", rounded("extreme_rate"))


@query(
    _OUTLIER_SQL
    + f" SELECT family, {rounded_sql('avg(extreme_rate)')} AS avg_extreme_rate,"
    f" {rounded_sql('max(extreme_rate)')} AS max_extreme_rate, count(*) AS n_features FROM rates"
    " GROUP BY family"
)
def outlier_by_family(spark, sf_dir):
    return ev.outliers_by_family(_rates(spark, sf_dir)).select(
        "family", rounded("avg_extreme_rate").alias("avg_extreme_rate"),
        rounded("max_extreme_rate").alias("max_extreme_rate"), "n_features",
    )


@query(
    f"WITH {PANEL_SQL}, bounds AS (SELECT min(num_price) AS low, (max(num_price) - min(num_price))"
    " / 60 AS width FROM panel), placed AS (SELECT CAST(least(floor((num_price - low) / width), 59)"
    " AS INTEGER) AS bin, low, width FROM panel, bounds WHERE num_price IS NOT NULL)"
    f" SELECT bin, {rounded_sql('low + bin * width', 4)} AS \"left\","
    f" {rounded_sql('low + (bin + 1) * width', 4)} AS \"right\", count(*) AS n"
    " FROM placed GROUP BY bin, low, width"
)
def histogram_60(spark, sf_dir):
    return histogram(panel(spark, sf_dir), "num_price").select(
        "bin", rounded("left", 4).alias("left"), rounded("right", 4).alias("right"), "n"
    )


_STATS_PLAIN = ["null_ratio", "mean", "std"]


@query(
    _STATS_SQL + " SELECT feature, "
    + ", ".join(f"{rounded_sql(c, 4)} AS {c}" for c in _STATS_PLAIN)
    + ", CASE WHEN std IS NULL OR std <= 1e-12 THEN 'EXCLUDE_constante_std0'"
    " WHEN null_ratio > 0.2 THEN 'EXCLUDE_missingness_gt_0.2' ELSE 'KEEP' END AS decision,"
    " (std IS NOT NULL AND std > 1e-12 AND null_ratio <= 0.2) AS keep FROM stats"
)
def feature_selection(spark, sf_dir):
    stats = ev.feature_stats(numeric_features(spark, sf_dir, _BASES_RARE), _MEANS_RARE)
    return ev.select_features(stats).select(
        "feature", *[rounded(c, 4).alias(c) for c in _STATS_PLAIN], "decision", "keep"
    )


def _z_sql(c: str) -> str:
    x = f"coalesce({c}, mu_{c})"
    return f"CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN 0.0 ELSE ({x} - mu_{c}) / sd_{c} END"


_MOMENTS_SQL = "moments AS (SELECT " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}" for c in _MEANS_RARE
) + " FROM features)"


@query(
    f"WITH {_RARE_SQL}, {_MOMENTS_SQL} SELECT entity_id, "
    + ", ".join(f"{rounded_sql(_z_sql(c))} AS z_{c}" for c in _MEANS_RARE)
    + " FROM features, moments"
)
def zscore_matrix(spark, sf_dir):
    features = numeric_features(spark, sf_dir, _BASES_RARE)
    found = ev.zscore_matrix(features, "entity_id", _MEANS_RARE)
    return found.select("entity_id", *[rounded(f"z_{c}").alias(f"z_{c}") for c in _MEANS_RARE])


@query(
    f"WITH {_RARE_SQL}, {_MOMENTS_SQL} SELECT entity_id, "
    + ", ".join(f"{rounded_sql(f'coalesce({c}, mu_{c})', 4)} AS {c}" for c in _MEANS_RARE)
    + " FROM features, moments"
)
def mean_imputed(spark, sf_dir):
    features = numeric_features(spark, sf_dir, _BASES_RARE).select("entity_id", *_MEANS_RARE)
    found = ev.impute_mean(features, _MEANS_RARE)
    return found.select("entity_id", *[rounded(c, 4).alias(c) for c in _MEANS_RARE])


@query(
    f"WITH {_RARE_SQL}, raw_moments AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}" for c in _MEANS_RARE)
    + " FROM features), filled AS (SELECT entity_id, "
    + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _MEANS_RARE)
    + " FROM features, raw_moments), moments AS (SELECT "
    + ", ".join(f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}" for c in _MEANS_RARE)
    + " FROM filled) SELECT entity_id, "
    + ", ".join(f"{rounded_sql(_z_sql(c))} AS z_{c}" for c in _MEANS_RARE)
    + " FROM filled, moments"
)
def imputed_zscores(spark, sf_dir):
    """Imputed first and scaled by the spread after imputing; constant columns give 0."""
    features = numeric_features(spark, sf_dir, _BASES_RARE).select("entity_id", *_MEANS_RARE)
    found = ev.zscore_matrix(ev.impute_mean(features, _MEANS_RARE), "entity_id", _MEANS_RARE)
    return found.select("entity_id", *[rounded(f"z_{c}").alias(f"z_{c}") for c in _MEANS_RARE])


@query(
    f"WITH {FEATURES_SQL}, moments AS (SELECT "
    + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in VARIED)
    + " FROM features) SELECT entity_id, "
    + ", ".join(f"{rounded_sql(_z_sql(c))} AS z_{c}" for c in VARIED)
    + " FROM features, moments"
)
def population_zscores(spark, sf_dir):
    features = numeric_features(spark, sf_dir)
    found = ev.zscore_matrix(features, "entity_id", VARIED, ddof=0)
    return found.select("entity_id", *[rounded(f"z_{c}").alias(f"z_{c}") for c in VARIED])
