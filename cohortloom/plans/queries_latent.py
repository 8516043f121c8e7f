"""Registered queries: correlations, loadings, components, factors.

Eigenvectors have no SQL form in general, but those of two features do: with
correlation r the components are (1, 1) and (1, -1) over the root of two, with
shares (1 + |r|) / 2 and (1 - |r|) / 2. The `pair` queries check the whole
path - standardise, fit, sign rule, project - against that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.names import feature_family
from cohortloom.operators import evidence as ev
from cohortloom.operators import latent as lat
from cohortloom.operators.profiles import top_loadings
from cohortloom.plans.registry import Registry, rounded, rounded_sql
from cohortloom.plans.star_panel import (
    BASES,
    FAMILIES,
    FEATURES_SQL,
    MEANS,
    VARIED,
    numeric_features,
    table,
)
from cohortloom.session import materialise

registry = Registry()
query = registry.query

_ALL_VARIED = [f"{f}_num_{b}" for b in BASES if b != "const" for f in FAMILIES]
Z = [f"z_{c}" for c in VARIED]


def stored_features(spark, sf_dir):
    """The feature table, written once, because fits read it several times."""
    return materialise(numeric_features(spark, sf_dir), "features")


def stored_zscores(spark, sf_dir, columns=VARIED):
    """Standardised features, written once."""
    features = numeric_features(spark, sf_dir)
    return materialise(ev.zscore_matrix(features, "entity_id", columns), "zscores")


def _corr_cells(names, source: str, guard: bool = True) -> str:
    rows = []
    for a in names:
        for b in names:
            value = f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))"
            if guard:
                value = f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN {value} END"
            rows.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {value} AS r FROM {source}")
    return " UNION ALL ".join(rows)


_FILLED_SQL = (
    f"WITH {FEATURES_SQL}, mu AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}" for c in MEANS)
    + " FROM features), filled AS (SELECT entity_id, "
    + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in MEANS)
    + " FROM features, mu)"
)
_CORR_SQL = f"{_FILLED_SQL}, corr AS ({_corr_cells(MEANS, 'filled')})"


@query(f"{_CORR_SQL} SELECT feature_a, feature_b, {rounded_sql('r')} AS r FROM corr")
def corr_matrix(spark, sf_dir):
    found = lat.correlation_matrix(stored_features(spark, sf_dir), MEANS)
    return found.withColumn("r", rounded("r"))


@query(
    f"{_FILLED_SQL}, cells AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, covar_pop({a}, {b}) AS cov FROM filled"
        for a in MEANS
        for b in MEANS
    )
    + f") SELECT feature_a, feature_b, {rounded_sql('cov', 4)} AS cov FROM cells"
)
def cov_matrix(spark, sf_dir):
    filled = materialise(
        ev.impute_mean(numeric_features(spark, sf_dir).select("entity_id", *MEANS), MEANS), "filled"
    )
    return lat.covariance_matrix(filled, MEANS).withColumn("cov", rounded("cov", 4))


@query(f"{_CORR_SQL} SELECT feature_a, feature_b, {rounded_sql('r')} AS r FROM corr")
def cov_to_corr(spark, sf_dir):
    filled = materialise(
        ev.impute_mean(numeric_features(spark, sf_dir).select("entity_id", *MEANS), MEANS), "filled"
    )
    found = lat.covariance_to_correlation(lat.covariance_matrix(filled, MEANS))
    return found.withColumn("r", rounded("r"))


# A loading table that SQL can compute too: the correlations of every feature
# with the mean features.
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _ALL_VARIED)
_LOADING_SQL = (
    f"WITH {FEATURES_SQL}, complete AS (SELECT * FROM features WHERE {_COMPLETE}), loadings AS ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{c}' AS component, covar_pop({f}, {c})"
        f" / (stddev_pop({f}) * stddev_pop({c})) AS loading FROM complete"
        for f in _ALL_VARIED
        for c in VARIED
    )
    + ")"
)


def _structure(spark, sf_dir):
    complete = numeric_features(spark, sf_dir).dropna(subset=_ALL_VARIED)
    features = materialise(complete, "features")
    r = lat.correlation_matrix(features, _ALL_VARIED)
    return r.where(F.col("feature_b").isin(VARIED)).select(
        F.col("feature_a").alias("feature"),
        F.col("feature_b").alias("component"),
        F.col("r").alias("loading"),
    )


@query(
    f"{_LOADING_SQL}, implied AS (SELECT a.feature AS feature_a, b.feature AS feature_b,"
    " CASE WHEN a.feature = b.feature THEN 1.0 ELSE sum(a.loading * b.loading) END AS r"
    " FROM loadings a JOIN loadings b USING (component) GROUP BY 1, 2),"
    f" observed AS ({_corr_cells(VARIED, 'complete', guard=False)})"
    " SELECT count(DISTINCT o.feature_a) AS n_features, "
    + rounded_sql(
        "sqrt(2.0 * sum((o.r - i.r) * (o.r - i.r)) / (count(DISTINCT o.feature_a)"
        " * (count(DISTINCT o.feature_a) + 1)))"
    )
    + " AS srmr FROM observed o JOIN implied i USING (feature_a, feature_b)"
    " WHERE o.feature_a <= o.feature_b"
)
def srmr_lowrank(spark, sf_dir):
    """Misfit between observed correlations and those implied by a loading table."""
    loadings = _structure(spark, sf_dir)
    observed = loadings.where(F.col("feature").isin(VARIED)).select(
        F.col("feature").alias("feature_a"), F.col("component").alias("feature_b"),
        F.col("loading").alias("r"),
    )
    found = lat.srmr(observed, lat.implied_correlation(loadings))
    return found.withColumn("srmr", rounded("srmr"))


_SS_SQL = (
    f"{_LOADING_SQL}, ss AS (SELECT component, sum(loading * loading) AS ss_loading FROM loadings"
    " GROUP BY component), shares AS (SELECT component, ss_loading,"
    " ss_loading / sum(ss_loading) OVER () AS proportion FROM ss)"
)


@query(
    f"{_SS_SQL} SELECT component, {rounded_sql('ss_loading')} AS ss_loading,"
    f" {rounded_sql('proportion')} AS proportion,"
    f" {rounded_sql('sum(proportion) OVER (ORDER BY component)')} AS cumulative FROM shares"
)
def factor_variance(spark, sf_dir):
    found = lat.variance_by_factor(_structure(spark, sf_dir))
    numbers = ["ss_loading", "proportion", "cumulative"]
    return found.select("component", *[rounded(c).alias(c) for c in numbers])


@query(
    f"{_LOADING_SQL}, placed AS (SELECT component, feature, loading, abs(loading) AS abs_loading,"
    " row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS place"
    f" FROM loadings) SELECT component, feature, {rounded_sql('loading')} AS loading,"
    f" {rounded_sql('abs_loading')} AS abs_loading, CAST(place AS INTEGER) AS place FROM placed"
    " WHERE place <= 6"
)
def factor_top_loadings(spark, sf_dir):
    found = top_loadings(_structure(spark, sf_dir))
    return found.select(
        "component", "feature", rounded("loading").alias("loading"),
        rounded("abs_loading").alias("abs_loading"), "place",
    )


@query(
    f"{_LOADING_SQL}, norms AS (SELECT feature, sqrt(sum(loading * loading)) AS loading_norm"
    " FROM loadings GROUP BY feature), stats AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio,"
        f" stddev_samp({c}) AS std FROM features"
        for c in _ALL_VARIED
    )
    + f") SELECT feature, {rounded_sql('null_ratio')} AS null_ratio, {rounded_sql('std', 4)} AS std,"
    f" {rounded_sql('loading_norm')} AS loading_norm,"
    f" {rounded_sql('(1 - null_ratio) * std * loading_norm', 4)} AS score"
    " FROM stats JOIN norms USING (feature)"
)
def feature_ranking(spark, sf_dir):
    norms = lat.loading_norms(_structure(spark, sf_dir))
    stats = ev.feature_stats(numeric_features(spark, sf_dir), _ALL_VARIED)
    found = ev.rank_features(stats, norms)
    return found.select(
        "feature", rounded("null_ratio").alias("null_ratio"), rounded("std", 4).alias("std"),
        rounded("loading_norm").alias("loading_norm"), rounded("score", 4).alias("score"),
    )


# --- two features: every number has a closed form -------------------------------------

_PAIR = ["mean_num_quantity", "max_num_quantity"]
_ZPAIR = [f"z_{c}" for c in _PAIR]
_PAIR_SQL = (
    f"WITH {FEATURES_SQL}, m AS (SELECT avg({_PAIR[0]}) AS ma, stddev_samp({_PAIR[0]}) AS sa,"
    f" avg({_PAIR[1]}) AS mb, stddev_samp({_PAIR[1]}) AS sb,"
    f" corr({_PAIR[0]}, {_PAIR[1]}) AS r FROM features),"
    f" z AS (SELECT entity_id, r, ({_PAIR[0]} - ma) / sa AS za, ({_PAIR[1]} - mb) / sb AS zb"
    " FROM features, m)"
)


def _pair_fit(spark, sf_dir):
    z = stored_zscores(spark, sf_dir, _PAIR)
    return z, lat.fit_pca(z, _ZPAIR)


@query(
    _PAIR_SQL + " SELECT 'pair' AS model, 1 AS component, "
    + f"{rounded_sql('(1 + abs(r)) / 2')} AS pve, {rounded_sql('(1 + abs(r)) / 2')} AS pve_cum"
    f" FROM m UNION ALL SELECT 'pair', 2, {rounded_sql('(1 - abs(r)) / 2')}, {rounded_sql('1')}"
    " FROM m"
)
def pca_pair_variance(spark, sf_dir):
    _, fit = _pair_fit(spark, sf_dir)
    found = lat.explained_variance(spark, fit, "pair")
    return found.select(
        "model", "component", rounded("pve").alias("pve"), rounded("pve_cum").alias("pve_cum")
    )


@query(
    _PAIR_SQL + ", c AS (SELECT CASE WHEN r >= 0 THEN 1 ELSE -1 END AS s FROM m)"
    + f" SELECT '{_ZPAIR[0]}' AS feature, 'PC1' AS component, {rounded_sql('1 / sqrt(2)')} AS loading"
    f" FROM c UNION ALL SELECT '{_ZPAIR[1]}', 'PC1', {rounded_sql('s / sqrt(2)')} FROM c"
    f" UNION ALL SELECT '{_ZPAIR[0]}', 'PC2', {rounded_sql('1 / sqrt(2)')} FROM c"
    f" UNION ALL SELECT '{_ZPAIR[1]}', 'PC2', {rounded_sql('-s / sqrt(2)')} FROM c"
)
def pca_pair_loadings(spark, sf_dir):
    _, fit = _pair_fit(spark, sf_dir)
    return lat.pca_loadings(spark, fit).withColumn("loading", rounded("loading"))


_SCORES = "(za + sign(r) * zb) / sqrt(2)", "(za - sign(r) * zb) / sqrt(2)"


@query(
    _PAIR_SQL
    + f" SELECT entity_id, {rounded_sql(_SCORES[0])} AS PC1, {rounded_sql(_SCORES[1])} AS PC2 FROM z"
)
def pca_pair_scores(spark, sf_dir):
    z, fit = _pair_fit(spark, sf_dir)
    found = lat.pca_scores(z, "entity_id", fit)
    return found.select("entity_id", rounded("PC1").alias("PC1"), rounded("PC2").alias("PC2"))


@query(
    _PAIR_SQL
    + f" SELECT entity_id, {rounded_sql(_SCORES[0])} AS z1,"
    f" {rounded_sql('power(' + _SCORES[1] + ', 2) / 2')} AS recon_mse FROM z"
)
def reconstruction_pair(spark, sf_dir):
    """One of two components kept: the error is half the square of the other one."""
    z, fit = _pair_fit(spark, sf_dir)
    found = lat.reconstruction_error(z, "entity_id", fit, k=1)
    return found.select("entity_id", rounded("z1").alias("z1"), rounded("recon_mse").alias("recon_mse"))


@query(
    _PAIR_SQL
    + f" SELECT entity_id, {rounded_sql('least(abs(za), abs(zb))')} AS low,"
    f" {rounded_sql('greatest(abs(za), abs(zb))')} AS high FROM z"
)
def varimax_pair_scores(spark, sf_dir):
    """Varimax over both components of two features turns them back into the features."""
    z, fit = _pair_fit(spark, sf_dir)
    factors = lat.fit_varimax(fit, 2)
    scores = lat.factor_scores(lat.pca_scores(z, "entity_id", fit), "entity_id", factors)
    f1, f2 = F.abs("F1"), F.abs("F2")
    return scores.select(
        "entity_id", rounded(F.least(f1, f2)).alias("low"), rounded(F.greatest(f1, f2)).alias("high")
    )


@query(
    f"WITH {FEATURES_SQL} SELECT count(*) AS n_entities, CAST({len(Z)} AS BIGINT) AS n_components,"
    " CAST(1.0 AS DOUBLE) AS total_share, TRUE AS unit_loadings, TRUE AS uncorrelated,"
    " TRUE AS variances_match FROM features"
)
def pca_consistency(spark, sf_dir):
    """What must hold for any full set of components of standardised features."""
    z = stored_zscores(spark, sf_dir)
    fit = lat.fit_pca(z, Z)
    names = lat.component_names(fit.k)
    scores = lat.pca_scores(z, "entity_id", fit)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    largest = F.greatest(*[F.abs(F.covar_samp(a, b)) for a, b in pairs])
    gaps = [
        F.abs(F.var_samp(n) - F.lit(float(r) * len(Z))) for n, r in zip(names, fit.ratios)
    ]
    norms = lat.loading_norms(lat.pca_loadings(spark, fit))
    off = norms.agg(F.max(F.abs(F.col("loading_norm") - 1))).scalar()
    return scores.agg(
        F.count("*").alias("n_entities"),
        F.lit(fit.k).cast("bigint").alias("n_components"),
        F.round(F.lit(float(fit.ratios.sum())), 6).alias("total_share"),
        (largest < 1e-6).alias("uncorrelated"),
        (F.greatest(*gaps) < 1e-6).alias("variances_match"),
    ).withColumn("unit_loadings", off < 1e-6)


# --- all features ---------------------------------------------------------------------


@query()
def pca_variance(spark, sf_dir):
    fit = lat.fit_pca(stored_zscores(spark, sf_dir), Z)
    return lat.explained_variance(spark, fit)


@query()
def pca_scores(spark, sf_dir):
    z = stored_zscores(spark, sf_dir)
    return lat.pca_scores(z, "entity_id", lat.fit_pca(z, Z))


@query()
def pca_loadings(spark, sf_dir):
    return lat.pca_loadings(spark, lat.fit_pca(stored_zscores(spark, sf_dir), Z))


@query()
def loading_norm(spark, sf_dir):
    columns = _ALL_VARIED
    z = stored_zscores(spark, sf_dir, columns)
    fit = lat.fit_pca(z, [f"z_{c}" for c in columns], k=10)
    return lat.loading_norms(lat.pca_loadings(spark, fit))


@query()
def pca_compare(spark, sf_dir):
    """Explained variance of the mean features beside that of all families."""
    features = stored_features(spark, sf_dir)
    sets = {"means": VARIED, "all_families": _ALL_VARIED}
    return lat.compare_feature_sets(features, "entity_id", sets)


@query(
    "SELECT unnest(['all_families', 'means']) AS model, unnest([16, 4])::BIGINT AS n_components,"
    " TRUE AS whole, TRUE AS falling, (SELECT count(DISTINCT l_partkey) > 0 FROM lineitem) AS has_rows"
)
def pca_compare_consistency(spark, sf_dir):
    """What must hold for every feature set: shares that fall and add up to one."""
    features = stored_features(spark, sf_dir)
    sets = {"means": VARIED, "all_families": _ALL_VARIED}
    report = lat.compare_feature_sets(features, "entity_id", sets)
    shares = F.transform(F.array_sort(F.collect_list(F.struct("component", "pve"))), lambda s: s["pve"])
    return report.groupBy("model").agg(
        F.count("*").alias("n_components"),
        (F.abs(F.max("pve_cum") - 1) < 1e-9).alias("whole"),
        (shares == F.sort_array(F.collect_list("pve"), asc=False)).alias("falling"),
    ).withColumn("has_rows", features.agg(F.count("*") > 0).scalar())


@query()
def varimax_scores(spark, sf_dir):
    z = stored_zscores(spark, sf_dir, _ALL_VARIED)
    fit = lat.fit_pca(z, [f"z_{c}" for c in _ALL_VARIED])
    factors = lat.fit_varimax(fit, 10)
    return lat.factor_scores(lat.pca_scores(z, "entity_id", fit, 10), "entity_id", factors)


@query()
def varimax_loadings(spark, sf_dir):
    z = stored_zscores(spark, sf_dir, _ALL_VARIED)
    fit = lat.fit_pca(z, [f"z_{c}" for c in _ALL_VARIED])
    loadings = lat.factor_loadings(spark, lat.fit_varimax(fit, 10))
    return loadings.withColumn("family", feature_family(F.substring("feature", 3, 100)))


@query()
def varimax_variance(spark, sf_dir):
    z = stored_zscores(spark, sf_dir, _ALL_VARIED)
    fit = lat.fit_pca(z, [f"z_{c}" for c in _ALL_VARIED])
    factors = lat.fit_varimax(fit, 10, scale_loadings=True)
    return lat.variance_by_factor(lat.factor_loadings(spark, factors))


def _embedding_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(64)]
    return rows.select("vec_id", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]), names


@query()
def latent_projection(spark, sf_dir):
    """Three components of all embeddings, with their shares."""
    wide, names = _embedding_columns(spark, sf_dir)
    z = materialise(ev.zscore_matrix(wide, "vec_id", names), "latent")
    fit = lat.fit_pca(z, [f"z_{n}" for n in names], k=3)
    shares = [F.lit(float(r)).alias(f"pve_{i + 1}") for i, r in enumerate(fit.ratios)]
    return lat.pca_scores(z, "vec_id", fit).select("*", *shares)


@query(
    "WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i"
    " FROM embeddings), moments AS (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM cells GROUP BY i)"
    " SELECT vec_id, " + rounded_sql("sum(power((x - m) / s, 2))", 5) + " AS energy, "
    + rounded_sql("max(d)", 6) + " AS total_share FROM cells JOIN moments USING (i),"
    " (SELECT CAST(1.0 AS DOUBLE) AS d) GROUP BY vec_id"
)
def latent_energy(spark, sf_dir):
    """All components of the embeddings: turning the space keeps the length of every row."""
    wide, names = _embedding_columns(spark, sf_dir)
    z = materialise(ev.zscore_matrix(wide, "vec_id", names), "latent")
    fit = lat.fit_pca(z, [f"z_{n}" for n in names])
    scores = lat.pca_scores(z, "vec_id", fit)
    squares = [F.col(c) * F.col(c) for c in scores.columns if c != "vec_id"]
    energy = squares[0]
    for square in squares[1:]:
        energy = energy + square
    total = F.lit(float(fit.ratios.sum()))
    return scores.select("vec_id", rounded(energy, 5).alias("energy"), rounded(total).alias("total_share"))


@query()
def reconstruction_error(spark, sf_dir):
    """Five components of the embeddings and the error of leaving out the rest."""
    wide, names = _embedding_columns(spark, sf_dir)
    z = materialise(ev.zscore_matrix(wide, "vec_id", names), "encoded")
    fit = lat.fit_pca(z, [f"z_{n}" for n in names], k=5)
    return lat.reconstruction_error(z, "vec_id", fit)
