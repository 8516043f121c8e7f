"""The whole analysis as stages over stored tables, from text members to checked reports.

Each stage reads what earlier ones stored below one root folder and stores its
own result, so any stage can be repeated alone, and a lost executor never
costs more than the stage that was running.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from cohortloom.functions.names import columns_with_prefix
from cohortloom.operators import clustering as cl
from cohortloom.operators import evidence as ev
from cohortloom.operators import expectations as ex
from cohortloom.operators import latent as lat
from cohortloom.operators import profiles as pr
from cohortloom.operators import profiling as pf
from cohortloom.operators import quality as ql
from cohortloom.operators import risk as rk
from cohortloom.operators.features import entity_features
from cohortloom.operators.panel import build_panel
from cohortloom.operators.shape import select_roles
from cohortloom.roles import Roles
from cohortloom.sources.delimited import MEMBER_KEYS, ingest_delimited
from cohortloom.sources.tables import gathered_by_partition, scan_table, write_report, write_table

KEYS = ("year", "quarter")
ENTITY = "entity_id"


@dataclass(frozen=True)
class Study:
    """One analysis: a session and the root folder of its tables."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def store(self, df: DataFrame, name: str) -> DataFrame:
        write_table(df, self.path(name), mode="overwrite")
        return self.read(name)

    def report(self, df: DataFrame, name: str) -> None:
        write_report(df, self.path(f"reports/{name}"))


def load_bronze(study: Study, source: str, **options) -> DataFrame:
    """Text members to the all-text table `bronze`; returns the load log."""
    return ingest_delimited(
        study.spark, source, study.path("bronze"), log_path=study.path("load_log"), **options
    )


def build_silver(study: Study, entity: str, period: str, drop: Sequence[str] = ()) -> Roles:
    """Profile the columns, give them roles, store the role-selected table and quality reports."""
    bronze = scan_table(study.spark, study.path("bronze"))
    columns = [c for c in bronze.columns if c not in MEMBER_KEYS]
    profile = study.store(pf.profile_columns(bronze, columns), "column_profile")
    roles = pf.roles_from(pf.assign_roles(profile, entity, period, drop), KEYS)
    write_table(
        select_roles(bronze, roles), study.path("silver"), KEYS, mode="overwrite"
    )
    silver = scan_table(study.spark, study.path("silver"))
    study.report(ql.partition_quality(silver, KEYS, entity, period), "partition_quality")
    study.report(ql.coverage(silver, entity, period), "coverage")
    study.report(ql.duplicate_keys(silver, KEYS, [entity, period]), "duplicate_keys")
    study.report(ql.missing_by_column(silver, roles.core_columns()), "missing_by_column")
    return roles


def build_gold(study: Study, roles: Roles, keep: Column | None = None) -> None:
    """The typed panel of the kept entities, and one wide row of features per entity."""
    silver = scan_table(study.spark, study.path("silver"))
    panel = build_panel(silver, roles, keep=keep, entity_name=ENTITY)
    gathered = gathered_by_partition(panel, KEYS)
    write_table(gathered, study.path("panel"), KEYS, mode="overwrite")
    stored = scan_table(study.spark, study.path("panel"))
    # Partition values were features of no entity: only prefixed columns are summarised.
    study.store(entity_features(stored, ENTITY), "features")


def build_matrix(study: Study, prefix: str = "mean_num_", **limits) -> list[str]:
    """Evidence and selection of features, and the standardised matrix of those kept."""
    features = study.read("features")
    families = [f"{f}_num_" for f in ("mean", "std", "min", "max")]
    everything = columns_with_prefix(features, families)
    missing = study.store(ev.feature_missingness(features, everything), "missingness")
    study.report(missing, "missingness")
    study.report(ev.missingness_by_family(missing), "missingness_by_family")
    stats = study.store(
        ev.feature_stats(features, columns_with_prefix(features, prefix)), "feature_stats"
    )
    decisions = study.store(ev.select_features(stats, **limits), "decisions")
    kept = ev.kept_features(decisions)
    study.store(ev.zscore_matrix(features, ENTITY, kept), "matrix")
    return kept


def build_factors(study: Study, m: int = 10) -> None:
    """Components and rotated factors of the matrix: scores, loadings, variance reports."""
    matrix = study.read("matrix")
    columns = columns_with_prefix(matrix, "z_")
    fit = lat.fit_pca(matrix, columns)
    scores = study.store(lat.pca_scores(matrix, ENTITY, fit), "component_scores")
    factors = lat.fit_varimax(fit, m)
    study.store(lat.factor_scores(scores, ENTITY, factors), "factor_scores")
    study.report(lat.explained_variance(study.spark, fit), "explained_variance")
    loadings = lat.factor_loadings(study.spark, factors)
    study.report(loadings, "factor_loadings")
    study.report(lat.variance_by_factor(loadings), "variance_by_factor")
    study.report(pr.top_loadings(loadings), "top_loadings")


def build_segments(
    study: Study, sizes: Sequence[int] = (10, 5), n_init: int = 50, **sweep
) -> tuple[str, int]:
    """Compare spaces, fit the best one at its best k, store labels and profiles."""
    spaces = {}
    for table, tag, letter in (("factor_scores", "EFA_F", "F"), ("component_scores", "PCA_PC", "PC")):
        scores = study.read(table)
        for size in sizes:
            columns = [c for c in lat.component_names(size, letter) if c in scores.columns]
            spaces[f"{tag}1-{size}"] = (scores, columns)
    report = study.store(cl.compare_spaces(spaces, ENTITY, **sweep), "space_report")
    study.report(cl.best_per_group(report), "best_per_space")
    space, k = cl.winner(report)
    table, columns = spaces[space]
    fit = cl.kmeans_fit(table, ENTITY, columns, k, n_init)
    labels = study.store(fit.labels, "labels")
    study.report(fit.centroids, "centroids")
    sizes_report = study.store(pr.cluster_sizes(labels), "cluster_sizes")
    profile = pr.cluster_profile(table, labels, ENTITY, columns)
    study.report(pr.full_profile(sizes_report, profile), "cluster_profile")
    return space, k


def resolve_risk_fields(study: Study) -> dict[str, str | None]:
    """The panel's period, delinquency, termination, balance and rate columns, found by profile."""
    panel = scan_table(study.spark, study.path("panel"))
    profile = study.store(pf.field_profile(panel), "field_profile")
    scores = pf.score_fields(profile)
    study.report(scores, "field_scores")
    found = {r["role"]: r["column"] for r in pf.resolve_fields(scores).collect()}
    candidates = pf.code_candidates(profile, exclude=[ENTITY])
    if candidates:
        refined = study.store(pf.refine_code_fields(panel, candidates), "code_fields")
        chosen = pf.choose_code_fields(refined).collect()
        found.update({r["role"]: r["column"] for r in chosen if r["column"]})
    return found


def build_risk(study: Study, delinquency: str, balance: str, rate: str) -> None:
    """Risk of every entity, risk of every cluster, and the clusters' share by year."""
    panel = scan_table(study.spark, study.path("panel"))
    labels = study.read("labels")
    metrics = study.store(
        rk.risk_metrics(panel, ENTITY, "period_date", delinquency, balance, rate), "risk_metrics"
    )
    study.store(rk.rates_by_cluster(metrics, labels, ENTITY), "risk_rates")
    study.report(rk.cohort_by_first_year(metrics, labels, ENTITY), "cohorts")
    study.store(rk.cluster_share_by_year(panel, labels, ENTITY, "period_date"), "year_shares")


def check_study(study: Study, min_rows: int = 10_000) -> DataFrame:
    """All results present and within their ranges: one row per check."""
    rates, shares = study.read("risk_rates"), study.read("year_shares")
    spaces, sizes = study.read("space_report"), study.read("cluster_sizes")
    outputs = ["bronze", "silver", "panel", "features", "matrix", "factor_scores", "labels",
               "risk_metrics", "risk_rates", "year_shares"]
    rate_columns = columns_with_prefix(rates, "ever_") + ["terminated_rate"]
    return ex.run_expectations(
        [
            ex.expect_outputs(study.spark, study.root, outputs),
            ex.expect_min_rows(study.read("factor_scores"), min_rows, "factor_scores"),
            ex.expect_columns(spaces, ["space", "k", "silhouette"], "space_report"),
            ex.expect_between(spaces, "silhouette", -1.0, 1.0, "space_report"),
            ex.expect_best_at_least(spaces, "k", "silhouette", 2, "space_report"),
            ex.expect_total_equal(sizes, "n_entities", study.read("labels"), "cluster_sizes"),
            *[ex.expect_between(rates, c, 0.0, 1.0, "risk_rates") for c in rate_columns],
            ex.expect_between(shares, "share", 0.0, 1.0, "year_shares"),
            ex.expect_group_sum(shares, ["year"], "share", 1.0, "year_shares"),
        ]
    )
