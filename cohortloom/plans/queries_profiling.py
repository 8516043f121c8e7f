"""Registered queries: column profiles, roles, field detection, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import patterns
from cohortloom.functions.names import distinct_tokens
from cohortloom.operators import profiling as p
from cohortloom.operators.quantiles import approximate_quantiles
from cohortloom.operators.quality import temporal_range as range_of
from cohortloom.plans.registry import Registry, rounded, rounded_sql
from cohortloom.plans.star_panel import (
    BASE_SQL,
    BASES,
    MEANS,
    PANEL_SQL,
    numeric_features,
    panel,
    table,
    text_rows,
)

registry = Registry()
query = registry.query

_COLUMNS = [
    "entity_id", "period_raw", "flag", "status", "quantity", "price", "tax", "disc", "const",
    "priority", "dq_code", "upb", "rate", "quarter",
]


def _ratio_sql(pattern: str) -> str:
    hit = f"sum(CASE WHEN v IS NOT NULL AND regexp_matches(v, '{pattern}') THEN 1.0 ELSE 0.0 END)"
    return rounded_sql(f"coalesce({hit} / nullif(count(v), 0), 0)")


_PROFILE_SQL = (
    f"WITH {BASE_SQL}, cells AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, CASE WHEN CAST({c} AS VARCHAR) NOT IN ('', 'nan', '<NA>')"
        f" THEN CAST({c} AS VARCHAR) END AS v FROM base"
        for c in _COLUMNS
    )
    + "), profile AS (SELECT col, "
    + rounded_sql("count(v) / count(*)")
    + " AS non_null_ratio, "
    + _ratio_sql(patterns.NUMERIC)
    + " AS numeric_ratio, "
    + _ratio_sql(patterns.SIX_DIGITS)
    + " AS six_digit_ratio, "
    + _ratio_sql(patterns.SHORT_CODE)
    + " AS short_code_ratio, count(DISTINCT v) AS n_unique FROM cells GROUP BY col)"
)
_RATIOS = ["non_null_ratio", "numeric_ratio", "six_digit_ratio", "short_code_ratio"]


@query(_PROFILE_SQL + " SELECT * FROM profile")
def column_profile(spark, sf_dir):
    found = p.profile_columns(text_rows(spark, sf_dir), _COLUMNS, exact=True)
    return found.select("col", *[rounded(c).alias(c) for c in _RATIOS], "n_unique")


@query(
    _PROFILE_SQL + " SELECT col, CASE WHEN col = 'entity_id' THEN 'entity'"
    " WHEN col = 'period_raw' THEN 'period' WHEN col = 'const' THEN 'drop'"
    " WHEN non_null_ratio > 0.30 AND numeric_ratio > 0.98 THEN 'numeric'"
    " WHEN non_null_ratio > 0.30 AND short_code_ratio > 0.80 AND n_unique <= 200 THEN 'codes'"
    " WHEN non_null_ratio > 0.30 AND n_unique <= 5000 THEN 'text' ELSE 'unused' END AS role"
    " FROM profile"
)
def column_roles(spark, sf_dir):
    found = p.profile_columns(text_rows(spark, sf_dir), _COLUMNS, exact=True)
    return p.assign_roles(found, "entity_id", "period_raw", drop=["const"])


_FIELDS = {
    "entity_id": "string", "period_raw": "string", "period_date": "timestamp_ntz",
    "year": "bigint", "quarter": "string", "cat_flag": "string", "cat_status": "string",
    "num_quantity": "double", "num_price": "double", "num_tax": "double", "num_disc": "double",
    "dq_code": "string", "upb": "double", "rate": "double", "line_no": "int",
    "order_key": "bigint",
}


def _field_sql(name: str, dtype: str) -> str:
    if dtype == "string":
        def hit(pattern):
            return rounded_sql(
                f"avg(CASE WHEN regexp_matches({name}, '{pattern}') THEN 1.0 ELSE 0.0 END)"
            )

        rest = (
            f"'text' AS kind, CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value,"
            f" {hit(patterns.YEAR_MONTH)} AS yyyymm_ratio,"
            f" {hit(patterns.TERMINATION_STRICT)} AS zbc_ratio, count(DISTINCT {name}) AS n_unique"
        )
    elif dtype == "timestamp_ntz":
        month = f"CAST(strftime({name}, '%Y%m') AS INTEGER)"
        rest = (
            f"'date', CAST(min({month}) AS DOUBLE), CAST(max({month}) AS DOUBLE), 1.0, 0.0,"
            f" count(DISTINCT {month})"
        )
    else:
        kind = "integer" if dtype in ("bigint", "int") else "fraction"
        rest = (
            f"'{kind}', {rounded_sql(f'min({name})')}, {rounded_sql(f'max({name})')}, 0.0, 0.0,"
            f" count(DISTINCT {name})"
        )
    return f"SELECT '{name}' AS \"column\", '{dtype}' AS type, {rest} FROM panel"


_FIELD_PROFILE_SQL = (
    f"WITH {PANEL_SQL}, fields AS ("
    + " UNION ALL ".join(_field_sql(n, t) for n, t in _FIELDS.items())
    + ")"
)
_MONTHS = "min_value BETWEEN 199000 AND 202700 AND max_value BETWEEN 199000 AND 202900"
_SCORES_SQL = (
    _FIELD_PROFILE_SQL + ", scores AS (SELECT *, CASE WHEN kind = 'integer' AND " + _MONTHS
    + " THEN 6 ELSE 0 END + CASE WHEN kind = 'text' AND yyyymm_ratio >= 0.6 THEN 6 ELSE 0 END"
    + " + CASE WHEN kind = 'date' AND " + _MONTHS + " THEN 7 ELSE 0 END AS score_period,"
    " CASE WHEN kind = 'integer' AND min_value >= 0 AND max_value <= 12 AND n_unique <= 20"
    " THEN 7 ELSE 0 END AS score_dq,"
    " CASE WHEN kind = 'integer' AND min_value >= 0 AND max_value <= 99 AND n_unique <= 40"
    " THEN 5 ELSE 0 END + CASE WHEN kind = 'text' AND zbc_ratio >= 0.4 THEN 7 ELSE 0 END"
    " AS score_zbc,"
    " CASE WHEN kind IN ('integer', 'fraction') AND max_value >= 50000 AND n_unique >= 1000"
    " THEN 5 ELSE 0 END AS score_upb,"
    " CASE WHEN kind = 'fraction' AND min_value >= 0 AND max_value <= 20 THEN 5 ELSE 0 END"
    " AS score_rate FROM fields)"
)


def _fields(spark, sf_dir):
    found = p.field_profile(panel(spark, sf_dir).select(*_FIELDS), exact=True)
    return found.select(
        "column", "type", "kind",
        *[rounded(c).alias(c) for c in ("min_value", "max_value", "yyyymm_ratio", "zbc_ratio")],
        "n_unique",
    )


@query(_FIELD_PROFILE_SQL + " SELECT * FROM fields")
def field_profile(spark, sf_dir):
    return _fields(spark, sf_dir)


_SCORE_COLUMNS = ["score_period", "score_dq", "score_zbc", "score_upb", "score_rate"]


@query(_SCORES_SQL + ' SELECT "column", ' + ", ".join(_SCORE_COLUMNS) + " FROM scores")
def field_role_scores(spark, sf_dir):
    return p.score_fields(_fields(spark, sf_dir)).select("column", *_SCORE_COLUMNS)


@query(
    _SCORES_SQL + ", long AS ("
    + " UNION ALL ".join(
        f'SELECT \'{r}\' AS role, "column", score_{r} AS score FROM scores' for r in p.FIELD_ROLES
    )
    + ") SELECT role, arg_min(\"column\", row(-score, \"column\")) FILTER (WHERE score > 0)"
    ' AS "column", max(score) AS score FROM long GROUP BY role'
)
def field_resolution(spark, sf_dir):
    return p.resolve_fields(p.score_fields(_fields(spark, sf_dir)))


_CODES = ["cat_flag", "cat_status", "dq_code", "line_no", "num_quantity", "quarter", "rate"]
_REFINE_SQL = (
    f"WITH {PANEL_SQL}, cells AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM panel WHERE {c} IS NOT NULL"
        for c in _CODES
    )
    + '), refined AS (SELECT "column", '
    + rounded_sql(
        f"avg(CASE WHEN regexp_matches(trim(v), '{patterns.DELINQUENCY}') THEN 1.0 ELSE 0.0 END)"
    )
    + " AS dq_ratio, "
    + rounded_sql(
        f"avg(CASE WHEN regexp_matches(trim(v), '{patterns.TERMINATION}') THEN 1.0 ELSE 0.0 END)"
    )
    + ' AS zbc_ratio, count(DISTINCT v) AS n_unique FROM cells GROUP BY "column")'
)


def _refined(spark, sf_dir):
    found = p.refine_code_fields(panel(spark, sf_dir), _CODES)
    return found.select(
        "column", rounded("dq_ratio").alias("dq_ratio"), rounded("zbc_ratio").alias("zbc_ratio"),
        "n_unique",
    )


@query(_REFINE_SQL + " SELECT * FROM refined")
def code_field_refine(spark, sf_dir):
    return _refined(spark, sf_dir)


@query(
    _REFINE_SQL + " SELECT 'dq' AS role, arg_min(\"column\", row(-dq_ratio, n_unique, \"column\"))"
    ' FILTER (WHERE dq_ratio >= 0.30) AS "column", max(dq_ratio) AS ratio FROM refined'
    " UNION ALL SELECT 'zbc', arg_min(\"column\", row(-zbc_ratio, n_unique, \"column\"))"
    " FILTER (WHERE zbc_ratio >= 0.10), max(zbc_ratio) FROM refined"
)
def code_field_choice(spark, sf_dir):
    return p.choose_code_fields(_refined(spark, sf_dir))


_TOKEN = "[A-Z][a-z]{5,}|[0-9]{3,}"


@query(
    "SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ',') AS tokens"
    " FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '"
    + _TOKEN
    + "'))) AS tokens FROM documents)"
)
def model_tokens(spark, sf_dir):
    """All different tokens of every whole text."""
    tokens = distinct_tokens(F.col("text"), _TOKEN)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", tokens.alias("t"))
        .select(
            "doc_id",
            F.size("t").cast("bigint").alias("n_tokens"),
            F.array_join("t", ",").alias("tokens"),
        )
    )


@query()
def column_profile_sketch(spark, sf_dir):
    """The single-pass profile with estimated distinct counts."""
    return p.profile_columns(text_rows(spark, sf_dir), _COLUMNS)


@query()
def field_profile_sketch(spark, sf_dir):
    return p.field_profile(panel(spark, sf_dir).select(*_FIELDS))


@query()
def approx_distinct_entities(spark, sf_dir):
    return range_of(panel(spark, sf_dir), "entity_id", "period_date")


@query()
def approx_quantiles(spark, sf_dir):
    features = numeric_features(spark, sf_dir, BASES)
    return approximate_quantiles(features, MEANS, [0.01, 0.25, 0.5, 0.75, 0.99])


@query(
    f"WITH {PANEL_SQL} SELECT count(*) AS n_rows, TRUE AS entities_close, TRUE AS median_close"
    " FROM panel"
)
def sketch_consistency(spark, sf_dir):
    """Estimates beside exact answers: distinct entities within 10 %, the median within 1 % of ranks."""
    rows = panel(spark, sf_dir).select("entity_id", "num_price")
    median = rows.agg(F.percentile_approx("num_price", 0.5)).scalar()
    # Counted apart: beside it, Spark would keep a sketch for every different entity.
    exact = rows.agg(F.count_distinct("entity_id")).scalar()
    counted = rows.withColumn("_m", median).agg(
        F.count("*").alias("n_rows"),
        F.approx_count_distinct("entity_id").alias("estimate"),
        F.first(exact).alias("exact"),
        F.avg(F.when(F.col("num_price") <= F.col("_m"), 1.0).otherwise(0.0)).alias("below"),
    )
    return counted.select(
        "n_rows",
        (F.abs(F.col("estimate") / F.col("exact") - 1) < 0.1).alias("entities_close"),
        (F.abs(F.col("below") - 0.5) < 0.01).alias("median_close"),
    )
