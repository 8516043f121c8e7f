"""Registered queries: shaping, parsing, the panel, samples, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.cleaning import to_double, to_int
from cohortloom.functions.periods import parse_period
from cohortloom.operators.panel import build_panel, restrict_to
from cohortloom.operators.sampling import in_sample, sample_entities, sample_parameters, sample_rows, split_rows
from cohortloom.operators.shape import align_schema, as_strings, rename_positional
from cohortloom.plans.registry import Registry, rounded, rounded_sql
from cohortloom.plans.star_panel import (
    BASE_SQL,
    PANEL_SQL,
    ROLES,
    panel,
    table,
    text_rows,
)
from cohortloom.sources.tables import partition_counts, scan_table

registry = Registry()
query = registry.query

_PANEL_OUT = (
    "entity_id, period_raw, period_date, year, quarter, cat_flag, cat_status, txt_priority,"
    " num_quantity, num_price, num_tax, num_disc, num_const"
)


@query(f"WITH {PANEL_SQL} SELECT {_PANEL_OUT} FROM panel")
def panel_build(spark, sf_dir):
    built = build_panel(text_rows(spark, sf_dir), ROLES)
    return built.withColumn("year", F.col("year").cast("bigint"))


@query(
    "WITH texts AS (SELECT l_linenumber AS kind, CASE l_linenumber"
    " WHEN 2 THEN substr(strftime(l_shipdate, '%m%Y'), 2)"
    " WHEN 3 THEN '13' || strftime(l_shipdate, '%Y') WHEN 4 THEN ''"
    " WHEN 5 THEN NULL WHEN 6 THEN strftime(l_shipdate, '%Y-%m')"
    " ELSE strftime(l_shipdate, '%m%Y') END AS text FROM lineitem)"
    " SELECT kind, CASE WHEN regexp_matches(text, '^[0-9]{6}$')"
    " THEN try_strptime(text, '%m%Y') END AS period_date, count(*) AS n FROM texts GROUP BY ALL"
)
def period_parse(spark, sf_dir):
    """Good texts and five kinds of bad ones: short, month 13, empty, NULL, other format."""
    shipped, kind = F.col("l_shipdate"), F.col("l_linenumber")
    good = F.date_format(shipped, "MMyyyy")
    text = (
        F.when(kind == 2, F.substring(good, 2, 6))
        .when(kind == 3, F.concat(F.lit("13"), F.date_format(shipped, "yyyy")))
        .when(kind == 4, "")
        .when(kind == 5, F.lit(None))
        .when(kind == 6, F.date_format(shipped, "yyyy-MM"))
        .otherwise(good)
    )
    lines = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), text.alias("text"))
    return lines.groupBy("kind", parse_period(F.col("text")).alias("period_date")).agg(
        F.count("*").alias("n")
    )


@query(
    "WITH texts AS (SELECT CASE l_linenumber WHEN 1 THEN CAST(l_quantity / 2 AS VARCHAR)"
    " WHEN 2 THEN CAST(-l_quantity / 2 AS VARCHAR) WHEN 3 THEN ' ' || CAST(CAST(l_quantity AS"
    " INTEGER) AS VARCHAR) WHEN 4 THEN '0' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"
    " WHEN 5 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'e1' WHEN 6 THEN"
    " CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'd' ELSE l_returnflag END AS text"
    " FROM lineitem) SELECT text, CAST(TRY_CAST(text AS INTEGER) AS DOUBLE) AS as_int,"
    " TRY_CAST(text AS DOUBLE) AS as_double, count(*) AS n FROM texts GROUP BY ALL"
)
def text_to_numeric(spark, sf_dir):
    """Fractions, negatives, blanks, leading zeros, exponents, suffixes and words."""
    kind, quantity = F.col("l_linenumber"), F.col("l_quantity")
    whole = quantity.cast("int").cast("string")
    text = (
        F.when(kind == 1, (quantity / 2).cast("string"))
        .when(kind == 2, (-quantity / 2).cast("string"))
        .when(kind == 3, F.concat(F.lit(" "), whole))
        .when(kind == 4, F.concat(F.lit("0"), whole))
        .when(kind == 5, F.concat(whole, F.lit("e1")))
        .when(kind == 6, F.concat(whole, F.lit("d")))
        .otherwise(F.col("l_returnflag"))
    )
    counts = table(spark, sf_dir, "lineitem").groupBy(text.alias("text")).agg(
        F.count("*").alias("n")
    )
    parsed = F.col("text")
    return counts.select(
        "text",
        to_int(parsed).cast("double").alias("as_int"),
        to_double(parsed).alias("as_double"),
        "n",
    )


@query(
    f"WITH {BASE_SQL} SELECT entity_id, CAST(NULL AS VARCHAR) AS absent, period_raw,"
    " CAST(quantity AS VARCHAR) AS quantity, quarter FROM base"
)
def schema_align(spark, sf_dir):
    wanted = ["entity_id", "absent", "period_raw", "quantity", "quarter"]
    return align_schema(text_rows(spark, sf_dir), wanted)


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS c000, c_name AS c001,"
    " CAST(c_nationkey AS VARCHAR) AS c002, CAST(c_acctbal AS VARCHAR) AS c003 FROM customer"
)
def positional_rename(spark, sf_dir):
    return as_strings(
        rename_positional(table(spark, sf_dir, "customer"), ["c000", "c001", "c002", "c003"])
    )


_BUCKET_SQL = "CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 10000 < 150"
_SAMPLE_SQL = (
    "SELECT DISTINCT entity_id FROM base WHERE " + _BUCKET_SQL.format(key="entity_id")
)


@query(f"WITH {BASE_SQL} {_SAMPLE_SQL}")
def entity_sample_hash(spark, sf_dir):
    rows = text_rows(spark, sf_dir).select("entity_id")
    return sample_entities(rows, "entity_id", portable=True)


@query(
    f"WITH {BASE_SQL} SELECT 10000 AS buckets, 150 AS threshold, CAST(0.015 AS DOUBLE) AS fraction,"
    f" count(*) AS n_entities FROM ({_SAMPLE_SQL})"
)
def entity_sample_record(spark, sf_dir):
    """The record that is stored with a sample of entities."""
    rows = text_rows(spark, sf_dir).select("entity_id")
    return sample_parameters(sample_entities(rows, "entity_id", portable=True), 10_000, 150)


_SEMI_SQL = (
    f"WITH {PANEL_SQL}, ids AS ({_SAMPLE_SQL}) SELECT entity_id, count(*) AS n_months,"
    " min(period_date) AS min_period, max(period_date) AS max_period"
    " FROM panel WHERE entity_id IN (SELECT entity_id FROM ids) GROUP BY entity_id"
)


def _month_ranges(rows):
    return rows.groupBy("entity_id").agg(
        F.count("*").alias("n_months"),
        F.min("period_date").alias("min_period"),
        F.max("period_date").alias("max_period"),
    )


@query(_SEMI_SQL)
def panel_semi_join(spark, sf_dir):
    """The sample applied as a table of ids."""
    rows = panel(spark, sf_dir)
    ids = sample_entities(rows, "entity_id", portable=True)
    return _month_ranges(restrict_to(rows, ids, "entity_id"))


@query(_SEMI_SQL)
def panel_hash_filter(spark, sf_dir):
    """The same sample applied as a predicate on the scan: no join."""
    return _month_ranges(
        panel(spark, sf_dir).where(in_sample(F.col("entity_id"), portable=True))
    )


@query(
    "SELECT DISTINCT user_id FROM events"
)
def distinct_entities(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id").distinct()


_ORDER_SQL = "CAST('0x' || substr(md5('42:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


@query(
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY "
    + _ORDER_SQL.format(key="c_custkey")
    + ", c_custkey LIMIT 500"
)
def hash_ordered_sample(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sample_rows(customers, 500, ["c_custkey"], seed=42, portable=True)


@query(
    "SELECT p_partkey, CASE WHEN "
    + _ORDER_SQL.format(key="p_partkey")
    + " % 100 < 80 THEN 'train' ELSE 'validation' END AS part FROM part"
)
def split_train_val(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return split_rows(parts, ["p_partkey"], portable=True)


@query(
    f"WITH {BASE_SQL} SELECT year, quarter, count(*) AS n_rows FROM base GROUP BY year, quarter"
)
def partition_row_counts(spark, sf_dir):
    return partition_counts(text_rows(spark, sf_dir).withColumn("year", F.col("year").cast("bigint")))


@query(
    f"SELECT event_type, count(*) AS n, {rounded_sql('sum(value)', 3)} AS total"
    " FROM events WHERE value >= 10 GROUP BY event_type"
)
def projected_scan(spark, sf_dir):
    """Two of six columns and the filter reach the Parquet reader."""
    rows = scan_table(spark, sf_dir, "events.parquet", columns=["event_type", "value"])
    rows = rows.where(F.col("value") >= 10)
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), rounded(F.sum("value"), 3).alias("total")
    )
