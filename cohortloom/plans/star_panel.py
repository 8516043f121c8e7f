"""The star schema's line items seen as a panel: one row per part and ship month.

Parts are the entities. Missing values, unreadable periods, a constant
column, a sparse column and non-numeric codes are derived from the data, so
that every operator meets them. Each Spark table here has its SQL twin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.periods import is_period, valid_period
from cohortloom.operators.features import entity_features
from cohortloom.roles import Roles
from cohortloom.sources.tables import gathered_by_partition

ROLES = Roles(
    entity="entity_id",
    period="period_raw",
    codes=["flag", "status"],
    text=["priority"],
    numeric=["quantity", "price", "tax", "disc", "const"],
)
BASES = ["quantity", "price", "tax", "disc", "const"]
MEANS = [f"mean_num_{b}" for b in BASES]
VARIED = [f"mean_num_{b}" for b in BASES if b != "const"]
FAMILIES = ["mean", "std", "min", "max"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns() -> dict:
    quantity, discount, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    # As a date format would give it, in plain arithmetic.
    month = F.lpad(F.month("l_shipdate").cast("string"), 2, "0")
    return {
        "entity_id": F.col("l_partkey").cast("string"),
        "period_raw": F.when(quantity == 50, "").otherwise(F.concat(month, F.year("l_shipdate").cast("string"))),
        "year": F.year("l_shipdate").cast("bigint"),
        "quarter": F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string")),
        "flag": F.col("l_returnflag"),
        "status": F.when(line != 7, F.col("l_linestatus")),
        "quantity": quantity,
        "price": price,
        "tax": tax,
        "disc": F.when(quantity < 45, discount),
        "const": F.lit(7.0),
        "rare": F.when((discount > 0.095) & (tax < 0.045), price),
        "dq_code": F.when(discount < 0.005, "XX")
        .when(discount > 0.095, (line - 1).cast("string"))
        .otherwise("0"),
        "upb": F.when((tax < 0.005) & (discount < 0.005), 0.0).otherwise(price),
        "rate": discount * 100,
        "ship_ts": F.col("l_shipdate"),
        "order_key": F.col("l_orderkey"),
        "line_no": line,
    }


_SQL_COLUMNS = {
    "entity_id": "CAST(l_partkey AS VARCHAR)",
    "period_raw": "CASE WHEN l_quantity = 50 THEN '' ELSE strftime(l_shipdate, '%m%Y') END",
    "year": "CAST(year(l_shipdate) AS BIGINT)",
    "quarter": "'Q' || quarter(l_shipdate)",
    "flag": "l_returnflag",
    "status": "CASE WHEN l_linenumber <> 7 THEN l_linestatus END",
    "priority": "o_orderpriority",
    "quantity": "l_quantity",
    "price": "l_extendedprice",
    "tax": "l_tax",
    "disc": "CASE WHEN l_quantity < 45 THEN l_discount END",
    "const": "CAST(7.0 AS DOUBLE)",
    "rare": "CASE WHEN l_discount > 0.095 AND l_tax < 0.045 THEN l_extendedprice END",
    "dq_code": "CASE WHEN l_discount < 0.005 THEN 'XX'"
    " WHEN l_discount > 0.095 THEN CAST(l_linenumber - 1 AS VARCHAR) ELSE '0' END",
    "upb": "CASE WHEN l_tax < 0.005 AND l_discount < 0.005 THEN 0.0::DOUBLE ELSE l_extendedprice END",
    "rate": "l_discount * 100",
    "ship_ts": "l_shipdate",
    "order_key": "l_orderkey",
    "line_no": "l_linenumber",
}

PREFIXED = {
    "flag": "cat_flag",
    "status": "cat_status",
    "priority": "txt_priority",
    **{b: f"num_{b}" for b in [*BASES, "rare"]},
}

# SQL: `base` has the derived columns, `panel` the readable rows under panel names.
BASE_SQL = (
    "base AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _SQL_COLUMNS.items())
    + " FROM lineitem JOIN part ON l_partkey = p_partkey"
    " LEFT JOIN orders ON l_orderkey = o_orderkey)"
)
PANEL_SQL = (
    BASE_SQL
    + ", parsed AS (SELECT *, CASE WHEN regexp_matches(period_raw, '^[0-9]{6}$')"
    " THEN try_strptime(period_raw, '%m%Y') END AS period_date FROM base)"
    + ", panel AS (SELECT "
    + ", ".join(f"{n} AS {PREFIXED.get(n, n)}" for n in _SQL_COLUMNS)
    + ", period_date FROM parsed WHERE period_date IS NOT NULL)"
)
LABELS_SQL = (
    "labels_of AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id,"
    " CAST(p_size % 3 AS INTEGER) AS cluster FROM part)"
)


def features_sql(bases: Sequence[str] = tuple(BASES)) -> str:
    """CTE `features`: the numeric summaries per entity."""
    parts = []
    for b in bases:
        parts += [
            f"avg(num_{b}) AS mean_num_{b}",
            f"stddev_samp(num_{b}) AS std_num_{b}",
            f"min(num_{b}) AS min_num_{b}",
            f"max(num_{b}) AS max_num_{b}",
        ]
    return (
        "features AS (SELECT entity_id, count(*) AS n_months, min(period_date) AS min_period,"
        f" max(period_date) AS max_period, {', '.join(parts)} FROM panel GROUP BY entity_id)"
    )


FEATURES_SQL = PANEL_SQL + ", " + features_sql()


def base_rows(spark: SparkSession, sf_dir: str, orders: bool = False) -> DataFrame:
    """All line items of known parts, with the derived columns.

    The join with `part` only drops unknown parts, so it is a semi-join. The
    orders are joined when their priority is asked for.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    rows = lines.join(parts, "l_partkey", "left_semi")
    columns = _columns()
    if orders:
        order = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"
        )
        rows = rows.join(order, "l_orderkey", "left")
        columns["priority"] = F.col("o_orderpriority")
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def text_rows(spark: SparkSession, sf_dir: str, gathered: Sequence[str] = ()) -> DataFrame:
    """The all-text table that a panel is built from.

    Rows are brought together by the columns `gathered` while they are typed: texts
    are the wider form.
    """
    rows = base_rows(spark, sf_dir, orders=True)
    wanted = [*ROLES.core_columns(), "dq_code", "upb", "rate", "year", "quarter"]
    if gathered:
        rows = gathered_by_partition(rows.select(*wanted), gathered)
    return rows.select(*[F.col(c).cast("string").alias(c) for c in wanted])


def panel(spark: SparkSession, sf_dir: str, orders: bool = False) -> DataFrame:
    """The typed panel: rows with a readable period text, under panel names."""
    period = F.col("period_raw")
    rows = base_rows(spark, sf_dir, orders).where(is_period(period))
    dated = rows.withColumn("period_date", valid_period(period))
    named = {n: p for n, p in PREFIXED.items() if n in rows.columns}
    return dated.withColumnsRenamed(named)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed label per entity, for the operators that take labels."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("entity_id"),
        (F.col("p_size") % 3).cast("int").alias("cluster"),
    )


def numeric_features(
    spark: SparkSession, sf_dir: str, bases: Sequence[str] = tuple(BASES)
) -> DataFrame:
    return entity_features(
        panel(spark, sf_dir), numeric=[f"num_{b}" for b in bases], coded=[]
    )
