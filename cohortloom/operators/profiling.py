"""What the columns of a table look like, and which role each can play."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import patterns
from cohortloom.functions.cleaning import MISSING_SENTINELS, tokens_to_null
from cohortloom.functions.periods import yyyymm
from cohortloom.operators.tidy import melt, tidy_aggregate, value_frequencies
from cohortloom.roles import Roles

# Thresholds of the automatic column roles.
MIN_NON_NULL = 0.30
MIN_NUMERIC = 0.98
MIN_SHORT_CODE = 0.80
MAX_CODES = 200
MAX_TEXTS = 5000

# A code field needs at least these shares of matching values.
MIN_DELINQUENCY_RATIO = 0.30
MIN_TERMINATION_RATIO = 0.10

FIELD_ROLES = ("period", "dq", "zbc", "upb", "rate")

# Whole numbers up to this size are exact as doubles.
_EXACT_DOUBLE = 2**53


def _share(condition: Column, weight: Column, of: Column) -> Column:
    """Weighted share of `of` that also meets the condition; 0 when nothing does."""
    part = F.sum(F.when(of & condition, weight).otherwise(0))
    whole = F.sum(F.when(of, weight).otherwise(0))
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False
) -> DataFrame:
    """Per column: shares of present, numeric, six-digit and short-code values, distinct count.

    The default reads the table once and estimates the distinct count; only
    one row per column and task is shuffled. `exact` first counts each
    column's different values, so that the text classes are tested once per
    different value instead of once per row.
    """
    columns = list(columns or df.columns)
    if exact:
        cells = value_frequencies(df, columns)
    else:
        cells = melt(df, columns, key="col", dtype="string").withColumn("n", F.lit(1))
    text = tokens_to_null(F.col("value"), MISSING_SENTINELS)
    present, weight = text.isNotNull(), F.col("n")
    profile = cells.groupBy("col").agg(
        _share(present, weight, F.lit(True)).alias("non_null_ratio"),
        _share(text.rlike(patterns.NUMERIC), weight, present).alias("numeric_ratio"),
        _share(text.rlike(patterns.SIX_DIGITS), weight, present).alias("six_digit_ratio"),
        _share(text.rlike(patterns.SHORT_CODE), weight, present).alias("short_code_ratio"),
        (F.count(text) if exact else F.approx_count_distinct(text)).alias("n_unique"),
    )
    return profile.orderBy(
        F.desc("numeric_ratio"), F.desc("short_code_ratio"), F.desc("non_null_ratio"), "col"
    )


def assign_roles(
    profile: DataFrame, entity: str, period: str, drop: Sequence[str] = ()
) -> DataFrame:
    """Role of every profiled column: entity, period, drop, numeric, codes, text or unused."""
    filled = F.col("non_null_ratio") > MIN_NON_NULL
    few = F.col("n_unique")
    role = (
        F.when(F.col("col") == entity, "entity")
        .when(F.col("col") == period, "period")
        .when(F.col("col").isin(*drop) if drop else F.lit(False), "drop")
        .when(filled & (F.col("numeric_ratio") > MIN_NUMERIC), "numeric")
        .when(filled & (F.col("short_code_ratio") > MIN_SHORT_CODE) & (few <= MAX_CODES), "codes")
        .when(filled & (few <= MAX_TEXTS), "text")
        .otherwise("unused")
    )
    return profile.select("col", role.alias("role"))


def roles_from(
    assigned: DataFrame, partitions: Sequence[str] = ("year", "quarter")
) -> Roles:
    """The assigned roles as a `Roles` object. Reads one row per column of the table."""
    names: dict[str, list[str]] = {}
    for row in assigned.orderBy("col").collect():
        if row["col"] not in partitions:
            names.setdefault(row["role"], []).append(row["col"])
    return Roles(
        entity=names["entity"][0],
        period=names["period"][0],
        numeric=names.get("numeric", []),
        codes=names.get("codes", []),
        text=names.get("text", []),
        drop=names.get("drop", []),
        partitions=list(partitions),
    )


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "fraction"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text"


def field_profile(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False
) -> DataFrame:
    """Per column: type, range, distinct count, and shares of month-like and termination-code texts.

    Dates are profiled as YYYYMM numbers; texts have no range. One pass; with `exact` it counts
    the different values, from which everything else follows, and an empty table has its rows, too.
    """
    kinds = {f.name: _kind(f.dataType) for f in df.schema.fields}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = list(columns or df.columns)
    if exact:
        return _exact_field_profile(df, columns, kinds, types)

    def seen(c: str) -> Column:
        return yyyymm(F.col(f"`{c}`")) if kinds[c] == "date" else F.col(f"`{c}`")

    def bound(c: str, which) -> Column:
        if kinds[c] == "text":
            return F.lit(None).cast("double")
        return which(seen(c)).cast("double")

    def month_like(c: str) -> Column:
        if kinds[c] == "text":
            return F.coalesce(patterns.match_ratio(F.col(f"`{c}`"), patterns.YEAR_MONTH), F.lit(0.0))
        return F.lit(1.0 if kinds[c] == "date" else 0.0)

    def termination_like(c: str) -> Column:
        if kinds[c] == "text":
            found = patterns.match_ratio(F.col(f"`{c}`"), patterns.TERMINATION_STRICT)
            return F.coalesce(found, F.lit(0.0))
        return F.lit(0.0)

    stats = {
        "type": lambda c: F.lit(types[c]),
        "kind": lambda c: F.lit(kinds[c]),
        "min_value": lambda c: bound(c, F.min),
        "max_value": lambda c: bound(c, F.max),
        "yyyymm_ratio": month_like,
        "zbc_ratio": termination_like,
        "n_unique": lambda c: F.approx_count_distinct(seen(c)),
    }
    return tidy_aggregate(df, columns, stats, key="column")


def _number_and_text(value: Column, kind: str, dtype: str) -> tuple[Column, Column]:
    """A value as a number or, where a double would not hold it, a text; the other one is NULL."""
    if kind == "date":
        value = yyyymm(value)
    number, text = value.cast("double"), value.cast("string")
    if kind == "text" or dtype.startswith("decimal"):
        return F.lit(None).cast("double"), text
    if dtype == "bigint":
        held = value.between(-_EXACT_DOUBLE, _EXACT_DOUBLE)
        return F.when(held, number), F.when(~held, text)
    return number, F.lit(None).cast("string")


def _exact_field_profile(
    df: DataFrame, columns: Sequence[str], kinds: dict[str, str], types: dict[str, str]
) -> DataFrame:
    """`field_profile` from the different values of every column and how often each occurs.

    Numbers are counted as numbers, in short keys, and a pattern is tested once per
    different text.
    """
    cells = []
    for at, c in enumerate(columns):
        cells += [F.lit(at), *_number_and_text(F.col(f"`{c}`"), kinds[c], types[c])]
    values = (
        df.select(F.stack(F.lit(len(columns)), *cells).alias("at", "number", "text"))
        .groupBy("at", "number", "text")
        .agg(F.count("*").alias("n"))
    )
    fields = [
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.lit(kinds[c]).alias("kind"))
        for c in columns
    ]
    texts = [at for at, c in enumerate(columns) if kinds[c] == "text"]
    is_text, n = F.col("at").isin(texts), F.col("n")
    as_number = F.when(~is_text, F.coalesce("number", F.col("text").try_cast("double")))
    stats = values.groupBy("at").agg(
        F.min(as_number).alias("min_value"),
        F.max(as_number).alias("max_value"),
        *[
            _share(is_text & F.col("text").rlike(pattern), n, F.lit(True)).alias(name)
            for name, pattern in (
                ("yyyymm_ratio", patterns.YEAR_MONTH),
                ("zbc_ratio", patterns.TERMINATION_STRICT),
            )
        ],
        F.count(F.when(F.col("number").isNotNull() | F.col("text").isNotNull(), 1)).alias("n_unique"),
    )
    known = df.sparkSession.range(1).select(F.posexplode(F.array(*fields)).alias("at", "field"))
    return known.join(stats, "at", "left").select(
        "field.*",
        "min_value",
        "max_value",
        F.when(F.col("field.kind") == "date", 1.0)
        .otherwise(F.coalesce("yyyymm_ratio", F.lit(0.0)))
        .alias("yyyymm_ratio"),
        F.coalesce("zbc_ratio", F.lit(0.0)).alias("zbc_ratio"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
    )


def score_fields(profile: DataFrame) -> DataFrame:
    """Points of every field for each of the five risk roles."""
    low, high, unique = F.col("min_value"), F.col("max_value"), F.col("n_unique")
    integer = F.col("kind") == "integer"
    fraction = F.col("kind") == "fraction"
    text = F.col("kind") == "text"
    is_date = F.col("kind") == "date"

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    # The ranges and the points given for them.
    month_range = low.between(199000, 202700) & high.between(199000, 202900)
    wide_types = F.col("type").isin("bigint", "int") | fraction
    return profile.select(
        "*",
        (
            points(integer & month_range, 6)
            + points(text & (F.col("yyyymm_ratio") >= 0.6), 6)
            + points(is_date & month_range, 7)
        ).alias("score_period"),
        points(integer & (low >= 0) & (high <= 12) & (unique <= 20), 7).alias("score_dq"),
        (
            points(integer & (low >= 0) & (high <= 99) & (unique <= 40), 5)
            + points(text & (F.col("zbc_ratio") >= 0.4), 7)
        ).alias("score_zbc"),
        points(wide_types & (high >= 50000) & (unique >= 1000), 5).alias("score_upb"),
        points(fraction & (low >= 0.0) & (high <= 20.0), 5).alias("score_rate"),
    )


def resolve_fields(scores: DataFrame) -> DataFrame:
    """The best field per role. Ties go to the first name; no points at all give NULL."""
    options = F.array(
        *[
            F.struct(F.lit(r).alias("role"), F.col(f"score_{r}").alias("score"))
            for r in FIELD_ROLES
        ]
    )
    long = scores.select("column", F.inline(options))
    return long.groupBy("role").agg(
        F.min_by(
            "column",
            F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("s"), "column")),
        ).alias("column"),
        F.max("score").alias("score"),
    )


def code_candidates(
    profile: DataFrame, exclude: Sequence[str] = (), max_unique: int = MAX_CODES
) -> list[str]:
    """Columns with few different values. Reads one row per column of the table."""
    few = profile.where(F.col("n_unique") <= max_unique).select("column").collect()
    return sorted(r["column"] for r in few if r["column"] not in exclude)


def refine_code_fields(
    df: DataFrame,
    columns: Sequence[str],
    delinquency: str = patterns.DELINQUENCY,
    termination: str = patterns.TERMINATION,
) -> DataFrame:
    """Shares of delinquency-like and termination-like values among the present ones.

    All rows count. The patterns are tested once per different value.
    """
    text = F.trim("value")
    present = F.col("value").isNotNull()
    weight = F.col("n")
    return (
        value_frequencies(df, columns, key="column")
        .groupBy("column")
        .agg(
            _share(text.rlike(delinquency), weight, present).alias("dq_ratio"),
            _share(text.rlike(termination), weight, present).alias("zbc_ratio"),
            F.count("value").alias("n_unique"),
        )
    )


def choose_code_fields(refined: DataFrame) -> DataFrame:
    """The delinquency and the termination field, NULL when no column matches well enough."""
    chosen = []
    for role, ratio, needed in (
        ("dq", "dq_ratio", MIN_DELINQUENCY_RATIO),
        ("zbc", "zbc_ratio", MIN_TERMINATION_RATIO),
    ):
        order = F.struct((-F.col(ratio)).alias("r"), "n_unique", "column")
        chosen.append(
            F.struct(
                F.lit(role).alias("role"),
                F.min_by("column", F.when(F.col(ratio) >= needed, order)).alias("column"),
                F.max(ratio).alias("ratio"),
            )
        )
    return refined.agg(F.array(*chosen).alias("_rows")).select(F.inline("_rows"))
