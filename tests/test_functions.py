import datetime

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import patterns
from cohortloom.functions.cleaning import is_blank, to_double, to_int, tokens_to_null
from cohortloom.functions.hashing import hash_bucket, hash_order
from cohortloom.functions.names import distinct_tokens, feature_base, feature_family
from cohortloom.functions.numeric import drawdown_ratio, pair_correlation, vector_norm, zscore
from cohortloom.functions.periods import is_period, month_start, parse_period, yyyymm


def values(spark, rows, column, dtype="string"):
    table = spark.createDataFrame([(r,) for r in rows], f"x {dtype}")
    return [r[0] for r in table.select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "text, whole, number",
    [
        ("1.5", 2, 1.5), ("2.5", 3, 2.5), ("-2.5", -3, -2.5), (" 12", 12, 12.0), ("03", 3, 3.0),
        ("R", None, None), ("XX", None, None), ("1e3", 1000, 1000.0), ("", None, None),
        (None, None, None), ("1d", None, None), ("1.5f", None, None), ("1d ", None, None),
        ("nan", None, None), ("9999999999", None, 9999999999.0),
    ],
)
def test_tolerant_numbers(spark, text, whole, number):
    assert values(spark, [text], to_int) == [whole]
    assert values(spark, [text], to_double) == [number]


def test_infinity_is_a_number(spark):
    assert values(spark, ["inf"], to_double) == [float("inf")]


@pytest.mark.parametrize("text", ["12020", "132020", "002020", "", None, "1a2020", " 12020", "+12020", "010000"])
def test_bad_periods(spark, text):
    assert values(spark, [text], parse_period) == [None]
    assert values(spark, [text], is_period) == [False]


def test_good_periods(spark):
    january = datetime.datetime(2020, 1, 1)
    assert values(spark, ["012020"], parse_period) == [january]
    assert values(spark, ["202001"], lambda c: parse_period(c, "yyyyMM")) == [january]
    assert values(spark, ["2020-01"], lambda c: parse_period(c, "yyyy-MM")) == [january]
    assert values(spark, ["2020-01", "x"], lambda c: is_period(c, "yyyy-MM")) == [True, False]


def test_months(spark):
    day = datetime.date(2021, 7, 19)
    assert values(spark, [day], yyyymm, "date") == [202107]
    assert values(spark, [day], month_start, "date") == [datetime.datetime(2021, 7, 1)]


def test_blanks_and_tokens(spark):
    assert values(spark, ["", None, "a"], is_blank) == [True, True, False]
    assert values(spark, ["", "NA", "NULL", "null", "x", None], tokens_to_null) == [
        None, None, None, None, "x", None,
    ]


def test_text_classes(spark):
    def hits(pattern, texts):
        return values(spark, texts, lambda c: c.rlike(pattern))

    assert hits(patterns.NUMERIC, ["123", "-10", "3.14", "1e3", "."]) == [True] * 3 + [False] * 2
    assert hits(patterns.SHORT_CODE, ["R", "A1", "ABCD", "a"]) == [True, True, False, False]
    assert hits(patterns.DELINQUENCY, ["0", "12", "R", "XX", "03"]) == [True] * 4 + [False]
    assert hits(patterns.TERMINATION, ["01", "1", "96", "5"]) == [True, True, True, False]


def test_hashes_are_fixed_and_in_range(spark):
    # md5("1") starts with c4ca4238.
    assert values(spark, ["1"], lambda c: hash_bucket(c, 10_000, portable=True)) == [
        int("c4ca4238", 16) % 10_000
    ]
    for portable in (True, False):
        found = values(spark, [str(i) for i in range(500)], lambda c: hash_order([c], 7, portable))
        assert all(0 <= h < 2**60 for h in found) and len(set(found)) == 500
        again = values(spark, [str(i) for i in range(500)], lambda c: hash_order([c], 8, portable))
        assert found != again


def test_names(spark):
    assert values(spark, ["mean_num_c001", "x"], feature_family) == ["mean", "x"]
    assert values(spark, ["mean_num_year", "x"], feature_base) == ["year", None]
    model = "F1 =~ mean_num_c022 + mean_num_c007\nF2 =~ mean_num_c022"
    assert values(spark, [model], lambda c: distinct_tokens(c, r"mean_num_c\d+")) == [
        ["mean_num_c007", "mean_num_c022"]
    ]


def test_ratio_needs_a_positive_maximum(spark):
    rows = spark.createDataFrame([(10.0, 5.0), (0.0, -1.0), (None, None)], "a double, b double")
    found = [r[0] for r in rows.select(drawdown_ratio(F.col("a"), F.col("b"))).collect()]
    assert found == [0.5, None, None]


def test_zscore_of_constant_and_missing(spark):
    rows = spark.createDataFrame(
        [(1.0, 1.0, 0.0), (1.0, 2.0, None), (None, 2.0, 3.0), (5.0, 2.0, 3.0)],
        "x double, mu double, sd double",
    )
    found = [r[0] for r in rows.select(zscore(F.col("x"), F.col("mu"), F.col("sd"))).collect()]
    assert found == [0.0, 0.0, 0.0, 1.0]


def test_vector_norm(spark):
    rows = spark.createDataFrame([(3.0, 4.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in rows.select(vector_norm([F.col("a"), F.col("b")])).collect()] == [5.0, 2.0]


def test_correlation_over_complete_pairs(spark):
    rows = [(float(i), 2.0 * i, 7.0) for i in range(10)] + [(100.0, None, 7.0)]
    table = spark.createDataFrame(rows, "a double, b double, c double")
    a, b, c = (F.col(n) for n in "abc")
    found = table.agg(
        pair_correlation(a, b), pair_correlation(a, c), pair_correlation(a, b, min_rows=11)
    ).first()
    assert found[0] == pytest.approx(1.0) and found[1] is None and found[2] is None
