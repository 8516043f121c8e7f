import pytest
from pyspark.sql import functions as F

from cohortloom.operators import expectations as ex
from cohortloom.operators import profiling as p
from cohortloom.operators import quality as q


def texts(spark):
    rows = [("1", "012020", "R", "a b", None), ("2", "022020", "0", "a c", "nan"), ("3", "", "1", "a d", "<NA>")]
    return spark.createDataFrame(rows, "id string, period string, code string, words string, none string")


@pytest.mark.parametrize("exact", [True, False])
def test_column_profile(spark, exact):
    found = {r["col"]: r for r in p.profile_columns(texts(spark), exact=exact).collect()}
    assert found["none"]["non_null_ratio"] == 0.0 and found["none"]["n_unique"] == 0
    assert found["none"]["numeric_ratio"] == 0.0
    assert found["period"]["six_digit_ratio"] == 1.0
    assert found["period"]["non_null_ratio"] == pytest.approx(2 / 3)
    assert found["code"]["short_code_ratio"] == 1.0 and found["code"]["n_unique"] == 3


def test_roles_follow_the_profile(spark):
    profile = p.profile_columns(texts(spark), exact=True)
    roles = p.roles_from(p.assign_roles(profile, "id", "period", drop=["none"]))
    assert roles.entity == "id" and roles.period == "period" and roles.drop == ["none"]
    assert roles.codes == ["code"] and roles.text == ["words"] and roles.numeric == []


def test_partition_columns_never_become_roles(spark):
    table = texts(spark).withColumn("year", F.lit("2020"))
    roles = p.roles_from(p.assign_roles(p.profile_columns(table, exact=True), "id", "period"))
    assert "year" not in roles.numeric and roles.core_columns() == ["id", "period", "code", "words"]


def test_field_roles_and_their_ties(spark):
    rows = [(202001 + i % 12, i % 3, 0.5 * (i % 7), 60_000.0 + i, "09") for i in range(1500)]
    table = spark.createDataFrame(rows, "month int, dq int, rate double, upb double, zb string")
    for exact in (True, False):
        scores = p.score_fields(p.field_profile(table, exact=exact))
        found = {r["role"]: r["column"] for r in p.resolve_fields(scores).collect()}
        assert found == {"period": "month", "dq": "dq", "zbc": "zb", "upb": "upb", "rate": "rate"}
    # No points at all resolve to nothing, not to some column.
    words = spark.createDataFrame([("x",)], "w string")
    empty = p.resolve_fields(p.score_fields(p.field_profile(words, exact=True))).collect()
    assert {r["column"] for r in empty} == {None}


def test_exact_field_profile_reads_the_table_once(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 0.5 AS half", "'09' AS code").write.parquet(str(tmp_path / "t"))
    profile = p.field_profile(spark.read.parquet(str(tmp_path / "t")), exact=True)
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_exact_field_profile_of_odd_values(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (2L * 4611686018427387903, 0.0D, 1.10BD, DATE'2020-02-03', '202002', true),"
        " (2L * 4611686018427387903 + 1, -0.0D, -2.25BD, DATE'2020-02-29', 'x', true),"
        " (-7L, double('nan'), NULL, NULL, NULL, NULL), (NULL, NULL, 1.10BD, NULL, '96', false)"
        " AS t(whole, number, exact, day, word, flag)"
    )
    found = {r["column"]: r for r in p.field_profile(rows, exact=True).collect()}
    plain = {r["column"]: r for r in p.field_profile(rows).collect()}
    for name, row in plain.items():
        # Only the estimated count may differ; NaN is told by its text.
        assert repr(row[:-1]) == repr(found[name][:-1])
    assert {c: r["n_unique"] for c, r in found.items()} == {
        "whole": 3, "number": 2, "exact": 2, "day": 1, "word": 3, "flag": 2
    }
    assert found["word"]["yyyymm_ratio"] == 0.25 and found["word"]["zbc_ratio"] == 0.25


def test_exact_field_profile_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "w string, n long, d date")
    found = p.field_profile(rows, exact=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, p.field_profile(rows).collect()))
    assert {r["n_unique"] for r in found.collect()} == {0}


def test_code_refinement(spark):
    rows = [("0", "01", "q"), ("12", "96", "r"), ("XX", "5", None), (" R ", "7", "s")]
    table = spark.createDataFrame(rows, "late string, closed string, other string")
    refined = p.refine_code_fields(table, table.columns)
    found = {r["column"]: r for r in refined.collect()}
    assert found["late"]["dq_ratio"] == 1.0 and found["closed"]["zbc_ratio"] == 0.5
    assert found["other"]["n_unique"] == 3
    chosen = {r["role"]: r["column"] for r in p.choose_code_fields(refined).collect()}
    assert chosen == {"dq": "late", "zbc": "closed"}
    nothing = p.choose_code_fields(refined.where("column = 'other'")).collect()
    assert {r["column"] for r in nothing} == {None}
    profile = p.field_profile(table, exact=True)
    assert p.code_candidates(profile, exclude=["other"], max_unique=4) == ["closed", "late"]


def test_quality_reports(spark):
    rows = [("a", "012020", "2020"), ("a", "012020", "2020"), (None, "022020", "2020"), ("", "", "2021")]
    table = spark.createDataFrame(rows, "id string, period string, year string")
    found = {r["year"]: r for r in q.partition_quality(table, ["year"], "id", "period", exact=True).collect()}
    assert found["2020"]["null_entity"] == 1 and found["2021"]["null_period"] == 1
    assert found["2021"]["min_period"] is None
    # A pair with a NULL part is no pair.
    dups = {r["year"]: r for r in q.duplicate_keys(table, ["year"], ["id", "period"], exact=True).collect()}
    assert (dups["2020"]["n_pairs"], dups["2020"]["n_duplicates"]) == (1, 2)
    missing = [(r["col"], r["null_ratio"]) for r in q.missing_by_column(table).collect()]
    assert missing == [("id", 0.5), ("period", 0.25), ("year", 0.0)]
    counts = [(r["value"], r["n"]) for r in q.value_counts(table, "id", k=2).collect()]
    assert counts == [("a", 2), ("", 1)]
    assert q.value_counts(table, "id", include_null=False).count() == 2
    merged = q.merge_counts([q.value_counts(table, "id", None), q.value_counts(table, "year", None)])
    assert {r["value"]: r["n"] for r in merged.collect()} == {"a": 2, "": 1, None: 1, "2020": 3, "2021": 1}


def status(df):
    return [r["status"] for r in df.collect()]


def test_expectations(spark):
    table = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 1.0000000000001)], "cluster int, share double")
    assert status(ex.expect_columns(table, ["share", "cluster"], "t")) == ["pass"]
    assert ex.expect_columns(table, ["a", "b"], "t").first()["detail"] == "a,b"
    assert status(ex.expect_between(table, "share", 0, 1, "t")) == ["pass"]  # within tolerance
    assert status(ex.expect_between(table, "share", 0, 0.9, "t")) == ["fail"]
    assert status(ex.expect_between(table.limit(0), "share", 0, 1, "t")) == ["fail"]  # empty
    assert status(ex.expect_min_rows(table, 4, "t")) == ["fail"]
    assert status(ex.expect_total_equal(table, "cluster", table, "t")) == ["pass"]
    groups = table.withColumn("g", F.col("cluster") > 1)
    assert status(ex.expect_group_sum(groups, ["g"], "share", 1.0, "t")) == ["pass"]
    assert status(ex.expect_group_sum(table, ["cluster"], "share", 1.0, "t")) == ["fail"]
    assert status(ex.expect_best_at_least(table, "cluster", "share", 2, "t")) == ["pass"]
    results = ex.run_expectations(
        [ex.expect_min_rows(table, 4, "t", severity="warning"), ex.expect_min_rows(table, 1, "t")]
    )
    found = ex.verdict(results).first()
    assert (found["errors"], found["warnings"], found["verdict"]) == (0, 1, "pass")
    assert ex.summarise(results).count() == 2


def test_expected_outputs(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "gold" / "panel"))
    (tmp_path / "empty.csv").write_text("")
    found = {
        r["subject"]: r["status"]
        for r in ex.expect_outputs(spark, str(tmp_path), ["gold/panel", "gold", "empty.csv", "absent"]).collect()
    }
    assert found == {"gold/panel": "pass", "gold": "pass", "empty.csv": "fail", "absent": "fail"}
