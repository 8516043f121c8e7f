import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import expectations as ex
from cohortloom.operators import quality as q
from cohortloom.operators import quantile_states as qs
from cohortloom.operators import rollups as ru
from cohortloom.operators.sampling import sample_strata
from cohortloom.operators.silhouette import _blocks, silhouette, silhouette_estimate
from cohortloom.plans import queries_states


def cells(spark, n=60_000):
    return spark.range(n).selectExpr(
        "IF(id % 97 = 0, NULL, concat('e', id % 40000)) AS entity",
        "CAST(2020 + id % 3 AS BIGINT) AS year", "concat('Q', 1 + id % 4) AS quarter",
    )


def test_dense_numbers_and_bitmaps_count_as_distinct_does(spark):
    rows = cells(spark).persist()
    numbers = ru.dense_numbers(rows, "entity", buckets=16).persist()
    n = rows.select("entity").distinct().where("entity IS NOT NULL").count()
    assert numbers.selectExpr("min(number)", "max(number)", "count(*)", "count(DISTINCT number)").first() == (1, n, n, n)
    numbered = rows.join(numbers, "entity", "left")
    half = F.col("quarter") < "Q3"
    pieces = ru.bitmaps(numbered.where(half), "number", ["year", "quarter"]).unionByName(
        ru.bitmaps(numbered.where(~half | (F.col("quarter") == "Q2")), "number", ["year", "quarter"])
    )
    found = ru.distinct_levels(pieces, [["year", "quarter"], ["year"], []], ["year", "quarter"]).collect()
    for r in found:
        same = [F.col(k) == r[k] for k in ("year", "quarter") if r[k] is not None]
        part = rows.where(same[0]) if same else rows
        part = part.where(same[1]) if len(same) > 1 else part
        assert r["n_entities"] == part.selectExpr("count(DISTINCT entity)").first()[0], r
    assert len(found) == 12 + 3 + 1
    assert ru.dense_numbers(rows.limit(0), "entity").count() == 0


def test_united_sketches_stay_within_their_error(spark):
    rows = cells(spark)
    sketches = ru.distinct_sketches(rows, "entity", ["year", "quarter"])
    exact = rows.selectExpr("count(DISTINCT entity) AS n", "count(*) AS rows").first()
    found = ru.sketched(sketches).withColumn("ok", ru.within_error(F.col("estimate"), F.lit(exact["n"]))).first()
    assert found["ok"] and found["n_rows"] == exact["rows"]
    assert not spark.range(1).select(ru.within_error(F.lit(2 * exact["n"]), F.lit(exact["n"]))).first()[0]


def test_merged_quantiles_have_their_ranks(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.lognormal(size=20_000), np.full(10_000, 2.0)))
    rows = [(float(v), i % 7) for i, v in enumerate(x)] + [(None, 1), (float("nan"), 2)]
    frame = spark.createDataFrame(rows, "x double, g int").withColumn("empty", F.lit(None).cast("double"))
    states = qs.quantile_sketches(frame, ["x", "empty"], ["g"])
    found = qs.sketch_quantiles(qs.merged_sketches(states, ["x", "empty"]), ["x", "empty"], [0.1, 0.5, 0.9])
    checked = qs.exact_ranks(frame, found, ["x"]).collect()
    assert {r["feature"] for r in checked} == {"x"} and {r["n"] for r in checked} == {30_000}
    for r in checked:
        assert r["below"] - qs.rank_error() * 2 <= r["prob"] <= r["upto"] + qs.rank_error() * 2
        assert r["below"] == pytest.approx((x < r["value"]).mean())


@pytest.mark.parametrize("shape", ["heavy", "flat", "ties"])
def test_heavy_hitters_equal_full_counts(spark, shape):
    rng = random.Random(3)
    draw = {
        "heavy": lambda: str(int(rng.paretovariate(0.7))), "flat": lambda: str(rng.randrange(3000)),
        "ties": lambda: str(rng.randrange(40)),
    }[shape]
    values = [None] * 50 + [draw() for _ in range(6000)]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    expected = sorted(Counter(values).items(), key=lambda t: (-t[1], t[0] is None, t[0] or ""))[:30]
    for buckets, probes in ((64, 3), (4096, 50)):
        got = [(r["value"], r["n"]) for r in q.heavy_hitters(frame, "v", 30, buckets, probes).collect()]
        assert got == expected
    assert q.heavy_hitters(frame.limit(0), "v").count() == 0
    assert q.heavy_hitters(frame.where("v = '1'"), "v", k=5).count() <= 1


def test_heavy_hitters_leave_most_values_uncounted(spark):
    rows = spark.range(200_000).selectExpr("IF(id % 3 = 0, concat('hot', id % 5), CAST(id AS STRING)) AS v")
    sizes = rows.groupBy(F.pmod(F.xxhash64("v"), F.lit(1 << 16))).count()
    assert q.heavy_hitters(rows, "v", k=5).first()["n"] > 10_000
    assert sizes.where("count >= 10000").count() <= 5


def test_strata_samples_merge_and_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id % 50 AS STRING)) AS g")
    whole = {tuple(r) for r in sample_strata(rows, ["g"], 20, ["id"]).collect()}
    assert {tuple(r) for r in sample_strata(rows.repartition(13), ["g"], 20, ["id"]).collect()} == whole
    parts = [sample_strata(rows.where(f"id % 4 = {i}"), ["g"], 20, ["id"]) for i in range(4)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert {tuple(r) for r in sample_strata(merged, ["g"], 20, ["id"]).collect()} == whole
    assert sum(g == "hot" for _, g in whole) == 20
    few = sample_strata(rows.where("id < 7"), ["g"], 20, ["id"])
    assert few.count() == 7 and few.columns == ["id", "g"]


def test_silhouette_estimate_is_exact_when_all_rows_are_taken(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) + (i % 3) * 2).tolist(), i % 3) for i in range(600)] + [(999, [50.0] * 3, 9)]
    frame = spark.createDataFrame(rows, "id long, x array<double>, c int")
    exact = silhouette(frame, "id", "x", ["c"]).first()["silhouette"]
    whole = {r["cluster"]: r for r in silhouette_estimate(frame, "id", "x", "c", per_cluster=1000).collect()}
    assert whole[None]["silhouette"] == pytest.approx(exact, abs=1e-7) and whole[None]["std_error"] == 0
    assert whole[9]["silhouette"] == 0.0
    hits = 0
    for seed in range(12):
        some = {r["cluster"]: r for r in silhouette_estimate(frame, "id", "x", "c", 30, seed).collect()}[None]
        assert some["n_sampled"] == 91 and some["std_error"] > 0
        hits += abs(some["silhouette"] - exact) <= 2 * some["std_error"]
    assert hits >= 9
    assert silhouette_estimate(frame.limit(0), "id", "x", "c").count() == 0


def test_checks_during_the_write_equal_those_of_the_stored_table(spark, tmp_path):
    nan = float("nan")
    frame = spark.createDataFrame([(0.5, 1.0), (1.0 + 1e-13, 2.0), (None, 3.0), (nan, 4.0)], "r double, s double")
    checks = [ex.Between("r", 0, 1), ex.Between("s", 0, 9), ex.MinRows(4), ex.MinRows(5, "warning"), ex.Total("s", 10)]
    path = str(tmp_path / "t")
    found = ex.write_checked(frame, lambda df: df.write.parquet(path), checks, "t")
    stored = spark.read.parquet(path)
    again = ex.run_expectations(
        [
            ex.expect_between(stored, "r", 0, 1, "t"), ex.expect_between(stored, "s", 0, 9, "t"),
            ex.expect_min_rows(stored, 4, "t"), ex.expect_min_rows(stored, 5, "t", "warning"),
        ]
    )
    assert [tuple(r) for r in found.where("check <> 'total'").collect()] == [tuple(r) for r in again.collect()]
    assert found.where("check = 'total'").first()["status"] == "pass"
    assert ex.write_checked(frame, lambda df: df.write.parquet(path + "2"), [], "t").count() == 0


def test_silhouette_sends_a_row_to_few_blocks():
    assert _blocks(780_000, [64], None) == _blocks(20_000, [64], None) == 16
    assert _blocks(2_000_000, [64], None) == 31 and _blocks(500, [64], None) == _blocks(0, None, None) == 1
    assert _blocks(100_000, [4096], None) == 98


def test_silhouette_interval_holds_a_small_sample_only(spark, monkeypatch):
    taken = []

    def noted(*args, per_cluster, **options):
        taken.append(per_cluster)
        return silhouette_estimate(*args, per_cluster=per_cluster, **options)

    monkeypatch.setattr(queries_states, "estimate", noted)
    found = queries_states.silhouette_interval(spark, "/root/testdata/sf0.001").collect()
    assert taken == [25] and all(r["within_error"] for r in found)
