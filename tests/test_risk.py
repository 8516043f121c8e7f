import datetime

import pytest

from cohortloom.operators import risk as rk


def panel(spark):
    def month(y, m):
        return datetime.datetime(y, m, 1)

    rows = [
        ("a", month(2020, 1), "0", "100", 3.0),
        ("a", month(2021, 2), "3", "0", 4.0),
        ("b", month(2020, 5), "XX", "50", None),
        ("b", month(2020, 6), None, None, 2.0),
        ("c", month(2021, 1), "6", "0", 1.0),
        (None, month(2021, 1), "6", "10", 1.0),
    ]
    return spark.createDataFrame(
        rows, "id string, period timestamp_ntz, dq string, upb string, rate double"
    )


def labels(spark):
    return spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "id string, cluster int")


def metrics(spark):
    return rk.risk_metrics(panel(spark), "id", "period", "dq", "upb", "rate")


def test_metrics_of_each_entity(spark):
    found = {r["id"]: r for r in metrics(spark).collect()}
    assert set(found) == {"a", "b", "c"}
    a, b, c = found["a"], found["b"], found["c"]
    assert (a["max_dq"], a["ever_30"], a["ever_90"], a["ever_180"]) == (3, 1, 1, 0)
    assert (a["terminated_upb0"], a["amortization_ratio"], a["avg_rate"]) == (1, 1.0, 3.5)
    # A code that is no number, and a missing one, count as current.
    assert (b["max_dq"], b["ever_30"], b["terminated_upb0"], b["avg_rate"]) == (0, 0, 0, 2.0)
    assert c["ever_180"] == 1 and c["amortization_ratio"] is None


def test_rates_skip_missing_ratios(spark):
    found = {r["cluster"]: r for r in rk.rates_by_cluster(metrics(spark), labels(spark), "id").collect()}
    assert found[0]["n_entities"] == 2 and found[0]["ever_90_rate"] == 0.5
    assert found[0]["avg_amort_ratio"] == pytest.approx(0.5)
    assert found[1]["avg_amort_ratio"] is None


def test_years(spark):
    cohorts = rk.cohort_by_first_year(metrics(spark), labels(spark), "id").collect()
    assert [tuple(r) for r in cohorts] == [(2020, 0, 2), (2021, 1, 1)]
    shares = rk.cluster_share_by_year(panel(spark), labels(spark), "id", "period")
    found = {(r["year"], r["cluster"]): (r["n_entities"], r["share"]) for r in shares.collect()}
    assert found == {(2020, 0): (2, 1.0), (2021, 0): (1, 0.5), (2021, 1): (1, 0.5)}
    pivot = {r["year"]: (r["cluster_0"], r["cluster_1"]) for r in rk.share_pivot(shares).collect()}
    assert pivot == {2020: (1.0, 0.0), 2021: (0.5, 0.5)}
