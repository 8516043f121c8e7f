"""The stages from text members to checked reports, and loading by arrival."""

from cohortloom.operators import expectations as ex
from cohortloom.operators.sampling import in_sample
from cohortloom.plans import stages
from cohortloom.plans.star_panel import text_rows
from cohortloom.sources.tables import read_report, scan_table
from cohortloom.streaming.arrivals import load_arrivals
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def write_members(spark, folder):
    rows = text_rows(spark, SF_DIR).where("dq_code <> 'XX'")
    data = rows.withColumn("member", F.concat("year", "quarter")).drop("year", "quarter")
    data.coalesce(1).write.partitionBy("member").option("sep", "|").csv(folder)


def test_all_stages(spark, tmp_path):
    source = str(tmp_path / "members")
    write_members(spark, source)
    study = stages.Study(spark, str(tmp_path / "study"))
    log = stages.load_bronze(study, source, process_all=True)
    total = log.agg(F.sum("n_rows")).first()[0]
    assert total == scan_table(spark, study.path("bronze")).count()
    roles = stages.build_silver(study, entity="c000", period="c001", drop=["c008"])
    assert roles.codes == ["c002", "c003"] and "c009" in roles.text
    assert "c005" in roles.numeric and "c008" not in roles.numeric
    stages.build_gold(study, roles, keep=in_sample(F.col("c000"), 10, 9))
    features = study.read("features")
    panel = scan_table(spark, study.path("panel"))
    assert features.count() == panel.select("entity_id").distinct().count() < 200
    assert not [c for c in features.columns if "year" in c]
    kept = stages.build_matrix(study)
    assert "mean_num_c005" in kept
    stages.build_factors(study, m=4)
    space, k = stages.build_segments(study, sizes=(4, 2), n_init=1, ks=[2, 3])
    assert k in (2, 3)
    fields = stages.resolve_risk_fields(study)
    assert fields["period"] == "period_date" and fields["upb"] in ("num_c005", "num_c011")
    stages.build_risk(study, delinquency="num_c010", balance="num_c011", rate="num_c012")
    results = stages.check_study(study, min_rows=100)
    assert ex.verdict(results).first()["verdict"] == "pass"
    assert read_report(spark, study.path("reports/best_per_space")).count() == 4


def test_arrivals_are_loaded_once(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()

    def run():
        query = load_arrivals(spark, source, target, str(tmp_path / "checkpoint"), log)
        assert query.awaitTermination(120)

    (tmp_path / "in" / "2020Q1.csv").write_text("a|1\nb|2\n")
    run()
    (tmp_path / "in" / "2020Q2.csv").write_text("c;3\n")
    (tmp_path / "in" / "readme.txt").write_text("not a member\n")
    run()
    run()
    assert {(r["quarter"], r["c000"]) for r in scan_table(spark, target).collect()} == {
        ("Q1", "a"), ("Q1", "b"), ("Q2", "c"),
    }
    assert spark.read.parquet(log).count() == 2
