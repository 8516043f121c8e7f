import pytest

from cohortloom import session
from cohortloom.session import materialise, scratch_path, scratch_root
from cohortloom.sources import delimited as dl
from cohortloom.sources import heads
from cohortloom.sources import inventory as inv
from cohortloom.sources import tables as tb
from cohortloom.streaming.arrivals import load_arrivals


def members(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "2020Q1.csv").write_text("x|a|012020|\nx|b|022020|NA\n")
    (source / "2020q2.csv").write_text("x|a|042020|5\n")
    (source / "2021Q1.txt").write_text("x,a,012021\nx,NULL,022021\n")
    (source / "notes.txt").write_text("nothing")
    return str(source)


def test_layout_is_found_per_file(spark, tmp_path):
    found = {
        r["path"].rsplit("/", 1)[1]: (r["delimiter"], r["n_columns"], r["lines"])
        for r in dl.sniff_layout(dl.read_lines(spark, members(tmp_path))).collect()
    }
    assert found["2020Q1.csv"] == ("|", 4, 2) and found["2021Q1.txt"] == (",", 3, 2)
    # Nothing found, and a tie, give the first candidate.
    assert found["notes.txt"][0] == ","
    (tmp_path / "tie.csv").write_text("a|b,c\n")
    assert dl.sniff_layout(dl.read_lines(spark, str(tmp_path / "tie.csv"))).first()["delimiter"] == ","


def test_ingest_mixed_layouts_then_again(spark, tmp_path):
    source, target, log = members(tmp_path), str(tmp_path / "out"), str(tmp_path / "log")
    first = dl.ingest_delimited(spark, source, target, process_all=True, log_path=log)
    assert {(r["year"], r["quarter"]): (r["n_rows"], r["n_columns"]) for r in first.collect()} == {
        (2020, "Q1"): (2, 4), (2020, "Q2"): (1, 4), (2021, "Q1"): (2, 3),
    }
    stored = tb.scan_table(spark, target)
    assert stored.columns == ["c000", "c001", "c002", "c003", "member", "load_id", "year", "quarter"]
    found = {(r["c002"], r["c003"]) for r in stored.collect()}
    assert found == {("012020", None), ("022020", None), ("042020", "5"), ("012021", None), ("022021", None)}
    assert stored.where("c001 IS NULL").count() == 1
    assert dl.ingest_delimited(spark, source, target, process_all=True, log_path=log).count() == 0
    again = dl.ingest_delimited(spark, source, target, years=[2021], overwrite=True, log_path=log)
    assert again.count() == 1 and tb.scan_table(spark, target).count() == 5
    assert spark.read.parquet(log).count() == 4
    one = tb.scan_table(spark, target, "year=2020/quarter=Q2")
    assert one.first()["year"] == 2020  # a single folder still has its partition columns
    assert tb.scan_table(spark, target, with_partitions=False).columns[-1] == "c003"
    assert dict(inv.table_manifest(spark, target).groupBy("quarter").count().collect())["Q2"] == 1
    assert inv.manifest_summary(inv.table_manifest(spark, target)).first()["files"] == 3


def test_years_and_given_layout(spark, tmp_path):
    source, target = members(tmp_path), str(tmp_path / "out")
    dl.ingest_delimited(spark, source, target, years=[2020], delimiter="|", width=4)
    assert tb.partition_counts(tb.scan_table(spark, target)).count() == 2


@pytest.mark.parametrize("line", ["a|b", "a|b|c|d"])
def test_short_and_long_rows_are_errors(spark, tmp_path, line):
    (tmp_path / "bad.csv").write_text("1|2|3\n" + line + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        dl.read_delimited(spark, str(tmp_path / "bad.csv"), "|", 3).collect()


def test_inventory_guesses(spark, tmp_path):
    for name, size in (("Perf_2021_c2.csv", 10), ("2020Q4.csv", 30), ("old_1999.csv", 20), ("t1.csv", 0)):
        (tmp_path / name).write_text("x" * size)
    rows = [(r["file"], r["year"], r["period"]) for r in inv.file_inventory(spark, str(tmp_path)).collect()]
    assert rows == [
        ("2020Q4.csv", "2020", "unknown_period"),
        ("old_1999.csv", "unknown_year", "unknown_period"),
        ("Perf_2021_c2.csv", "2021", "C2"),
        ("t1.csv", "unknown_year", "T1"),
    ]
    assert inv.largest_files(inv.file_inventory(spark, str(tmp_path)), 1).first()["file"] == "2020Q4.csv"
    assert inv.bytes_by_period(inv.file_inventory(spark, str(tmp_path))).count() == 4


def test_reports_and_schema(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5)], "name string, x double")
    tb.write_report(table, str(tmp_path / "report"))
    assert tb.read_report(spark, str(tmp_path / "report")).dtypes == [("name", "string"), ("x", "double")]
    typed = tb.read_report(spark, str(tmp_path / "report"), "name string, x string")
    assert typed.first()["x"] == "1.5"
    assert [r["column"] for r in tb.table_schema(table).collect()] == ["name", "x"]
    with pytest.raises(ValueError, match="y"):
        tb.require_columns(table, ["name", "y"])


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    both = spark.createDataFrame([(1, "a"), (2, "b")], "x int, g string")
    tb.write_table(both, path, ["g"])
    tb.write_table(both.where("g = 'a'").selectExpr("x + 10 AS x", "g"), path, ["g"], mode="replace_partitions")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(11, "a"), (2, "b")}
    gathered = tb.gathered_by_partition(spark.range(100).selectExpr("id", "'hot' AS g"), ["g"])
    tb.write_table(gathered, str(tmp_path / "s"), ["g"])
    assert len(list((tmp_path / "s" / "g=hot").glob("*.parquet"))) == 1


def test_scratch_is_where_the_session_says(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_root(spark) == named.rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_blanks_in_names_late_files_and_empty_files(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "2020 Q1 a+b.csv").write_text("x|1\ny|2\n")
    (source / "2020Q2.csv").write_text("")
    assert {(r["file"], r["bytes"]) for r in inv.list_files(spark, str(source)).collect()} == {
        ("2020 Q1 a+b.csv", 8), ("2020Q2.csv", 0),
    }
    first = dl.ingest_delimited(spark, str(source), target, process_all=True)
    assert {(r["member"], r["quarter"], r["n_rows"]) for r in first.collect()} == {
        ("in/2020 Q1 a+b.csv", "Q1", 2), ("in/2020Q2.csv", "Q2", 0),
    }
    (source / "2020Q1-late.csv").write_text("z|3\n")
    late = dl.ingest_delimited(spark, str(source), target, process_all=True).where("n_rows > 0")
    assert [r["member"] for r in late.collect()] == ["in/2020Q1-late.csv"]
    assert {r["c000"] for r in tb.scan_table(spark, target).collect()} == {"x", "y", "z"}


def test_a_quarter_may_arrive_in_several_batches(spark, tmp_path):
    source, target, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()
    for i in range(4):
        (source / f"2020Q1_{i}.csv").write_text(f"a{i}|1\n")
    load_arrivals(
        spark, str(source), target, str(tmp_path / "state"), log_path=log, files_per_batch=1
    ).awaitTermination()
    assert {r["c000"] for r in tb.scan_table(spark, target).collect()} == {"a0", "a1", "a2", "a3"}
    assert spark.read.parquet(log).agg({"n_rows": "sum"}).first()[0] == 4


def test_scratch_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path / "scratch"))
    materialise(spark.range(3), "x")
    (tmp_path / "scratch" / "other").mkdir()
    assert session.clear_scratch(spark) and not session.clear_scratch(spark)
    assert [p.name for p in (tmp_path / "scratch").iterdir()] == ["other"]


def loaded(spark, target):
    return sorted((r["member"], r["c000"]) for r in tb.scan_table(spark, target).collect())


def test_a_quarter_has_one_folder_and_members_are_replaced(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(5):
        (source / f"2020Q1_{i}.csv").write_text(f"a{i}|1\n" * 3)
    (source / "2020Q2.csv").write_text("b|1\n")
    dl.ingest_delimited(spark, str(source), str(target), process_all=True, files_per_load=2)
    folders = [p.name for p in (target / "year=2020").iterdir()]
    assert sorted(folders) == ["quarter=Q1", "quarter=Q2"]
    assert not [p for p in (target / "year=2020" / "quarter=Q1").iterdir() if p.is_dir()]
    (source / "2020Q1_3.csv").write_text("new|2\n")
    (source / "2020Q2.csv").write_text("")
    dl.ingest_delimited(spark, str(source), str(target), process_all=True, overwrite=True)
    assert loaded(spark, str(target)) == sorted(
        [(f"in/2020Q1_{i}.csv", f"a{i}") for i in (0, 1, 2, 4)] * 3 + [("in/2020Q1_3.csv", "new")]
    )
    assert not (target / "year=2020" / "quarter=Q2").exists()
    counts = {r["member"]: r["n_rows"] for r in dl.stored_members(spark, str(target)).collect()}
    assert counts["in/2020Q1_3.csv"] == 1 and counts["in/2020Q2.csv"] == 0


@pytest.mark.parametrize("broken_at", ["rows", "list"])
def test_a_load_that_broke_off_is_undone_and_repeated(spark, tmp_path, monkeypatch, broken_at):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "2020Q1_0.csv").write_text("a|1\n")
    dl.ingest_delimited(spark, str(source), target, process_all=True)
    (source / "2020Q1_1.csv").write_text("b|1\n")
    (source / "2020Q3_1.csv").write_text("c|1\n")
    real = {"rows": dl.write_table, "list": dl._list_files}[broken_at]

    def fail(*args, **kwargs):
        if broken_at == "list" and args[3] == "started":
            return real(*args, **kwargs)
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(dl, "write_table" if broken_at == "rows" else "_list_files", fail)
        with pytest.raises(OSError, match="lost"):
            dl.ingest_delimited(spark, str(source), target, process_all=True)
    dl.ingest_delimited(spark, str(source), target, process_all=True)
    expected = [("in/2020Q1_0.csv", "a"), ("in/2020Q1_1.csv", "b"), ("in/2020Q3_1.csv", "c")]
    assert loaded(spark, target) == expected
    assert dl.recover(spark, target) == 0


def test_small_files_are_packed(spark, tmp_path):
    path = str(tmp_path / "_t")
    rows = spark.range(0, 40_000, 1, 20).selectExpr(
        "id", "sha2(CAST(id AS STRING), 256) AS h", "IF(id % 10 = 0, 'b', 'a') AS g"
    )
    tb.write_table(rows, path, ["g"])
    before = {f.parent.name: [] for f in (tmp_path / "_t").glob("g=*/*.parquet")}
    for f in (tmp_path / "_t").glob("g=*/*.parquet"):
        before[f.parent.name].append(f.stat().st_size)
    goal = sum(before["g=a"]) // 4
    report = {r["g"]: r for r in tb.compact_table(spark, path, ["g"], goal).collect()}
    assert report["a"]["files"] == 20 and report["a"]["bytes"] == sum(before["g=a"])
    after = {g: [f.stat().st_size for f in (tmp_path / "_t" / g).glob("*.parquet")] for g in before}
    assert len(after["g=a"]) == report["a"]["wanted"] and len(after["g=b"]) == 1
    assert max(after["g=a"]) <= 1.5 * goal
    assert spark.read.parquet(path).selectExpr("count(*)", "sum(id)", "count(DISTINCT h)").first() == (
        40_000, 799_980_000, 40_000,
    )
    assert tb.compact_table(spark, path, ["g"], goal).count() == 0


def test_heads_give_the_layouts_of_whole_files_and_read_no_more(spark, tmp_path, monkeypatch):
    (tmp_path / "a b.csv").write_text("x|1|2\n" * 5000)
    (tmp_path / "c.csv").write_bytes(b"p;q\r\nr;s")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "one.csv").write_text("k," * 9000)
    paths = [r["path"] for r in inv.list_files(spark, str(tmp_path)).collect()]
    whole = {r["path"]: (r["delimiter"], r["n_columns"]) for r in dl.sniff_layout(dl.read_lines(spark, paths)).collect()}
    lines = heads.read_heads(spark, paths, 1000)
    some = {r["path"]: (r["delimiter"], r["n_columns"], r["lines"]) for r in dl.sniff_layout(lines).collect()}
    assert {p.rsplit("/", 1)[1]: v for p, v in some.items()} == {
        "a b.csv": ("|", 3, 166), "c.csv": (";", 2, 2), "one.csv": (",", 501, 1),
    }
    assert {p: v[:2] for p, v in some.items() if "one" not in p} == {p: v for p, v in whole.items() if "one" not in p}
    read = []

    class Watched:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *error):
            self.stream.close()

        def read(self, n):
            read.append(n)
            return self.stream.read(n)

    real = heads.open_file
    monkeypatch.setattr(heads, "open_file", lambda path: Watched(real(path)))
    assert len(heads.head_lines(str(tmp_path / "a b.csv"), 64)) == 10 and sum(read) == 65
    assert heads.read_heads(spark, []).count() == 0


def test_split_arrivals_are_written_by_more_tasks_as_rows_grow(spark, monkeypatch):
    from types import SimpleNamespace

    from cohortloom.plans import queries_files

    sources = []
    stop = SimpleNamespace(awaitTermination=lambda: None)
    monkeypatch.setattr(queries_files, "load_arrivals", lambda s, source, *a, **o: sources.append(source) or stop)
    monkeypatch.setattr(queries_files, "scan_table", lambda s, path: spark.createDataFrame([], "year int, quarter string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries_files.arrivals_split(spark, "/root/testdata/sf0.01")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = [r["path"] for r in inv.list_files(spark, sources[0], "*.csv").collect()]
    assert len({n.rsplit("/", 1)[1].split("-")[1] for n in names}) > 4
    assert len({n.split("member=")[1][:6] for n in names}) * 4 == len({n.split("/")[-2] for n in names})


def test_rows_are_gathered_before_they_become_texts(spark):
    from cohortloom.plans.star_panel import text_rows

    rows = text_rows(spark, "/root/testdata/sf0.001", ["year", "quarter"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("RebalancePartitions")]
    assert "cast(quantity" in above and {t for _, t in rows.dtypes} == {"string"}
