"""Registered queries: files, delimited loading, manifests. Written data goes to the scratch area."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.functions.cleaning import to_double
from cohortloom.operators.expectations import expect_outputs
from cohortloom.operators.shape import with_partition_columns
from cohortloom.plans.registry import Registry, rounded, rounded_sql
from cohortloom.plans.star_panel import BASE_SQL, base_rows, table, text_rows
from cohortloom.session import scratch_path
from cohortloom.sources import delimited as dl
from cohortloom.sources import inventory as inv
from cohortloom.sources.heads import read_heads
from cohortloom.sources.tables import (
    gathered_by_partition,
    partition_counts,
    read_report,
    require_columns,
    scan_table,
    table_schema,
    write_report,
    write_table,
)
from cohortloom.streaming.arrivals import load_arrivals

registry = Registry()
query = registry.query


def _members(spark, sf_dir) -> str:
    """The all-text rows as headerless delimited files, one folder per year and quarter."""
    target = scratch_path(spark, "members")
    _write_members(text_rows(spark, sf_dir, ["year", "quarter"]), F.concat("year", "quarter"), target)
    return target


def _write_members(rows, member, target: str) -> None:
    """Rows as delimited files below a folder for each `member`."""
    data = rows.withColumn("member", member).drop("year", "quarter")
    data.write.mode("append").partitionBy("member").option("sep", "|").csv(target)


_LINE_BYTES = 32


def _sized_files(spark, sf_dir, place: str) -> str:
    """A folder with one file per quarter: a line of 32 bytes for each different ship day.

    `place` is where a quarter's file goes, with {y} and {q}; the sizes follow a
    rule that SQL can state.
    """
    days = base_rows(spark, sf_dir).select("ship_ts", F.col("year").cast("string").alias("year"), "quarter").distinct()
    line = F.rpad(F.date_format("ship_ts", "yyyy-MM-dd"), _LINE_BYTES - 1, ".")
    member = F.concat("year", "quarter").alias("member")
    raw, target = scratch_path(spark, "days"), scratch_path(spark, "sized")
    lines = days.select(line.alias("line"), member)
    lines.repartition("member").write.partitionBy("member").text(raw)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(raw).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in inv.list_files(spark, raw, "*.txt").collect():  # one file per quarter
        named = found["path"].split("member=")[1]
        goal = paths(f"{target}/" + place.format(y=named[:4], q=named[4:6]))
        system.mkdirs(goal.getParent())
        system.rename(paths(found["path"]), goal)
    return target


_SIZED_SQL = (
    f"WITH {BASE_SQL}, files AS (SELECT CAST(year AS VARCHAR) AS year, quarter, year || quarter || '.txt' AS file,"
    f" {_LINE_BYTES} * count(DISTINCT ship_ts) AS bytes,"
    " CASE quarter WHEN 'Q4' THEN 'unknown_period' ELSE quarter END AS period FROM base GROUP BY ALL)"
)
_ANY_YEAR = r"((?:19|20)[0-9]{2})"


def _inventory(spark, sf_dir):
    return inv.file_inventory(spark, _sized_files(spark, sf_dir, "{y}{q}.txt"), year_pattern=_ANY_YEAR)


@query(f"{_SIZED_SQL} SELECT file, bytes, year, period FROM files")
def file_inventory(spark, sf_dir):
    """Files found in a folder with their sizes, and the year and period guessed from their names.

    The guess knows the first three quarters only.
    """
    return _inventory(spark, sf_dir)


@query(
    f"{_SIZED_SQL} SELECT year, period, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes,"
    " round(sum(bytes) / 1073741824.0, 2) AS gib FROM files GROUP BY year, period"
)
def bytes_by_period(spark, sf_dir):
    return inv.bytes_by_period(_inventory(spark, sf_dir))


@query(f"{_SIZED_SQL} SELECT row_number() OVER (ORDER BY bytes DESC, file) AS place, file, bytes FROM files"
       " ORDER BY place LIMIT 5")
def largest_files(spark, sf_dir):
    """The five largest files, in the order of the report."""
    top = inv.largest_files(_inventory(spark, sf_dir), 5)
    order = Window.orderBy(F.desc("bytes"), "file")  # five rows
    return top.select(F.row_number().over(order).cast("bigint").alias("place"), "file", "bytes")


@query(
    f"{_SIZED_SQL} SELECT year || quarter || '.parquet' AS file, year, quarter, bytes FROM files"
)
def manifest_files(spark, sf_dir):
    """The files of a table's folders with partition values and sizes, from the listing alone."""
    root = _sized_files(spark, sf_dir, "year={y}/quarter={q}/{y}{q}.parquet")
    return inv.table_manifest(spark, root)


@query(
    f"{_SIZED_SQL} SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes,"
    " round(sum(bytes) / 1073741824.0, 2) AS gib FROM files"
)
def manifest_sizes(spark, sf_dir):
    root = _sized_files(spark, sf_dir, "year={y}/quarter={q}/{y}{q}.parquet")
    return inv.manifest_summary(inv.table_manifest(spark, root))


@query(
    f"WITH {BASE_SQL}, sizes AS (SELECT year || quarter AS member, count(*) AS n FROM base GROUP BY ALL)"
    " SELECT member, n FROM sizes ORDER BY n DESC, member LIMIT 5"
)
def largest_members(spark, sf_dir):
    """The five members with the most lines, by a report on the files' lines."""
    lines = dl.read_lines(spark, _members(spark, sf_dir))
    counts = lines.groupBy(inv.partition_value(F.col("path"), "member").alias("file")).agg(
        F.count("*").alias("bytes")
    )
    return inv.largest_files(counts, 5).select(F.col("file").alias("member"), F.col("bytes").alias("n"))


@query(
    f"WITH {BASE_SQL} SELECT '|' AS delimiter, 13 AS n_columns, count(*) AS n_lines FROM base"
)
def sniffed_layout(spark, sf_dir):
    """Delimiter and width found in every member, with the lines counted on the way."""
    found = dl.sniff_layout(dl.read_lines(spark, _members(spark, sf_dir)))
    return found.groupBy("delimiter", "n_columns").agg(F.sum("lines").alias("n_lines"))


@query(
    f"WITH {BASE_SQL} SELECT year || quarter AS member, '|' AS delimiter, 13 AS n_columns FROM base GROUP BY year, quarter"
)
def sniffed_heads(spark, sf_dir):
    """Delimiter and width of every member from the first 4 KB of each file."""
    files = inv.list_files(spark, _members(spark, sf_dir), "*.csv").where("bytes > 0")
    paths = [r["path"] for r in files.select("path").collect()]  # one per member file
    found = dl.sniff_layout(read_heads(spark, paths, 4096))
    member = inv.partition_value(F.col("path"), "member").alias("member")
    return found.select(member, "delimiter", "n_columns").distinct()


@query(
    f"WITH {BASE_SQL} SELECT CAST(year AS INTEGER) AS year, quarter, count(*) AS n_rows FROM base GROUP BY year, quarter"
)
def head_sniffed_load(spark, sf_dir):
    """Members loaded with layouts from their heads: every row is there."""
    target = scratch_path(spark, "bronze")
    dl.ingest_delimited(spark, _members(spark, sf_dir), target, process_all=True, sniff_bytes=4096)
    return partition_counts(scan_table(spark, target))


@query(f"WITH {BASE_SQL} SELECT DISTINCT CAST(year AS INTEGER) AS year, quarter FROM base WHERE year >= 1998")
def member_selection(spark, sf_dir):
    files = inv.list_files(spark, _members(spark, sf_dir))
    chosen = inv.member_filter(files, years=range(1998, 2100))
    return chosen.select("year", "quarter").distinct()


@query(
    f"WITH {BASE_SQL} SELECT year, quarter, count(*) AS n_rows,"
    " count(DISTINCT entity_id) AS n_entities, count(nullif(period_raw, '')) AS n_periods,"
    " count(status) AS n_status, count(disc) AS n_disc,"
    f" {rounded_sql('sum(CAST(price AS DECIMAL(18, 2)))', 2)} AS price FROM base GROUP BY year, quarter"
)
def delimited_ingest(spark, sf_dir):
    """Text members to a partitioned table and back: nothing lost, empty texts became NULL."""
    target = scratch_path(spark, "bronze")
    dl.ingest_delimited(spark, _members(spark, sf_dir), target, process_all=True)
    stored = scan_table(spark, target)
    return stored.groupBy(F.col("year").cast("bigint").alias("year"), "quarter").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("c000").alias("n_entities"),
        F.count("c001").alias("n_periods"),
        F.count("c003").alias("n_status"),
        F.count("c007").alias("n_disc"),
        rounded(F.sum(to_double(F.col("c005")).cast("decimal(18,2)")), 2).alias("price"),
    )


@query(
    f"WITH {BASE_SQL} SELECT CAST(year AS INTEGER) AS year, quarter, '|' AS delimiter,"
    " 13 AS n_columns, count(*) AS n_rows, 'snappy' AS compression FROM base"
    " GROUP BY year, quarter"
)
def load_log(spark, sf_dir):
    """The stored log after two loads, by quarter: the second finds every member done."""
    source, target = _members(spark, sf_dir), scratch_path(spark, "bronze")
    log = scratch_path(spark, "log")
    for _ in range(2):
        dl.ingest_delimited(spark, source, target, process_all=True, log_path=log)
    keys = ("year", "quarter", "delimiter", "n_columns", "compression")
    return spark.read.parquet(log).groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))


_COUNTS_SQL = f"WITH {BASE_SQL} SELECT CAST(year AS INTEGER) AS year, quarter, count(*) AS n_rows FROM base GROUP BY year, quarter"


@query(_COUNTS_SQL)
def late_member(spark, sf_dir):
    """Files that come later for quarters that are stored already."""
    rows = text_rows(spark, sf_dir, ["year", "quarter"])
    source, target = scratch_path(spark, "members"), scratch_path(spark, "bronze")
    late = F.pmod(F.xxhash64("entity_id"), F.lit(3)) == 0
    for part in (~late, late):
        _write_members(rows.where(part), F.concat("year", "quarter"), source)
        dl.ingest_delimited(spark, source, target, process_all=True)
    return partition_counts(scan_table(spark, target))


@query(_COUNTS_SQL)
def arrivals_split(spark, sf_dir):
    """A folder loaded as a stream of batches that split quarters: stored rows by quarter."""
    source, target = scratch_path(spark, "members"), scratch_path(spark, "bronze")
    # Four folders a quarter, each of as many files as its size asks for.
    piece = F.pmod(F.xxhash64("entity_id"), F.lit(4)).cast("string")
    rows = text_rows(spark, sf_dir, ["year", "quarter"])
    _write_members(rows, F.concat("year", "quarter", F.lit("-"), piece), source)
    load_arrivals(
        spark, source, target, scratch_path(spark, "arrivals"), files_per_batch=40, delimiter="|", width=13
    ).awaitTermination()
    return partition_counts(scan_table(spark, target))


@query(
    f"WITH {BASE_SQL} SELECT DISTINCT CAST(year AS VARCHAR) AS year, quarter, TRUE AS has_bytes"
    " FROM base"
)
def manifest(spark, sf_dir):
    target = scratch_path(spark, "bronze")
    dl.ingest_delimited(spark, _members(spark, sf_dir), target, process_all=True)
    return (
        inv.table_manifest(spark, target)
        .groupBy("year", "quarter")
        .agg((F.sum("bytes") > 0).alias("has_bytes"))
    )


@query(
    f"WITH {BASE_SQL} SELECT CAST(year AS VARCHAR) AS year, quarter, count(*) AS n_rows FROM base"
    " GROUP BY year, quarter"
)
def path_partitions(spark, sf_dir):
    """Partition values taken from the path of each row's file."""
    target = scratch_path(spark, "bronze")
    dl.ingest_delimited(spark, _members(spark, sf_dir), target, process_all=True)
    rows = scan_table(spark, target, with_partitions=False)
    return partition_counts(with_partition_columns(rows))


_STORED_SQL = (
    f"WITH {BASE_SQL} SELECT CAST(year AS INTEGER) AS year, quarter, count(*) AS n_rows,"
    " count(DISTINCT entity_id) AS n_entities,"
    f" {rounded_sql('sum(CAST(price AS DECIMAL(18, 2)))', 2)} AS price FROM base GROUP BY year, quarter"
)


def _stored_summary(rows):
    price = F.sum(to_double(F.col("price")).cast("decimal(18,2)"))
    return rows.groupBy("year", "quarter").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("entity_id").alias("n_entities"),
        rounded(price, 2).alias("price"),
    )


@query(_STORED_SQL)
def recompressed_table(spark, sf_dir):
    """A snappy table written again with zstd, partition by partition, and read back."""
    rows = text_rows(spark, sf_dir)
    first, second = scratch_path(spark, "snappy"), scratch_path(spark, "zstd")
    write_table(rows, first, ("year", "quarter"), "snappy")
    gathered = gathered_by_partition(scan_table(spark, first), ["year", "quarter"])
    write_table(gathered, second, ("year", "quarter"), "zstd")
    return _stored_summary(scan_table(spark, second))


@query(_STORED_SQL)
def replaced_partitions(spark, sf_dir):
    """A table of which every second quarter is written once more: nothing doubles."""
    rows = text_rows(spark, sf_dir, ["year", "quarter"])
    target = scratch_path(spark, "result")
    write_table(rows, target, ("year", "quarter"))
    again = rows.where(F.col("quarter").isin("Q1", "Q3"))
    write_table(again, target, ("year", "quarter"), mode="replace_partitions")
    return _stored_summary(scan_table(spark, target))


@query(_STORED_SQL)
def report_round_trip(spark, sf_dir):
    """A result as a CSV report and back, with the types given and with the types inferred."""
    target = scratch_path(spark, "report")
    write_report(_stored_summary(text_rows(spark, sf_dir)), target)
    schema = "year int, quarter string, n_rows bigint, n_entities bigint, price double"
    given, inferred = read_report(spark, target, schema), read_report(spark, target)
    same = [F.col(c).cast(t).alias(c) for c, t in given.dtypes]
    return given.intersect(inferred.select(*same))


@query(
    "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS \"column\""
    " FROM (DESCRIBE SELECT * FROM lineitem)"
)
def schema_listing(spark, sf_dir):
    rows = require_columns(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])
    return table_schema(rows).select("position", "column")


@query(
    f"WITH {BASE_SQL} SELECT TRUE AS a_file_for_each, TRUE AS bytes_add_up, TRUE AS columns_known,"
    " count(DISTINCT year || quarter) AS n_quarters FROM base"
)
def manifest_totals(spark, sf_dir):
    """The summary of a manifest against its own rows and against the listing."""
    target = scratch_path(spark, "bronze")
    dl.ingest_delimited(spark, _members(spark, sf_dir), target, process_all=True)
    listed = inv.table_manifest(spark, target)
    sizes = inv.list_files(spark, target, "*.parquet").agg(F.sum("bytes")).scalar()
    quarters = listed.select("year", "quarter").distinct().agg(F.count("*")).scalar()
    columns = table_schema(scan_table(spark, target)).count()
    return inv.manifest_summary(listed).select(
        (F.col("files") >= quarters).alias("a_file_for_each"),
        (F.col("bytes") == sizes).alias("bytes_add_up"),
        F.lit(columns == 17).alias("columns_known"),
        quarters.alias("n_quarters"),
    )


@query(
    f"WITH {BASE_SQL} SELECT 'output' AS \"check\", year || quarter AS subject, 'pass' AS status FROM base"
    " GROUP BY year, quarter UNION ALL SELECT 'output', '1066Q1', 'fail'"
    " UNION ALL SELECT 'output', 'empty', 'fail'"
)
def output_presence(spark, sf_dir):
    """Members stored as outputs: those of the table are there, others and an empty one are not."""
    target = scratch_path(spark, "outputs")
    data = text_rows(spark, sf_dir).select(F.concat("year", "quarter").alias("member"), "entity_id")
    names = [r["member"] for r in data.select("member").distinct().collect()]  # one per quarter
    data.repartition("member").write.partitionBy("member").text(target)
    spark.createDataFrame([], "line string").write.text(f"{target}/empty")
    wanted = {name: f"member={name}" for name in names} | {"1066Q1": "member=1066Q1", "empty": "empty"}
    found = expect_outputs(spark, target, list(wanted.values()))
    subject = F.regexp_replace("subject", "^member=", "")
    return found.select("check", subject.alias("subject"), "status")
