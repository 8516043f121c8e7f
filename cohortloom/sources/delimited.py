"""Headerless delimited text: layout detection, reading, and loading into a partitioned table.

A loaded table has one folder per year and quarter, however many files a quarter came
in. Which files it holds is written in its own file list, the hidden folder `_files`
below it: a load reads the files that are not listed as done, appends their rows under
its own load id, and lists them. A load that broke off between its rows and its list
entry is found by its entry `started`, and its rows are taken out before the next load.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortloom.functions.cleaning import NULL_TOKENS, tokens_to_null
from cohortloom.sources.heads import read_heads
from cohortloom.sources.inventory import (
    decoded_path,
    list_files,
    member_filter,
    member_name,
    member_quarter,
    member_year,
    path_key,
)
from cohortloom.sources.tables import scan_table, write_table

# The folders of a loaded table, and the columns that say where a row came from.
QUARTER_KEYS = ("year", "quarter")
ORIGIN = ("member", "load_id")
MEMBER_KEYS = (*QUARTER_KEYS, *ORIGIN)
FILE_LIST = "_files"

# The delimiters tried, in order of preference on a tie.
DELIMITERS = (",", "|", "\t", ";")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines with the path of their file, as `path_key` gives it."""
    wanted = [paths] if isinstance(paths, str) else list(paths)
    path = decoded_path(F.col("_metadata.file_path"))
    return spark.read.text(wanted).select(path.alias("path"), "value")


def _occurrences(delimiter: str):
    return F.length("value") - F.length(F.replace(F.col("value"), F.lit(delimiter), F.lit("")))


def sniff_layout(lines: DataFrame, candidates: Sequence[str] = DELIMITERS) -> DataFrame:
    """Per file: the most frequent delimiter, the width it gives, and the lines that are not empty.

    One pass over all lines with map-side totals, whatever the number of files.
    The width is that of the widest line. On a tie the first candidate wins.
    """
    hits = [F.sum(_occurrences(d)).alias(f"hits_{i}") for i, d in enumerate(candidates)]
    width = [F.max(_occurrences(d)).alias(f"most_{i}") for i, d in enumerate(candidates)]
    filled = F.count_if(F.length("value") > 0).alias("lines")
    totals = lines.groupBy("path").agg(*hits, *width, filled)
    options = F.array(
        *[
            F.struct(
                F.col(f"hits_{i}").alias("hits"),
                F.lit(-i).alias("preference"),
                F.lit(d).alias("delimiter"),
                (F.col(f"most_{i}") + 1).cast("int").alias("n_columns"),
            )
            for i, d in enumerate(candidates)
        ]
    )
    best = F.array_max(options)
    return totals.select(
        "path",
        best["delimiter"].alias("delimiter"),
        best["hits"].alias("hits"),
        best["n_columns"].alias("n_columns"),
        "lines",
    )


def column_names(width: int) -> list[str]:
    return [f"c{i:03d}" for i in range(width)]


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    delimiter: str,
    width: int,
    null_tokens: Iterable[str] = NULL_TOKENS,
    with_member: bool = False,
) -> DataFrame:
    """All columns as text, named c000, c001, ...; a short or long row is an error.

    `with_member` adds year, quarter and member from the name of the row's file.
    """
    names = column_names(width)
    raw = (
        spark.read.schema(StructType([StructField(n, StringType()) for n in names]))
        .option("sep", delimiter)
        .option("header", False)
        .option("multiLine", False)
        .option("mode", "FAILFAST")
        .csv([paths] if isinstance(paths, str) else list(paths))
    )
    tokens = tuple(null_tokens)
    columns = [tokens_to_null(F.col(n), tokens).alias(n) for n in names]
    if with_member:
        path = decoded_path(F.col("_metadata.file_path"))
        columns += [
            member_year(path).alias("year"),
            member_quarter(path).alias("quarter"),
            member_name(path).alias("member"),
        ]
    return raw.select(*columns)


FILES_SCHEMA = (
    "load_id string, status string, member string, year int, quarter string, delimiter string,"
    " n_columns int, n_rows bigint, listed_at timestamp"
)
LOG_SCHEMA = (
    "member string, year int, quarter string, delimiter string, n_columns int, "
    "n_rows bigint, seconds double, compression string, finished_at timestamp"
)


def file_list(spark: SparkSession, root: str) -> DataFrame:
    """All entries of a table's file list, none for a table that does not exist yet."""
    try:
        return spark.read.schema(FILES_SCHEMA).parquet(f"{root}/{FILE_LIST}")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], FILES_SCHEMA)
        raise


def stored_members(spark: SparkSession, root: str) -> DataFrame:
    """(member, year, quarter, n_rows, ...) of the files a table holds, by its file list."""
    done = file_list(spark, root).where("status = 'done'")
    latest = F.max_by(F.struct(*done.columns), "listed_at")
    return done.groupBy("member").agg(latest.alias("last")).select("last.*")


def _list_files(spark: SparkSession, root: str, load_id: str, status: str, rows: Sequence[tuple]) -> None:
    """Append entries (member, year, quarter, delimiter, n_columns, n_rows) of a load."""
    now = datetime.now(timezone.utc)
    entries = [(load_id, status, *row, now) for row in rows]
    table = spark.createDataFrame(entries, FILES_SCHEMA)
    table.coalesce(1).write.mode("append").parquet(f"{root}/{FILE_LIST}")


def _without(spark: SparkSession, root: str, lost: DataFrame, on: str) -> None:
    """Write the quarters in `lost` again without the rows whose `on` is in it.

    A quarter is replaced as a whole; one that keeps no row loses its folder.
    Repeating the call after a failure changes nothing more.
    """
    try:
        table = scan_table(spark, root)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return
    named = [F.col(k).cast("string").alias(f"_{k}") for k in QUARTER_KEYS]
    quarters = F.broadcast(lost.select(*named).distinct())
    same = [F.col(k).cast("string") == F.col(f"_{k}") for k in QUARTER_KEYS]
    touched = table.join(quarters, same, "left_semi")
    kept = touched.join(F.broadcast(lost.select(on).distinct()), on, "left_anti").select(*table.columns)
    left = {(str(r["year"]), r["quarter"]) for r in kept.select(*QUARTER_KEYS).distinct().collect()}
    write_table(kept, root, QUARTER_KEYS, mode="replace_partitions")
    for row in quarters.collect():
        if tuple(row) not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/year={row[0]}/quarter={row[1]}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def recover(spark: SparkSession, root: str) -> int:
    """Take out the rows of loads that broke off; returns the number of such loads."""
    entries = file_list(spark, root)
    ended = entries.where("status <> 'started'").select("load_id").distinct()
    broken = entries.where("status = 'started'").join(ended, "load_id", "left_anti")
    found = broken.select("load_id", *QUARTER_KEYS).distinct().collect()  # a row per quarter of a load
    if not found:
        return 0
    _without(spark, root, spark.createDataFrame(found), "load_id")
    for load_id in {r["load_id"] for r in found}:
        _list_files(spark, root, load_id, "undone", [(None, None, None, None, None, None)])
    return len({r["load_id"] for r in found})


def load_members(
    spark: SparkSession,
    members: Sequence[Row],
    target: str,
    compression: str = "snappy",
    null_tokens: Iterable[str] = NULL_TOKENS,
    delimiter: str | None = None,
    width: int | None = None,
    sniff_bytes: int | None = None,
) -> DataFrame:
    """Read member files and add their rows to `target/year=.../quarter=...`.

    `members` has one row `(path, file, year, quarter)` per file. A member that
    the table holds already is replaced: its quarter is written again without
    its old rows. Files of one quarter may come in any number of loads. Files are
    read by one plan per distinct layout, not one job per file. Giving both
    `delimiter` and `width` saves the pass over the text that detects them;
    `sniff_bytes` detects them from that much of each file's head (a longer row
    further on is then an error of the load, not a wider layout). Returns the load log, one row per member; an empty file has 0 rows in it. One
    load at a time may run on a table.
    """
    started = time.time()
    tokens = tuple(null_tokens)
    paths = [m["path"] for m in members]
    if not paths:
        return spark.createDataFrame([], LOG_SCHEMA)
    recover(spark, target)
    names = {path_key(m["path"]): "/".join(m["path"].split("/")[-2:]) for m in members}
    old = stored_members(spark, target).where("n_rows > 0")
    wanted = spark.createDataFrame([(n,) for n in names.values()], "member string")
    old = old.join(wanted, "member", "left_semi").select("member", *QUARTER_KEYS).collect()
    if old:
        _without(spark, target, spark.createDataFrame(old), "member")
    if delimiter is not None and width is not None:
        layouts = {path_key(p): (delimiter, width) for p in paths}
    else:
        lines = read_lines(spark, paths) if sniff_bytes is None else read_heads(spark, paths, sniff_bytes)
        sniffed = sniff_layout(lines).collect()  # one row per file of this load
        layouts = {r["path"]: (r["delimiter"], r["n_columns"]) for r in sniffed}
    by_layout: dict[tuple[str, int], list[str]] = {}
    for path in paths:
        if path_key(path) in layouts:  # an empty file has no line and so no layout
            by_layout.setdefault(layouts[path_key(path)], []).append(path)
    load_id = uuid.uuid4().hex
    entries = [
        (names[path_key(m["path"])], m["year"], m["quarter"], *layouts.get(path_key(m["path"]), (None, 0)))
        for m in sorted(members, key=lambda m: m["path"])
    ]
    _list_files(spark, target, load_id, "started", [(*e, None) for e in entries])
    counts: dict[str, int] = {}
    if by_layout:
        parts = [
            read_delimited(spark, group, sep, n_columns, tokens, with_member=True)
            for (sep, n_columns), group in sorted(by_layout.items())
        ]
        widest = max(n_columns for _, n_columns in by_layout)
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rows = rows.withColumn("load_id", F.lit(load_id)).select(*column_names(widest), *ORIGIN, *QUARTER_KEYS)
        # Every input split belongs to one member and so to one quarter: no shuffle is needed.
        write_table(rows, target, QUARTER_KEYS, compression, mode="append")
        # Rows as written; only the two origin columns of these quarters are read.
        written = scan_table(spark, target).where(F.col("load_id") == load_id)
        written = written.where(F.col("year").isin(sorted({e[1] for e in entries})))
        counts = {r["member"]: r["count"] for r in written.groupBy("member").count().collect()}
    done = [(*e, counts.get(e[0], 0)) for e in entries]
    _list_files(spark, target, load_id, "done", done)
    seconds, now = round(time.time() - started, 3), datetime.now(timezone.utc)
    return spark.createDataFrame([(*d, seconds, compression, now) for d in done], LOG_SCHEMA)


def _in_pieces(rows: Iterable[Row], n: int) -> Iterator[list[Row]]:
    piece: list[Row] = []
    for row in rows:
        piece.append(row)
        if len(piece) == n:
            yield piece
            piece = []
    if piece:
        yield piece


def ingest_delimited(
    spark: SparkSession,
    source: str,
    target: str,
    years: Iterable[int] | None = None,
    process_all: bool = False,
    overwrite: bool = False,
    log_path: str | None = None,
    files_per_load: int = 10_000,
    **options,
) -> DataFrame:
    """Load the delimited members (`...2020Q1...`) below `source` into a partitioned table.

    Members on the table's file list are skipped unless `overwrite`; a file that
    comes later for a stored quarter is loaded. The driver holds the names of
    `files_per_load` files at a time. `options` go to `load_members`. Returns the
    load log of this run, which is also appended to `log_path`.
    """
    members = member_filter(list_files(spark, source), years, process_all)
    if not overwrite:
        done = stored_members(spark, target).select("member")
        named = members.withColumn("member", member_name(F.col("path")))
        members = named.join(done, "member", "left_anti")
    logs = []
    for piece in _in_pieces(members.orderBy("year", "quarter", "path").toLocalIterator(), files_per_load):
        logs.append(load_members(spark, piece, target, **options))
        if log_path:
            append_load_log(logs[-1], log_path)
    return reduce(DataFrame.unionByName, logs) if logs else spark.createDataFrame([], LOG_SCHEMA)


def append_load_log(log: DataFrame, path: str) -> None:
    log.coalesce(1).write.mode("append").parquet(path)
