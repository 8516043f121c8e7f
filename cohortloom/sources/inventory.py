"""File inventories: what lies in a folder, how large, for which year and period."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.numeric import to_gib

# The spellings of years and periods in file names. The guess of
# the inventory knows thirds of a year and the first three quarters only.
YEAR_QUARTER = r"(?i)(\d{4})\s*Q([1-4])"
GUESSED_YEAR = r"(20[0-9]{2})"
GUESSED_PERIOD = r"(?i)(C[123]|Q[123]|T[123])"


def _captured(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def decoded_path(path: Column) -> Column:
    """A path from a file column in the form that readers take and listings give.

    Metadata columns escape blanks and the like (`%20`); a plus sign means itself.
    """
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def path_key(path: str) -> str:
    """`decoded_path` of a path from a listing, which is not escaped."""
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", path)


def list_files(spark: SparkSession, root: str, name_filter: str | None = None) -> DataFrame:
    """One row per file below `root`: path, file name and bytes, empty files included.

    Only the listing is used: the content column of the source is pruned, so
    no file is opened. Spark plans no task for an empty file; those are added
    from the file index, which the driver holds anyway. Hive-style folders stay
    part of the path.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    found = reader.load(root).select("path", F.col("length").alias("bytes"))
    names = [(name,) for name in found.inputFiles()]
    indexed = spark.createDataFrame(names, "escaped string").select(
        decoded_path(F.col("escaped")).alias("name")
    )
    listed = found.withColumn("name", F.regexp_replace("path", "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/"))
    files = indexed.join(listed, "name", "left").select(
        F.coalesce("path", "name").alias("path"), F.coalesce("bytes", F.lit(0)).alias("bytes")
    )
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "bytes")


def guessed(
    files: DataFrame, year_pattern: str = GUESSED_YEAR, period_pattern: str = GUESSED_PERIOD
) -> DataFrame:
    """Files with the year and period guessed from their names, largest first."""
    year = _captured(F.col("file"), year_pattern, 1)
    period = F.upper(_captured(F.col("file"), period_pattern, 1))
    return files.select(
        "file",
        "bytes",
        F.coalesce(year, F.lit("unknown_year")).alias("year"),
        F.coalesce(period, F.lit("unknown_period")).alias("period"),
    ).orderBy(F.desc("bytes"), "file")


def file_inventory(
    spark: SparkSession, root: str, name_filter: str | None = None, **patterns: str
) -> DataFrame:
    """`guessed` for every file below a folder."""
    return guessed(list_files(spark, root, name_filter), **patterns)


def largest_files(files: DataFrame, k: int = 20) -> DataFrame:
    return files.orderBy(F.desc("bytes"), "file").limit(k)


def bytes_by_period(files: DataFrame) -> DataFrame:
    return (
        files.groupBy("year", "period")
        .agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
        .withColumn("gib", to_gib(F.col("bytes")))
        .orderBy("year", "period")
    )


def member_name(path: Column) -> Column:
    """Folder and file name, the part of a path that names a member."""
    return F.substring_index(path, "/", -2)


def _member_code(path: Column) -> Column:
    """`2020Q1` in the name of a member, else the empty text.

    Year and quarter are both cut from it, so a row costs one pattern match.
    """
    return F.regexp_extract(member_name(path), YEAR_QUARTER, 0)


def member_year(path: Column) -> Column:
    return F.substring(_member_code(path), 1, 4).try_cast("int")


def member_quarter(path: Column) -> Column:
    code = _member_code(path)
    return F.when(code != "", F.concat(F.lit("Q"), F.substring(code, -1, 1)))


def member_filter(
    files: DataFrame, years: Iterable[int] | None = None, process_all: bool = False
) -> DataFrame:
    """Files whose name (or folder) holds a year and quarter, of the wanted years, largest first.

    `process_all` keeps every year. Files without a quarter are never members.
    """
    path = F.col("path")
    members = files.select(
        "path",
        "file",
        "bytes",
        member_year(path).alias("year"),
        member_quarter(path).alias("quarter"),
    ).where(F.col("year").isNotNull())
    if not process_all and years is not None:
        members = members.where(F.col("year").isin([int(y) for y in years]))
    return members.orderBy(F.desc("bytes"), "file")


def partition_value(path: Column, key: str) -> Column:
    """Value of a Hive-style folder `key=value` in a path, NULL when absent."""
    return _captured(path, rf"{key}=([^/]+)/", 1)


def table_manifest(
    spark: SparkSession, root: str, keys: tuple[str, ...] = ("year", "quarter")
) -> DataFrame:
    """One row per Parquet file of a table, with its partition values and size."""
    files = list_files(spark, root, "*.parquet")
    partition = [partition_value(F.col("path"), k).alias(k) for k in keys]
    return files.select("file", *partition, "bytes").orderBy(*keys, "file")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("files"),
        F.sum("bytes").alias("bytes"),
        to_gib(F.sum("bytes")).alias("gib"),
    )
