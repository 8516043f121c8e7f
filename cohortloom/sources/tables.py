"""Parquet and CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortloom.sources.inventory import list_files, partition_value


def scan_table(
    spark: SparkSession,
    root: str,
    pattern: str | None = None,
    columns: Sequence[str] | None = None,
    partition_columns: Sequence[str] = ("year", "quarter", "member", "load_id"),
    with_partitions: bool = True,
    merge_schema: bool = False,
) -> DataFrame:
    """A Parquet table, or the part of it that `pattern` names below `root`.

    `basePath` is always set, so that partition columns exist even when a
    single folder or file is read. `columns` reaches the scan's read schema.
    Without partitions the columns that say where a row came from are left out too.
    """
    path = f"{root.rstrip('/')}/{pattern}" if pattern else root
    table = (
        spark.read.option("basePath", root)
        .option("mergeSchema", str(merge_schema).lower())
        .parquet(path)
    )
    if not with_partitions:
        table = table.drop(*partition_columns)
    return table.select(*columns) if columns else table


def partition_counts(df: DataFrame, keys: Sequence[str] = ("year", "quarter")) -> DataFrame:
    """Rows per partition. Over partition columns only, the scan reads no data pages."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).orderBy(*keys)


def table_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in wanted if c not in present]


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    absent = missing_columns(df, wanted)
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    compression: str = "zstd",
    mode: str = "error",
) -> None:
    """Write Parquet. The mode `replace_partitions` leaves partitions not in `df` as they are."""
    writer = df.write.option("compression", compression)
    if mode == "replace_partitions":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def gathered_by_partition(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows brought together by partition, in pieces of the advisory partition size.

    For writing a table whose rows are mixed: few files per folder, and a
    partition with a large share of the rows is split over as many tasks as
    its size asks for.
    """
    return df.hint("rebalance", *keys)


def compact_table(
    spark: SparkSession,
    root: str,
    keys: Sequence[str] = ("year", "quarter"),
    target_bytes: int = 256 << 20,
    compression: str = "zstd",
) -> DataFrame:
    """Pack the small files of a table; returns (keys..., files, bytes, wanted) of the packed partitions.

    A partition with a quarter more files than its bytes need at `target_bytes` each is
    written again with that many, its rows dealt evenly. Others are not read.
    The number of rows of the result is that of the partitions; a partition is
    replaced as a whole, so a failure leaves the old files or the new ones.
    """
    files = list_files(spark, root, "*.parquet")
    values = [partition_value(F.col("path"), k).alias(k) for k in keys]
    sizes = files.select(*values, "bytes").groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes")
    )
    wanted = F.greatest(F.ceil(F.col("bytes") / target_bytes), F.lit(1)).cast("int")
    small = sizes.withColumn("wanted", wanted).where("files > 1.25 * wanted").orderBy(*keys)
    found = small.collect()  # one row per partition
    report = spark.createDataFrame(found, small.schema)
    if not found:
        return report
    first, before = 0, []
    for row in found:
        before.append((*[row[k] for k in keys], row["wanted"], first))
        first += row["wanted"]
    schema = ", ".join(f"`{k}` string" for k in keys) + ", _wanted int, _first int"
    places = F.broadcast(spark.createDataFrame(before, schema))
    table = spark.read.option("basePath", root).parquet(root)
    plain = table.withColumns({k: F.col(k).cast("string") for k in keys})
    rows = plain.join(places, list(keys))
    # Rows are numbered within their input task, so every file gets its share of each.
    slot = F.pmod(F.monotonically_increasing_id(), F.col("_wanted")).cast("int")
    rows = rows.withColumn("_slot", F.col("_first") + slot).repartitionById(first, F.col("_slot"))
    packed = rows.select(*table.columns)
    write_table(packed, root, keys, compression, mode="replace_partitions")
    return report


def write_report(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A small result as one CSV file with a header."""
    mode = "overwrite" if overwrite else "error"
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def read_report(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """A CSV file with a header; types are inferred only when no schema is given."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)
