"""Members loaded as they arrive in a folder, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortloom.sources.delimited import append_load_log, load_members
from cohortloom.sources.inventory import member_filter

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def load_arrivals(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    log_path: str | None = None,
    files_per_batch: int = 1000,
    **options,
) -> StreamingQuery:
    """Load the files that are new since the last run, then stop.

    The stream carries file names only; its checkpoint remembers which were
    taken. Every file has a partition of its own, which its load replaces: a
    batch that is repeated after a failure changes nothing, and the files of a
    quarter may come in any number of batches. `files_per_batch` bounds the
    names a batch holds and changes no result. `options` go to `load_members`.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
        .select("path", F.col("length").alias("bytes"))
    )

    def load(batch: DataFrame, _: int) -> None:
        named = batch.withColumn("file", F.element_at(F.split("path", "/"), -1))
        members = member_filter(named, process_all=True).collect()  # one row per file
        log = load_members(spark, members, target, **options)
        if log_path and members:
            append_load_log(log, log_path)

    return (
        names.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
