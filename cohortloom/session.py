"""Session building and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "cohortloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution and a fixed time zone.

    `master` and `shuffle_partitions` are left to the cluster when not given.
    On a large cluster set `shuffle_partitions` so that one partition holds
    about 128-256 MB; adaptive execution then merges the small ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED = "cohortloom.zip"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Operators that run in workers are found there by name. Where the package is
    installed on every node (see `pyproject.toml`) this changes nothing. The
    archive is made in the driver's temporary folder; Spark hands it out.
    """
    context = spark.sparkContext
    if any(name.endswith(_SHIPPED) for name in context.listFiles):
        return
    source = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="cohortloom-package-")) / _SHIPPED
    with zipfile.ZipFile(archive, "w") as made:
        for module in sorted(source.rglob("*.py")):
            made.write(module, module.relative_to(source.parent))
    context.addPyFile(str(archive))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session, from `spark.checkpoint.dir`.

    A local session without one gets a temporary folder, as in tests. A
    cluster without one is an error: a machine-local folder would be lost
    with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    checkpoint_dir = spark.sparkContext.getCheckpointDir()
    if checkpoint_dir:
        return checkpoint_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cohortloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch root."""
    return f"{scratch_root(spark)}/cohortloom/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and return the written table.

    For results that are read several times (iterative fits, multi-pass
    statistics). Unlike a cache the written table survives lost executors and
    keeps column pruning for the later passes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Remove the tables that `materialise` and `scratch_path` left below the scratch root.

    For the end of a session: results that are still to be read from those
    tables are lost. Returns whether there was anything to remove. Only the
    folder `cohortloom` is touched.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/cohortloom")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.delete(folder, True))
