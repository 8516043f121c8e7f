"""The first lines of many files, as a data source that reads no more than their heads."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cohortloom.sources.inventory import path_key

HEAD_BYTES = 1 << 20
FILES_PER_TASK = 64


class Files(InputPartition):
    """Some of the paths, read by one task."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


def open_file(path: str):
    """A file on any store that pyarrow opens: local, hdfs, s3, gs."""
    import pyarrow.fs as stores

    scheme, colon, rest = path.partition(":")
    if scheme == "file":
        path = "file:///" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        path = "s3" + colon + rest
    elif not colon:
        return stores.LocalFileSystem().open_input_stream(path, compression=None)
    if path.startswith("file://"):
        return stores.LocalFileSystem().open_input_stream(path[len("file://") :], compression=None)
    store, inside = stores.FileSystem.from_uri(path)
    return store.open_input_stream(inside, compression=None)


def head_lines(path: str, n_bytes: int) -> list[str]:
    """The complete lines of the first `n_bytes`; of a longer first line, what was read of it."""
    with open_file(path) as stream:
        data = stream.read(n_bytes)
        more = len(data) == n_bytes and bool(stream.read(1))
    lines = data.split(b"\n")
    if (more and len(lines) > 1) or lines[-1] == b"":
        lines = lines[:-1]
    return [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]


class HeadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.n_bytes = int(options.get("bytes", HEAD_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        step = FILES_PER_TASK
        return [Files(self.paths[i : i + step]) for i in range(0, len(self.paths), step)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for path in partition.paths:
            for line in head_lines(path, self.n_bytes):
                yield path_key(path), line


class HeadSource(DataSource):
    """Rows (path, value) as of `read_lines`, from the heads of the files in the option `paths`."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeadReader(self.options)


def read_heads(spark: SparkSession, paths: Sequence[str], n_bytes: int = HEAD_BYTES) -> DataFrame:
    """The first lines of every file, with the path as `path_key` gives it.

    At most `n_bytes` and one byte are read of each file. A line cut off by the
    bound is left out, unless it is the only one. Empty files give no row.
    """
    spark.dataSource.register(HeadSource)
    if not paths:
        return spark.createDataFrame([], "path string, value string")
    reader = spark.read.format(HeadSource.name()).option("bytes", str(n_bytes))
    return reader.option("paths", json.dumps(list(paths))).load()
