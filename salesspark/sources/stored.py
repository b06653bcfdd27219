"""Folders in the shared store that several sessions may write and read: snapshots of sources, publishing by rename."""

from __future__ import annotations

import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from salesspark.session import ensure_checkpoint_dir


class Store:
    """Files by URI, through the file systems that Spark itself uses."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, uri: str):
        path = self._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self._conf), path

    def children(self, uri: str) -> list[tuple[str, int, int]]:
        """(URI, length, time of change) of what lies directly in a folder, sorted; nothing if there is no such folder."""
        fs, path = self._at(uri)
        if not fs.exists(path):
            return []
        return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))

    def snapshot(self, files: list[str]) -> list[tuple[str, int, int]]:
        """(URI, length, time of change) of each file: it differs as soon as a source is replaced."""
        folders = {f.rsplit("/", 1)[0] for f in files}
        known = {uri: (uri, length, time) for folder in folders for uri, length, time in self.children(folder)}
        return [known.get(f, (f, -1, -1)) for f in sorted(files)]

    def rename(self, old: str, new: str) -> None:
        fs, path = self._at(old)
        target = self._at(new)[1]
        fs.mkdirs(target.getParent())
        if not fs.rename(path, target):
            raise OSError(f"could not publish {new}")

    def delete(self, uri: str) -> None:
        fs, path = self._at(uri)
        fs.delete(path, True)


def attempt_name(uri: str) -> str:
    """A name beside ``uri`` that no other writer uses and no reader looks at."""
    folder, name = uri.rstrip("/").rsplit("/", 1)
    return f"{folder}/.attempt-{uuid.uuid4().hex}-{name}"


@contextmanager
def kept_rows(df: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``df``, written once to the shared folder, for several readers that each take a few columns; the files go at the end."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(place)
        yield spark.read.schema(df.schema).parquet(place)
    finally:
        Store(spark).delete(place)
