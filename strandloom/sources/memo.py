"""Results that are kept in a folder, and folders for text that is written and read again."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at ``path``; where no whole one is there, or ``again`` is set, it is computed and written first.

    A run that broke off leaves no _SUCCESS file, so its parts are never taken for a result.
    """
    at, files = _path(spark, f"{path.rstrip('/')}/_SUCCESS")
    if again or not files.exists(at):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share (under spark.checkpoint.dir; a temporary one in local mode), gone at the end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    return path


class Settled:
    """Steps of an iteration, each written in the shared folder and read again, so that a lost executor repeats one step.

    A state replaces the state before it, whose files go; what is kept beside it is small and goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.last = spark, name, None

    def keep(self, frame: DataFrame) -> DataFrame:
        path = passing_folder(self.spark, self.name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def put(self, frame: DataFrame) -> DataFrame:
        path = passing_folder(self.spark, self.name)
        frame.write.parquet(path)
        if self.last is not None:
            at, files = _path(self.spark, self.last)
            files.delete(at, True)
        self.last = path
        return self.spark.read.schema(frame.schema).parquet(path)

    def close(self, frame: DataFrame) -> DataFrame:
        self.last = None
        return frame


def common_stem(paths: Iterable[str]) -> str | None:
    """What all file names, without their last extension, begin with; null where that is nothing."""
    return os.path.commonprefix([os.path.splitext(p)[0] for p in paths]) or None
