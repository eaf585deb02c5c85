"""The folder that all executors share, and tables written there between the jobs of a run."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster names; a local folder of this process where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="rowforge-run-")
        shared_dir.own = found
    return found.rstrip("/")


def stored(spark: SparkSession, given: str, variable: str, fallback: str) -> str:
    """Where what outlives a run is kept: as given; else in the shared folder that a cluster names; else, on one machine, under the user's home."""
    if given:
        return given
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/')}/rowforge" if named else str(Path(os.environ.get(variable) or Path.home() / fallback) / "rowforge")


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


class Workspace:
    """Each table is written once and read as often as needed, so what made it never runs twice and a lost executor loses no more than a task."""

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/rowforge-{name}-{uuid.uuid4().hex[:12]}", 0
        self.tables: list[str] = []
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str = "table", partition_by: Iterable[str] = ()) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(at)
        self.tables.append(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def keep_last(self) -> None:
        """Delete all tables but the last, which holds what is still needed of them."""
        for at in self.tables[:-1]:
            delete(self.spark, at)
        del self.tables[:-1]

    def drop(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # the session has ended, and its local folder with it
            pass


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names that no column has, whatever its case."""
    have, out = {x.lower() for x in taken}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out
