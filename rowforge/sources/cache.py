"""The cache of step results: a Parquet table by step, a row for each key and time of storing."""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import delete, hadoop_path

FILES = 32  # stored by runs before a step's entries are rewritten
SCHEMA = "key string, value string, present array<string>, created_at double, expires_at double"


class CacheTable:
    """Entries expire by one clock reading a run. Only the driver adds entries, whole files at a time, so readers see all or none."""

    def __init__(self, spark: SparkSession, folder: str, ttl: int, now: float | None = None):
        self.spark, self.folder, self.ttl, self.now = spark, folder.rstrip("/"), ttl, time.time() if now is None else now

    def _at(self, step: str) -> str:
        return f"{self.folder}/cache/step_name={quote(step, safe='')}"

    def _exists(self, path: str) -> bool:
        fs, at = hadoop_path(self.spark, path)
        return fs.exists(at)

    def raw(self, step: str) -> DataFrame:
        if not self._exists(self._at(step)):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self._at(step))

    def live(self, step: str) -> DataFrame:
        """The newest entry of each key that has not expired: (key, value, present)."""
        good = self.raw(step).where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(self.now)))
        return good.groupBy("key").agg(F.max_by(F.struct("value", "present"), "created_at").alias("e")).select("key", "e.value", "e.present")

    def add(self, step: str, entries: DataFrame) -> None:
        """Entries are (key, value, present)."""
        expires = F.lit(self.now + self.ttl if self.ttl else None).cast("double")
        entries.select("key", "value", "present", F.lit(self.now).alias("created_at"), expires.alias("expires_at")).write.parquet(f"{self._at(step)}/{uuid.uuid4().hex}")
        if len(self._parts(step)) > FILES:
            self.compact(step)

    def _parts(self, step: str) -> list[str]:
        fs, at = hadoop_path(self.spark, self._at(step))
        return [s.getPath().toString() for s in fs.listStatus(at)] if fs.exists(at) else []

    def steps(self) -> list[str]:
        fs, at = hadoop_path(self.spark, f"{self.folder}/cache")
        return [unquote(s.getPath().getName().split("=", 1)[1]) for s in fs.listStatus(at)] if fs.exists(at) else []

    def clear(self, step: str | None = None) -> int:
        """Drop a step's entries, or all; how many there were."""
        n = 0
        for s in [step] if step is not None else self.steps():
            n += self.raw(s).count()
            delete(self.spark, self._at(s))
        return n

    def compact(self, step: str) -> int:
        """Rewrite a step's entries without those that have expired or been replaced; how many went.

        The new entries are moved in before the old ones go. In between, and after a crash there, both are read, which is the same
        to live(). Runs call this themselves once they have stored often.
        """
        parts, old = self._parts(step), self.raw(step)
        before = old.count()
        live = old.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(self.now)))
        newest = live.groupBy("key").agg(F.max_by(F.struct("value", "present", "created_at", "expires_at"), "created_at").alias("e")).select("key", "e.*")
        name = uuid.uuid4().hex
        fs, made = hadoop_path(self.spark, f"{self.folder}/rewrite-{name}")
        newest.write.parquet(made.toString())
        kept = self.spark.read.schema(SCHEMA).parquet(made.toString()).count()
        to = hadoop_path(self.spark, f"{self._at(step)}/{name}")[1]
        fs.mkdirs(to.getParent())
        fs.rename(made, to)
        for path in parts:
            delete(self.spark, path)
        return before - kept
