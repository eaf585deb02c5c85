"""Checkpoints: a Parquet table of each finished step and a manifest that names them.

Manifests are numbered. A new one is moved into its place complete, and only then the older ones go, so at any time the newest
readable one is whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validate import canonical
from .rows import ROW
from .workspace import delete, hadoop_path


def content_digest(rows: DataFrame, total: int, sample: int = 5) -> str:
    """A hash of the columns' names, the count, and the first and last rows, which overlap where there are few."""
    ends = {r[ROW]: r for r in rows.orderBy(ROW).limit(sample).collect() + rows.orderBy(F.desc(ROW)).limit(sample).collect()}
    ids = sorted(ends)
    picked = [ends[i] for i in ids[:sample]] + [ends[i] for i in ids[-sample:]]
    payload = [sorted([[k, v] for k, v in r.asDict(True).items() if k != ROW], key=lambda p: p[0]) for r in picked]
    return hashlib.sha256(canonical([sorted(c for c in rows.columns if c != ROW), total, payload]).encode()).hexdigest()[:16]


def short(table: DataFrame, most: int = 500) -> DataFrame:
    """A step's table with its error messages cut to ``most`` characters."""
    error = F.col("step.error")
    cut = F.when(error.isNotNull(), F.struct(error["type"].alias("type"), F.substring(error["msg"], 1, most).alias("msg")))
    return table.withColumn("step", F.when(F.col("step").isNotNull(), F.col("step").withField("error", cut)))


class Checkpoints:
    def __init__(self, spark: SparkSession, folder: str, identifier: str):
        self.spark, self.identifier = spark, identifier
        self.at = f"{folder.rstrip('/')}/checkpoints/{''.join(c if c.isalnum() or c in '_-' else '_' for c in identifier)}"

    def _manifests(self) -> list[str]:
        """Names, the newest first."""
        fs, at = hadoop_path(self.spark, self.at)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((n for n in names if n.startswith("manifest-") and n.endswith(".json")), reverse=True)

    def _read(self) -> dict[str, Any] | None:
        for name in self._manifests():
            try:
                return json.loads(self.spark.read.text(f"{self.at}/{name}", wholetext=True).collect()[0][0])
            except (ValueError, IndexError):
                continue
        return None

    def load(self, columns: list[str], total: int, fields: dict[str, list[str]]) -> dict[str, DataFrame] | None:
        """Tables of finished steps by name; None where there is no checkpoint or it is of other rows, columns or fields."""
        m = self._read()
        if m is None or m["total_rows"] != total or m["columns"] != sorted(columns) or any(m["fields"].get(s) not in (None, f) for s, f in fields.items()):
            return None
        return {s: self.spark.read.parquet(p) for s, p in m["steps"].items() if s in fields}

    def save(self, columns: list[str], total: int, fields: dict[str, list[str]], tables: dict[str, DataFrame]) -> None:
        m = self._read() or {}
        steps, old = dict(m.get("steps", {})), []
        for s, table in tables.items():
            path = f"{self.at}/step-{''.join(c if c.isalnum() else '_' for c in s)}-{uuid.uuid4().hex[:8]}"
            short(table).write.parquet(path)
            old += [steps[s]] if s in steps else []
            steps[s] = path
        body = json.dumps({"columns": sorted(columns), "total_rows": total, "fields": fields, "steps": steps})
        names = self._manifests()
        number = 1 + (int(names[0].split("-")[1].split(".")[0]) if names else 0)
        fs, src = hadoop_path(self.spark, f"{self.at}/writing-{uuid.uuid4().hex}")
        out = fs.create(src)
        out.write(body.encode())
        out.close()
        if not fs.rename(src, hadoop_path(self.spark, f"{self.at}/manifest-{number:09d}.json")[1]):
            raise OSError(f"another run writes checkpoints to {self.at}")
        for name in names:
            delete(self.spark, f"{self.at}/{name}")
        for path in old:
            delete(self.spark, path)

    def clear(self) -> None:
        delete(self.spark, self.at)


def list_checkpoints(spark: SparkSession, folder: str) -> list[str]:
    fs, at = hadoop_path(spark, f"{folder.rstrip('/')}/checkpoints")
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
