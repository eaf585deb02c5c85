"""Run logs: JSON lines of eight record types, written from a run's tables and read in batch or as a stream.

A log is a folder. The driver writes the run's own records as small files; records of rows are written by executors, so
their number doesn't matter. ``single_file`` joins a small run's log into one file in order.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import redact as redact_text
from ..functions.text import redact
from .rows import ROW
from .workspace import hadoop_path

SCHEMA = (
    "v INT, t DOUBLE, type STRING, run_id STRING, started_at STRING, num_rows BIGINT, display_key STRING, step STRING, level INT, mode STRING, row BIGINT, key STRING, status STRING, from_cache BOOLEAN, `values` STRING, "
    "error STRUCT<type:STRING,msg:STRING>, usage STRUCT<`in`:BIGINT,`out`:BIGINT,cost:DOUBLE>, elapsed_ms DOUBLE, elapsed_s DOUBLE, num_errors BIGINT, total_errors BIGINT, batch_id STRING, attempt INT, kind STRING, latency_ms DOUBLE, "
    "backoff_s DOUBLE, prompt_ref STRUCT<off:BIGINT,len:BIGINT>, cost STRUCT<`in`:BIGINT,`out`:BIGINT,cost:DOUBLE>, num_cells BIGINT, cells ARRAY<STRUCT<step:STRING,row:BIGINT>>"
)


def new_run_id() -> str:
    return f"{datetime.datetime.now(datetime.timezone.utc):%Y-%m-%d-%H%M%S}-{uuid.uuid4().hex[:6]}"


def default_display_key(df: DataFrame) -> str | None:
    """The first string column."""
    return next((f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not f.name.startswith("__")), None)


def display_keys(rows: DataFrame, key: str | None) -> Column:
    """A row's label: its key column as text; null where there is none."""
    return F.col(f"`{key}`").cast("string") if key is not None and key in rows.columns else F.lit(None).cast("string")


def row_complete(frame: DataFrame, step: str, column: str, key: Column, t: float = 0.0) -> DataFrame:
    """A record for each row of a step, as struct columns in the log's order."""
    c = F.col(column)
    ok_values = F.when(c["status"] != "error", c["values"])
    usage = F.when(c["usage"].isNotNull(), F.struct(c["usage"]["prompt_tokens"].alias("in"), c["usage"]["completion_tokens"].alias("out"), F.lit(None).cast("double").alias("cost")))
    error = F.when(c["status"] == "error", F.struct(c["error"]["type"].alias("type"), redact(c["error"]["msg"]).alias("msg")))
    return frame.select(
        F.lit(1).alias("v"), F.lit(t).alias("t"), F.lit("row_complete").alias("type"), F.lit(step).alias("step"), F.col(ROW).alias("row"), key.alias("key"), c["status"].alias("status"),
        F.coalesce(c["from_cache"], F.lit(False)).alias("from_cache"), ok_values.alias("values"), error.alias("error"), usage.alias("usage"), c["elapsed_ms"].alias("elapsed_ms"),
    )


def row_attempts(frame: DataFrame, step: str, column: str, t: float = 0.0) -> DataFrame:
    """A record for each call that a step's rows made."""
    a = F.col("a")
    rows = frame.select(ROW, F.explode(F.col(f"{column}.attempts")).alias("a"))
    error = F.when(a["error"].isNotNull(), F.struct(a["error"]["type"].alias("type"), redact(a["error"]["msg"]).alias("msg")))
    return rows.select(
        F.lit(1).alias("v"), F.lit(t).alias("t"), F.lit("row_attempt").alias("type"), F.lit(step).alias("step"), F.col(ROW).alias("row"), a["attempt"].alias("attempt"), a["kind"].alias("kind"), a["status"].alias("status"),
        a["latency_ms"].alias("latency_ms"), a["backoff_s"].alias("backoff_s"), error.alias("error"), redact(a["body"]).alias("body"),
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log, a folder or a file; lines that aren't JSON are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(path)


def read_run_context(spark: SparkSession, path: str) -> tuple[str | None, str | None, float]:
    """(run_id, display_key, last t) of a log."""
    log = read_run_log(spark, path)
    first = log.where("type = 'pipeline_start'").select("run_id", "display_key").limit(1).collect()
    last = log.agg(F.max("t")).first()[0]
    return (first[0][0] if first else None, first[0][1] if first else None, last or 0.0)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(step, row, attempt, body): what was sent and answered, of runs that captured it."""
    return spark.read.schema("step string, row long, attempt int, body string").json(f"{path}/prompts")


def read_prompt_ref(path: str | Path, off: int, length: int) -> dict[str, Any]:
    """A record of a prompt file by its place in bytes."""
    with open(path, "rb") as f:
        f.seek(off)
        return json.loads(f.read(length))


class JsonlRunLogger:
    """Writes a run's log to a folder; one that has a log already gets a retry's records after it, under its run id."""

    def __init__(self, path: str | Path, run_id: str | None = None):
        self.path, self.run_id, self.base, self.began, self.retry = str(path).rstrip("/"), run_id or new_run_id(), 0.0, time.monotonic(), False
        self.n, self.cells = 0, 0
        self.spark: SparkSession | None = None

    def now(self) -> float:
        return self.base + time.monotonic() - self.began

    def put(self, record: dict[str, Any]) -> None:
        self.n += 1
        fs, at = hadoop_path(self.spark, f"{self.path}/events/{self.now():017.6f}-{self.n:06d}.json")
        out = fs.create(at)
        out.write((json.dumps({"v": 1, "t": self.now(), **record}, default=str) + "\n").encode())
        out.close()

    def rows(self, records: DataFrame, kind: str) -> None:
        self.n += 1
        records.write.option("ignoreNullFields", "false").json(f"{self.path}/events/{self.now():017.6f}-{self.n:06d}-{kind}")

    def start(self, run: Any, total: int, display_key: str | None, retry: bool, frame: DataFrame) -> None:
        from ..plans.manifest import build_manifest

        self.spark, self.retry = run.spark, retry
        source = frame.select(*[F.col(f"`{c}`") for c in run.input])
        self.key = display_key or default_display_key(source)
        at = datetime.datetime.now(datetime.timezone.utc).isoformat()
        if retry:
            run_id, key, self.base = read_run_context(run.spark, self.path)
            self.run_id, self.key = run_id or self.run_id, key or self.key
            cells = []
            for n in run.p.step_names:
                if n in run.partial:
                    cells += [{"step": n, "row": r[0]} for r in frame.where(F.col(run.redo[n])).select(ROW).orderBy(ROW).toLocalIterator()]
            self.cells = len(cells)
            self.put({"type": "retry_start", "run_id": self.run_id, "started_at": at, "num_rows": total, "num_cells": len(cells), "cells": cells})
            return
        level = {s: i for i, names in enumerate(run.p.execution_levels) for s in names}
        steps = [{"name": n, "level": level[n], "mode": "batch" if getattr(run.by[n], "batch", False) else "realtime", "model": getattr(run.by[n], "model", None)} for n in run.p.step_names]
        self.put({"type": "pipeline_start", "run_id": self.run_id, "started_at": at, "num_rows": total, "display_key": self.key, "steps": steps, "manifest": build_manifest(run.p, run.config, run.capture), "plan": None})

    def step(self, run: Any, frame: DataFrame, name: str, total: int) -> None:
        """A step's records, once its rows are there."""
        c = run.col[name]
        rows = frame.where(F.col(run.redo[name])) if name in run.partial else frame
        n = rows.count() if name in run.partial else total
        if name in run.partial and not n:
            return
        level = next(i for i, names in enumerate(run.p.execution_levels) if name in names)
        self.put({"type": "step_start", "step": name, "level": level, "mode": "batch" if name in run.batches else "realtime", "num_rows": n})
        attempts = row_attempts(rows, name, c, self.now())
        if getattr(run.by[name], "model", None) is not None:
            if run.capture != "metadata":
                attempts.select("step", "row", "attempt", "body").where("body IS NOT NULL").write.mode("append").json(f"{self.path}/prompts")
            self.rows(attempts.drop("body"), "attempts")
        self.rows(row_complete(rows, name, c, display_keys(rows, self.key), self.now()), "rows")
        u = run.usage(frame, [name]).steps.get(name)
        bad = rows.where(F.col(f"{c}.status") == "error").count()
        self.put({"type": "step_end", "step": name, "num_errors": bad, "usage": {"in": u.prompt_tokens if u else 0, "out": u.completion_tokens if u else 0, "cost": None}, "elapsed_s": run.elapsed.get(name, 0.0), "batch_id": run.batches.get(name) or None})

    def end(self, total: int, errors: int, cost: Any, elapsed: float) -> None:
        self.put({"type": "retry_end" if self.retry else "pipeline_end", "num_rows": total, "total_errors": errors, "cost": {"in": cost.total_prompt_tokens, "out": cost.total_completion_tokens, "cost": None}, "elapsed_s": elapsed, **({"num_cells": self.cells} if self.retry else {})})


def single_file(spark: SparkSession, folder: str, path: str | Path) -> Path:
    """A log as one file: records in the order in which they were written, rows of a step by row."""
    parts = spark.read.text(f"{folder}/events", recursiveFileLookup=True).select("value", F.input_file_name().alias("file"))
    order = F.regexp_extract("file", r"events/([^/]*)", 1)
    row = F.get_json_object("value", "$.row").cast("long")
    with open(path, "w") as f:
        for r in parts.orderBy(order, row, F.get_json_object("value", "$.attempt").cast("int")).toLocalIterator():
            f.write(r["value"] + "\n")
    return Path(path)


def redact_body(body: Any) -> Any:
    """Secrets replaced in all texts of a nested value."""
    if isinstance(body, str):
        return redact_text(body)
    if isinstance(body, dict):
        return {k: redact_body(v) for k, v in body.items()}
    return [redact_body(v) for v in body] if isinstance(body, (list, tuple)) else body


__all__ = ["JsonlRunLogger", "default_display_key", "display_keys", "new_run_id", "read_prompt_ref", "read_prompts", "read_run_context", "read_run_log", "redact_body", "row_attempts", "row_complete", "single_file"]
