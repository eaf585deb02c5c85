"""Pipelines: a DAG of steps compiled to Spark jobs over one wide frame.

A run's frame has the row number, the input's columns and a struct column for each finished step, so routing results to
dependents needs no join and no shuffle. Column steps stay lazy. Python steps run as one Arrow job for as many steps as
have no cache or batch between them, and what such a job makes is written once; errors, usage, the log, reports and
comparisons are then queries over the frame.
"""

from __future__ import annotations

import asyncio
import copy
import hashlib
import json
import logging
import re
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .config import EnrichmentConfig
from .errors import PipelineError, StepError
from .functions.logs import Progress
from .functions.text import cache_key, row_json
from .functions.validate import canonical
from .hooks import EnrichmentHooks, PipelineEndEvent, PipelineStartEvent, RowAttemptEvent, RowCompleteEvent, StepEndEvent, StepStartEvent
from .operators.kernel import Kernel, failure, one, step_type
from .operators.merge import final_columns, step_value
from .operators.steps import ExprStep, LLMStep, StepContext
from .plans import dag
from .sources.cache import CacheTable
from .sources.checkpoint import Checkpoints, content_digest
from .sources.rows import ROW, beside, numbered, to_frame
from .sources.workspace import Workspace, delete, hadoop_path, stored
from .types import BatchRequest, CostSummary, StepUsage

log = logging.getLogger("rowforge")
TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_write_tokens", "cache_read_tokens")
_USAGE = ("prompt_tokens", "completion_tokens", "total_tokens", "model", "cache_write_tokens", "cache_read_tokens")
_REPLIES = T.StructType([T.StructField(ROW, T.LongType()), T.StructField("content", T.StringType()), T.StructField("usage", T.StructType([T.StructField(n, T.StringType() if n == "model" else T.LongType()) for n in _USAGE]))])
_HELD, _HELD_CHARS = 50_000, 16 << 20  # replies that the driver holds before they are written, beside a chunk's, and their length
_PIECE, _PIECES = 4 << 20, 8 << 20  # characters of requests packed at a time, and compressed bytes that the driver takes at a time


@dataclass
class PipelineResult:
    """``data`` is the input with the new fields; ``errors`` has a row for each failed cell. Both are read from written tables."""

    data: DataFrame
    frame: DataFrame
    columns: list[Column]  # those of data, over the frame
    steps: dict[str, str]  # each step's column in the frame
    cost: CostSummary
    num_rows: int
    elapsed_seconds: float
    step_elapsed: dict[str, float] = field(default_factory=dict)
    field_specs: dict[str, dict[str, Any]] = field(default_factory=dict)
    run_id: str = ""
    row_key: str | None = None
    work: Workspace | None = None

    @property
    def errors(self) -> DataFrame:
        """(_row_id, step, error_type, error), from one pass over the frame."""
        cells = [F.struct(F.lit(s).alias("step"), F.col(f"{c}.error.type").alias("error_type"), F.col(f"{c}.error.msg").alias("error"), (F.col(f"{c}.status") == "error").alias("bad")) for s, c in self.steps.items()]
        if not cells:
            return self.frame.sparkSession.createDataFrame([], "_row_id long, step string, error_type string, error string")
        return self.frame.select(ROW, F.inline(F.filter(F.array(*cells), lambda x: x["bad"]))).drop("bad")

    @property
    def has_errors(self) -> bool:
        return not self.errors.isEmpty()

    @property
    def success_rate(self) -> float:
        """1 less failed cells by rows, which several failing steps can bring below 0."""
        return 1 - self.errors.count() / self.num_rows if self.num_rows else 1.0

    @property
    def row_success_rate(self) -> float:
        return 1 - self.errors.select(ROW).distinct().count() / self.num_rows if self.num_rows else 1.0

    def errors_by(self, what: str = "step", top: int = 5) -> DataFrame:
        """The most frequent steps or error types with errors; of equals the one whose first row comes first."""
        seen = self.errors.groupBy(what).agg(F.count(F.lit(1)).alias("count"), F.min(ROW).alias("first"))
        return seen.orderBy(F.desc("count"), "first", what).limit(top).drop("first")

    def save(self, path: str | Path) -> Path:
        from .sources.sinks import save

        return save(self.frame.select(*self.columns, F.col(ROW).alias("__rf_order")), path, order="__rf_order")

    def report(self, output_format: str = "text", path: str | Path | None = None, disable: list[str] | None = None) -> Any:
        from .operators.report import report

        return report(self, output_format, path, disable)

    def summary(self) -> str:
        by = self.errors_by("step").collect() if self.has_errors else []
        lines = [f"{self.num_rows} rows, {len(self.steps)} steps, {self.elapsed_seconds:.1f} s", f"tokens: {self.cost.total_tokens:,}, cache hits: {self.cost.cache_hit_rate:.0%}"]
        lines += [f"errors in {r['step']}: {r['count']}" for r in by]
        lines += [f"  row {r[ROW]}, {r['step']}: {r['error_type']}: {r['error']}" for r in self.errors.orderBy(ROW, "step").limit(5).collect()] if by else []
        return "\n".join(lines)

    def __str__(self) -> str:
        return self.summary()

    def close(self) -> None:
        """Drop the run's tables; the result can't be read after that."""
        if self.work is not None:
            self.work.drop()


def refuse_loop() -> None:
    try:
        asyncio.get_running_loop()
    except RuntimeError:
        return
    raise PipelineError("an event loop is running here: await run_async() instead")


class _Names:
    """Columns by name, for a column step."""

    def __init__(self, find: Callable[[str], Column]):
        self._find = find

    def __getitem__(self, name: str) -> Column:
        return self._find(name)


class Pipeline:
    def __init__(self, steps: list[Any]):
        steps = list(steps)
        dag.validate(steps)
        self._steps, self._levels = steps, dag.levels(steps)
        self._by = {s.name: s for s in steps}

    @property
    def step_names(self) -> list[str]:
        return [n for level in self._levels for n in level]

    @property
    def execution_levels(self) -> list[list[str]]:
        return [list(x) for x in self._levels]

    def get_step(self, name: str) -> Any:
        if name not in self._by:
            raise KeyError(f"no step {name!r}")
        return self._by[name]

    def field_specs(self) -> dict[str, dict[str, Any]]:
        out: dict[str, dict[str, Any]] = {}
        for n in self.step_names:
            s = self._by[n]
            out |= {f: s.field_specs[f].as_dict() if f in getattr(s, "field_specs", {}) else {} for f in s.fields}
        return out

    def run(
        self, data: Any, config: EnrichmentConfig | None = None, hooks: EnrichmentHooks | None = None, output_file: str | None = None, confirm: bool = False, *, run_log: Any = None, display_key: str | None = None,
        capture: str = "metadata", row_key: str | None = None, order_by: list[str] | None = None, data_identifier: str | None = None, spark: SparkSession | None = None,
    ) -> PipelineResult:
        """Run all steps over all rows. ``row_key`` names a unique integer column to number rows by; see sources.rows.numbered.

        Not from within an event loop, which it would block: there, await ``run_async``.
        """
        refuse_loop()
        if capture not in ("metadata", "prompts", "full"):
            raise ValueError("capture is 'metadata', 'prompts' or 'full'")
        spark = spark or (data.sparkSession if isinstance(data, DataFrame) else SparkSession.builder.getOrCreate())
        if confirm:
            print(self.plan(data, config=config, row_key=row_key, order_by=order_by, spark=spark).summary())
            if input("Go on? [y/N] ").strip().lower() not in ("y", "yes"):
                raise PipelineError("stopped before the run")
        run = _Run(self, spark, config or EnrichmentConfig(), hooks, capture)
        result = run.go(to_frame(spark, data), row_key, order_by or [], data_identifier, run_log=run_log, display_key=display_key, listed=not isinstance(data, DataFrame) and isinstance(data, (list, tuple)))
        if output_file:
            result.save(output_file)
        return result

    async def run_async(self, data: Any, config: EnrichmentConfig | None = None, **kw: Any) -> PipelineResult:
        return await asyncio.to_thread(self.run, data, config, **kw)

    def retry_failed(
        self, data: Any, config: EnrichmentConfig | None = None, hooks: EnrichmentHooks | None = None, rows: list[int] | None = None, steps: list[str] | None = None, *, run_log: Any = None, display_key: str | None = None,
        data_identifier: str | None = None, row_key: str | None = None, order_by: list[str] | None = None, spark: SparkSession | None = None,
    ) -> PipelineResult:
        """Run the failed cells of a checkpointed run again, and what depends on them; all else is read from the checkpoint."""
        refuse_loop()
        config = config or EnrichmentConfig()
        if not config.enable_checkpointing:
            raise PipelineError("a retry needs a checkpoint: set enable_checkpointing")
        if steps and (unknown := sorted(set(steps) - set(self._by))):
            raise PipelineError(f"unknown steps: {', '.join(unknown)}")
        spark = spark or (data.sparkSession if isinstance(data, DataFrame) else SparkSession.builder.getOrCreate())
        run = _Run(self, spark, config, hooks, "metadata")
        return run.go(to_frame(spark, data), row_key, order_by or [], data_identifier, retry=(rows, steps), run_log=run_log, display_key=display_key)

    def plan(self, data: Any, sample_size: int = 3, config: EnrichmentConfig | None = None, row_key: str | None = None, order_by: list[str] | None = None, spark: SparkSession | None = None) -> Any:
        from dataclasses import replace

        from .plans.preview import preview

        spark = spark or (data.sparkSession if isinstance(data, DataFrame) else SparkSession.builder.getOrCreate())
        return preview(self, to_frame(spark, data), sample_size, replace(config or EnrichmentConfig(), enable_checkpointing=False), row_key, order_by or [])

    def runner(self, config: EnrichmentConfig | None = None) -> Enricher:
        return Enricher(self, config)

    def clear_cache(self, step: str | None = None, cache_dir: str | None = None, spark: SparkSession | None = None) -> int:
        return CacheTable(spark or SparkSession.builder.getOrCreate(), cache_folder(spark or SparkSession.builder.getOrCreate(), cache_dir or ""), 0).clear(step)


def cache_folder(spark: SparkSession, given: str) -> str:
    return stored(spark, given, "XDG_CACHE_HOME", ".cache")


class Enricher:
    """A pipeline with its settings, to run again and again."""

    def __init__(self, pipeline: Pipeline, config: EnrichmentConfig | None = None):
        self.pipeline, self.config = pipeline, config or EnrichmentConfig()

    def run(self, data: Any, overwrite_fields: bool | None = None, data_identifier: str | None = None, **kw: Any) -> DataFrame:
        from dataclasses import replace

        config = self.config if overwrite_fields is None else replace(self.config, overwrite_fields=overwrite_fields)
        return self.pipeline.run(data, config, data_identifier=data_identifier, **kw).data


class _Run:
    def __init__(self, pipeline: Pipeline, spark: SparkSession, config: EnrichmentConfig, hooks: EnrichmentHooks | None, capture: str):
        self.p, self.spark, self.config, self.hooks, self.capture = pipeline, spark, config, hooks or EnrichmentHooks(), capture
        self.by = pipeline._by
        self.col = {n: f"__rf_{i}" for i, n in enumerate(pipeline.step_names)}
        self.redo = {n: f"__rf_redo_{i}" for i, n in enumerate(pipeline.step_names)}
        self.types: dict[str, dict[str, T.DataType | None]] = {}
        self.parsed: dict[str, list[str]] = {}
        self.work = Workspace(spark)
        self.elapsed: dict[str, float] = {}
        self.batches: dict[str, str] = {}
        self.stored: str | None = None  # the folder of results that tasks store as they go
        self.progress = Progress(spark, config.enable_progress_bar, len(pipeline.step_names))
        self.holding = False
        self.partial: set[str] = set()  # steps of which only some cells run
        self.done: list[str] = []
        self.cached: set[str] = set()

    # -- the whole

    def go(self, df: DataFrame, row_key: str | None, order_by: list[str], identifier: str | None, retry: tuple | None = None, run_log: Any = None, display_key: str | None = None, listed: bool = False) -> PipelineResult:
        began = time.monotonic()
        frame = numbered(df, self.work, row_key, order_by)
        self.input = [c for c in frame.columns if c != ROW]
        if clash := [c for c in self.input if c.lower().startswith("__rf_")]:
            raise ValueError(f"column names that begin with __rf_ are the library's: {', '.join(clash)}")
        total = frame.count()
        names = self.p.step_names
        specs = self.p.field_specs()
        logger = None
        if run_log is not None:
            from .sources.runlog import JsonlRunLogger

            logger = run_log if isinstance(run_log, JsonlRunLogger) else JsonlRunLogger(run_log)
        store = None
        if self.config.enable_checkpointing:
            store = Checkpoints(self.spark, stored(self.spark, self.config.checkpoint_dir, "XDG_STATE_HOME", ".local/state"), identifier or f"df_{content_digest(frame, total)}")
        fields = {n: list(self.by[n].fields) for n in names}
        if store and self.config.checkpoint_interval:
            fs, at = hadoop_path(self.spark, f"{store.at}/partial")
            self.stored = re.sub("^file:/+", "file:///", fs.makeQualified(at).toString())
        prior = store.load(self.input, total, fields) if store and (retry or self.config.auto_resume) else None
        if retry and not prior:
            raise PipelineError("there is no checkpoint of these rows to retry")
        if prior:
            frame = self.resume(frame, prior, retry)
        self.hooks.fire("on_pipeline_start", PipelineStartEvent(list(names), total, self.config))
        if logger:
            logger.start(self, total, display_key, retry is not None, frame)
        result = None
        try:
            with self.progress:
                frame = self.execute(frame, total, store, fields, logger, display_key)
            cost = self.usage(frame)
            columns = final_columns(frame, self.input, self.p._steps, names, self.col, self.config.overwrite_fields or listed)
            result = PipelineResult(frame.select(*columns), frame, columns, dict(self.col), cost, total, time.monotonic() - began, dict(self.elapsed), specs, logger.run_id if logger else "", row_key, self.work)
            if store and not result.has_errors:
                store.clear()
            return result
        finally:
            errors = result.errors.count() if result is not None and (self.hooks.on_pipeline_end or logger) else 0
            self.hooks.fire("on_pipeline_end", PipelineEndEvent(total, errors, result.cost if result else CostSummary(), time.monotonic() - began))
            if logger:
                logger.end(total, errors, result.cost if result else CostSummary(), time.monotonic() - began)

    def resume(self, frame: DataFrame, prior: dict[str, DataFrame], retry: tuple | None) -> DataFrame:
        """The frame with finished steps' tables and, for each, which cells are to run again: failed ones and what depends on them."""
        rows, steps = retry or (None, None)
        for n, table in prior.items():
            c = self.col[n]
            frame = beside(frame, table.select(ROW, F.col("step").alias(c)), ROW, "left")
            self.done.append(n)
            self.types[n] = {f.name: f.dataType for f in table.schema["step"].dataType["values"].dataType}
            self.parsed[n] = self.json_fields(n)
        for n in self.p.step_names:
            if n not in prior:
                continue
            mine = F.coalesce(F.col(f"{self.col[n]}.status") == "error", F.lit(False))
            if rows is not None:
                mine = mine & F.col(ROW).isin([int(r) for r in rows])
            if steps is not None and n not in steps:
                mine = F.lit(False)
            for d in self.by[n].depends_on:
                if d in prior:
                    mine = mine | F.col(self.redo[d])
            frame = frame.withColumn(self.redo[n], mine)
        self.partial = set(prior)
        return self.work.write(frame, "resumed")

    def execute(self, frame: DataFrame, total: int, store: Checkpoints | None, fields: dict[str, list[str]], logger: Any, display_key: str | None) -> DataFrame:
        pending: list[str] = []

        def flush() -> None:
            nonlocal frame
            if not pending:
                return
            began = time.monotonic()
            frame = self.settle(self.kernel(frame, [self.by[n] for n in pending]), pending)
            for n in pending:
                self.elapsed[n] = (time.monotonic() - began) / len(pending)
            finished(list(pending))
            pending.clear()

        def finished(names: list[str]) -> None:
            self.done += [n for n in names if n not in self.done]
            self.progress.step(names, total)
            kernel = [n for n in names if not isinstance(self.by[n], ExprStep)]
            if store and kernel:
                try:
                    store.save(self.input, total, fields, {n: frame.select(ROW, F.col(self.col[n]).alias("step")) for n in kernel})
                except Exception as e:  # a run is worth more than its checkpoint
                    log.warning("the checkpoint was not saved: %s", e)
                else:
                    for n in kernel:  # the whole step's table is stored now
                        if self.stored:
                            delete(self.spark, f"{self.stored}/{quote(n, safe='')}")
            for n in names:
                self.after(frame, n, total, logger, display_key)
            if self.config.on_error == "raise":
                for n in names:
                    bad = frame.where(F.col(f"{self.col[n]}.status") == "error").orderBy(ROW).select(ROW, F.col(f"{self.col[n]}.error.*")).limit(1).collect()
                    if bad:
                        raise StepError(f"step {n!r}, row {bad[0][ROW]}: {bad[0]['type']}: {bad[0]['msg']}", n)

        for depth, level in enumerate(self.p._levels):
            for n in level:
                step = self.by[n]
                if (self.hooks.on_step_start or logger) and n not in self.partial:
                    mode = "batch" if isinstance(step, LLMStep) and step.batch else "realtime"
                    self.hooks.fire("on_step_start", StepStartEvent(n, total, depth, mode))
                if isinstance(step, ExprStep):
                    if set(step.depends_on) & set(pending):
                        flush()
                    frame = self.expression(frame, step)
                    self.elapsed[n] = 0.0
                    finished([n])
                    continue
                batch = isinstance(step, LLMStep) and step.is_batch_eligible
                use_cache = self.config.enable_caching and getattr(step, "cache", False)
                if n not in self.partial and isinstance(step.run_if if step.run_if is not None else step.skip_if, Column):
                    flush()
                    began = time.monotonic()
                    through = lambda f, s: self.through_cache(f, s, batch, use_cache) if batch or use_cache else self.settle(self.kernel(f, [s]), [s.name])  # noqa: B023, E731
                    frame = self.columnwise(frame, step, through)
                    self.elapsed[n] = time.monotonic() - began
                    finished([n])
                elif n in self.partial:
                    flush()
                    began = time.monotonic()
                    frame = self.again(frame, step)
                    self.elapsed[n] = time.monotonic() - began
                    finished([n])
                elif batch or use_cache:
                    flush()
                    began = time.monotonic()
                    frame = self.through_cache(frame, step, batch, use_cache)
                    self.elapsed[n] = time.monotonic() - began
                    finished([n])
                else:
                    pending.append(n)
        flush()
        return frame

    # -- steps

    def json_fields(self, name: str) -> list[str]:
        s = self.by[name]
        return [f for f, spec in getattr(s, "field_specs", {}).items() if spec.type == "JSON" and not spec.enum]

    def expression(self, frame: DataFrame, step: ExprStep) -> DataFrame:
        row = _Names(lambda c: F.col(f"`{c}`") if c in self.input else _missing(step.name, c))

        def find(name: str) -> Column:
            c = step_value([(d, self.col[d]) for d in step.depends_on if name in self._given(d)], name)
            return c if c is not None else _missing(step.name, name)

        prior = _Names(find)
        made = step.fn(row, prior)
        if lacking := set(step.fields) - set(made):
            raise PipelineError(f"step {step.name!r} gives no {', '.join(sorted(lacking))}")
        test = step.run_if or step.skip_if
        skip = F.lit(False)
        if test is not None:
            said = F.coalesce(test(row, prior).cast("boolean"), F.lit(False))
            skip = ~said if step.run_if is not None else said
        message = step.error(row, prior).cast("string") if step.error is not None else F.lit(None).cast("string")
        bad = message.isNotNull()
        types = {f.name: f.dataType for f in frame.select(*[made[f].alias(f) for f in step.fields]).schema}
        defaults = step.skip_defaults()
        cell = lambda f: F.when(skip, F.lit(defaults[f]).cast(types[f])).when(bad, F.lit(None).cast(types[f])).otherwise(made[f]).alias(f)
        null = lambda t: F.lit(None).cast(t)
        full = step_type(types)
        parts = [
            F.struct(*[cell(f) for f in step.fields]).alias("values"), null(full["present"].dataType).alias("present"), F.when(skip, F.lit("skipped")).when(bad, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
            F.lit(False).alias("from_cache"), F.when(~skip & bad, F.struct(F.lit("ValueError").alias("type"), message.alias("msg"))).alias("error"), *[null(full[x].dataType).alias(x) for x in ("usage", "attempts", "elapsed_ms")],
        ]
        self.types[step.name] = dict(types)
        return frame.withColumn(self.col[step.name], F.struct(*parts))

    def _given(self, name: str) -> list[str]:
        s = self.by[name]
        return [*s.fields, *([s.sources_field] if getattr(s, "cited", False) else [])]

    def _tasks(self, steps: list[Any]) -> int | None:
        """How many tasks may run the steps: for those that wait for others, no more than there may be rows in flight."""
        waits = any(isinstance(s, LLMStep) or asyncio.iscoroutinefunction(getattr(s, "fn", None)) for s in steps)
        return max(1, min(self.spark.sparkContext.defaultParallelism, self.config.max_workers)) if waits else None

    def _make(self, frame: DataFrame, steps: list[Any], carry: list[str] | None = None) -> tuple[Kernel, T.StructType]:
        schema = T.StructType([f for f in frame.schema.fields if carry is None or f.name in carry])
        for s in steps:
            kinds = s.spark_types() if hasattr(s, "spark_types") else dict.fromkeys(s.fields)
            self.types[s.name] = kinds
            self.parsed[s.name] = self.json_fields(s.name)
            schema = schema.add(self.col[s.name], step_type({f: t or T.StringType() for f, t in kinds.items()}))
        tasks = self._tasks(steps) or max(1, self.spark.sparkContext.defaultParallelism)
        workers = max(1, self.config.max_workers // tasks)
        specs = {s.name: {f: spec.as_dict() for f, spec in getattr(s, "field_specs", {}).items()} or {f: {} for f in s.fields} for s in steps}
        read = {d: self.col[d] for s in steps for d in s.depends_on}
        arrow = to_arrow_schema(schema)
        return Kernel(steps, {s.name: self.types[s.name] for s in steps}, read, self.input, ROW, self.config, specs, workers, self.capture, arrow, self.parsed, schema.names[: -len(steps)], self.stored), schema

    def kernel(self, frame: DataFrame, steps: list[Any], carry: list[str] | None = None) -> DataFrame:
        run, schema = self._make(frame, steps, carry)
        return self.dealt(frame, steps).mapInArrow(run, schema)

    def dealt(self, frame: DataFrame, steps: list[Any]) -> DataFrame:
        """The frame's rows dealt evenly to as many tasks as may run the steps.

        Merely to unite partitions gives some tasks twice the rows of others, and what is read as fewer partitions leaves tasks idle.
        """
        tasks = self._tasks(steps)
        return frame.repartition(tasks, ROW) if tasks else frame

    def columnwise(self, frame: DataFrame, step: Any, run: Callable[[DataFrame, Any], DataFrame]) -> DataFrame:
        """A step whose predicate is a Column: rows that it skips are told apart by Spark and never reach Python."""
        said = F.coalesce((step.run_if if step.run_if is not None else step.skip_if).cast("boolean"), F.lit(False))
        skip = ~said if step.run_if is not None else said
        bare, c = copy.copy(step), self.col[step.name]
        bare.run_if = bare.skip_if = None
        self.holding = True  # the frame is read again below
        done = run(frame.where(~skip), bare)
        self.holding = False
        kind = done.schema[c].dataType
        defaults = step.skip_defaults()
        as_kind = lambda f, t: F.from_json(F.lit(canonical({"v": defaults.get(f)})), T.StructType([T.StructField("v", t)]))["v"].alias(f)
        given = {
            "values": F.struct(*[as_kind(f.name, f.dataType) for f in kind["values"].dataType]), "present": F.array(*[F.lit(f) for f in step.fields]), "status": F.lit("skipped"), "from_cache": F.lit(False),
        }
        cell = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
        written = self.work.write(done.unionByName(frame.where(skip).withColumn(c, cell)), "frame")
        self.work.keep_last()
        return written

    def settle(self, frame: DataFrame, names: list[str]) -> DataFrame:
        """Write the frame, then give fields whose type wasn't declared the type that all their values have."""
        written = self.work.write(frame, "frame")
        if not self.holding:
            self.work.keep_last()
        return self.typed(written, names)

    def typed(self, frame: DataFrame, names: list[str]) -> DataFrame:
        open_fields = [(n, f) for n in names for f, t in self.types[n].items() if t is None]
        if not open_fields:
            return frame
        path = lambda n, f: F.col(self.col[n])["values"][f]
        said = frame.agg(*[F.schema_of_variant_agg(F.try_parse_json(path(n, f))).alias(f"k{i}") for i, (n, f) in enumerate(open_fields)]).first()
        out = frame
        for i, (n, f) in enumerate(open_fields):
            kind = _kind(said[f"k{i}"])
            self.types[n][f] = kind or T.StringType()
            if kind is None:
                self.parsed[n] = [*self.parsed.get(n, []), f]
            else:
                value = F.variant_get(F.try_parse_json(path(n, f)), "$", kind.simpleString())
                c = F.col(self.col[n])
                out = out.withColumn(self.col[n], c.withField(f"values.`{f}`", value))
        return out

    def again(self, frame: DataFrame, step: Any) -> DataFrame:
        """Only the cells that are to run again pass through Python; the others keep what they have."""
        c, flag = self.col[step.name], F.col(self.redo[step.name])
        test = step.run_if if step.run_if is not None else step.skip_if
        if isinstance(test, Column):  # rows that it skips keep what they have
            said = F.coalesce(test.cast("boolean"), F.lit(False))
            flag = flag & (said if step.run_if is not None else ~said)
            step = copy.copy(step)
            step.run_if = step.skip_if = None
        todo, rest = frame.where(flag).drop(c), frame.where(~flag)
        before = self.types[step.name]
        run, schema = self._make(todo, [step])
        done = todo.mapInArrow(run, schema)
        done = self.work.write(done, "again")
        done = self.typed(done, [step.name])
        target = frame.schema[c].dataType
        if done.schema[c].dataType != target:  # types as the checkpoint has them
            own = F.col(c)
            done = done.withColumn(c, F.struct(F.struct(*[own["values"][f].cast(t).alias(f) for f, t in before.items()]).alias("values"), *[own[x].alias(x) for x in target.names if x != "values"]))
        self.types[step.name] = before
        written = self.work.write(rest.unionByName(done.select(*frame.columns)), "frame")
        self.work.keep_last()
        return written

    def through_cache(self, frame: DataFrame, step: Any, batch: bool, use_cache: bool) -> DataFrame:
        """Look rows up by key, run the first row of each missing key once, and give its result to the key's other rows.

        Skipped rows and rows whose predicate fails are told apart first and take no part in the lookup. Rows with one key
        share a failure; failures are never stored.
        """
        c = self.col[step.name]
        key, gate, hit, first = "__rf_key", "__rf_gate", "__rf_hit", "__rf_first"
        given = list(step.inputs) if getattr(step, "inputs", None) is not None else self.input
        reads = [*(f"`{x}`" for x in given), *(self.col[d] for d in step.depends_on)]
        row = row_json((x, F.col(f"`{x}`")) for x in (getattr(step, "inputs", None) or self.input))
        prior = row_json((f"{i}.{d}", F.struct(F.col(f"{self.col[d]}.values"), F.col(f"{self.col[d]}.present"))) for i, d in enumerate(step.depends_on))
        static = step.static_key() if hasattr(step, "static_key") else canonical({"step": step.name})
        static = hashlib.sha256(static.encode()).hexdigest()
        named = frame.withColumn(key, cache_key(static, row, prior) if use_cache else F.concat(F.lit("row "), F.col(ROW).cast("string")))
        empty = step_type({f: T.StringType() for f in step.fields})
        if step.run_if is not None or step.skip_if is not None:
            told = named.mapInArrow(*self._gate(named, step, gate, [ROW, key]))
        else:
            told = named.select(ROW, key, F.lit(None).cast(empty).alias(gate))
        told = self.work.write(told.select(ROW, key, gate), "keys")  # from here on keys and row numbers alone are moved
        asked = told.where(F.col(gate).isNull()).select(ROW, key)

        store = CacheTable(self.spark, cache_folder(self.spark, self.config.cache_dir), self.config.cache_ttl) if use_cache else None
        none = F.lit(None).cast("struct<value:string,present:array<string>>").alias(hit)
        if store:
            known = store.live(step.name).select(F.col("key").alias(key), F.struct("value", "present").alias(hit))
            once = asked.groupBy(key).agg(F.min(ROW).alias(first))  # combined before the shuffle, so a hot key is no burden
            once = self.work.write(beside(once, known, key, "left"), "looked")
        else:
            once = asked.select(key, F.col(ROW).alias(first), none)
        bare = copy.copy(step)
        bare.run_if = bare.skip_if = None  # told already
        missing = once.where(F.col(hit).isNull()).select(F.col(first).alias(ROW), key)
        todo = beside(frame.select(ROW, *reads), missing)
        made = self.batched(todo, bare, [ROW, key]) if batch else self.kernel(todo, [bare], [ROW, key])
        made = self.work.write(made.select(key, F.col(ROW).alias(first), c), "made")
        target = made.schema[c].dataType
        if store:
            good = made.where(F.col(f"{c}.status") == "ok")
            value = F.to_json(F.col(f"{c}.values"), {"ignoreNullFields": "false"})
            store.add(step.name, good.select(F.col(key).alias("key"), value.alias("value"), F.col(f"{c}.present").alias("present")))
            self.cached.add(step.name)

        values = target["values"].dataType

        def cell(**parts: Column) -> Column:
            return F.struct(*[parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in target])

        res, stopped = F.col(c), F.col(gate)
        from_hit = cell(values=F.from_json(F.col(hit)["value"], values), present=F.col(hit)["present"], status=F.lit("ok"), from_cache=F.lit(True))
        shared = cell(values=res["values"], present=res["present"], status=res["status"], from_cache=res["status"] == "ok", error=res["error"])
        own = lambda f, t: stopped["values"][f] if isinstance(t, T.StringType) else F.variant_get(F.try_parse_json(stopped["values"][f]), "$", t.simpleString())
        skipped = F.struct(*[(own(f.name, f.dataType) if f.name in step.fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in values])
        skipped = cell(values=skipped, present=stopped["present"], status=stopped["status"], from_cache=F.lit(False), error=stopped["error"])
        found = made.select(key, first, c)
        if store:
            found = found.unionByName(once.where(F.col(hit).isNotNull()).select(key, F.lit(None).cast("long").alias(first), from_hit.alias(c)))
            cells = beside(asked, found, key).select(ROW, F.when(F.col(first).isNull() | (F.col(ROW) == F.col(first)), res).otherwise(shared).alias(c))
        else:  # each row was its own key's only one
            cells = found.select(F.col(first).alias(ROW), c)
        cells = cells.unionByName(told.where(stopped.isNotNull()).select(ROW, skipped.alias(c)))
        return self.settle(beside(frame, cells, ROW, "left").select(*[F.col(f"`{x}`") for x in frame.columns], c), [step.name])

    def _gate(self, frame: DataFrame, step: Any, name: str, carry: list[str]) -> tuple[Any, T.StructType]:
        """A job that tests the predicate alone: beside ``carry``, null for rows that are to run, else what they get."""
        schema = T.StructType([frame.schema[x] for x in carry]).add(name, step_type({f: T.StringType() for f in step.fields}))
        read = {d: self.col[d] for d in step.depends_on}
        declared = step.spark_types() if hasattr(step, "spark_types") else {}
        plain = {f: T.StringType() if isinstance(declared.get(f), T.StringType) else None for f in step.fields}
        kernel = Kernel([_Gate(step)], {step.name: plain}, read, self.input, ROW, self.config, {step.name: {}}, 1, "metadata", to_arrow_schema(schema), self.parsed, carry)
        return kernel, schema

    def batched(self, frame: DataFrame, step: LLMStep, carry: list[str]) -> DataFrame:
        """Requests to the provider's batch jobs, chunk by chunk, and replies back by row; rows without a usable reply are called one by one."""
        run, schema = self._make(frame, [step])
        config = self.config
        read = {d: self.col[d] for d in step.depends_on}
        make = _Requests(step, run, read)
        asked = self.work.write(frame.mapInArrow(make, f"{ROW} long, messages string"), "requests")
        pieces = self.packed(asked)
        client = step.resolve_client()
        loop = asyncio.new_event_loop()
        sent: list[str] = []
        parts: list[str] = []

        try:
            _, call = step.build_messages(StepContext({}, {}, {}, config))
            chunk: list[BatchRequest] = []
            number, same = None, {}

            def submit() -> None:
                if chunk:
                    sent.append(loop.run_until_complete(client.submit_batch(list(chunk))))
                    chunk.clear()
                    same.clear()

            for r in pieces.toLocalIterator():  # the provider takes requests from one place; no more than a chunk is held
                if r["chunk"] != number:
                    submit()
                    number = r["chunk"]
                for i, messages in zip(r["ids"], json.loads(zlib.decompress(r["piece"]))):
                    for m in messages:  # the same text, such as the system's half, is held once
                        m["content"] = same.setdefault(m["content"], m["content"])
                    chunk.append(BatchRequest(f"row-{i}", messages, step.model, call["temperature"], call["max_tokens"], step.response_format, step.provider_kwargs))
            submit()

            async def polled(some: list[str]) -> list[Any]:
                return await asyncio.gather(*[client.poll_batch(b, config.batch_poll_interval, config.batch_timeout) for b in some])

            held: list[tuple[int, Any]] = []
            weight = 0

            def keep() -> None:
                if held:
                    usage = [v.usage and {n: getattr(v.usage, n) for n in _USAGE} for _, v in held]
                    rows = pa.table([pa.array([i for i, _ in held], pa.int64()), pa.array([v.content for _, v in held], pa.string()), pa.array(usage, to_arrow_schema(_REPLIES).field("usage").type)], list(_REPLIES.names))
                    self.work.write(self.spark.createDataFrame(rows, _REPLIES), "replies")
                    parts.append(self.work.tables[-1])
                    held.clear()

            few = max(1, _HELD // config.batch_max_requests)
            for at in range(0, len(sent), few):  # all have been sent, so those that are asked for late are waited for together with these
                results = loop.run_until_complete(polled(sent[at : at + few]))
                while results:
                    got = results.pop(0).responses
                    while got:
                        k, v = got.popitem()
                        held.append((int(k[4:]), v))
                        weight += len(v.content)
                        if len(held) >= _HELD or weight >= _HELD_CHARS:
                            keep()
                            weight = 0
            keep()
        except BaseException:
            for b in sent:
                try:
                    loop.run_until_complete(client.cancel_batch(b))
                except Exception as e:
                    log.warning("batch %s was not cancelled: %s", b, e)
            raise
        finally:
            loop.close()
        self.batches[step.name] = sent[0] if sent else ""
        replies = self.spark.read.schema(_REPLIES).parquet(*parts) if parts else self.spark.createDataFrame([], _REPLIES)
        reply = "__rf_reply"
        with_reply = beside(frame, replies.select(ROW, F.struct("content", "usage").alias(reply)), ROW, "left")
        inner = T.StructType([with_reply.schema[x] for x in carry]).add(self.col[step.name], schema[self.col[step.name]].dataType)
        finish = Kernel([_Reply(step)], {step.name: self.types[step.name]}, read, [*self.input, reply], ROW, config, {step.name: {}}, run.workers, self.capture, to_arrow_schema(inner), self.parsed, carry)
        return self.dealt(with_reply, [step]).mapInArrow(finish, inner)

    def packed(self, asked: DataFrame) -> DataFrame:
        """Requests in the order of rows, (chunk, first, ids, piece) for some of a chunk at a time; a partition has a few MB."""
        place = "__rf_place"
        kept = self.work.write(asked.orderBy(ROW).withColumn(place, F.monotonically_increasing_id()), "ordered")
        starts, at = {}, 0
        for part, n in sorted(kept.groupBy(F.shiftright(place, 33)).count().collect()):
            starts[part] = at
            at += n
        pieces = self.work.write(kept.mapInArrow(_Pack(starts, place, self.config.batch_max_requests), "chunk long, first long, ids array<long>, piece binary"), "pieces")
        size = pieces.agg(F.sum(F.length("piece") + 8 * F.size("ids"))).first()[0] or 0
        return pieces.repartitionByRange(size // _PIECES + 1, "first").sortWithinPartitions("first")

    # -- what is told of a run

    def usage(self, frame: DataFrame, only: list[str] | None = None) -> CostSummary:
        """Tokens and rows by step, in one aggregate over the frame. A step without calls, cache use or skips has no entry."""
        aggs = []
        for i, (n, c) in enumerate(self.col.items()):
            if only is not None and n not in only or isinstance(self.by[n], ExprStep) and self.by[n].run_if is None and self.by[n].skip_if is None:
                continue
            col = F.col(c)
            told = col["usage"].isNotNull()
            aggs += [F.coalesce(F.sum(col["usage"][t]), F.lit(0)).alias(f"{i}.{t}") for t in TOKENS]
            ok = col["status"] == "ok"
            aggs += [F.count_if(told).alias(f"{i}.told"), F.count_if(col["status"] == "skipped").alias(f"{i}.skipped"), F.count_if(ok & col["from_cache"]).alias(f"{i}.hits"), F.count_if(ok & ~col["from_cache"]).alias(f"{i}.ok")]
            aggs.append(F.min_by(F.when(told, col["usage"]["model"]), F.when(told, F.col(ROW))).alias(f"{i}.model"))
        out = CostSummary()
        if not aggs:
            return out
        got = frame.agg(*aggs).first().asDict()
        for i, n in enumerate(self.col):
            if f"{i}.told" not in got:
                continue
            v = {k.split(".", 1)[1]: x for k, x in got.items() if k.startswith(f"{i}.")}
            hits, misses = (v["hits"], v["ok"]) if n in self.cached else (0, 0)
            if not (v["told"] or hits or misses or v["skipped"]):
                continue
            mode = "batch" if n in self.batches else "realtime"
            out.steps[n] = StepUsage(**{t: int(v[t]) for t in TOKENS}, rows_processed=hits + misses if n in self.cached else v["told"], rows_skipped=v["skipped"], cache_hits=hits, cache_misses=misses, model=v["model"], execution_mode=mode, batch_id=self.batches.get(n) or None)
        return out

    def after(self, frame: DataFrame, name: str, total: int, logger: Any, display_key: str | None) -> None:
        h, c = self.hooks, self.col[name]
        if logger:
            logger.step(self, frame, name, total)
        rows = frame.where(F.col(self.redo[name])) if name in self.partial and self.redo[name] in frame.columns else frame
        if h.on_row_complete or h.on_row_attempt:
            for r in rows.select(ROW, c).orderBy(ROW).toLocalIterator():
                cell = r[c].asDict(True)
                for a in cell["attempts"] or []:
                    h.fire("on_row_attempt", RowAttemptEvent(name, r[ROW], a["attempt"], a["kind"], a["status"], a["latency_ms"], a["backoff_s"], a["error"], a["body"]))
                h.fire("on_row_complete", RowCompleteEvent(name, r[ROW], cell["values"], cell["error"], bool(cell["from_cache"]), cell["status"] == "skipped", cell["usage"], cell["elapsed_ms"]))
        if h.on_step_end:
            bad = rows.where(F.col(f"{c}.status") == "error").count()
            mine = self.usage(frame, [name]).steps.get(name)
            h.fire("on_step_end", StepEndEvent(name, total, bad, mine, self.elapsed.get(name, 0.0), "batch" if name in self.batches else "realtime", self.batches.get(name) or None))


class _Gate:
    """A step's predicate without its call."""

    def __init__(self, step: Any):
        self.name, self.fields, self.depends_on, self.inputs = step.name, step.fields, step.depends_on, None
        self.step = step

    async def gate(self, ctx: StepContext) -> dict[str, Any] | None:
        import inspect

        try:
            said = (self.step.run_if or self.step.skip_if)(ctx.row, ctx.prior_results)
            if inspect.isawaitable(said):
                said = await said
        except Exception as e:
            return failure(e, self.fields)
        if bool(said) == (self.step.run_if is None):
            return {"values": self.step.skip_defaults(), "present": list(self.fields), "status": "skipped", "from_cache": False}
        return None


class _Reply(_Gate):
    """A batch reply parsed; without a usable one, the step's own call."""

    async def gate(self, ctx: StepContext) -> dict[str, Any] | None:
        from .types import LLMResponse, UsageInfo

        row = dict(ctx.row)
        reply = row.pop("__rf_reply", None)
        if reply is not None:
            try:
                u = reply["usage"]
                r = self.step.parse_response(LLMResponse(reply["content"], UsageInfo(**u) if u else None))
                return {"values": r.values, "present": list(r.values), "status": "ok", "from_cache": False, "usage": u}
            except ValueError:
                pass
        bare = _NoTest(self.step)
        return await one(bare, StepContext(row, ctx.fields, ctx.prior_results, ctx.config, ctx.row_index, ctx.capture), None)


class _NoTest:
    def __init__(self, step: Any):
        self.name, self.fields, self.depends_on, self.run = step.name, step.fields, step.depends_on, step.run


class _Requests:
    def __init__(self, step: LLMStep, kernel: Kernel, read: dict[str, str]):
        self.step, self.kernel, self.read = step, kernel, read

    def __call__(self, batches: Any) -> Any:
        for b in batches:
            rows, ids, held = self.kernel.unpack(b, self.kernel.row_columns)
            out = []
            for i, row in enumerate(rows):
                ctx = self.kernel.context(self.step, row, ids[i], {d: held[d][i] for d in self.step.depends_on})
                out.append(canonical(self.step.build_messages(ctx)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], [ROW, "messages"])


class _Pack:
    """Ordered requests as compressed pieces, none with requests of two chunks."""

    def __init__(self, starts: dict[int, int], place: str, most: int):
        self.starts, self.place, self.most = starts, place, most

    def __call__(self, batches: Any) -> Any:
        ids: list[int] = []
        texts: list[str] = []
        first = size = 0

        def piece() -> pa.RecordBatch:
            made = [[first // self.most], [first], [ids], [zlib.compress(f"[{','.join(texts)}]".encode(), 1)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], ["chunk", "first", "ids", "piece"])

        for b in batches:
            for i, text, p in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in (ROW, "messages", self.place))):
                at = self.starts[p >> 33] + (p & ((1 << 33) - 1))
                if ids and (at != first + len(ids) or at % self.most == 0 or size >= _PIECE):
                    yield piece()
                    ids, texts, size = [], [], 0
                if not ids:
                    first = at
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield piece()


def _missing(step: str, name: str) -> Column:
    raise PipelineError(f"step {step!r} reads {name!r}, which neither the input nor a direct dependency has")


def _kind(said: str | None) -> T.DataType | None:
    """The Spark type for what variant values were seen; None for what stays JSON."""
    said = (said or "VOID").upper()
    if said == "VOID":
        return T.StringType()
    if said in ("BIGINT", "BOOLEAN", "STRING"):
        return {"BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "STRING": T.StringType()}[said]
    if said.startswith(("DECIMAL", "DOUBLE", "FLOAT")):
        return T.DoubleType()
    return T.ArrayType(T.StringType()) if said == "ARRAY<STRING>" else None
