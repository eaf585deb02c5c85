"""The body of a kernel job: rows of an Arrow batch through one or more Python steps, a struct column for each step.

Nothing that a row does fails the task: an exception becomes the row's error. A predicate is tested before its call.
"""

from __future__ import annotations

import asyncio
import hashlib
import inspect
import json
import math
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import types as T

from ..config import EnrichmentConfig
from ..errors import redact
from ..functions.validate import canonical
from .steps import StepContext

ERROR = T.StructType([T.StructField("type", T.StringType()), T.StructField("msg", T.StringType())])
_TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_write_tokens", "cache_read_tokens")
USAGE = T.StructType([*[T.StructField(n, T.LongType()) for n in _TOKENS], T.StructField("model", T.StringType())])
ATTEMPT = T.StructType(
    [T.StructField("attempt", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("status", T.StringType()), T.StructField("latency_ms", T.DoubleType()), T.StructField("backoff_s", T.DoubleType()), T.StructField("error", ERROR), T.StructField("body", T.StringType())]
)
_PLAIN = frozenset((str, int, bool, type(None)))
QUICK_S = 0.0005  # a plain function faster than that gains nothing from threads


def step_type(values: dict[str, T.DataType]) -> T.StructType:
    """A step's column: its values and how they came about."""
    own = T.StructType([T.StructField(f, t) for f, t in values.items()])
    return T.StructType(
        [
            T.StructField("values", own), T.StructField("present", T.ArrayType(T.StringType())), T.StructField("status", T.StringType()), T.StructField("from_cache", T.BooleanType()), T.StructField("error", ERROR),
            T.StructField("usage", USAGE), T.StructField("attempts", T.ArrayType(ATTEMPT)), T.StructField("elapsed_ms", T.DoubleType()),
        ]
    )


def tidy(value: Any) -> Any:
    """NaN and the infinities as null, at any depth."""
    if type(value) in _PLAIN:
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: tidy(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [tidy(v) for v in value]
    if value is not None and type(value).__name__ in ("NaTType", "NAType"):
        return None
    return value.item() if hasattr(value, "item") and type(value).__module__ == "numpy" else value


def as_type(value: Any, t: T.DataType | None) -> Any:
    """A value for a column; without a type, its JSON."""
    value = tidy(value)
    if value is None:
        return None
    if t is None:
        return canonical(value)
    if isinstance(t, T.StringType):
        return value if isinstance(value, str) else canonical(value)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
        return int(value)
    if isinstance(t, T.BooleanType):
        return bool(value)
    return value


def failure(e: BaseException, fields: list[str]) -> dict[str, Any]:
    return {"values": dict.fromkeys(fields), "present": list(fields), "status": "error", "from_cache": False, "error": {"type": type(e).__name__, "msg": redact(str(e))}, "attempts": getattr(e, "attempts", None)}


def tested(step: Any) -> bool:
    return getattr(step, "run_if", None) is not None or getattr(step, "skip_if", None) is not None


async def one(step: Any, ctx: StepContext, pool: ThreadPoolExecutor | None) -> dict[str, Any]:
    """A row through a step."""
    since = time.monotonic()
    if hasattr(step, "gate"):
        return await step.gate(ctx)
    try:
        test = step.run_if or step.skip_if if hasattr(step, "run_if") else None
        if test is not None:
            said = test(getattr(ctx, "whole", ctx.row), ctx.prior_results)
            if inspect.isawaitable(said):
                said = await said
            if bool(said) == (step.run_if is None):
                return {"values": step.skip_defaults(), "present": list(step.fields), "status": "skipped", "from_cache": False}
        fn = getattr(step, "fn", None)
        if pool is not None and fn is not None and not inspect.iscoroutinefunction(fn):
            raw = await asyncio.get_running_loop().run_in_executor(pool, fn, ctx)
            if inspect.isawaitable(raw):
                raw = await raw
            values, usage, attempts = {k: v for k, v in raw.items() if k in step.fields}, None, None
        else:
            r = await step.run(ctx)
            allowed = {*step.fields, *([step.sources_field] if getattr(step, "cited", False) else [])}
            values, usage, attempts = {k: v for k, v in r.values.items() if k in allowed}, r.usage, r.metadata.get("attempts")
        return {"values": values, "present": list(values), "status": "ok", "from_cache": False, "usage": usage and {**{n: getattr(usage, n) for n in _TOKENS}, "model": usage.model}, "attempts": attempts, "elapsed_ms": (time.monotonic() - since) * 1000}
    except Exception as e:
        return failure(e, step.fields) | {"elapsed_ms": (time.monotonic() - since) * 1000}


def prior_of(depends_on: list[str], held: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """What the direct dependencies gave, in their order, the last one winning; a field not given isn't there."""
    out: dict[str, Any] = {}
    for d in depends_on:
        values, present = held[d]["values"] or {}, held[d]["present"]
        out |= {k: v for k, v in values.items() if present is None or k in present}
    return out


class Partial:
    """Results that a task has stored of a step, by row, so that the task, if it runs again, needn't ask for them again.

    Only good results are stored, ``every`` rows a file, and each counts only for the input that it was made of.
    """

    def __init__(self, folder: str, step: str, every: int):
        self.system, at = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.at, self.every, self.new, self.known = f"{at}/{quote(step, safe='')}/part-{part:06d}", every, [], {}
        for f in self.system.get_file_info(fs.FileSelector(self.at, allow_not_found=True)):
            if f.path.endswith(".json"):
                with self.system.open_input_stream(f.path) as lines:
                    self.known |= {r["row"]: r for r in map(json.loads, lines.read().splitlines())}

    @staticmethod
    def of(ctx: StepContext) -> str:
        return hashlib.sha256(canonical([ctx.row, ctx.prior_results]).encode()).hexdigest()

    def find(self, ctx: StepContext) -> dict[str, Any] | None:
        r = self.known.get(ctx.row_index)
        return r["result"] if r and r["input"] == self.of(ctx) else None

    def add(self, ctx: StepContext, result: dict[str, Any]) -> None:
        if result["status"] == "ok":
            self.new.append(canonical({"row": ctx.row_index, "input": self.of(ctx), "result": tidy(result)}))
            if len(self.new) >= self.every:
                self.flush()

    def flush(self) -> None:
        if self.new:
            self.system.create_dir(self.at, recursive=True)
            name = f"{self.at}/{uuid.uuid4().hex}"
            with self.system.open_output_stream(name) as out:
                out.write("\n".join(self.new).encode())
            self.system.move(name, name + ".json")
            self.new = []


class Kernel:
    """Runs steps, in an order that keeps dependencies, over batches whose columns are a row number, the row's and earlier steps'.

    Steps that don't depend on each other run together, with ``workers`` rows in flight between them. ``carry`` names the columns that
    come out beside the steps', all if None; ``partial`` is the folder of what tasks have stored.
    """

    def __init__(
        self, steps: list[Any], types: dict[str, dict[str, T.DataType | None]], columns: dict[str, str], row_columns: list[str], row_id: str, config: EnrichmentConfig, specs: dict[str, dict], workers: int,
        capture: str, schema: pa.Schema, parsed: dict[str, list[str]], carry: list[str] | None = None, partial: str | None = None,
    ):
        self.carry, self.partial = carry, partial
        self.steps, self.types, self.columns, self.row_columns, self.row_id = steps, types, columns, row_columns, row_id
        self.config, self.specs, self.workers, self.capture, self.schema, self.parsed = config, specs, workers, capture, schema, parsed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loop = asyncio.new_event_loop()
        pool = ThreadPoolExecutor(self.workers) if self.workers > 1 else None
        pools: dict[str, Any] = {s.name: None for s in self.steps}  # a step gets the pool once it has shown to be slow
        every = self.config.checkpoint_interval
        self.stored = {s.name: Partial(self.partial, s.name, every) for s in self.steps if getattr(s, "model", None)} if self.partial and every else {}
        try:
            for b in batches:
                if b.num_rows:
                    yield self.batch(b, loop, pool, pools)
        finally:
            for stored in self.stored.values():
                stored.flush()
            if pool is not None:
                pool.shutdown()
            loop.close()

    def unpack(self, b: pa.RecordBatch, columns: list[str]) -> tuple[list[dict], list[int], dict[str, list]]:
        """Rows as dicts, their numbers, and what earlier steps gave them."""
        names = b.schema.names
        columns = [c for c in columns if c in names]
        values = [b.column(names.index(c)) for c in columns]
        values = [v.to_pylist() if pa.types.is_integer(v.type) or pa.types.is_string(v.type) else list(map(tidy, v.to_pylist())) for v in values]
        rows = [dict(zip(columns, v)) for v in zip(*values)] if columns else [{} for _ in range(b.num_rows)]
        held = {n: b.column(names.index(c)).to_pylist() for n, c in self.columns.items() if c in names}
        for n, fields in self.parsed.items():
            for cell in held.get(n, ()) if fields else ():
                for f in fields:
                    if isinstance(cell["values"].get(f), str):
                        cell["values"][f] = json.loads(cell["values"][f])
        return rows, b.column(names.index(self.row_id)).to_pylist(), held

    def context(self, step: Any, row: dict, row_id: int, held: dict[str, dict]) -> StepContext:
        own = getattr(step, "inputs", None)
        ctx = StepContext(row if own is None else {k: row[k] for k in own}, self.specs[step.name], prior_of(step.depends_on, held), self.config, row_id, self.capture)
        if tested(step):
            ctx.__dict__["whole"] = row  # predicates see the row, whatever the step reads
        return ctx

    def batch(self, b: pa.RecordBatch, loop: asyncio.AbstractEventLoop, pool: ThreadPoolExecutor | None, pools: dict[str, Any]) -> pa.RecordBatch:
        wanted = set().union(*[set(s.inputs) if getattr(s, "inputs", None) is not None and not tested(s) else set(self.row_columns) for s in self.steps])
        rows, ids, held = self.unpack(b, [c for c in self.row_columns if c in wanted])
        made: list[pa.Array] = []
        kept = b.schema.names if self.carry is None else self.carry
        waves: list[list[Any]] = []
        for step in self.steps:
            if not waves or {s.name for s in waves[-1]} & set(step.depends_on):
                waves.append([])
            waves[-1].append(step)
        for wave in waves:
            work = [(s, [self.context(s, row, ids[i], {d: held[d][i] for d in s.depends_on}) for i, row in enumerate(rows)]) for s in wave]
            held |= dict(zip((s.name for s in wave), loop.run_until_complete(self.together(work, pool, pools))))
            for s in wave:
                made.append(pa.array(self.cells(held[s.name], self.types[s.name]), self.schema.field(len(kept) + len(made)).type))
        return pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *made], schema=self.schema)

    def cells(self, results: list[dict | None], types: dict[str, T.DataType | None]) -> list[dict | None]:
        """Results as a column's values; one that doesn't fit its declared type becomes an error, for later steps too."""
        out: list[dict | None] = []
        for r in results:
            if r is None:  # a gate that lets the row pass
                out.append(None)
                continue
            try:
                v = {f: as_type(r["values"].get(f), t) for f, t in types.items()}
            except (TypeError, ValueError) as e:
                r |= failure(e, list(types)) | {"elapsed_ms": r.get("elapsed_ms")}
                v = dict.fromkeys(types)
            out.append(r | {"values": v})
        return out

    async def together(self, work: list[tuple[Any, list[StepContext]]], pool: ThreadPoolExecutor | None, pools: dict[str, Any]) -> list[list[dict[str, Any]]]:
        free = asyncio.Semaphore(self.workers)
        return await asyncio.gather(*[self.all(step, ctxs, pool, pools, free) for step, ctxs in work])

    async def all(self, step: Any, ctxs: list[StepContext], pool: ThreadPoolExecutor | None, pools: dict[str, Any], free: asyncio.Semaphore) -> list[dict[str, Any]]:
        results: list[Any] = [None] * len(ctxs)
        at, stored = 0, self.stored.get(step.name)
        if pools[step.name] is None and type(step).__name__ == "FunctionStep" and not inspect.iscoroutinefunction(step.fn):
            began = time.monotonic()
            while at < len(ctxs):  # plain functions one after another, for as long as they are quick
                results[at] = await one(step, ctxs[at], None)
                at += 1
                if pool is not None and at % 16 == 0 and (time.monotonic() - began) / at > QUICK_S:
                    pools[step.name] = pool
                    break
        it = iter(range(at, len(ctxs)))

        async def worker() -> None:
            for i in it:
                results[i] = stored.find(ctxs[i]) if stored else None
                if results[i] is None:
                    async with free:
                        results[i] = await one(step, ctxs[i], pools[step.name])
                    if stored:
                        stored.add(ctxs[i], results[i])

        if at < len(ctxs):
            await asyncio.gather(*[worker() for _ in range(min(self.workers, len(ctxs) - at))])
        return results
