"""Lifecycle events and the callables that get them, all on the driver. What a callable raises is logged and dropped."""

from __future__ import annotations

import asyncio
import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from .config import EnrichmentConfig

log = logging.getLogger("rowforge")


@dataclass(frozen=True)
class PipelineStartEvent:
    step_names: list[str]
    num_rows: int
    config: EnrichmentConfig


@dataclass(frozen=True)
class PipelineEndEvent:
    num_rows: int
    total_errors: int
    cost: Any
    elapsed_seconds: float


@dataclass(frozen=True)
class StepStartEvent:
    step_name: str
    num_rows: int
    level: int
    execution_mode: str = "realtime"


@dataclass(frozen=True)
class StepEndEvent:
    step_name: str
    num_rows: int
    num_errors: int
    usage: Any
    elapsed_seconds: float
    execution_mode: str = "realtime"
    batch_id: str | None = None


@dataclass(frozen=True)
class RowCompleteEvent:
    step_name: str
    row_index: int
    values: dict[str, Any]
    error: Any
    from_cache: bool
    skipped: bool = False
    usage: Any = None
    elapsed_ms: float | None = None


@dataclass(frozen=True)
class RowAttemptEvent:
    step_name: str
    row_index: int
    attempt: int
    kind: str
    status: str
    latency_ms: float | None
    backoff_s: float | None
    error: Any = None
    body: Any = None


@dataclass
class EnrichmentHooks:
    """Row hooks are called from the step's table after the step, in row order, as executors can't call the driver."""

    on_pipeline_start: Callable[[PipelineStartEvent], Any] | None = None
    on_pipeline_end: Callable[[PipelineEndEvent], Any] | None = None
    on_step_start: Callable[[StepStartEvent], Any] | None = None
    on_step_end: Callable[[StepEndEvent], Any] | None = None
    on_row_complete: Callable[[RowCompleteEvent], Any] | None = None
    on_row_attempt: Callable[[RowAttemptEvent], Any] | None = None

    def fire(self, name: str, event: Any) -> None:
        fn = getattr(self, name)
        if fn is None:
            return
        try:
            said = fn(event)
            if inspect.isawaitable(said):
                asyncio.run(_wait(said))
        except Exception as e:
            log.warning("%s failed: %s", name, e)

    def merged(self, other: EnrichmentHooks | None) -> EnrichmentHooks:
        """Hooks that call these and then the other's."""
        if other is None:
            return self

        def both(name: str) -> Callable[[Any], None] | None:
            own = [h for h in (self, other) if getattr(h, name) is not None]
            return (lambda e: [h.fire(name, e) for h in own] and None) if own else None

        return EnrichmentHooks(**{f.name: both(f.name) for f in fields(self)})


async def _wait(x: Any) -> Any:
    return await x
