"""Logging of the library, coloured or as JSON lines."""

from __future__ import annotations

import json
import logging
import sys
import threading
from typing import Any

from ..errors import redact

_COLOURS = {"DEBUG": 36, "INFO": 32, "WARNING": 33, "ERROR": 31, "CRITICAL": 35}


class _Text(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        text = redact(super().format(record))
        return f"\x1b[{_COLOURS.get(record.levelname, 0)}m{text}\x1b[0m" if sys.stderr.isatty() else text


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": redact(record.getMessage())})


def setup_logging(level: str = "INFO", json_format: bool = False) -> logging.Logger:
    log = logging.getLogger("rowforge")
    handler = logging.StreamHandler()
    handler.setFormatter(_Json() if json_format else _Text("%(asctime)s %(levelname)s %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(level.upper())
    log.propagate = False
    return log


class Progress:
    """A line on a terminal about a run: steps done, and tasks done of those that Spark runs now. Silent where stderr is no terminal."""

    def __init__(self, spark: Any, wanted: bool, steps: int, out: Any = None, every: float = 0.5):
        self.spark, self.steps, self.out, self.every = spark, steps, out or sys.stderr, every
        self.on = wanted and bool(getattr(self.out, "isatty", bool)())
        self.done, self.names, self.over = 0, "", threading.Event()

    def line(self) -> str:
        status = self.spark.sparkContext.statusTracker()
        stages = [i for i in map(status.getStageInfo, status.getActiveStageIds()) if i]
        tasks = f", tasks {sum(i.numCompletedTasks for i in stages)} of {sum(i.numTasks for i in stages)}" if stages else ""
        return f"steps {self.done} of {self.steps}{self.names}{tasks}"

    def step(self, names: list[str], rows: int) -> None:
        self.done, self.names = self.done + len(names), f", last {names[-1]}: {rows:,} rows"
        if self.on:
            self.out.write(f"\r\x1b[K{self.line()}")
            self.out.flush()

    def __enter__(self) -> Progress:
        def tell() -> None:
            while not self.over.wait(self.every):
                self.out.write(f"\r\x1b[K{self.line()}")
                self.out.flush()

        if self.on:
            threading.Thread(target=tell, daemon=True).start()
        return self

    def __exit__(self, *_: Any) -> None:
        self.over.set()
        if self.on:
            self.out.write("\n")
