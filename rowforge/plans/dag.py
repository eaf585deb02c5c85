"""The step graph: checks, levels, and what must run again with a failed cell."""

from __future__ import annotations

from typing import Any

from ..errors import PipelineError


def validate(steps: list[Any]) -> None:
    names = [s.name for s in steps]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise PipelineError(f"step names are used twice: {', '.join(twice)}")
    for s in steps:
        if unknown := sorted(set(s.depends_on) - set(names)):
            raise PipelineError(f"step {s.name!r} depends on unknown steps: {', '.join(unknown)}")


def levels(steps: list[Any]) -> list[list[str]]:
    """Names by level, each step one level above its highest dependency, in alphabetical order within a level."""
    left, out, done = {s.name: set(s.depends_on) for s in steps}, [], set()
    while left:
        ready = sorted(n for n, deps in left.items() if deps <= done)
        if not ready:
            raise PipelineError(f"these steps depend on each other in a cycle: {', '.join(sorted(left))}")
        out.append(ready)
        done |= set(ready)
        for n in ready:
            del left[n]
    return out


def producers(steps: list[Any], order: list[str]) -> dict[str, list[str]]:
    """Of each field, the steps that give it, in the order in which they are merged; the last that has it wins."""
    by = {s.name: s for s in steps}
    out: dict[str, list[str]] = {}
    for n in order:
        s = by[n]
        for f in [*s.fields, *([s.sources_field] if getattr(s, "cited", False) else [])]:
            out.setdefault(f, []).append(n)
    return out


def dependents(steps: list[Any]) -> dict[str, set[str]]:
    """Of each step, all that run after it because of it."""
    out: dict[str, set[str]] = {s.name: set() for s in steps}
    for name in out:
        grown = {name}
        while True:
            more = {s.name for s in steps if grown & set(s.depends_on)} - grown
            if not more:
                break
            grown |= more
        out[name] = grown - {name}
    return out


def ancestors(steps: list[Any], name: str) -> set[str]:
    """A step and all that it depends on."""
    by, out, todo = {s.name: s for s in steps}, set(), [name]
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += by[n].depends_on
    return out
