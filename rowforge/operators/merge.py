"""Step results as table columns: who wins where several steps give one field, and what of the input is kept."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.dag import producers


def step_value(givers: list[tuple[str, str]], field: str) -> Column | None:
    """A field's value from steps' columns, given in the order in which they are merged: the last that has the field wins, null or not."""
    out: Column | None = None
    for _, c in givers:
        own = F.col(c)["values"][field]
        if out is None:
            out = own
        else:
            out = F.when(F.col(c)["present"].isNull() | F.array_contains(F.col(c)["present"], field), own).otherwise(out)
    return out


def upsert(existing: Column, t: T.DataType, new: Column, overwrite: bool) -> Column:
    """The new value, or the existing one where it is to be kept and is neither null nor blank."""
    if overwrite:
        return new
    kept = existing.isNotNull()
    if isinstance(t, T.StringType):
        kept = kept & (existing != "")
    return F.when(kept, existing).otherwise(new)


def final_columns(frame: DataFrame, columns: list[str], steps: list[Any], order: list[str], at: dict[str, str], overwrite: bool) -> list[Column]:
    """The input's columns with the steps' fields put in, new fields after them; fields that begin with __ stay inside."""
    made = {f: step_value([(n, at[n]) for n in names], f) for f, names in producers(steps, order).items() if not f.startswith("__")}
    out = [upsert(F.col(f"`{c}`"), frame.schema[c].dataType, made[c], overwrite).alias(c) if c in made else F.col(f"`{c}`") for c in columns]
    return [*out, *[v.alias(f) for f, v in made.items() if f not in columns]]
