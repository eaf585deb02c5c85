"""Differences between two runs: rows aligned by one join, cells compared null-safely, one aggregate a side for each kind of field."""

from __future__ import annotations

import html
import logging
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_text, no_nan
from ..sources.rows import ROW, beside
from .report import format_seconds, format_tokens, number

log = logging.getLogger("rowforge")
ERR = "__rf_err"


@dataclass
class FieldChurn:
    field: str
    kind: str
    changed: int
    total: int
    freq_a: dict[str, float] | None = None
    freq_b: dict[str, float] | None = None
    mean_a: float | None = None
    mean_b: float | None = None
    std_a: float | None = None
    std_b: float | None = None
    mean_delta: float | None = None
    avg_len_tokens_a: float | None = None
    avg_len_tokens_b: float | None = None
    len_delta_tokens: float | None = None

    @property
    def changed_pct(self) -> float:
        return self.changed / self.total * 100 if self.total else 0.0


@dataclass
class CostDelta:
    prompt_tokens_a: int
    prompt_tokens_b: int
    completion_tokens_a: int
    completion_tokens_b: int
    total_tokens_a: int
    total_tokens_b: int
    cache_hit_rate_a: float
    cache_hit_rate_b: float
    elapsed_seconds_a: float
    elapsed_seconds_b: float

    def __getattr__(self, name: str) -> Any:
        if name.endswith("_delta"):
            return getattr(self, f"{name[:-6]}_b") - getattr(self, f"{name[:-6]}_a")
        raise AttributeError(name)


def unique(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).count().where("count > 1").isEmpty()


def align(a: DataFrame, b: DataFrame, key: str | None = None) -> tuple[DataFrame, str]:
    """Pairs of rows as structs ``a`` and ``b``: by ``key`` where it is unique on both sides, else by row number.

    By row number the shorter side's rows are compared; what has no partner is left out, by key too.
    """
    mode, on = "positional", ROW
    if key is not None:
        if unique(a, key) and unique(b, key):
            mode, on = "label", key
        else:
            log.warning("%r isn't unique on both sides; rows are compared by their place", key)
    x, y = (d.select(F.col(f"`{on}`").alias("__rf_on"), F.struct("*").alias(n)) for d, n in ((a, "a"), (b, "b")))
    return beside(x, y, "__rf_on").select("a", "b"), mode


def unmatched(a: DataFrame, b: DataFrame, key: str) -> tuple[int, int]:
    """Rows of each side whose key the other lacks."""
    x, y = a.select(key), b.select(key)
    return beside(x, y, key, "left_anti").count(), beside(y, x, key, "left_anti").count()


def differs(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """Whether cells differ; nulls are equal, and so are numbers and booleans of one value. Maps compare through JSON."""
    if ta != tb:
        numeric = (T.NumericType, T.BooleanType)
        if isinstance(ta, numeric) and isinstance(tb, numeric):
            exact = (T.IntegralType, T.BooleanType)
            kind = "decimal(20,0)" if isinstance(ta, exact) and isinstance(tb, exact) else "double"
            if isinstance(ta, T.DecimalType) and isinstance(tb, (*exact, T.DecimalType)) or isinstance(tb, T.DecimalType) and isinstance(ta, exact):
                whole = max(19, *(t.precision - t.scale for t in (ta, tb) if isinstance(t, T.DecimalType)))
                scale = max(t.scale for t in (ta, tb) if isinstance(t, T.DecimalType))
                kind = f"decimal({whole + scale},{scale})" if whole + scale <= 38 else "double"
            through = "int" if "decimal" in kind else kind  # a boolean has no cast to decimal of its own
            a, b = (x.cast(through).cast(kind) if isinstance(t, T.BooleanType) else x.cast(kind) for x, t in ((a, ta), (b, tb)))
        else:
            a, b = as_text(a, ta), as_text(b, tb)
    elif isinstance(ta, (T.MapType, T.VariantType)):
        a, b = as_text(a, ta), as_text(b, tb)
    return ~a.eqNullSafe(b)


def frequencies(rows: DataFrame, value: Column) -> DataFrame:
    """(value, share) of non-null values."""
    n = rows.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").count()
    return n.crossJoin(n.agg(F.sum("count").alias("total"))).select("value", (F.col("count") / F.col("total")).alias("share"))


def enum_shift(a: DataFrame, b: DataFrame, top: int | None = None) -> DataFrame:
    """(value, share_a, share_b, shift) of two frequency tables, the largest shift first, ties by value."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    j = a.select("value", F.col("share").alias("a")).join(b.select("value", F.col("share").alias("b")), "value", "full_outer")
    out = j.select("value", zero(F.col("a")).alias("share_a"), zero(F.col("b")).alias("share_b"), (zero(F.col("b")) - zero(F.col("a"))).alias("shift"))
    ranked = out.orderBy(F.desc(F.abs("shift")), "value")
    return ranked.limit(top) if top else ranked


@dataclass
class ComparisonResult:
    result_a: Any
    result_b: Any
    label_a: str
    label_b: str
    fields: list[str]
    field_specs: dict[str, dict[str, Any]]
    aligned: DataFrame
    align_mode: str

    def _type(self, side: str, f: str) -> T.DataType:
        return self.aligned.schema[side].dataType[f].dataType

    def _differs(self, f: str) -> Column:
        return differs(F.col("a")[f], F.col("b")[f], self._type("a", f), self._type("b", f))

    def changed_rows(self, field: str | None = None) -> DataFrame:
        """Rows in which a compared field differs or in which one side failed, with each field's two values."""
        if field is not None and field not in self.fields:
            raise KeyError(f"{field!r} is not compared; these are: {self.fields}")
        picked = [field] if field is not None else self.fields
        changed = F.col("a")[ERR] != F.col("b")[ERR]
        for f in picked:
            changed = changed | self._differs(f)
        cols = [F.col(s)[f].alias(f"{f}_{label}") for f in picked for s, label in (("a", self.label_a), ("b", self.label_b))]
        return self.aligned.where(changed).select(F.col("a")[ROW].alias(ROW), *cols)

    def distribution_shift(self) -> dict[str, FieldChurn]:
        """One aggregate for all counts, means and lengths, and a frequency table a side for each enum field."""
        aggs, kinds = [F.count(F.lit(1)).alias("total")], {}
        for i, f in enumerate(self.fields):
            spec = self.field_specs.get(f, {})
            kinds[f] = "enum" if spec.get("enum") else "numeric" if spec.get("type") == "Number" else "text"
            aggs.append(F.count_if(self._differs(f)).alias(f"c{i}"))
            for s in "ab":
                v = F.col(s)[f]
                if kinds[f] == "numeric":
                    aggs += [F.avg(number(v)).alias(f"m{s}{i}"), F.stddev_samp(number(v)).alias(f"s{s}{i}")]
                elif kinds[f] == "text" and spec.get("type", "String") == "String":
                    aggs.append(F.avg(F.floor(F.length(as_text(v, self._type(s, f))) / 4)).alias(f"l{s}{i}"))
        got = self.aligned.agg(*aggs).first().asDict()
        minus = lambda x, y: None if x is None or y is None else y - x
        out = {}
        for i, f in enumerate(self.fields):
            c = FieldChurn(f, kinds[f], got[f"c{i}"], got["total"])
            if kinds[f] == "enum":
                c.freq_a, c.freq_b = ({r["value"]: r["share"] for r in frequencies(self.aligned, as_text(F.col(s)[f], self._type(s, f))).collect()} for s in "ab")
            elif kinds[f] == "numeric":
                c.mean_a, c.mean_b, c.std_a, c.std_b = (got[f"{x}{s}{i}"] for x in "ms" for s in "ab")
                c.mean_delta = minus(c.mean_a, c.mean_b)
            elif f"la{i}" in got:
                c.avg_len_tokens_a, c.avg_len_tokens_b = got[f"la{i}"], got[f"lb{i}"]
                c.len_delta_tokens = minus(c.avg_len_tokens_a, c.avg_len_tokens_b)
            out[f] = c
        return out

    def cost_delta(self) -> CostDelta:
        a, b = self.result_a, self.result_b
        x, y = a.cost, b.cost
        return CostDelta(x.total_prompt_tokens, y.total_prompt_tokens, x.total_completion_tokens, y.total_completion_tokens, x.total_tokens, y.total_tokens, x.cache_hit_rate, y.cache_hit_rate, a.elapsed_seconds, b.elapsed_seconds)

    def _lines(self) -> list[tuple[str, list[str]]]:
        models = lambda c: ", ".join(sorted({s.model for s in c.steps.values() if s.model})) or "—"
        head = f"`{self.label_a}` ({models(self.result_a.cost)}) and `{self.label_b}` ({models(self.result_b.cost)})"
        churn = []
        for c in self.distribution_shift().values():
            line = f"`{c.field}`: {c.changed} of {c.total} changed ({c.changed_pct:.1f}%)"
            if c.kind == "enum":
                keys = sorted(set(c.freq_a) | set(c.freq_b))
                ranked = sorted(keys, key=lambda k: abs(c.freq_b.get(k, 0.0) - c.freq_a.get(k, 0.0)), reverse=True)
                line += "; " + ", ".join(f"{k!r} {c.freq_a.get(k, 0.0):.0%} → {c.freq_b.get(k, 0.0):.0%}" for k in ranked[:5]) + (", …" if len(ranked) > 5 else "") if ranked else ""
            elif c.mean_delta is not None:
                line += f"; mean {c.mean_delta:+.2f}"
            elif c.len_delta_tokens is not None:
                line += f"; length {c.len_delta_tokens:+.0f} tokens"
            churn.append(line)
        d = self.cost_delta()
        share = lambda x, base: f"{x / base:+.0%}" if base else "new" if x else "n/a"
        cost = [
            f"input tokens {share(d.prompt_tokens_delta, d.prompt_tokens_a)}, output tokens {share(d.completion_tokens_delta, d.completion_tokens_a)} ({format_tokens(d.total_tokens_a)} → {format_tokens(d.total_tokens_b)} in all)",
            f"cache hits {d.cache_hit_rate_a:.0%} → {d.cache_hit_rate_b:.0%}", f"time {format_seconds(d.elapsed_seconds_a)} → {format_seconds(d.elapsed_seconds_b)}",
        ]
        return [(head, []), ("Fields", churn), ("Cost", cost)]

    def summary(self) -> str:
        (head, _), *rest = self._lines()
        return "\n".join([head, *[x for title, lines in rest for x in ("", f"## {title}", *[f"- {y}" for y in lines])]])

    def report(self, output_format: str = "markdown", path: str | Path | None = None) -> str:
        if output_format == "markdown":
            out = self.summary()
        elif output_format == "html":
            import re

            code = lambda x: re.sub(r"`([^`]*)`", r"<code>\1</code>", html.escape(x))
            (head, _), *rest = self._lines()
            out = f"<!doctype html><meta charset=utf-8><title>Comparison</title><h1>{code(head)}</h1>" + "".join(f"<h2>{t}</h2><ul>{''.join(f'<li>{code(x)}</li>' for x in lines)}</ul>" for t, lines in rest)
        else:
            raise ValueError(f"output_format {output_format!r} is neither markdown nor html")
        if path is not None:
            Path(path).write_text(out)
        return out


def compare(a: Any, b: Any, *, label_a: str = "A", label_b: str = "B", key: str | None = None) -> ComparisonResult:
    """Compare two runs' output fields; ``key`` names a column of the data to pair rows by."""
    only = set(a.field_specs) ^ set(b.field_specs)
    if only:
        log.warning("only one of the runs has %s", ", ".join(sorted(only)))
    fields = [f for f in dict.fromkeys([*a.field_specs, *b.field_specs]) if f in a.data.columns and f in b.data.columns]
    specs = {f: a.field_specs.get(f) or b.field_specs.get(f) or {} for f in fields}
    sides = []
    for r in (a, b):
        bad = F.lit(False)
        for c in r.steps.values():
            bad = bad | F.coalesce(F.col(f"{c}.status") == "error", F.lit(False))
        sides.append(no_nan(r.frame.select(ROW, bad.alias(ERR), *r.columns)))
    aligned, mode = align(*sides, key)
    if mode == "positional" and a.num_rows != b.num_rows:
        log.warning("the runs have %d and %d rows; the first %d are compared", a.num_rows, b.num_rows, min(a.num_rows, b.num_rows))
    return ComparisonResult(a, b, label_a, label_b, fields, specs, aligned, mode)
