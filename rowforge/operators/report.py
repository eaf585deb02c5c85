"""Quality findings of a run: seven heuristics, each an aggregate over the run's table. One pass serves all that look at values."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LENGTHS, as_text, has_refusal_phrase
from ..sources.rows import ROW
from ..types import CostSummary

RANK = {"error": 0, "warning": 1, "info": 2}
ENUM_SHARE, CLIP_SHARE, REFUSAL_SHARE, ERROR_SHARE, HIT_SHARE, COST_SHARE = 0.60, 0.25, 0.05, 0.05, 0.10, 0.60
SHORT, LONG, LEAST_TOKENS, LEAST_NUMBERS = 0.30, 2.00, 1000, 4
HINT = re.compile(r"(\d+)\s*(?:-|–|to)\s*(\d+)\s*(word|char|sentence|token)", re.I)


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    subject: str
    message: str
    evidence: dict[str, Any] = field(default_factory=dict)


@dataclass
class ReportContext:
    """What heuristics look at: the rows with a row number, the fields' specifications, tokens by step, and errors by step."""

    rows: DataFrame
    specs: dict[str, dict[str, Any]]
    cost: CostSummary
    errors: dict[str, int]


def percent(share: float) -> int:
    return round(share * 100)


# -- aggregates, which the queries use as well


def mode(rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """(value, count, total): the most frequent non-null value, of equals the one whose first row comes first."""
    seen = rows.select(value.alias("value"), order.alias("at")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first"))
    best = F.max_by(F.struct("value", "count"), F.struct("count", (-F.col("first")).alias("before")))
    return seen.agg(best.alias("b"), F.sum("count").alias("total")).where("b IS NOT NULL").select("b.value", "b.count", "total")


def number(c: Column) -> Column:
    """The value as a double; null where it is none, NaN included."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def clipping(rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """(value, count, total, low, high): the most frequent number beside the least and the greatest."""
    n = rows.select(number(value).alias("n"), order.alias("at")).where("n IS NOT NULL")
    seen = n.groupBy("n").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first"))
    best = F.max_by(F.struct("n", "count"), F.struct("count", (-F.col("first")).alias("before")))
    return seen.agg(best.alias("b"), F.sum("count").alias("total"), F.min("n").alias("low"), F.max("n").alias("high")).where("b IS NOT NULL").select(F.col("b.n").alias("value"), "b.count", "total", "low", "high")


def mean_length(rows: DataFrame, value: Column, unit: str) -> DataFrame:
    return rows.where(value.isNotNull() & (value != "")).agg(F.avg(LENGTHS[unit][0](value)).alias("mean"))


# -- heuristics


def enum_collapse(ctx: ReportContext) -> list[Finding]:
    out = []
    for f, spec in ctx.specs.items():
        if not spec.get("enum") or f not in ctx.rows.columns:
            continue
        r = mode(ctx.rows, as_text(F.col(f"`{f}`"), ctx.rows.schema[f].dataType), F.col(ROW)).first()
        if r and r["count"] / r["total"] >= ENUM_SHARE:
            share = r["count"] / r["total"]
            out.append(Finding("enum_collapse", "warning", f, f"`{f}` is `{r['value']}` in {percent(share)}% of rows: its values may be too few, or its prompt may not tell them apart.", {"top_value": r["value"], "ratio": round(share, 3), "total": r["total"]}))
    return out


def numeric_clipping(ctx: ReportContext) -> list[Finding]:
    out = []
    for f, spec in ctx.specs.items():
        if spec.get("type") != "Number" or f not in ctx.rows.columns:
            continue
        r = clipping(ctx.rows, F.col(f"`{f}`"), F.col(ROW)).first()
        if not r or r["total"] < LEAST_NUMBERS or r["count"] / r["total"] < CLIP_SHARE or r["value"] not in (r["low"], r["high"]):
            continue
        share, edge = r["count"] / r["total"], "max" if r["value"] == r["high"] else "min"
        shown = int(r["value"]) if float(r["value"]).is_integer() else r["value"]
        out.append(Finding("numeric_clipping", "warning", f, f"`{f}` is at its {edge} ({shown}) in {percent(share)}% of rows: it hardly scores. Ask in other words, or for its parts.", {"top_value": shown, "edge": edge, "ratio": round(share, 3), "total": r["total"]}))
    return out


def _strings(ctx: ReportContext) -> list[str]:
    return [f for f, s in ctx.specs.items() if s.get("type", "String") == "String" and f in ctx.rows.columns]


def length_anomaly(ctx: ReportContext) -> list[Finding]:
    asked = {}
    for f in _strings(ctx):
        m = HINT.search(ctx.specs[f].get("format") or "")
        if m and int(m[1]) + int(m[2]):
            asked[f] = (int(m[1]), int(m[2]), m[3].lower())
    if not asked:
        return []
    text = {f: as_text(F.col(f"`{f}`"), ctx.rows.schema[f].dataType) for f in asked}
    got = ctx.rows.agg(*[F.avg(F.when(text[f].isNotNull() & (text[f] != ""), LENGTHS[u][0](text[f]))).alias(f"m{i}") for i, (f, (_, _, u)) in enumerate(asked.items())]).first()
    out = []
    for i, (f, (low, high, unit)) in enumerate(asked.items()):
        mean = got[f"m{i}"]
        if mean is None or SHORT <= mean / ((low + high) / 2) <= LONG:
            continue
        label = LENGTHS[unit][1]
        how = "cut short" if mean < (low + high) / 2 else "too wordy"
        out.append(Finding("length_anomaly", "warning", f, f"`{f}` has {mean:.0f} {label} on average where {low} to {high} were asked for: values are {how}.", {"mean": round(mean, 1), "hint_lo": low, "hint_hi": high, "unit": label}))
    return out


def refusal_pattern(ctx: ReportContext) -> list[Finding]:
    fields = _strings(ctx)
    if not fields:
        return []
    text = {f: as_text(F.col(f"`{f}`"), ctx.rows.schema[f].dataType) for f in fields}
    got = ctx.rows.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(text.values())], *[F.count_if(has_refusal_phrase(c)).alias(f"h{i}") for i, c in enumerate(text.values())]).first()
    out = []
    for i, f in enumerate(fields):
        hits, total = got[f"h{i}"], got[f"n{i}"]
        if hits and hits / total >= REFUSAL_SHARE:
            out.append(Finding("refusal_pattern", "warning", f, f"`{f}` declines to answer in {percent(hits / total)}% of rows: the model seems to lack what it needs.", {"hits": hits, "total": total, "ratio": round(hits / total, 3)}))
    return out


def retry_storm(ctx: ReportContext) -> list[Finding]:
    out = []
    for step, u in ctx.cost.steps.items():
        total, bad = u.rows_processed + u.rows_skipped, ctx.errors.get(step, 0)
        if ctx.errors and total and bad / total >= ERROR_SHARE:
            out.append(Finding("retry_storm", "warning", step, f"{percent(bad / total)}% of `{step}`'s rows failed after all retries: its fields may ask too much, or calls are limited.", {"errors": bad, "total": total, "ratio": round(bad / total, 3)}))
    return out


def cache_thrash(ctx: ReportContext) -> list[Finding]:
    return [
        Finding("cache_thrash", "info", step, f"`{step}` found {percent(u.cache_hit_rate)}% of its rows in the cache: inputs probably change in ways that don't matter.", {"hits": u.cache_hits, "misses": u.cache_misses, "ratio": round(u.cache_hit_rate, 3)})
        for step, u in ctx.cost.steps.items()
        if u.cache_hits and u.cache_hit_rate < HIT_SHARE
    ]


def cost_outlier(ctx: ReportContext) -> list[Finding]:
    total = ctx.cost.total_tokens
    if len(ctx.cost.steps) < 2 or total < LEAST_TOKENS:
        return []
    return [
        Finding("cost_outlier", "info", step, f"`{step}` took {percent(u.total_tokens / total)}% of the tokens ({u.total_tokens:,} of {total:,}).", {"step_tokens": u.total_tokens, "total_tokens": total, "ratio": round(u.total_tokens / total, 3)})
        for step, u in ctx.cost.steps.items()
        if u.total_tokens / total >= COST_SHARE
    ]


#: By code; add to it to have more heuristics run.
BUILTIN_HEURISTICS: dict[str, Callable[[ReportContext], list[Finding]]] = {
    f.__name__: f for f in (enum_collapse, numeric_clipping, length_anomaly, retry_storm, cache_thrash, refusal_pattern, cost_outlier)
}


def run_heuristics(ctx: ReportContext, disable: list[str] | None = None) -> list[Finding]:
    found = [x for code, fn in BUILTIN_HEURISTICS.items() if code not in (disable or ()) for x in fn(ctx)]
    return sorted(found, key=lambda f: (RANK.get(f.severity, 99), f.code, f.subject))


def findings_frame(spark: Any, found: list[Finding]) -> DataFrame:
    rows = [(f.code, f.severity, f.subject, f.message, json.dumps(f.evidence, sort_keys=True)) for f in found]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in ("code", "severity", "subject", "message", "evidence")]))


def format_tokens(n: int) -> str:
    return f"{n / 1e6:.1f}M" if n >= 1e6 else f"{n / 1e3:.1f}K" if n >= 1e3 else str(n)


def format_seconds(s: float) -> str:
    return f"{s:.1f}s" if s < 60 else f"{int(s // 60)}m {int(s % 60)}s" if s < 3600 else f"{int(s // 3600)}h {int(s % 3600 // 60)}m"


def report(result: Any, output_format: str = "text", path: str | Path | None = None, disable: list[str] | None = None) -> Any:
    """Findings as text, Markdown, HTML, dicts or a DataFrame; written to ``path`` too, where one is given."""
    errors = {r["step"]: r["count"] for r in result.errors.groupBy("step").count().collect()}
    produced = [f for f in result.data.columns if f in result.field_specs]
    rows = result.frame.select(ROW, *result.columns).select(ROW, *[F.col(f"`{c}`") for c in produced])
    found = run_heuristics(ReportContext(rows, result.field_specs, result.cost, errors), disable)
    if output_format == "dataframe":
        return findings_frame(result.frame.sparkSession, found)
    if output_format in ("dict", "json"):
        out: Any = [asdict(f) for f in found]
        if output_format == "json":
            out = json.dumps(out, indent=2)
    elif output_format in ("text", "markdown", "html"):
        head = f"{result.num_rows:,} rows, {sum(errors.values()):,} failed cells, {format_tokens(result.cost.total_tokens)} tokens, {format_seconds(result.elapsed_seconds)}"
        kinds = [(r["error_type"], r["count"]) for r in result.errors_by("error_type").collect()] if errors else []
        out = _render(found, head, kinds, output_format)
    else:
        raise ValueError(f"output_format {output_format!r} is none of text, markdown, html, dict, json, dataframe")
    if path is not None:
        Path(path).write_text(out if isinstance(out, str) else json.dumps(out, indent=2))
    return out


def _render(found: list[Finding], head: str, kinds: list[tuple[str, int]], form: str) -> str:
    lines = [f"[{f.severity}] {f.code} {f.subject}: {f.message}" for f in found] or ["Nothing stands out."]
    errors = [f"{k}: {n}" for k, n in kinds]
    if form == "text":
        return "\n".join([head, *lines, *errors])
    if form == "markdown":
        return "\n".join(["# Run report", "", head, "", "## Findings", "", *[f"- {x}" for x in lines], *(["", "## Errors", "", *[f"- {x}" for x in errors]] if errors else [])])
    item = lambda x: "<li>" + re.sub(r"`([^`]*)`", r"<code>\1</code>", html.escape(x)) + "</li>"
    body = f"<h1>Run report</h1><p>{html.escape(head)}</p><h2>Findings</h2><ul>{''.join(map(item, lines))}</ul>"
    return "<!doctype html><meta charset=utf-8><title>Run report</title>" + body + (f"<h2>Errors</h2><ul>{''.join(map(item, errors))}</ul>" if errors else "")
