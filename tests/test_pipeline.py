"""Pipelines: the graph, routing, predicates, merging, errors, cache, checkpoints, hooks."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowforge import EnrichmentConfig, EnrichmentHooks, ExprStep, FunctionStep, Pipeline, PipelineError, StepError
from rowforge.plans import dag
from rowforge.sources.cache import CacheTable
from rowforge.sources.checkpoint import list_checkpoints

OFF = EnrichmentConfig(enable_caching=False)


def step(name, deps=(), fields=None, **kw):
    return FunctionStep(name, lambda c: {f: 1 for f in fields or [name]}, fields or [name], depends_on=list(deps), **kw)


def test_graph_is_checked():
    with pytest.raises(PipelineError, match="twice"):
        Pipeline([step("a"), step("a")])
    with pytest.raises(PipelineError, match="unknown"):
        Pipeline([step("a", ["b"])])
    with pytest.raises(PipelineError, match="cycle"):
        Pipeline([step("a", ["b"]), step("b", ["a"])])
    p = Pipeline([step("d", ["b", "c"]), step("c", ["a"]), step("b", ["a"]), step("a")])
    assert p.execution_levels == [["a"], ["b", "c"], ["d"]] and p.step_names == ["a", "b", "c", "d"]
    assert dag.dependents(p._steps)["a"] == {"b", "c", "d"} and dag.ancestors(p._steps, "b") == {"a", "b"}
    with pytest.raises(KeyError):
        p.get_step("x")
    with pytest.raises(PipelineError):
        step("a", run_if=lambda r, p: True, skip_if=lambda r, p: True)


def test_lists_pandas_and_types(spark):
    def fn(c):
        return {"n": c.row["x"], "s": str(c.row["x"]), "l": ["a"], "o": {"k": [1]}, "m": 1 if c.row["x"] else 2.5, "b": c.row["x"] is None, "drop": 1}

    p = Pipeline([FunctionStep("f", fn, ["n", "s", "l", "o", "m", "b"])])
    for data in ([{"x": 2}, {"x": None}], pd.DataFrame({"x": [2, float("nan")]})):
        out = p.run(data, OFF, spark=spark).data
        kinds = dict(out.dtypes)
        assert kinds["l"] == "array<string>" and kinds["o"] == "string" and kinds["m"] == "double" and kinds["b"] == "boolean" and "drop" not in kinds
        rows = [r.asDict() for r in out.collect()]
        assert sorted(r["n"] is None for r in rows) == [False, True] and rows[0]["o"] == '{"k":[1]}'
    t = datetime.datetime(2024, 1, 2)
    assert Pipeline([FunctionStep("f", lambda c: {"y": c.row["t"].year}, ["y"])]).run([{"t": t}], OFF, spark=spark).data.first().y == 2024
    with pytest.raises(ValueError):
        p.run(spark.createDataFrame([(1, 2)], "x int, X int"), OFF)


def test_a_failed_row_goes_on_with_nulls(spark):
    def a(c):
        if c.row["i"] == 1:
            raise ValueError("key sk-abcdefghijklmnopqrstuvwx leaks")
        return {"a": 10}

    seen = FunctionStep("b", lambda c: {"b": sorted(c.prior_results.items())[0][1] is None}, ["b"], depends_on=["a"])
    r = Pipeline([FunctionStep("a", a, ["a"]), seen]).run([{"i": i} for i in range(3)], OFF, spark=spark)
    assert {x.i: (x.a, x.b) for x in r.data.collect()} == {0: (10, False), 1: (None, True), 2: (10, False)}
    e = r.errors.collect()
    assert [(x._row_id, x.step, x.error_type) for x in e] == [(1, "a", "ValueError")] and "REDACTED" in e[0].error
    assert r.has_errors and r.success_rate == pytest.approx(2 / 3) and "errors in a: 1" in r.summary()
    with pytest.raises(StepError, match="row 1"):
        Pipeline([FunctionStep("a", a, ["a"])]).run([{"i": i} for i in range(3)], EnrichmentConfig(enable_caching=False, on_error="raise"), spark=spark)


def test_predicates_async_and_their_errors(spark):
    async def fn(c):
        return {"y": c.row["i"] * 2}

    async def even(row, prior):
        return row["i"] % 2 == 0

    def bad(row, prior):
        return 1 / row["i"] > 0.4

    rows = [{"i": i} for i in range(4)]
    assert {r.i: r.y for r in Pipeline([FunctionStep("f", fn, ["y"], run_if=even)]).run(rows, OFF, spark=spark).data.collect()} == {0: 0, 1: None, 2: 4, 3: None}
    r = Pipeline([FunctionStep("f", fn, ["y"], skip_if=bad)]).run(rows, OFF, spark=spark)
    assert {x.i: x.y for x in r.data.collect()} == {0: None, 1: None, 2: None, 3: 6}
    assert [x.error_type for x in r.errors.collect()] == ["ZeroDivisionError"]


def test_calls_are_made_once(spark, tmp_path):
    """However often results are read, and only for rows that are to run."""
    log = tmp_path / "calls"
    log.mkdir()

    def fn(c):
        (log / f"{c.row['i']}-{datetime.datetime.now().timestamp()}").touch()
        return {"y": 1}

    r = Pipeline([FunctionStep("f", fn, ["y"], run_if=lambda row, prior: row["i"] < 5)]).run([{"i": i} for i in range(20)], OFF, spark=spark)
    r.data.collect(), r.data.count(), r.errors.count(), r.summary()
    assert sorted(p.name.split("-")[0] for p in log.iterdir()) == ["0", "1", "2", "3", "4"]


def test_expr_and_kernel_agree(spark):
    rows = [{"i": i, "s": None if i % 3 == 0 else f"v{i}"} for i in range(50)]
    k = FunctionStep("k", lambda c: {"y": (c.row["s"] or "").upper()}, ["y"], run_if=lambda r, p: r["i"] % 2)
    e = ExprStep("k", lambda row, prior: {"y": F.upper(F.coalesce(row["s"], F.lit("")))}, ["y"], run_if=lambda row, prior: row["i"] % 2 == 1)
    a, b = ({r.i: r.y for r in Pipeline([s]).run(rows, OFF, spark=spark).data.collect()} for s in (k, e))
    assert a == b
    with pytest.raises(PipelineError, match="neither"):
        Pipeline([ExprStep("k", lambda row, prior: {"y": prior["nope"]}, ["y"])]).run(rows, OFF, spark=spark)


def test_cache_counts_versions_and_expiry(spark, tmp_path):
    rows = [{"x": i % 3} for i in range(9)]
    make = lambda v=None: Pipeline([FunctionStep("f", lambda c: {"y": c.row["x"], "o": {"a": 1}}, ["y", "o"], cache_version=v, skip_if=lambda r, p: r["x"] == 2)])
    config = EnrichmentConfig(cache_dir=str(tmp_path))
    counts = lambda r: (r.cost.steps["f"].cache_hits, r.cost.steps["f"].cache_misses, r.cost.steps["f"].rows_skipped)
    assert counts(make().run(rows, config, spark=spark)) == (4, 2, 3)
    again = make().run(rows, config, spark=spark)
    assert counts(again) == (6, 0, 3) and {(r.x, r.y, r.o) for r in again.data.collect()} == {(0, 0, '{"a":1}'), (1, 1, '{"a":1}'), (2, None, None)}
    assert counts(make("v2").run(rows, config, spark=spark)) == (4, 2, 3)
    assert CacheTable(spark, str(tmp_path), 0, now=4e9).live("f").count() == 0
    assert CacheTable(spark, str(tmp_path), 0, now=4e9).compact("f") == 4
    assert counts(make().run(rows, config, spark=spark)) == (4, 2, 3)
    assert make().clear_cache("f", str(tmp_path), spark) == 2 and make().clear_cache(None, str(tmp_path), spark) == 0


def test_failures_are_not_cached(spark, tmp_path):
    config = EnrichmentConfig(cache_dir=str(tmp_path))

    def fn(c):
        raise ValueError

    r = Pipeline([FunctionStep("f", fn, ["y"])]).run([{"x": 1}, {"x": 1}], config, spark=spark)
    assert r.errors.count() == 2
    assert Pipeline([FunctionStep("f", lambda c: {"y": 1}, ["y"])]).run([{"x": 1}], config, spark=spark).cost.steps["f"].cache_misses == 1


def test_a_rerun_resumes_and_heals(spark, tmp_path):
    config = EnrichmentConfig(enable_caching=False, enable_checkpointing=True, checkpoint_dir=str(tmp_path))
    rows = [{"i": i} for i in range(6)]

    def make(broken):
        def a(c):
            if broken and c.row["i"] == 4:
                raise ValueError("no")
            return {"a": 0 if broken else 1}

        return Pipeline([FunctionStep("a", a, {"a": "bigint"}), FunctionStep("b", lambda c: {"b": c.prior_results["a"]}, {"b": "bigint"}, depends_on=["a"]), FunctionStep("c", lambda c: {"c": 0 if broken else 1}, {"c": "bigint"})])

    assert make(True).run(rows, config, spark=spark).errors.count() == 1 and len(list_checkpoints(spark, str(tmp_path))) == 1
    with pytest.raises(PipelineError):
        make(False).retry_failed(rows, config, steps=["zzz"], spark=spark)
    r = make(False).run(rows, config, spark=spark)  # a plain run takes the failed cell and its dependents up again, nothing else
    assert {x.i: (x.a, x.b, x.c) for x in r.data.collect()} == {i: ((1, 1, 0) if i == 4 else (0, 0, 0)) for i in range(6)}
    assert list_checkpoints(spark, str(tmp_path)) == []
    with pytest.raises(PipelineError, match="no checkpoint"):
        make(False).retry_failed(rows, config, spark=spark)
    with pytest.raises(PipelineError, match="enable_checkpointing"):
        make(False).retry_failed(rows, OFF, spark=spark)


def test_hooks(spark):
    got = []
    hooks = EnrichmentHooks(on_pipeline_start=lambda e: got.append(("start", e.num_rows)), on_step_start=lambda e: got.append(("step", e.step_name)), on_row_complete=lambda e: got.append((e.row_index, e.values, e.skipped)), on_step_end=lambda e: 1 / 0, on_pipeline_end=lambda e: got.append(("end", e.total_errors)))
    Pipeline([FunctionStep("f", lambda c: {"y": c.row["x"]}, {"y": "bigint"}, run_if=lambda r, p: r["x"])]).run([{"x": 0}, {"x": 5}], OFF, hooks=hooks, spark=spark)
    assert got == [("start", 2), ("step", "f"), (0, {"y": None}, True), (1, {"y": 5}, False), ("end", 0)]


def test_config():
    for bad in ({"temperature": 3}, {"max_tokens": 0}, {"max_workers": 0}, {"max_retries": -1}, {"cache_ttl": -1}, {"on_error": "x"}, {"batch_timeout": 0}):
        with pytest.raises(ValueError):
            EnrichmentConfig(**bad)
    assert EnrichmentConfig.for_production().enable_checkpointing and EnrichmentConfig.for_development().max_workers == 5
    assert not EnrichmentConfig.for_server().enable_progress_bar and EnrichmentConfig.for_batch().max_retries == 5


def test_empty_input(spark):
    r = Pipeline([FunctionStep("f", lambda c: {"y": 1}, {"y": "bigint"})]).run(spark.createDataFrame([], "x int"), OFF)
    assert r.data.columns == ["x", "y"] and r.data.count() == 0 and r.success_rate == 1
