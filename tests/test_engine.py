"""What a run does on its way: order of output, narrow cache lookups, bounds on calls, stored results, progress."""

import asyncio
import csv
import io
import json
import time
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge import EnrichmentConfig, FunctionStep, LLMStep, Pipeline
from rowforge.errors import PipelineError
from rowforge.functions.logs import Progress
from rowforge.operators import kernel
from rowforge.operators.compare import differs
from rowforge.operators.steps import StepContext
from rowforge.providers.base import EchoClient
from rowforge.sources.cache import CacheTable
from rowforge.sources.checkpoint import Checkpoints
from rowforge.sources.workspace import Workspace, stored

OFF = EnrichmentConfig(enable_caching=False)


@pytest.mark.parametrize("suffix", [".csv", ".json", ".parquet"])
def test_files_are_in_input_order(spark, tmp_path, suffix):
    rows = [{"x": (i * 37) % 101} for i in range(101)]
    p = Pipeline([FunctionStep("f", lambda c: {"y": c.row["x"] + 1}, {"y": "bigint"})])
    r = p.run(spark.createDataFrame(rows).repartition(3), EnrichmentConfig(cache_dir=str(tmp_path / "cache")))
    want = [x.x for x in r.frame.orderBy("_row_id").collect()]
    at = r.save(tmp_path / f"out{suffix}")
    if suffix == ".csv":
        got = [int(x["x"]) for x in csv.DictReader(open(at))]
    else:
        got = [x["x"] for x in json.load(open(at))] if suffix == ".json" else [x.x for x in spark.read.parquet(f"file://{at}").collect()]
    assert got == want and got != sorted(got)


def test_cached_steps_move_keys_not_columns(spark, tmp_path):
    """Many rows of one key and many skipped ones; what a step doesn't read isn't sent to it."""
    rows = spark.range(600).select(F.col("id").cast("int").alias("i"), F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), F.lit("long text").alias("t"))

    def fn(c):
        assert set(c.row) == {"k"}
        return {"y": c.row["k"] * 2}

    step = lambda: FunctionStep("f", fn, {"y": "bigint"}, inputs=["k"], run_if=lambda row, prior: row["i"] % 100 != 7)
    config = EnrichmentConfig(cache_dir=str(tmp_path))
    for hits in (600 - 6 - 200 + 1, 594):
        r = Pipeline([step()]).run(rows, config)
        got = {x.i: x.y for x in r.data.collect()}
        assert got == {i: None if i % 100 == 7 else 0 if i < 400 else 2 * i for i in range(600)}
        u = r.cost.steps["f"]
        assert u.rows_skipped == 6 and u.cache_hits + u.cache_misses == 594
        hits_now = u.cache_hits
    assert hits_now == 594


def test_cache_names_and_rewrites(spark, tmp_path):
    one = CacheTable(spark, str(tmp_path), 0, now=1.0)
    entry = lambda v: spark.createDataFrame([("k", v, ["y"])], "key string, value string, present array<string>")
    one.add("a/b", entry("1"))
    one.add("a_b", entry("2"))
    assert one.live("a/b").first().value == "1" and sorted(one.steps()) == ["a/b", "a_b"]
    CacheTable(spark, str(tmp_path), 0, now=2.0).add("a/b", entry("3"))
    assert one.compact("a/b") == 1 and one.live("a/b").first().value == "3" and one.raw("a/b").count() == 1


def test_manifests_are_replaced_whole(spark, tmp_path):
    c = Checkpoints(spark, str(tmp_path), "id")
    table = spark.createDataFrame([(0, ("E", "m" * 900)), (1, None)], "_row_id long, error struct<type:string,msg:string>").select("_row_id", F.struct("error").alias("step"))
    c.save(["x"], 2, {"s": ["f"]}, {"s": table})
    first = c._manifests()
    c.save(["x"], 2, {"s": ["f"], "t": ["g"]}, {"t": table})
    assert len(first) == len(c._manifests()) == 1 and first != c._manifests()
    Path(c.at, "manifest-000000099.json").write_text('{"cut')  # as a crash would leave it
    assert set(c.load(["x"], 2, {"s": ["f"], "t": ["g"]})) == {"s", "t"}
    cells = {r["_row_id"]: r.step.error for r in c.load(["x"], 2, {"s": ["f"]})["s"].collect()}
    assert len(cells[0].msg) == 500 and cells[1] is None


@pytest.mark.parametrize("named,want", [("file:///shared/", "file:///shared/rowforge"), (None, "/x/rowforge")])
def test_folders(named, want):
    class Session:
        conf = {"spark.checkpoint.dir": named}

    assert stored(Session, "/given", "NO_SUCH", "x") == "/given" and stored(Session, "", "NO_SUCH", "x").endswith(want)


def test_calls_in_flight_are_bounded(spark, tmp_path):
    """Two sibling steps, more cores than workers: what is in flight is told by files that calls make and remove."""
    seen = str(tmp_path)

    def make(name):
        async def fn(c):
            own = Path(seen, f"now-{name}-{c.row['i']}")
            own.touch()
            Path(seen, f"peak-{len(list(Path(seen).glob('now-*')))}").touch()
            await asyncio.sleep(0.02)
            own.unlink()
            return {name: c.row["i"]}

        return FunctionStep(name, fn, {name: "bigint"})

    config = EnrichmentConfig(enable_caching=False, max_workers=3)
    r = Pipeline([make("a"), make("b")]).run(spark.range(40).selectExpr("id AS i").repartition(8), config)
    assert {(x.i, x.a, x.b) for x in r.data.collect()} == {(i, i, i) for i in range(40)}
    assert 1 <= max(int(p.name.split("-")[1]) for p in tmp_path.glob("peak-*")) <= 3


def test_siblings_run_together():
    order = []

    def make(name, after=()):
        async def fn(c):
            order.append(("begin", name))
            await asyncio.sleep(0.01)
            order.append(("end", name))
            return {name: 1}

        return FunctionStep(name, fn, {name: "bigint"}, depends_on=list(after))

    steps = [make("a"), make("b"), make("c", ["a", "b"])]
    import pyarrow as pa

    kinds = {s.name: {s.name: T.LongType()} for s in steps}
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType([T.StructField("_row_id", T.LongType()), *(T.StructField(s.name, kernel.step_type(kinds[s.name])) for s in steps)]))
    k = kernel.Kernel(steps, kinds, {}, [], "_row_id", OFF, {s.name: {} for s in steps}, 4, "metadata", schema, {})
    out = list(k(iter([pa.RecordBatch.from_arrays([pa.array([0])], ["_row_id"])])))
    assert order[:2] == [("begin", "a"), ("begin", "b")] and order[4:] == [("begin", "c"), ("end", "c")]
    assert out[0].column(3)[0].as_py()["values"] == {"c": 1}


def test_a_task_that_runs_again_keeps_its_results(tmp_path):
    """Stored results are found by row and input; other inputs and failures are asked for again."""
    p = kernel.Partial(f"file://{tmp_path}", "s/1", 2)
    ctx = lambda i, x: StepContext({"x": x}, {}, {}, OFF, i, "metadata")
    for i in range(5):
        p.add(ctx(i, i), {"values": {"y": i}, "status": "error" if i == 1 else "ok"})
    assert len(list(tmp_path.rglob("*.json"))) == 2  # four good ones
    again = kernel.Partial(f"file://{tmp_path}", "s/1", 2)
    assert again.find(ctx(3, 3))["values"] == {"y": 3} and again.find(ctx(3, 4)) is None and again.find(ctx(1, 1)) is None


def test_stored_results_of_a_model_step(spark, tmp_path):
    config = EnrichmentConfig(enable_caching=False, enable_checkpointing=True, checkpoint_dir=str(tmp_path), checkpoint_interval=2)
    step = LLMStep("m", {"v": "a value"}, client=EchoClient(lambda row: {"v": "x"}))
    r = Pipeline([step]).run(spark.range(6).selectExpr("id AS i"), config)
    assert [x.v for x in r.data.collect()] == ["x"] * 6 and not list(tmp_path.rglob("part-*.json"))  # the step's table has replaced them


def test_column_predicates(spark, tmp_path):
    """Rows that a Column skips never reach Python, whether cached or not."""
    rows = spark.range(20).selectExpr("id AS i", "CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS x")

    def fn(c):
        assert c.row["i"] % 2 == 1
        return {"y": c.row["i"], "z": "made"}

    for config in (OFF, EnrichmentConfig(cache_dir=str(tmp_path))):
        for how in ({"run_if": F.col("i") % 2 == 1}, {"skip_if": F.col("i") % 2 == 0}):
            first = FunctionStep("f", fn, {"y": "bigint", "z": "string"}, **how)
            then = FunctionStep("g", lambda c: {"w": c.prior_results["y"]}, {"w": "bigint"}, depends_on=["f"])
            r = Pipeline([first, then]).run(rows, config)
            assert {(x.i, x.y, x.z, x.w) for x in r.data.collect()} == {(i, i, "made", i) if i % 2 else (i, None, None, None) for i in range(20)}
            assert not r.has_errors and r.cost.steps["f"].rows_skipped == 10
    nulls = Pipeline([FunctionStep("f", lambda c: {"y": 1}, {"y": "bigint"}, run_if=F.col("x") > 10)]).run(rows, OFF)
    assert nulls.data.where("y = 1").count() == 8  # a null predicate is false


def test_run_refuses_an_event_loop(spark):
    p = Pipeline([FunctionStep("f", lambda c: {"y": 1}, {"y": "bigint"})])

    async def inside():
        with pytest.raises(PipelineError, match="run_async"):
            p.run([{"x": 1}], OFF, spark=spark)
        return await p.run_async([{"x": 1}], OFF, spark=spark)

    assert asyncio.run(inside()).data.first().y == 1


def test_progress(spark):
    class Terminal(io.StringIO):
        def isatty(self):
            return True

    out = Terminal()
    with Progress(spark, True, 2, out, every=0.01) as p:
        p.step(["a"], 1200)
        time.sleep(0.05)
    assert "steps 1 of 2, last a: 1,200 rows" in out.getvalue()
    quiet = io.StringIO()
    with Progress(spark, True, 2, quiet) as p:
        p.step(["a"], 1)
    assert quiet.getvalue() == ""


def test_mixed_numbers_compare_exactly(spark):
    big = 2**53
    df = spark.createDataFrame([(big, Decimal(big + 1), 1, True, 1.0), (big, Decimal(big), 2, True, 2.0)], "a bigint, b decimal(20,0), c int, d boolean, e double")
    kind = {f.name: f.dataType for f in df.schema}
    pairs = [("a", "b"), ("a", "c"), ("c", "d"), ("c", "e")]
    got = df.select(*[differs(F.col(x), F.col(y), kind[x], kind[y]).alias(x + y) for x, y in pairs]).collect()
    assert [tuple(r) for r in got] == [(True, True, False, False), (False, True, True, False)]


def test_tables_of_rows_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Step tables are small files of equal cells, but not small in the driver's memory."""
    plans, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, *a, **kw: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df, *a, **kw))[1])
    config = EnrichmentConfig(enable_caching=False, enable_checkpointing=True, checkpoint_dir=str(tmp_path))

    def steps(bad):
        def a(c):
            if c.row["i"] == bad:
                raise ValueError("no")
            return {"a": c.row["i"]}

        return Pipeline([FunctionStep("a", a, {"a": "bigint"}), FunctionStep("b", lambda c: {"b": c.prior_results.get("a")}, {"b": "bigint"}, depends_on=["a"])])

    rows = spark.range(50).withColumnRenamed("id", "i")
    steps(7).run(rows, config, row_key="i", data_identifier="x")
    r = steps(None).retry_failed(rows, config, row_key="i", data_identifier="x")
    assert {(x.i, x.a, x.b) for x in r.data.collect()} == {(i, i, i) for i in range(50)}
    cached = EnrichmentConfig(cache_dir=str(tmp_path / "cache"))
    for _ in range(2):
        assert steps(None).run(rows, cached, row_key="i").data.where("a = i AND b = i").count() == 50
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_model_steps_share_rows_evenly(spark):
    """Whatever the input's partitions; the prompt's half that all rows share is made once a task."""
    from pyspark import TaskContext

    from rowforge.operators import steps

    half = steps.system_half

    def counted(*a):
        made.append(1)
        return half(*a)

    made = []
    s = LLMStep("s", {"task": {"prompt": "p", "type": "Number"}}, client=EchoClient(lambda row: {"task": TaskContext.get().partitionId()}), structured_outputs=True, inputs=["i"])
    for parts in (1, 7):
        r = Pipeline([s]).run(spark.range(4000).withColumnRenamed("id", "i").coalesce(1).repartition(parts), EnrichmentConfig(enable_caching=False, max_workers=4), row_key="i")
        sizes = [x["count"] for x in r.data.groupBy("task").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1.2 * min(sizes)
    messages = [s.build_messages(StepContext({"i": i}, {}, {}))[0] for i in range(3)]
    steps.system_half = counted
    try:
        t = LLMStep("t", ["x"], client=EchoClient(lambda row: {}))
        again = [t.build_messages(StepContext({"i": i}, {}, {}))[0] for i in range(3)]
        assert len(made) == 1 and again[0][0] == again[2][0] and messages[0][1] != messages[1][1]
        t.system_prompt = "other"
        assert t.build_messages(StepContext({"i": 1}, {}, {}))[0][0]["content"].startswith("other")
    finally:
        steps.system_half = half
