"""Reports, comparisons, plans, run logs, field tables, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from rowforge import CostSummary, EchoClient, Enricher, EnrichmentConfig, ExprStep, FieldValidationError, FunctionStep, JsonlRunLogger, LLMStep, Pipeline, StepUsage, compare, load_fields
from rowforge.functions import text as X
from rowforge.operators import report as R
from rowforge.plans.preview import extrapolate
from rowforge.sources.rows import ROW
from rowforge.sources.runlog import read_run_context, read_run_log, single_file
from rowforge.streaming.enrich import enrich_stream

OFF = EnrichmentConfig(enable_caching=False)


def context(spark, values, spec, cost=None, errors=None):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{ROW} long, f {'double' if isinstance(values[0], float) else 'string'}")
    return R.ReportContext(rows, {"f": spec}, cost or CostSummary(), errors or {})


def test_heuristics(spark):
    at = lambda fn, values, spec: fn(context(spark, values, spec))
    f = at(R.enum_collapse, ["Other"] * 73 + ["A"] * 17 + ["B"] * 10, {"enum": ["Other", "A", "B"]})
    assert f[0].evidence == {"top_value": "Other", "ratio": 0.73, "total": 100}
    assert not at(R.enum_collapse, ["A"] * 59 + ["B"] * 41, {"enum": ["A", "B"]})
    clipped = [100.0] * 41 + [50.0, 60.0, 70.0, 80.0, 90.0] * 11 + [10.0] * 4
    assert at(R.numeric_clipping, clipped, {"type": "Number"})[0].evidence["edge"] == "max"
    assert not at(R.numeric_clipping, [50.0] * 41 + [10.0, 90.0] * 10, {"type": "Number"}) and not at(R.numeric_clipping, [1.0] * 3, {"type": "Number"})
    assert at(R.length_anomaly, ["one two three four five six seven eight nine ten eleven twelve"] * 20, {"format": "80-120 words"})[0].evidence["mean"] == 12
    assert not at(R.length_anomaly, ["a b c"] * 5, {"format": "2 to 4 words"}) and not at(R.length_anomaly, ["a"] * 5, {"format": "brief"})
    assert at(R.refusal_pattern, ["I cannot determine this"] * 8 + ["fine"] * 92, {})[0].evidence["ratio"] == 0.08
    cost = CostSummary({"a": StepUsage(total_tokens=1000, rows_processed=100, cache_hits=5, cache_misses=95), "b": StepUsage(total_tokens=9000, rows_processed=100)})
    ctx = context(spark, ["x"], {}, cost, {"a": 8})
    assert [f.subject for f in R.retry_storm(ctx)] == ["a"] and [f.subject for f in R.cache_thrash(ctx)] == ["a"] and [f.subject for f in R.cost_outlier(ctx)] == ["b"]
    assert [f.code for f in R.run_heuristics(ctx, ["cache_thrash"])] == ["retry_storm", "cost_outlier"]


def pair(spark, specs, a, b):
    def run(rows):
        make = lambda row, prior: {f: row["in_" + f] for f in specs}
        return Pipeline([ExprStep("s", make, specs)]).run(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, " + ", ".join(f"in_{f} {'double' if s.get('type') == 'Number' else 'string'}" for f, s in specs.items())), OFF, row_key="k")

    return compare(run(a), run(b), label_b="B")


def test_compare(spark):
    c = pair(spark, {"cat": {"prompt": "c", "enum": ["AI", "Other"]}}, [("AI",), ("AI",), ("Other",), ("Other",), ("Other",)], [("AI",), ("AI",), ("AI",), ("Other",), ("Other",)])
    d = c.distribution_shift()["cat"]
    assert d.freq_a == {"AI": 0.4, "Other": 0.6} and d.freq_b == {"AI": 0.6, "Other": 0.4} and d.changed == 1 and d.changed_pct == 20
    assert [(r.cat_A, r.cat_B) for r in c.changed_rows("cat").collect()] == [("Other", "AI")]
    with pytest.raises(KeyError):
        c.changed_rows("zzz")
    n = pair(spark, {"score": {"prompt": "s", "type": "Number"}}, [(10.0,), (20.0,), (30.0,)], [(10.0,), (25.0,), (40.0,)]).distribution_shift()["score"]
    assert (n.mean_a, n.mean_b, n.mean_delta, n.changed) == (20, 25, 5, 2) and n.std_a == 10
    nulls = pair(spark, {"score": {"prompt": "s", "type": "Number"}}, [(None,), (float("nan"),)], [(float("nan"),), (None,)])
    assert nulls.changed_rows().count() == 0 and nulls.distribution_shift()["score"].mean_delta is None
    assert "mean +5.00" in pair(spark, {"score": {"prompt": "s", "type": "Number"}}, [(1.0,)], [(6.0,)]).summary()
    html = c.report("html")
    assert "<code>cat</code>" in html and c.align_mode == "positional"


def test_report_formats(spark, tmp_path):
    r = Pipeline([ExprStep("s", lambda row, prior: {"c": F.lit("A")}, {"c": {"prompt": "c", "enum": ["A", "B"]}})]).run(spark.range(10).withColumnRenamed("id", "k"), OFF, row_key="k")
    assert "enum_collapse" in r.report() and r.report("dict")[0]["subject"] == "c" and json.loads(r.report("json"))[0]["code"] == "enum_collapse"
    r.report("html", tmp_path / "r.html")
    assert "<code>c</code>" in (tmp_path / "r.html").read_text() and r.report("markdown", disable=["enum_collapse"]).count("Nothing stands out") == 1
    with pytest.raises(ValueError):
        r.report("pdf")


def test_plan(spark):
    est = extrapolate(CostSummary({"s": StepUsage(300, 150, 450, cache_misses=3), "t": StepUsage(100, 50, 200, cache_hits=1, cache_misses=2)}), 30)
    assert (est.steps["s"].prompt_tokens, est.steps["s"].completion_tokens, est.steps["s"].total_tokens, est.steps["t"].total_tokens) == (3000, 1500, 4500, 3000)
    p = Pipeline([LLMStep("s", {"y": "why"}, client=EchoClient(lambda row: {"y": "x"}, 100, 50), structured_outputs=False), FunctionStep("t", lambda c: {"z": 1}, ["z"], depends_on=["s"])])
    plan = p.plan([{"x": i} for i in range(30)], 3, OFF, spark=spark)
    assert plan.total_rows == 30 and plan.sample_rows == 3 and plan.estimated_cost.total_tokens == 4500 and "about 4,500 tokens" in plan.summary()
    with pytest.raises(ValueError):
        p.plan([{"x": 1}], 0, OFF, spark=spark)


def test_run_log_and_retry_segment(spark, tmp_path):
    config = EnrichmentConfig(enable_caching=False, enable_checkpointing=True, checkpoint_dir=str(tmp_path / "ck"))

    def make(broken):
        def score(c):
            if broken and c.row["employees"] == 80:
                raise ValueError("no score")
            return {"score": c.row["employees"]}

        return Pipeline(
            [FunctionStep("normalize", lambda c: {"up": c.row["company"].upper()}, {"up": "string"}), FunctionStep("score", score, {"score": "bigint"}, depends_on=["normalize"]), FunctionStep("flag", lambda c: {"hot": (c.prior_results["score"] or 0) > 60}, {"hot": "boolean"}, depends_on=["score"], skip_if=lambda r, p: r["employees"] == 40)]
        )

    rows, log = [{"company": f"company-{i:02d}", "employees": 10 * (i + 1)} for i in range(12)], str(tmp_path / "log")
    r = make(True).run(rows, config, run_log=log, spark=spark)
    rec = read_run_log(spark, log)
    counts = {(x.step, x.status): x["count"] for x in rec.where("type = 'row_complete'").groupBy("step", "status").count().collect()}
    assert counts == {("normalize", "ok"): 12, ("score", "ok"): 11, ("score", "error"): 1, ("flag", "ok"): 11, ("flag", "skipped"): 1}
    run_id, key, last = read_run_context(spark, log)
    assert run_id == r.run_id and key == "company" and last > 0
    assert rec.where("type = 'row_complete' AND row = 7 AND step = 'score'").first().key == "company-07"
    make(False).retry_failed(rows, config, run_log=log, spark=spark)
    after = read_run_log(spark, log)
    start = after.where("type = 'retry_start'").first()
    assert start.run_id == run_id and sorted((c.step, c.row) for c in start.cells) == [("flag", 7), ("score", 7)]
    assert after.where("type = 'retry_end'").first().total_errors == 0 and after.where("type = 'row_complete'").count() == 38
    lines = [json.loads(x) for x in single_file(spark, log, tmp_path / "one.jsonl").read_text().splitlines()]
    assert lines[0]["type"] == "pipeline_start" and lines[-1]["type"] == "retry_end" and [x["row"] for x in lines if x.get("step") == "normalize" and x["type"] == "row_complete"] == list(range(12))
    assert lines[0]["manifest"]["steps"][0]["name"] == "normalize" and [x["t"] for x in lines] == sorted(x["t"] for x in lines)
    (tmp_path / "log/events/zz.json").write_text("not json\n")
    assert read_run_log(spark, log).where("type IS NOT NULL").count() == after.count()


def test_fields_csv(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('Category,Field,Prompt,Type,Enum,Examples,Default\nfirm,size,"How many, about",Number,,,0\nfirm,tier,Which,,"a, b","[""x, y"", ""z""]",\npost,size,Other,,,,\n')
    f = load_fields(str(path), spark=spark)
    assert f["tier"] == {"prompt": "Which", "type": "String", "enum": ["a", "b"], "examples": ["x, y", "z"]} and f["size"]["prompt"] == "Other"
    assert load_fields(str(path), "firm", spark)["size"] == {"prompt": "How many, about", "type": "Number", "default": "0"}
    for body, category in (("A,B\n1,2\n", None), ("Category,Field,Prompt\n", None), (path.read_text(), "none")):
        path.write_text(body)
        with pytest.raises(FieldValidationError):
            load_fields(str(path), category, spark)


def test_save(spark, tmp_path):
    r = Pipeline([FunctionStep("f", lambda c: {"t": ["a", "b"]}, {"t": "array<string>"})]).run([{"x": 1, "s": 'q"é'}, {"x": 2, "s": None}], OFF, output_file=str(tmp_path / "deep/out.JSON"), spark=spark)
    assert [x["x"] for x in json.loads((tmp_path / "deep/out.JSON").read_text())] == [1, 2]
    assert sorted(x.x for x in spark.read.parquet(str(r.save(tmp_path / "o.parquet"))).collect()) == [1, 2]
    back = spark.read.option("header", True).option("escape", '"').csv(str(r.save(tmp_path / "o.csv"))).orderBy("x").collect()
    assert back[0].s == 'q"é' and json.loads(back[0].t) == ["a", "b"]
    with pytest.raises(ValueError):
        r.save(tmp_path / "o.txt")


def test_text_functions(spark):
    import re

    from rowforge.errors import redact
    from rowforge.functions.validate import is_refusal

    texts = ["", "a", "a b c  d", "One. Two! Three", "N/A", " unknown ", "Authorization: abc x", "apikey=zz sk-" + "q" * 24, "Bearer tok.en", "x" * 17, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", "t", X.words(F.col("t")).alias("w"), X.sentences(F.col("t")).alias("s"), X.tokens(F.col("t")).alias("k"), X.redact(F.col("t")).alias("r"), X.is_refusal(F.col("t")).alias("no")).collect():
        assert r.no == is_refusal(r.t)
        if r.t is not None:
            assert (r.w, r.s, r.k, r.r) == (len(r.t.split()), max(1, len(re.split(r"[.!?]+", r.t.strip()))), max(1, len(r.t) // 4), redact(r.t))
    with pytest.raises(ValueError):
        X.fill_template("{zzz}", {})


def test_streamed_rows_are_enriched_once(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    p = Pipeline([FunctionStep("f", lambda c: {"y": c.row["x"] * 2}, {"y": "bigint"})])
    config = EnrichmentConfig(cache_dir=str(tmp_path / "cache"))
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    for part in ([1, 2], [2, 3]):
        spark.createDataFrame([(x,) for x in part], "x long").write.mode("append").parquet(str(source))
        enrich_stream(spark.readStream.schema("x long").parquet(str(source)), p, config, sink, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.x, r.y) for r in spark.read.parquet(str(out)).collect()) == [(1, 2), (2, 4), (2, 4), (3, 6)]


def test_enricher_overwrites_on_request(spark):
    e: Enricher = Pipeline([FunctionStep("f", lambda c: {"x": "new"}, {"x": "string"})]).runner(OFF)
    df = spark.createDataFrame([("old",), (None,), ("",)], "x string")
    assert sorted(r.x for r in e.run(df).collect()) == ["new", "new", "old"] and {r.x for r in e.run(df, overwrite_fields=True).collect()} == {"new"}
