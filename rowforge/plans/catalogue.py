"""Queries of the driver contract with the SQL that each must match. Each runs an operator over its whole table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EnrichmentConfig
from ..functions import text as X
from ..functions.prompt import user_half
from ..operators import compare as C
from ..operators import report as R
from ..operators.steps import ExprStep, FunctionStep, LLMStep
from ..pipeline import Pipeline, PipelineResult
from ..providers import EchoClient
from ..session import table
from ..sources.cache import CacheTable
from ..sources.checkpoint import content_digest
from ..sources.fields import field_table
from ..sources.rows import ROW
from ..sources.runlog import JsonlRunLogger, display_keys, default_display_key, read_run_log
from ..sources.workspace import shared_dir
from ..streaming.enrich import live_counts, stream_run_log
from ..types import CostSummary, LLMResponse, StepUsage, UsageInfo
from .preview import head

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLAIN = {"enable_caching": False}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rowforge-{name}-{uuid.uuid4().hex[:12]}"


def keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(ROW, F.col(key))


# -- steps and routing

STEP_MAP = """SELECT c_custkey, upper(c_name) AS name_upper, CASE WHEN c_custkey = 7 THEN NULL ELSE c_acctbal / 10 END AS score,
CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_custkey = 7 THEN FALSE ELSE c_acctbal / 10 > 6 END AS flagged FROM customer"""


def _score(ctx: Any) -> dict:
    if ctx.row["c_custkey"] == 7:
        raise ValueError("no score for 7")
    return {"score": ctx.row["c_acctbal"] / 10}


def step_map() -> Pipeline:
    return Pipeline(
        [
            FunctionStep("normalize", lambda c: {"name_upper": c.row["c_name"].upper()}, {"name_upper": "string"}, inputs=["c_name"]),
            FunctionStep("score", _score, {"score": "double"}, depends_on=["normalize"], inputs=["c_custkey", "c_acctbal"]),
            FunctionStep("flag", lambda c: {"flagged": (c.prior_results["score"] or 0) > 6}, {"flagged": "boolean"}, depends_on=["score"], run_if=lambda row, prior: row["c_mktsegment"] != "FURNITURE", inputs=["c_mktsegment"]),
        ]
    )


@query(STEP_MAP)
def fn_step_map(spark, sf):
    r = step_map().run(table(spark, sf, "customer"), EnrichmentConfig(**PLAIN), row_key="c_custkey")
    return r.data.select("c_custkey", "name_upper", "score", "flagged")


def expr_map() -> Pipeline:
    return Pipeline(
        [
            ExprStep("normalize", lambda row, prior: {"name_upper": F.upper(row["c_name"])}, ["name_upper"]),
            ExprStep("score", lambda row, prior: {"score": row["c_acctbal"] / 10}, ["score"], depends_on=["normalize"], error=lambda row, prior: F.when(row["c_custkey"] == 7, F.lit("no score for 7"))),
            ExprStep("flag", lambda row, prior: {"flagged": F.coalesce(prior["score"], F.lit(0.0)) > 6}, ["flagged"], depends_on=["score"], run_if=lambda row, prior: row["c_mktsegment"] != "FURNITURE"),
        ]
    )


@query(STEP_MAP)
def expr_step_map(spark, sf):
    return expr_map().run(table(spark, sf, "customer"), EnrichmentConfig(**PLAIN), row_key="c_custkey").data.select("c_custkey", "name_upper", "score", "flagged")


@query("SELECT o_orderkey, floor(o_totalprice)::BIGINT AS base, (floor(o_totalprice)::BIGINT % 7) AS lo, (floor(o_totalprice)::BIGINT // 7) AS hi, ((floor(o_totalprice)::BIGINT // 7) * 7 + floor(o_totalprice)::BIGINT % 7) AS back FROM orders")
def diamond_dag(spark, sf):
    p = Pipeline(
        [
            FunctionStep("d", lambda c: {"back": c.prior_results["hi"] * 7 + c.prior_results["lo"]}, {"back": "bigint"}, depends_on=["b", "c"], inputs=[]),
            FunctionStep("b", lambda c: {"lo": c.prior_results["base"] % 7}, {"lo": "bigint"}, depends_on=["a"], inputs=[]),
            FunctionStep("c", lambda c: {"hi": c.prior_results["base"] // 7}, {"hi": "bigint"}, depends_on=["a"], inputs=[]),
            FunctionStep("a", lambda c: {"base": int(c.row["o_totalprice"])}, {"base": "bigint"}, inputs=["o_totalprice"]),
        ]
    )
    return p.run(table(spark, sf, "orders"), EnrichmentConfig(**PLAIN), row_key="o_orderkey").data.select("o_orderkey", "base", "lo", "hi", "back")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'none' END AS standing, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 END AS twice FROM customer")
def run_if_defaults(spark, sf):
    s = ExprStep("s", lambda row, prior: {"standing": F.lit("credit"), "twice": row["c_acctbal"] * 2}, {"standing": {"prompt": "standing", "default": "none"}, "twice": {"prompt": "twice the balance", "type": "Number"}}, run_if=lambda row, prior: row["c_acctbal"] > 0)
    return Pipeline([s]).run(table(spark, sf, "customer"), row_key="c_custkey").data.select("c_custkey", "standing", "twice")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE length(c_name) END AS n FROM customer")
def skip_if_defaults(spark, sf):
    s = FunctionStep("s", lambda c: {"n": len(c.row["c_name"])}, {"n": "bigint"}, skip_if=lambda row, prior: row["c_mktsegment"] == "BUILDING", inputs=["c_name", "c_mktsegment"])
    return Pipeline([s]).run(table(spark, sf, "customer"), EnrichmentConfig(**PLAIN), row_key="c_custkey").data.select("c_custkey", "n")


@query("SELECT p_partkey, 'p_size_class' AS seen FROM part")
def prior_direct_only(spark, sf):
    p = Pipeline(
        [
            FunctionStep("one", lambda c: {"p_band": c.row["p_size"] // 10}, {"p_band": "bigint"}, inputs=["p_size"]),
            FunctionStep("two", lambda c: {"p_size_class": "big" if c.prior_results["p_band"] > 2 else "small"}, {"p_size_class": "string"}, depends_on=["one"], inputs=[]),
            FunctionStep("three", lambda c: {"seen": ",".join(sorted(c.prior_results))}, {"seen": "string"}, depends_on=["two"], inputs=[]),
        ]
    )
    return p.run(table(spark, sf, "part"), EnrichmentConfig(**PLAIN), row_key="p_partkey").data.select("p_partkey", "seen")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal, round(s_acctbal * 3, 2) AS shown FROM supplier")
def internal_fields_pruned(spark, sf):
    p = Pipeline([ExprStep("inner", lambda row, prior: {"__t": row["s_acctbal"] * 3}, ["__t"]), ExprStep("outer", lambda row, prior: {"shown": F.round(prior["__t"], 2)}, ["shown"], depends_on=["inner"])])
    return p.run(table(spark, sf, "supplier"), row_key="s_suppkey").data


def _merge(spark, sf, overwrite: bool) -> DataFrame:
    five = F.col("c_custkey") % 5
    rows = table(spark, sf, "customer").select("c_custkey", F.when(five == 0, F.lit(None)).when(five == 1, F.lit("")).otherwise(F.col("c_mktsegment")).alias("f"))
    s = ExprStep("s", lambda row, prior: {"f": F.concat(F.lit("new-"), row["c_custkey"])}, ["f"])
    return Pipeline([s]).run(rows, EnrichmentConfig(overwrite_fields=overwrite), row_key="c_custkey").data


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'new-' || c_custkey ELSE c_mktsegment END AS f FROM customer")
def merge_keep_existing(spark, sf):
    return _merge(spark, sf, False)


@query("SELECT c_custkey, 'new-' || c_custkey AS f FROM customer")
def merge_overwrite(spark, sf):
    return _merge(spark, sf, True)


@query("SELECT count(*) FILTER (c_custkey % 5 = 1) AS blank, count(*) FILTER (c_custkey % 5 = 0) AS missing, count(*) FILTER (c_custkey % 5 > 1) AS kept, count(*) AS total FROM customer")
def merge_blank_filled(spark, sf):
    """How many fields that were blank, missing or there have the new value or the old one, over all rows."""
    five, new = F.col("c_custkey") % 5, F.col("f") == F.concat(F.lit("new-"), F.col("c_custkey"))
    kinds = {"blank": (five == 1) & new, "missing": (five == 0) & new, "kept": (five > 1) & ~new & (F.col("f") != "")}
    return _merge(spark, sf, False).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()], F.count(F.lit(1)).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS f FROM orders")
def merge_presence(spark, sf):
    """Of two steps that give a field, the later wins where it gives it; where it fails, its null is what a row gets, here counted as 2."""
    p = Pipeline([FunctionStep("a", lambda c: {"f": 1}, {"f": "bigint"}, inputs=[]), FunctionStep("b", lambda c: {} if c.row["o_orderkey"] % 2 == 0 and c.row["o_orderkey"] % 11 else {"f": 2}, {"f": "bigint"}, inputs=["o_orderkey"])])
    return p.run(table(spark, sf, "orders"), EnrichmentConfig(**PLAIN), row_key="o_orderkey").data.select("o_orderkey", "f")


# -- errors


def _failing(spark, sf) -> PipelineResult:
    def a(c):
        if c.row["o_orderkey"] % 10 == 3:
            raise KeyError("no a")
        return {"a": c.row["o_totalprice"]}

    def b(c):
        return {"b": c.prior_results["a"] * 2}

    p = Pipeline([FunctionStep("a", a, {"a": "double"}, inputs=["o_orderkey", "o_totalprice"]), FunctionStep("b", b, {"b": "double"}, depends_on=["a"], inputs=[])])
    return p.run(table(spark, sf, "orders"), EnrichmentConfig(**PLAIN), row_key="o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice * 2 END AS b FROM orders")
def error_rows_nulled(spark, sf):
    return _failing(spark, sf).data.select("o_orderkey", "a", "b")


@query("SELECT o_orderkey AS row_id, s.step, s.error_type FROM orders, (VALUES ('a', 'KeyError'), ('b', 'TypeError')) s(step, error_type) WHERE o_orderkey % 10 = 3")
def errors_table(spark, sf):
    return _failing(spark, sf).errors.select(F.col(ROW).alias("row_id"), "step", "error_type")


@query("SELECT step, count(*) AS count FROM orders, (VALUES ('a'), ('b')) s(step) WHERE o_orderkey % 10 = 3 GROUP BY step")
def errors_by_step(spark, sf):
    return _failing(spark, sf).errors_by("step")


@query("SELECT 1 - 2.0::DOUBLE * count(*) FILTER (o_orderkey % 10 = 3) / count(*) AS success_rate, 1 - count(*) FILTER (o_orderkey % 10 = 3)::DOUBLE / count(*) AS row_success_rate FROM orders")
def success_rates(spark, sf):
    r = _failing(spark, sf)
    return spark.createDataFrame([(r.success_rate, r.row_success_rate)], "success_rate double, row_success_rate double")


# -- values

REFUSED = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' N/A ' WHEN 3 THEN 'Unable to Determine' WHEN 4 THEN 'unknown' ELSE c_mktsegment END AS v FROM customer"


def _refused(spark, sf) -> DataFrame:
    six, c = F.col("c_custkey") % 6, F.col("c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", F.when(six == 0, F.lit(None)).when(six == 1, "").when(six == 2, " N/A ").when(six == 3, "Unable to Determine").when(six == 4, "unknown").otherwise(c).alias("v"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 6 < 5 THEN 'none' ELSE v END AS v FROM ({REFUSED})")
def apply_defaults_refusal(spark, sf):
    return _refused(spark, sf).select("c_custkey", X.apply_default(F.col("v"), "none").alias("v"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN 'none' ELSE v END AS v FROM ({REFUSED})")
def apply_defaults_enum_exempt(spark, sf):
    return _refused(spark, sf).select("c_custkey", X.apply_default(F.col("v"), "none", ["Unknown", "Known"]).alias("v"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k, (props->>'$.k')::BIGINT % 2 = 0 AS even, CASE WHEN (props->>'$.k')::BIGINT > 50 THEN 'high' ELSE 'low' END AS band, [event_type, (props->>'$.k')] AS tags FROM events")
def parse_validate_types(spark, sf):
    def reply(row):
        k = json.loads(row["props"])["k"]
        return "```json\n" + json.dumps({"k": str(k), "even": "yes" if k % 2 == 0 else 0, "band": "high" if k > 50 else "low", "tags": [row["event_type"], str(k)]}) + "\n```"

    fields = {"k": {"prompt": "k", "type": "Number"}, "even": {"prompt": "even?", "type": "Boolean"}, "band": {"prompt": "band", "enum": ["high", "low"]}, "tags": {"prompt": "tags", "type": "List[String]"}}
    s = LLMStep("parse", fields, client=EchoClient(reply), structured_outputs=True, inputs=["props", "event_type"])
    return Pipeline([s]).run(table(spark, sf, "events"), EnrichmentConfig(**PLAIN), row_key="event_id").data.select("event_id", "k", "even", "band", "tags")


@query(
    """SELECT n_nationkey, '<row_data>' || chr(10) || '{"n_nationkey": ' || n_nationkey || ', "n_name": "' || n_name || '", "n_regionkey": ' || n_regionkey || '}' || chr(10) || '</row_data>' || chr(10) || chr(10)
|| 'Fill in the fields for this row and answer with one JSON object.' || chr(10) || chr(10) || '# Reminder' || chr(10) || 'Only the JSON object, with the keys: a, b.' AS prompt FROM nation"""
)
def prompt_user_half(spark, sf):
    s = FunctionStep("s", lambda c: {"prompt": user_half(["a", "b"], c.row, None)}, {"prompt": "string"})
    return Pipeline([s]).run(table(spark, sf, "nation"), EnrichmentConfig(**PLAIN), row_key="n_nationkey").data.select("n_nationkey", "prompt")


@query(
    r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' key sk-a1a1a1a1a1a1a1a1a1a1a1a1 end' WHEN 1 THEN ' header Bearer abc.def-123 end' WHEN 2 THEN ' api_key=xyz123 end' ELSE ' plain ' || source END AS t FROM documents)
    SELECT doc_id, """
    + X.redact_sql("t")
    + " AS t FROM t"
)
def redact_secrets(spark, sf):
    """Whole texts, which hold secrets of their own, with one more secret in three of four."""
    d, four = table(spark, sf, "documents"), F.col("doc_id") % 4
    secret = F.when(four == 0, " key sk-" + "a1" * 12 + " end").when(four == 1, " header Bearer abc.def-123 end").when(four == 2, " api_key=xyz123 end").otherwise(F.concat(F.lit(" plain "), F.col("source")))
    return d.select("doc_id", X.redact(F.concat("text", secret)).alias("t"))


@query("""SELECT c_custkey, sha256('step' || '|' || '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS key FROM customer""")
def cache_key(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.cache_key("step", X.row_json([("c_mktsegment", F.col("c_mktsegment")), ("c_custkey", F.col("c_custkey"))])).alias("key"))


@query("SELECT c_custkey, c_name AS key FROM customer")
def display_key(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", display_keys(c, default_display_key(c)).alias("key"))


@query("SELECT s_suppkey, 'who supplies ' || s_name || ' in ' || s_nationkey || '?' AS q FROM supplier")
def fill_template(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", X.fill_template("who supplies {s_name} in {s_nationkey}?", {c: F.col(c) for c in s.columns}).alias("q"))


# -- cache


def _priority() -> Pipeline:
    return Pipeline([FunctionStep("rank", lambda c: {"rank": int(c.row["o_orderpriority"][0])}, {"rank": "bigint"}, inputs=["o_orderpriority", "o_orderstatus"])])


@query("SELECT count(*) - count(DISTINCT o_orderpriority || o_orderstatus) AS hits, count(DISTINCT o_orderpriority || o_orderstatus) AS misses, count(*) AS rows FROM orders")
def cache_dedupe_counts(spark, sf):
    r = _priority().run(table(spark, sf, "orders"), EnrichmentConfig(cache_dir=folder(spark, "cache")), row_key="o_orderkey")
    u = r.cost.steps["rank"]
    return spark.createDataFrame([(u.cache_hits, u.cache_misses, u.rows_processed)], "hits long, misses long, rows long")


@query(
    """SELECT o_orderkey, left(o_orderpriority, 1)::BIGINT AS rank, o_orderstatus = 'F' OR row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) > 1 AS from_cache FROM orders"""
)
def cache_hit_miss_split(spark, sf):
    config, orders = EnrichmentConfig(cache_dir=folder(spark, "cache")), table(spark, sf, "orders")
    _priority().run(orders.where("o_orderstatus = 'F'"), config, row_key="o_orderkey")
    r = _priority().run(orders, config, row_key="o_orderkey")
    return r.frame.select("o_orderkey", F.col(r.steps["rank"])["values"]["rank"].alias("rank"), F.col(r.steps["rank"])["from_cache"].alias("from_cache"))


@query("SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'kept' END AS value FROM orders WHERE o_orderstatus <> 'F'")
def cache_ttl_filter(spark, sf):
    at, o = folder(spark, "cache"), table(spark, sf, "orders")
    entry = lambda value: [F.col("o_orderkey").cast("string").alias("key"), F.lit(value).alias("value"), F.array(F.lit("f")).alias("present")]
    CacheTable(spark, at, 100, 1000.0).add("s", o.where("o_orderstatus = 'F'").select(*entry("gone")))
    CacheTable(spark, at, 0, 1001.0).add("s", o.where("o_orderstatus <> 'F'").select(*entry("kept")))
    CacheTable(spark, at, 500, 1002.0).add("s", o.where("o_orderstatus = 'P'").select(*entry("new")))
    return CacheTable(spark, at, 0, 1101.0).live("s").select("key", "value")


# -- usage and plans


class CharClient:
    """Answers with a document's language; a token is four characters of the text or, in the answer, one."""

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None, provider_kwargs=None):
        row = json.loads(messages[1]["content"].split("<row_data>\n", 1)[1].split("\n</row_data>", 1)[0])
        a, b = row["n_chars"] // 4, len(row["lang"])
        return LLMResponse(json.dumps({"tongue": row["lang"]}), UsageInfo(a, b, a + b, model))


def _tongue(spark, sf, config: EnrichmentConfig | None = None) -> PipelineResult:
    steps = [LLMStep(n, {f: "the language"}, client=CharClient(), model=m, structured_outputs=False, inputs=["lang", "n_chars"]) for n, f, m in (("first", "tongue", "small"), ("second", "tongue", "large"))]
    steps[1].run_if = lambda row, prior: row["lang"] == "en"
    return Pipeline(steps).run(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), config or EnrichmentConfig(**PLAIN), row_key="doc_id")


TONGUE = "(SELECT 'first' AS step, 'small' AS model, * FROM documents UNION ALL SELECT 'second', 'large', * FROM documents WHERE lang = 'en')"


@query(
    f"""SELECT step, model, sum(n_chars // 4)::BIGINT AS prompt_tokens, sum(length(lang))::BIGINT AS completion_tokens, sum(n_chars // 4 + length(lang))::BIGINT AS total_tokens, count(*) AS rows_processed,
(SELECT count(*) FROM documents) - count(*) AS rows_skipped FROM {TONGUE} GROUP BY ALL"""
)
def step_usage_rollup(spark, sf):
    r = _tongue(spark, sf)
    return spark.createDataFrame([(n, u.model, u.prompt_tokens, u.completion_tokens, u.total_tokens, u.rows_processed, u.rows_skipped) for n, u in r.cost.steps.items()], "step string, model string, prompt_tokens long, completion_tokens long, total_tokens long, rows_processed long, rows_skipped long")


@query(f"SELECT sum(n_chars // 4)::BIGINT AS prompt_tokens, sum(length(lang))::BIGINT AS completion_tokens, sum(n_chars // 4 + length(lang))::BIGINT AS total_tokens, 0.0::DOUBLE AS cache_hit_rate FROM {TONGUE}")
def cost_summary(spark, sf):
    c = _tongue(spark, sf).cost
    return spark.createDataFrame([(c.total_prompt_tokens, c.total_completion_tokens, c.total_tokens, c.cache_hit_rate)], "prompt_tokens long, completion_tokens long, total_tokens long, cache_hit_rate double")


@query("SELECT doc_id, lang FROM documents WHERE doc_id < 3")
def plan_head_sample(spark, sf):
    return head(keyed(table(spark, sf, "documents"), "doc_id"), 3).select("doc_id", "lang")


@query("SELECT round_even(sum(n_chars // 4) * ((SELECT count(*) FROM documents) / 3), 0)::BIGINT AS prompt_tokens, round_even(sum(length(lang)) * ((SELECT count(*) FROM documents) / 3), 0)::BIGINT AS completion_tokens FROM documents WHERE doc_id < 3")
def plan_extrapolate(spark, sf):
    p = Pipeline([LLMStep("first", {"tongue": "the language"}, client=CharClient(), structured_outputs=False, inputs=["lang", "n_chars"])])
    e = p.plan(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), 3, EnrichmentConfig(**PLAIN), row_key="doc_id").estimated_cost
    return spark.createDataFrame([(e.total_prompt_tokens, e.total_completion_tokens)], "prompt_tokens long, completion_tokens long")


# -- reports


def _rows(df: DataFrame, key: str) -> DataFrame:
    return keyed(df, key)


@query("SELECT event_type AS value, count(*) AS count, (SELECT count(*) FROM events) AS total FROM events GROUP BY event_type ORDER BY count(*) DESC, min(event_id) LIMIT 1")
def enum_collapse(spark, sf):
    e = _rows(table(spark, sf, "events"), "event_id")
    return R.mode(e, F.col("event_type"), F.col(ROW))


@query("SELECT c_mktsegment AS value, count(*)::DOUBLE / (SELECT count(*) FROM customer) AS share FROM customer GROUP BY c_mktsegment")
def enum_frequency(spark, sf):
    return C.frequencies(table(spark, sf, "customer"), F.col("c_mktsegment"))


CLIPPED = "(SELECT least(l_quantity, 30)::DOUBLE AS q, l_orderkey * 10 + l_linenumber AS place FROM lineitem)"


@query(f"SELECT q AS value, count(*) AS count, (SELECT count(*) FROM lineitem) AS total, (SELECT min(q) FROM {CLIPPED}) AS low, (SELECT max(q) FROM {CLIPPED}) AS high FROM {CLIPPED} GROUP BY q ORDER BY count(*) DESC, min(place) LIMIT 1")
def numeric_clipping(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.least(F.col("l_quantity"), F.lit(30.0)).cast("string").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(ROW))
    return R.clipping(rows, F.col("q"), F.col(ROW))


def _length(unit: str) -> Query:
    def run(spark, sf):
        return R.mean_length(table(spark, sf, "documents"), F.col("text"), unit).select(F.round("mean", 6).alias("mean"))

    return run


for _unit, _expr in (
    ("words", r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"), ("sentences", "greatest(1, len(regexp_split_to_array(trim(text), '[.!?]+')))"),
    ("tokens", "greatest(1, length(text) // 4)"), ("chars", "length(text)"),
):
    QUERIES[f"length_{_unit}"] = _length(_unit[:-1])
    SQL[f"length_{_unit}"] = f"SELECT round(avg({_expr}), 6) AS mean FROM documents WHERE text <> ''"


@query("SELECT count(*) FILTER (c_custkey % 7 = 0) AS hits, count(*) AS total, count(*) FILTER (c_custkey % 7 = 0)::DOUBLE / count(*) AS share FROM customer")
def refusal_share(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("Sorry, I Cannot Determine "), F.col("c_name"))).otherwise(F.col("c_name")).alias("v"))
    return c.agg(F.count_if(X.has_refusal_phrase(F.col("v"))).alias("hits"), F.count("v").alias("total")).withColumn("share", F.col("hits") / F.col("total"))


def _usage_by(spark, sf, by: str = "event_type", step: Any = None) -> tuple[CostSummary, dict[str, int]]:
    """A run's usage made of events: a step for each type, its rows, failures and tokens counted in one aggregate."""
    e = table(spark, sf, "events")
    e = e if step is None else e.withColumn(by, step)
    got = e.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 13 == 0).alias("bad"), F.count_if(F.col("event_id") % 17 == 0).alias("hits"), F.sum(F.floor(F.abs("value"))).cast("long").alias("tokens")).collect()
    steps = {r[by]: StepUsage(total_tokens=r["tokens"], rows_processed=r["n"], cache_hits=r["hits"], cache_misses=r["n"] - r["hits"]) for r in got}
    return CostSummary(steps), {r[by]: r["bad"] for r in got}


def _found(spark, sf, fn: Callable, step: Any = None) -> DataFrame:
    cost, errors = _usage_by(spark, sf, step=step)
    found = fn(R.ReportContext(spark.createDataFrame([], "x int"), {}, cost, errors))
    return spark.createDataFrame([(f.subject, float(f.evidence["ratio"])) for f in found], "step string, ratio double")


@query("SELECT event_type AS step, round(count(*) FILTER (event_id % 13 = 0)::DOUBLE / count(*), 3) AS ratio FROM events GROUP BY event_type HAVING count(*) FILTER (event_id % 13 = 0) >= 0.05 * count(*)")
def retry_storm(spark, sf):
    return _found(spark, sf, R.retry_storm)


@query("SELECT event_type AS step, round(count(*) FILTER (event_id % 17 = 0)::DOUBLE / count(*), 3) AS ratio FROM events GROUP BY event_type HAVING count(*) FILTER (event_id % 17 = 0) BETWEEN 1 AND 0.0999999 * count(*)")
def cache_thrash(spark, sf):
    return _found(spark, sf, R.cache_thrash)


@query(
    """WITH t AS (SELECT CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'one' ELSE 'rest' END AS step, sum(floor(abs(value)))::BIGINT AS n FROM events GROUP BY 1)
    SELECT step, round(n / (SELECT sum(n) FROM t), 3)::DOUBLE AS ratio FROM t WHERE n >= 0.6 * (SELECT sum(n) FROM t)"""
)
def cost_outlier(spark, sf):
    """All event types but the first are one step, which takes most tokens."""
    e = table(spark, sf, "events")
    low = e.agg(F.min("event_type")).first()[0]
    return _found(spark, sf, R.cost_outlier, F.when(F.col("event_type") == low, "one").otherwise("rest"))


@query(
    """WITH c AS (SELECT c_custkey % 3 = 0 AS note, c_custkey % 4 = 0 AS a, least(c_custkey % 10, 5) AS half FROM customer),
    f AS (SELECT 'enum_collapse' AS code, 'warning' AS severity, 'kind' AS subject FROM c HAVING greatest(avg(a::INT), 1 - avg(a::INT)) >= 0.6
          UNION ALL SELECT 'numeric_clipping', 'warning', 'half' FROM c HAVING avg((half = (SELECT max(half) FROM c))::INT) >= 0.25
          UNION ALL SELECT 'refusal_pattern', 'warning', 'note' FROM c HAVING avg(note::INT) >= 0.05)
    SELECT *, row_number() OVER (ORDER BY severity, code, subject)::INTEGER AS place FROM f"""
)
def findings_ordered(spark, sf):
    """Findings of a run over customers in which a field collapses, one clips and one declines."""
    s = ExprStep(
        "s", lambda row, prior: {"note": F.when(row["c_custkey"] % 3 == 0, F.lit("insufficient information")).otherwise(row["c_name"]), "kind": F.when(row["c_custkey"] % 4 == 0, F.lit("A")).otherwise(F.lit("B")), "half": F.least(row["c_custkey"] % 10, F.lit(5)).cast("double")},
        {"note": "a note", "kind": {"prompt": "kind", "enum": ["A", "B"]}, "half": {"prompt": "half", "type": "Number"}},
    )
    found = Pipeline([s]).run(table(spark, sf, "customer"), row_key="c_custkey").report("dataframe")
    rows = [(r["code"], r["severity"], r["subject"], i + 1) for i, r in enumerate(found.collect())]
    return spark.createDataFrame(rows, "code string, severity string, subject string, place int")


# -- comparisons

SPECS = {"seg": {"prompt": "segment", "enum": ["AUTOMOBILE", "BUILDING"]}, "bal": {"prompt": "balance", "type": "Number"}, "name": "the name"}


def _two(spark, sf) -> C.ComparisonResult:
    def run(b: bool) -> PipelineResult:
        def made(row, prior):
            k = row["c_custkey"]
            return {
                "seg": F.when(F.lit(b) & (k % 5 == 0), F.lit("BUILDING")).otherwise(row["c_mktsegment"]), "bal": F.when(F.lit(b) & (k % 3 == 0), row["c_acctbal"] + 10).otherwise(F.when(k % 50 != 0, row["c_acctbal"])),
                "name": F.when(F.lit(b) & (k % 4 == 0), F.concat(row["c_name"], F.lit(" and sons"))).otherwise(row["c_name"]),
            }

        s = ExprStep("s", made, SPECS, error=lambda row, prior: F.when(F.lit(b) & (row["c_custkey"] % 97 == 1), F.lit("late")))
        return Pipeline([s]).run(table(spark, sf, "customer"), row_key="c_custkey")

    return C.compare(run(False), run(True))


TWO = """a AS (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey % 50 <> 0 THEN c_acctbal END AS bal, c_name AS name FROM customer),
b AS (SELECT c_custkey AS k, c_custkey % 97 = 1 AS bad, CASE WHEN bad THEN NULL WHEN c_custkey % 5 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS seg,
CASE WHEN bad THEN NULL WHEN c_custkey % 3 = 0 THEN c_acctbal + 10 WHEN c_custkey % 50 <> 0 THEN c_acctbal END AS bal, CASE WHEN bad THEN NULL WHEN c_custkey % 4 = 0 THEN c_name || ' and sons' ELSE c_name END AS name FROM customer)"""


@query(f'WITH {TWO} SELECT a.k AS row_id, a.seg AS "seg_A", b.seg AS "seg_B", a.bal AS "bal_A", b.bal AS "bal_B", a.name AS "name_A", b.name AS "name_B" FROM a JOIN b USING (k) WHERE b.bad OR a.seg IS DISTINCT FROM b.seg OR a.bal IS DISTINCT FROM b.bal OR a.name IS DISTINCT FROM b.name')
def compare_changed_rows(spark, sf):
    return _two(spark, sf).changed_rows().withColumnRenamed(ROW, "row_id")


@query(f'WITH {TWO} SELECT a.k AS row_id, a.seg AS "seg_A", b.seg AS "seg_B" FROM a JOIN b USING (k) WHERE b.bad OR a.seg IS DISTINCT FROM b.seg')
def compare_error_xor(spark, sf):
    return _two(spark, sf).changed_rows("seg").withColumnRenamed(ROW, "row_id")


def _orders(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return keyed(o.where("o_orderkey % 10 < 8"), "o_orderkey"), keyed(o.where("o_orderkey % 10 > 2").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice AS a, o_totalprice * 2 AS b FROM orders WHERE o_orderkey % 10 BETWEEN 3 AND 7")
def compare_label_join(spark, sf):
    pairs, _ = C.align(*_orders(spark, sf), key="o_orderkey")
    return pairs.select("a.o_orderkey", F.col("a.o_totalprice").alias("a"), F.col("b.o_totalprice").alias("b"))


@query("WITH a AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 10 < 8), b AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 10 > 2) SELECT r - 1 AS row_id, a.o_orderkey AS a, b.o_orderkey AS b FROM a JOIN b USING (r)")
def compare_positional(spark, sf):
    from ..sources.rows import numbered
    from ..sources.workspace import Workspace

    a, b = (numbered(d.drop(ROW), Workspace(spark), order_by=["o_orderkey"]) for d in _orders(spark, sf))
    return C.align(a, b)[0].select(F.col("a")[ROW].alias("row_id"), F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@query("SELECT count(*) FILTER (o_orderkey % 10 < 3) AS only_a, count(*) FILTER (o_orderkey % 10 > 7) AS only_b FROM orders")
def compare_unmatched(spark, sf):
    return spark.createDataFrame([C.unmatched(*_orders(spark, sf), "o_orderkey")], "only_a long, only_b long")


FREQ = """fa AS (SELECT seg AS value, count(*)::DOUBLE / (SELECT count(seg) FROM a) AS s FROM a WHERE seg IS NOT NULL GROUP BY seg), fb AS (SELECT seg AS value, count(*)::DOUBLE / (SELECT count(seg) FROM b) AS s FROM b WHERE seg IS NOT NULL GROUP BY seg),
f AS (SELECT value, coalesce(fa.s, 0) AS share_a, coalesce(fb.s, 0) AS share_b FROM fa FULL JOIN fb USING (value))"""


@query(f"WITH {TWO}, {FREQ} SELECT value, round(share_a, 9) AS share_a, round(share_b, 9) AS share_b FROM f")
def shift_enum(spark, sf):
    c = _two(spark, sf).distribution_shift()["seg"]
    return spark.createDataFrame([(k, round(c.freq_a.get(k, 0.0), 9), round(c.freq_b.get(k, 0.0), 9)) for k in sorted({*c.freq_a, *c.freq_b})], "value string, share_a double, share_b double")


@query(f"WITH {TWO}, {FREQ} SELECT value, round(share_b - share_a, 9) AS shift FROM f ORDER BY abs(share_b - share_a) DESC, value LIMIT 5")
def top5_shifts(spark, sf):
    t = _two(spark, sf).aligned
    return C.enum_shift(C.frequencies(t, F.col("a.seg")), C.frequencies(t, F.col("b.seg")), 5).select("value", F.round("shift", 9).alias("shift"))


@query(f"WITH {TWO} SELECT count(*) FILTER (a.bal IS DISTINCT FROM b.bal) AS changed, count(*) AS total, round(avg(a.bal), 6) AS mean_a, round(avg(b.bal), 6) AS mean_b, round(stddev_samp(a.bal), 6) AS std_a, round(stddev_samp(b.bal), 6) AS std_b, round(avg(b.bal) - avg(a.bal), 6) AS mean_delta FROM a JOIN b USING (k)")
def shift_numeric(spark, sf):
    c = _two(spark, sf).distribution_shift()["bal"]
    return spark.createDataFrame([(c.changed, c.total, *(round(x, 6) for x in (c.mean_a, c.mean_b, c.std_a, c.std_b, c.mean_delta)))], "changed long, total long, mean_a double, mean_b double, std_a double, std_b double, mean_delta double")


@query(f"WITH {TWO} SELECT count(*) FILTER (a.name IS DISTINCT FROM b.name) AS changed, round(avg(length(a.name) // 4), 6) AS len_a, round(avg(length(b.name) // 4), 6) AS len_b FROM a JOIN b USING (k)")
def shift_text(spark, sf):
    c = _two(spark, sf).distribution_shift()["name"]
    return spark.createDataFrame([(c.changed, round(c.avg_len_tokens_a, 6), round(c.avg_len_tokens_b, 6))], "changed long, len_a double, len_b double")


@query("SELECT (sum(n_chars // 4) FILTER (doc_id % 2 = 0) - sum(n_chars // 4))::BIGINT AS prompt_delta, (sum(length(lang)) FILTER (doc_id % 2 = 0) - sum(length(lang)))::BIGINT AS completion_delta FROM documents")
def cost_delta(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    p = Pipeline([LLMStep("first", {"tongue": "the language"}, client=CharClient(), structured_outputs=False, inputs=["lang", "n_chars"])])
    a, b = (p.run(d, EnrichmentConfig(**PLAIN), row_key="doc_id") for d in (docs, docs.where("doc_id % 2 = 0")))
    d = C.compare(a, b).cost_delta()
    return spark.createDataFrame([(d.prompt_tokens_delta, d.completion_tokens_delta)], "prompt_delta long, completion_delta long")


# -- checkpoints and retries


def _retry(spark, sf, **kw: Any) -> tuple[PipelineResult, PipelineResult]:
    """A run in which step ``a`` fails for some rows and ``c`` for others, and its retry, in which nothing fails."""

    def steps(broken: bool) -> Pipeline:
        def give(name: str, rest: int | None, value: int) -> Callable:
            def fn(c):
                if broken and rest is not None and c.row["o_orderkey"] % 100 == rest:
                    raise ValueError(name)
                return {name: value if broken else value + 1}

            return fn

        one = lambda n, rest, deps=(): FunctionStep(n, give(n, rest, 0), {n: "bigint"}, depends_on=list(deps), inputs=["o_orderkey"])
        return Pipeline([one("a", 5), one("b", None, ["a"]), one("c", 7), one("d", None, ["b"])])

    config = EnrichmentConfig(enable_checkpointing=True, checkpoint_dir=folder(spark, "checkpoint"), **PLAIN)
    orders = table(spark, sf, "orders").select("o_orderkey")
    first = steps(True).run(orders, config, row_key="o_orderkey", data_identifier="orders")
    return first, steps(False).retry_failed(orders, config, row_key="o_orderkey", data_identifier="orders", **kw)


@query("SELECT o_orderkey, o_orderkey % 100 = 5 AS a, o_orderkey % 100 = 7 AS c FROM orders WHERE o_orderkey % 100 IN (5, 7)")
def retry_selects_cells(spark, sf):
    f = _retry(spark, sf)[1].data
    return f.select("o_orderkey", (F.col("a") == 1).alias("a"), (F.col("c") == 1).alias("c")).where("a OR c")


@query("SELECT count(*) FILTER (o_orderkey % 100 = 5) AS a, count(*) FILTER (o_orderkey % 100 = 5) AS b, count(*) FILTER (o_orderkey % 100 = 7) AS c, count(*) FILTER (o_orderkey % 100 = 5) AS d FROM orders")
def retry_cascade(spark, sf):
    return _retry(spark, sf)[1].data.agg(*[F.count_if(F.col(x) == 1).alias(x) for x in "abcd"])


@query("SELECT count(*) FILTER (o_orderkey % 100 IN (5, 7)) AS before, count(*) FILTER (o_orderkey % 100 = 7) AS after FROM orders")
def retry_heals(spark, sf):
    a, b = _retry(spark, sf, steps=["a"])
    return spark.createDataFrame([(a.errors.count(), b.errors.count())], "before long, after long")


@query(
    """WITH o AS (SELECT o_orderkey AS k, '[["o_custkey",' || o_custkey || '],["o_orderdate","' || o_orderdate || '"],["o_orderkey",' || o_orderkey || '],["o_orderpriority","' || o_orderpriority
                        || '"],["o_orderstatus","' || o_orderstatus || '"],["o_totalprice",' || o_totalprice || ']]' AS j FROM orders),
    e AS ((SELECT * FROM o ORDER BY k LIMIT 5) UNION (SELECT * FROM o ORDER BY k DESC LIMIT 5))
    SELECT 'df_' || substr(sha256('[["o_custkey","o_orderdate","o_orderkey","o_orderpriority","o_orderstatus","o_totalprice"],' || (SELECT count(*) FROM orders) || ',[' || string_agg(j, ',' ORDER BY k) || ']]'), 1, 16) AS identifier FROM e"""
)
def content_digest_sample(spark, sf):
    """The digest's head and tail rows as canonical JSON; there are ten rows and more."""
    o = keyed(table(spark, sf, "orders"), "o_orderkey")
    return spark.createDataFrame([(f"df_{content_digest(o, o.count())}",)], "identifier string")


# -- batches


def _batch(spark, sf) -> tuple[PipelineResult, EchoClient]:
    client = EchoClient(lambda row: {"band": "big" if row["p_size"] > 25 else "small"}, 10, 2)
    s = LLMStep("band", {"band": {"prompt": "band", "enum": ["big", "small"]}}, client=client, structured_outputs=True, batch=True, inputs=["p_size"], cache=False)
    return Pipeline([s]).run(table(spark, sf, "part"), EnrichmentConfig(batch_max_requests=300, **PLAIN), row_key="p_partkey"), client


@query("SELECT (p_partkey // 300)::INTEGER AS chunk, count(*) AS requests FROM part GROUP BY 1")
def batch_chunks(spark, sf):
    held = _batch(spark, sf)[1].held
    return spark.createDataFrame([(i, len(x)) for i, x in enumerate(held.values())], "chunk int, requests long")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS band FROM part")
def batch_join_back(spark, sf):
    return _batch(spark, sf)[0].data.select("p_partkey", "band")


# -- run logs


def _logged(spark, sf) -> str:
    at = folder(spark, "log")
    step_map().run(table(spark, sf, "customer"), EnrichmentConfig(**PLAIN), row_key="c_custkey", run_log=JsonlRunLogger(at))
    return at


LOGGED = """SELECT 'normalize' AS step, c_custkey AS row, c_name AS key, 'ok' AS status FROM customer UNION ALL SELECT 'score', c_custkey, c_name, CASE WHEN c_custkey = 7 THEN 'error' ELSE 'ok' END FROM customer
UNION ALL SELECT 'flag', c_custkey, c_name, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'skipped' ELSE 'ok' END FROM customer"""


@query(LOGGED)
def runlog_row_complete(spark, sf):
    return read_run_log(spark, _logged(spark, sf)).where("type = 'row_complete'").select("step", "row", "key", "status")


@query(f"SELECT step, status, count(*) AS rows FROM ({LOGGED}) GROUP BY step, status")
def runlog_stream_counts(spark, sf):
    name = f"log_{uuid.uuid4().hex}"
    q = live_counts(stream_run_log(spark, _logged(spark, sf))).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


class FlakyClient:
    """Fails an event's first call, or spoils its first answer, by what its number leaves over three."""

    def __init__(self):
        self.seen: set[int] = set()

    async def complete(self, messages, model, temperature, max_tokens, response_format=None, tools=None, provider_kwargs=None):
        from ..errors import LLMAPIError

        n = json.loads(messages[1]["content"].split("<row_data>\n", 1)[1].split("\n</row_data>", 1)[0])["event_id"]
        first = n not in self.seen
        self.seen.add(n)
        if first and n % 3 == 1:
            raise LLMAPIError("slow down", 429)
        return LLMResponse("no JSON" if first and n % 3 == 2 else '{"ok": "yes"}', UsageInfo(11, 3, 14, model))


@query(
    """SELECT kind, status, attempt, count(*) AS calls FROM (SELECT 'api' AS kind, 'rate_limited' AS status, 1 AS attempt FROM events WHERE event_id % 3 = 1 UNION ALL SELECT 'parse', 'parse_error', 1 FROM events WHERE event_id % 3 = 2
UNION ALL SELECT 'parse', 'ok', CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END FROM events) GROUP BY ALL"""
)
def row_attempt_rollup(spark, sf):
    at = folder(spark, "log")
    p = Pipeline([LLMStep("s", {"ok": "yes?"}, client=FlakyClient(), structured_outputs=True, inputs=["event_id"])])
    p.run(table(spark, sf, "events"), EnrichmentConfig(retry_base_delay=0.0, **PLAIN), row_key="event_id", run_log=JsonlRunLogger(at))
    return read_run_log(spark, at).where("type = 'row_attempt'").groupBy("kind", "status", "attempt").agg(F.count(F.lit(1)).alias("calls"))


# -- field tables


@query(
    """SELECT * FROM (VALUES ('firm', 'size', 'How many' || chr(10) || 'Count people', 'Number', NULL, '0'), ('firm', 'tier', 'Which tier', 'String', ['a', 'b'], NULL), ('post', 'tone', 'Tone?', 'String', ['calm, cool', 'hot'], NULL)) t(category, field, prompt, type, enum, "default")"""
)
def load_fields_csv(spark, sf):
    rows = [("firm", "size", "How many", None, "Number", None, "0", "Count people"), ("firm", "tier", "Which tier", "String", None, " a, b ,", None, None), ("post", "tone", "Tone?", None, None, '["calm, cool", "hot"]', " ", None)]
    raw = spark.createDataFrame(rows, "Category string, Field string, Prompt string, Type string, Data_Type string, Enum string, Default string, Instructions string")
    return field_table(raw).select("category", "field", "prompt", "type", "enum", "default")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


