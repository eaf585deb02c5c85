"""The corpus pipeline against a brute-force version, the queries against SQL, and the guard that lets the folder go."""

import glob
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from rowforge.llm import packing, quality, queries

from .helpers import nasty, words
from .test_dedup import brute_pairs, brute_windows
from .test_text_ops import check_bins

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(t).stem} AS SELECT * FROM '{t}'")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(shown(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ranker = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in quality.quality_scores(docs, ranker, "text", "s", "k").where("k").collect()}
    first = {}
    for d in sorted(rows):
        first.setdefault(rows[d], d)
    rows = {d: rows[d] for d in first.values()}
    group = {d: d for d in rows}
    for a, b in brute_pairs(sorted(rows.items())):
        x, y = group[a], group[b]
        group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    rows = {d: t for d, t in rows.items() if group[d] == d}
    marked = brute_windows(list(rows.items()), 50)
    left = {d: len(words(t)) - len(marked.get((d, False), ())) for d, t in rows.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    per = {}
    for r in got:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.n_tokens
    assert per == {d: n for d, n in left.items() if n}
    check_bins(got, [(d, "w " * n) for d, n in left.items()], packing.CAPACITY)


def test_stages_take_nasty_rows(spark):
    docs = nasty(spark, extra=False)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            out.collect()
            assert name == names[-1] or out.columns == docs.columns


def test_nothing_else_imports_the_folder():
    for p in (ROOT / "rowforge").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "rowforge").parts:
            assert "rowforge.llm" not in p.read_text() and "from .llm" not in p.read_text() and "from ..llm" not in p.read_text()
    code = "import sys; sys.modules['rowforge.llm'] = None; sys.modules.pop('corpus_pipeline', None)\nimport __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
