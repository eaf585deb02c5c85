"""A corpus made ready for training: documents in, packed sequences out.

Each stage takes what its predecessor kept, which has been written to the shared folder and read again, so a lost executor
never costs more than part of a stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowforge.llm.common import Workspace
from rowforge.llm.exact_dedup import exact_dedup
from rowforge.llm.jaccard import near_dedup
from rowforge.llm.packing import best_fit_packing
from rowforge.llm.quality import quality_filter
from rowforge.llm.repeats import remove_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the cut learned from the labels."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 50 words that occur earlier."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 words: a row for each piece of a document, with its place."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", packing),
]

#: SQL can express neither the fitting nor the branch and bound; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            work.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
