"""Exact dedup with the heavy hitters split off.

Misra-Gries sketches, one a task and merged by an aggregation, name the digests that may be frequent. Their counts and
winners are then found exactly by an aggregation that combines before it shuffles, and the winners, of which there are
at most ``counters``, are broadcast: all other rows of those digests go where they are read. What remains has no digest
with more than about rows / counters copies, so an ordinary shuffle of (digest, order) finds its repeated digests and
their winners. Texts are never shuffled but those of winners: a row's order is compared with that of its digest's winner
where it is read. Texts are equal if their SHA-256 digests are: counts and winners are verified, texts are not compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST, Workspace, fits, fresh, row_order


def prune(counts: dict, counters: int) -> dict:
    """The Misra-Gries step for any number of arrivals at once: what the first counter beyond the limit holds is taken from all."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def misra_gries(batches: Iterable[pa.RecordBatch], counters: int) -> dict[bytes, int]:
    """Counts of at most ``counters`` values of the first column, each too low by at most rows / (counters + 1)."""
    held: dict[bytes, int] = {}
    for b in batches:
        for x in pc.value_counts(pc.drop_null(b.column(0))).to_pylist():
            held[x["values"]] = held.get(x["values"], 0) + x["counts"]
        held = prune(held, counters)
    return held


def heavy_digests(digests: DataFrame, column: str, counters: int, least: int) -> DataFrame:
    """At most ``counters`` values of a binary column that may occur ``least`` times or more, most frequent first."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries(batches, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "about"])

    merged = digests.select(column).mapInArrow(sketch, "digest binary, about long").groupBy("digest").agg(F.sum("about").alias("about"))
    return merged.where(F.col("about") >= least).orderBy(F.desc("about"), "digest").limit(counters).select("digest")


def exact_dedup(
    docs: DataFrame, text: str = "text", order: Iterable[str] = ("doc_id",), counters: int = 1024, least: int = 16, broadcast_bytes: int = BROADCAST
) -> DataFrame:
    """One row of each set of rows whose texts have one SHA-256 digest, which stands for equality byte for byte, with all its columns.

    The row with the smallest ``order`` columns stays (nulls last), ties going to the smaller hash of the whole row; of
    rows equal in every column one stays. Rows whose text is null have no content to compare, and all stay; empty texts
    are equal. No row, no result. ``counters`` bounds the sketches and the broadcast of heavy digests; the repeated
    other digests are broadcast while they take at most ``broadcast_bytes`` and joined by a shuffle beyond that.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    dg, od, win = fresh(docs.columns, "rf_digest", "rf_order", "rf_winner")
    keyed = docs.withColumns({dg: F.unhex(F.sha2(F.col(f"`{text}`").cast("binary"), 256)), od: row_order(docs, [c for c in order if c in docs.columns])})

    keys = work.write(keyed.where(F.col(dg).isNotNull()).select(dg, od), "keys")  # so texts are hashed once here and once where rows are let go
    heavy = F.broadcast(work.write(heavy_digests(keys, dg, counters, least).withColumnRenamed("digest", dg), "heavy"))
    best = lambda df: df.groupBy(dg).agg(F.count(F.lit(1)).alias("copies"), F.min(od).alias(win)).where("copies > 1").drop("copies")
    work.write(best(keys.join(heavy, dg, "left_semi")), "winners/kind=heavy")
    work.write(best(keys.join(heavy, dg, "left_anti")), "winners/kind=other")
    frequent, other = (spark.read.parquet(f"{work.path}/winners/kind={k}") for k in ("heavy", "other"))

    left = keyed.join(F.broadcast(frequent), dg, "left").where(F.col(win).isNull() | (F.col(od) == F.col(win)))
    if fits(other, 128, broadcast_bytes):
        other = F.broadcast(other)
    frequent_row = F.col(win).isNotNull().alias(win)
    left = left.select(*[F.col(f"`{c}`") for c in docs.columns], dg, od, frequent_row)
    win2 = fresh([*left.columns], "rf_other")[0]
    left = left.join(other.withColumnRenamed(win, win2), dg, "left").where(F.col(win2).isNull() | (F.col(od) == F.col(win2)))
    repeated = F.col(win) | F.col(win2).isNotNull()
    back = [F.col(f"`{c}`") for c in docs.columns]
    rank = W.partitionBy(dg).orderBy(od)  # only winners and their equals come here
    once = left.where(repeated).withColumn(win, F.row_number().over(rank)).where(F.col(win) == 1).select(*back)
    return left.where(~repeated).select(*back).unionByName(once)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, text, lang, source, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents)
WHERE nth = 1 OR text IS NULL
"""
