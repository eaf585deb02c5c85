"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled good document is preferred to a labelled bad one. The score is linear in features that Spark computes from the
whole text with built-in functions, once for each row; its weights minimise the logistic loss of feature differences over preference pairs.
The cut is a quantile of the scores of all documents, at the level that parts all labelled ones with the least error. Only
the weights are computed on the driver, from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh

FEATURES = ("symbols", "capitals", "digits", "ends", "distinct", "word_length", "long_words", "log_words", "line_words")


def features(text: str) -> list[Column]:
    """Columns f0, f1, ... of a text column; a null or empty text has those of the empty string, all finite."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    count = lambda regex: F.regexp_count(t, F.lit(regex))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    n = F.greatest(count(r"[^ \t\n\f\r]+"), F.lit(1)).cast("double")
    cols = [
        F.sqrt(count(r"[#$%&*|!<>{}=+~^@\\/_\[\]]") / chars),
        F.sqrt(count(r"\p{Lu}") / chars),
        F.sqrt(count(r"[0-9]") / chars),
        F.sqrt(count(r"[.?,;:]") / chars),
        F.size(F.array_distinct(F.array_remove(F.split(t, r"[ \t\n\f\r]+"), ""))) / n,
        F.least((F.length(t) - count(r"[ \t\n\f\r]")) / n, F.lit(30.0)),
        count(r"[^ \t\n\f\r]{21,}") / n,
        F.log1p(n),
        F.log1p(n / (count("\n") + 1)),
    ]
    return [c.cast("double").alias(f"f{i}") for i, c in enumerate(cols)]


@dataclass(frozen=True)
class Ranker:
    """score = weights . (features - centre) / scale; documents that score below the cut are rejected."""

    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float
    level: float  # the quantile of all documents' scores that the cut is

    def score(self, of: list[Column]) -> Column:
        out = F.lit(0.0)
        for c, w, m, s in zip(of, self.weights, self.centre, self.scale):
            out = out + (c - F.lit(m)) * F.lit(w / s)
        return out


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w . (better - worse))) + ridge |w|^2 / 2, by Newton steps with halving."""
    d = better - worse
    w = np.zeros(d.shape[1])
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + ridge * w @ w / 2
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = -(d * p[:, None]).mean(0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - then < 1e-10:
            break
        w, now = w - size * step, then
    return w


def best_level(scores: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The quantile level, and the score there, that separates good from bad with the least weighted error; of equals the lowest."""
    order = np.argsort(scores, kind="stable")
    s, g, w = scores[order], good[order], weight[order]
    wrong = np.concatenate([[0], np.cumsum(np.where(g, w, -w))])  # of rejecting the lowest i
    wrong[1:-1][s[1:] == s[:-1]] = np.inf  # equal scores are not parted
    i = int(np.argmin(wrong))
    level = w[:i].sum() / w.sum()
    cut = -np.inf if i == 0 else np.inf if i == len(s) else (s[i - 1] + s[i]) / 2
    return float(level), float(cut)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of scores, as sorted (score, good, bad) with counts: the counts below its best cut, and those from there on.

    No cut inside a range has less error, over all, than its best one, whatever the other ranges hold.
    """
    lo = hi = None
    total, below, error, least = np.zeros(2, np.int64), np.zeros(2, np.int64), 0, 0
    for b in batches:
        s, good, bad = (b.column(i).to_numpy() for i in range(3))
        if not len(s):
            continue
        if lo is None:
            lo = hi = s[0]
        wrong = error + np.cumsum(good - bad)  # of rejecting up to each score
        i = int(np.argmin(wrong))
        if wrong[i] < least:
            least, below = int(wrong[i]), total + [good[: i + 1].sum(), bad[: i + 1].sum()]
        total, error, hi = total + [good.sum(), bad.sum()], int(wrong[-1]), s[-1]
    if lo is not None:
        parts = [(lo, *below), (hi, *(total - below))] if below.any() and (total - below).any() else [(lo, *total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.float64(), pa.int64(), pa.int64()))], ["score", "good", "bad"])


def labelled_level(scored: DataFrame) -> tuple[int, int]:
    """How many of the (score, good) rows the cut with the least error rejects, and how many rows there are."""
    n = scored.groupBy("score").agg(F.sum("good").cast("long").alias("good"), F.sum(1 - F.col("good")).cast("long").alias("bad"))
    rows = n.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(chunks, "score double, good long, bad long").collect()  # two a partition
    rows.sort(key=lambda r: r["score"])
    at, good, many = (np.array(c) for c in zip(*[(float(i), g, float(r["good"] if g else r["bad"])) for i, r in enumerate(rows) for g in (True, False)]))
    level, _ = best_level(at, good, many)
    return round(level * many.sum()), int(many.sum())


def ordered(score: np.ndarray) -> np.ndarray:
    """Integers in the order of the scores."""
    bits = (score + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(np.iinfo(np.int64).max))


def score_at(scores: DataFrame, rank: int) -> float:
    """The score that has ``rank`` of the scores before it in order, found 16 bits at a time from counts."""
    prefix = 0
    for shift in (48, 32, 16, 0):

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = ordered(b.column(0).to_numpy()) >> shift
                part, c = np.unique(key if shift == 48 else key[key >> 16 == prefix], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(c, pa.int64())], ["part", "c"])

        rows = scores.select("score").mapInArrow(count, "part long, c long").groupBy("part").agg(F.sum("c").alias("c")).collect()  # 65,536 at most
        for r in sorted(rows):
            prefix = r["part"]
            if rank < r["c"]:
                break
            rank -= r["c"]
    bits = np.int64(prefix)
    return float((bits ^ ((bits >> np.int64(63)) & np.int64(np.iinfo(np.int64).max))).view(np.float64))


def known_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the labelled documents; one labelled both ways counts as bad, and labels with a null are ignored."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))


def weigh(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", per_class: int = 8000, pairs: int = 200_000, seed: int = 7) -> Ranker | None:
    """A ranker without a cut, from at most ``per_class`` labelled documents of each quality, those with the smallest hashes of doc_id.

    ``pairs`` preference pairs are drawn among them, as their product may be 64 million. None where either quality has no
    document, as nothing can then be learned.
    """
    known = known_quality(labels)
    parts = [known.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for g in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "doc_id")
    one = found.select("good", "doc_id", F.struct(*features("text")).alias("x")).groupBy("good", "doc_id").agg(F.min("x").alias("x"))
    rows = one.select("good", "doc_id", "x.*").toPandas().sort_values(["good", "doc_id"])  # at most 2 per_class rows
    x, good = rows.drop(columns=["good", "doc_id"]).to_numpy(float), rows["good"].to_numpy() == 1
    if not good.any() or good.all():
        return None
    rng = np.random.default_rng(seed)
    i, j = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    centre, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - centre) / scale
    w = bradley_terry(z[i], z[j])
    return Ranker(tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, scale)), -np.inf, 0.0)


def with_cut(ranker: Ranker, scored: DataFrame, labels: DataFrame) -> Ranker:
    """The ranker with its cut, for a written table (doc_id, score) of all documents.

    Of all labelled documents' scores the level is taken that separates good from bad with the least error, and the cut is the
    quantile of all documents' scores at that level.
    """
    rejected, labelled = labelled_level(scored.join(known_quality(labels), "doc_id").select("score", "good"))
    n = scored.count()
    rank = rejected * n // labelled
    cut = -np.inf if rank == 0 else np.inf if rank == n else score_at(scored, rank)
    return replace(ranker, cut=cut, level=rejected / labelled)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **fitting) -> Ranker | None:
    """A ranker of which the weights are learned from a sample of labelled documents and the cut from all documents."""
    ranker = weigh(docs, labels, text, doc_id, **fitting)
    if ranker is None:
        return None
    work = Workspace(docs.sparkSession, "quality")
    ranker = with_cut(ranker, work.write(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), ranker.score(features(text)).alias("score")), "scores"), labels)
    work.drop()
    return ranker


def quality_scores(docs: DataFrame, ranker: Ranker | None, text: str, score: str, keep: str) -> DataFrame:
    """docs with a score and whether it reaches the cut; without a ranker all are kept with a null score."""
    if ranker is None:
        return docs.withColumns({score: F.lit(None).cast("double"), keep: F.lit(True)})
    scored = docs.withColumn(score, ranker.score(features(text)))
    return scored.withColumn(keep, F.col(score) >= F.lit(ranker.cut))


def quality_filter(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", score: str | None = None, only: list[str] | None = None, **fitting) -> DataFrame:
    """The documents whose score reaches the cut, with all their columns or those named in ``only``; ``score`` names a column to add.

    Each row is scored from its own whole text, so equal rows fare alike and a null doc_id is nothing special. A null or
    empty text is scored as a text without words. Equal scores are on the same side of the cut. Without labels of both
    qualities every row stays, with a null score. No row, no result. Scores are computed once: the rows are written with them, and what
    finds the cut and what applies it read that table.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if only is None else only)]
    ranker = weigh(docs, labels, text, doc_id, **fitting)
    if ranker is None:
        return docs.select(*kept, *([F.lit(None).cast("double").alias(score)] if score else []))
    value, name = fresh(docs.columns, score or "rf_score", "rf_doc")
    work = Workspace(docs.sparkSession, "quality")
    scored = work.write(docs.select(*kept, F.col(f"`{doc_id}`").alias(name), ranker.score(features(text)).alias(value)), "scored")
    ranker = with_cut(ranker, scored.select(F.col(name).alias("doc_id"), F.col(value).alias("score")), labels)
    return scored.where(F.col(value) >= F.lit(ranker.cut)).select(*kept, *([F.col(value).alias(score)] if score else []))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_filter(docs, labels, score="score", only=["doc_id"])
