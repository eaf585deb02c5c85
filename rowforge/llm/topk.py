"""Exact top-k search by block-at-a-time pruning.

One pass over the texts makes the index, of all terms, once for all queries. It has a row for each block of documents: their
sizes, their forward index, and for each of the block's terms how many documents have it, its highest count in one of them and
the least size of those. Documents of a piece of input are put in blocks by size, so that these two bound a term's
weight closely whatever the corpus's mean size and document frequencies will be. A block's term maxima, summed over a query's
terms, bound the score of any document in it. A first pass scores each query's best block of every part; the kth best of
those scores is a floor that all tasks share. The second pass takes each query's blocks in falling order of bound, scores them
through the forward index, and stops at the first whose bound is below the kth score. A block's forward index is decoded
when the first query scores it, so blocks that no query needs are never scored. Scores are integers, millionths of a BM25
weight, so sums don't depend on order and ties are ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, slices, trimmed

K1, B, UNIT = 1.2, 0.75, 1_000_000
BLOCK = 256  # documents
HELD = 64 << 20  # bytes of term maxima in memory at once
BATCH = 32 << 20  # bytes of queries that are answered together
INDEX = "many long, total long, docs binary, none binary, sizes binary, terms binary, found binary, most binary, least binary, offsets binary, ids binary, counts binary"


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters and digits of all texts, and the text that each is of."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{N}]+")
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def joined(terms: pa.Array) -> bytes:
    """Terms, which hold no line's end, as lines."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.cast(pa.string()))
    return pc.binary_join(lists, "\n")[0].as_buffer().to_pybytes()


def parted(lines: pa.Scalar) -> pa.Array:
    body = lines.as_buffer()
    if not len(body):
        return pa.array([], pa.large_string())
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(body)], np.int64)), body])
    return pc.split_pattern(whole, "\n").flatten()


def index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index's rows for (doc_id, text)."""
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 10)
    names = [f.split()[0] for f in INDEX.split(", ")]
    for b in batches:
        for part in slices(b, 1, 4 << 20):
            words, owner = terms(part.column(1))
            n = part.num_rows
            size = np.bincount(owner, minlength=n)
            by_size = np.argsort(size, kind="stable")
            rank = np.empty(n, np.int64)
            rank[by_size] = np.arange(n)
            coded = words.dictionary_encode()
            many = max(len(coded.dictionary), 1)
            key, count = np.unique(rank[owner] * many + coded.indices.to_numpy(), return_counts=True)
            off, code = np.searchsorted(key, np.arange(n + 1) * many), key % many
            docs, none = part.column(0).fill_null(0).to_numpy()[by_size], part.column(0).is_null().to_numpy(zero_copy_only=False)[by_size]
            size = size[by_size]
            for a in range(0, n, BLOCK):
                z = min(a + BLOCK, n)
                lo, hi = off[a], off[z]
                own, ids, found = np.unique(code[lo:hi], return_inverse=True, return_counts=True)
                order = np.argsort(ids, kind="stable")
                head = np.cumsum(found) - found
                most = np.maximum.reduceat(count[lo:hi][order], head) if len(own) else own
                least = np.minimum.reduceat(np.repeat(size[a:z], np.diff(off[a : z + 1]))[order], head) if len(own) else own
                arrays = (docs[a:z], none[a:z].astype(np.uint8), size[a:z].astype(np.int64)), (found, most, least, off[a : z + 1] - lo, ids, count[lo:hi])
                row = (z - a, int(size[a:z].sum()), *(x.tobytes() for x in arrays[0]), joined(coded.dictionary.take(pa.array(own))), *(x.astype(np.int32).tobytes() for x in arrays[1]))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)


class Queries:
    """The terms of some queries as codes of their vocabulary."""

    def __init__(self, texts: list[str | None]):
        words, owner = terms(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary.cast(pa.large_string())
        pair = np.unique(owner.astype(np.int64) * max(len(self.vocabulary), 1) + coded.indices.to_numpy())
        self.flat = pair % max(len(self.vocabulary), 1)
        self.off = np.searchsorted(pair // max(len(self.vocabulary), 1), np.arange(len(texts) + 1))

    def __len__(self) -> int:
        return len(self.off) - 1

    def codes(self, terms: pa.Array) -> np.ndarray:
        """The code of each term, or -1."""
        return pc.fill_null(pc.index_in(terms.cast(pa.large_string()), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def bounds(self, peak: np.ndarray) -> np.ndarray:
        """Of each query the sum of its terms' maxima."""
        upto = np.append(0, np.cumsum(peak[self.flat]))
        return upto[self.off[1:]] - upto[self.off[:-1]]


class Best:
    """A query's best k so far: higher score first, then smaller doc_id, nulls last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(floor, 1)
        self.score, self.none, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.floor
        if not good.any():
            return
        s, z, d = (np.concatenate([x, y[good]]) for x, y in ((self.score, score), (self.none, none), (self.doc, doc)))
        order = np.lexsort((d, z, -s))[: self.k]
        self.score, self.none, self.doc = s[order], z[order], d[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def weight(idf: np.ndarray, count: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights in millionths, which rise with the count and fall with the size."""
    return np.floor(idf * (count * (K1 + 1.0)) / (count + K1 * (1.0 - B + B * size / mean)) * UNIT + 0.5).astype(np.int64)


class Block:
    """A row of the index: its term maxima at once, its forward index when it is first scored."""

    decoded = 0  # blocks whose forward index was read, of this process

    def __init__(self, row: dict, queries: Queries, idf: np.ndarray, mean: float):
        self.row, self.idf, self.mean = row, idf, mean
        self.known = queries.codes(parted(row["terms"]))
        own = self.known >= 0
        self.peak = np.zeros(max(len(idf), 1), np.int64)
        most, least = (np.frombuffer(row[c].as_buffer(), np.int32)[own] for c in ("most", "least"))
        self.peak[self.known[own]] = weight(idf[self.known[own]], most, least, mean)
        self.table: tuple | None = None

    def score(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all documents for a query's terms, with what tells the documents apart."""
        if self.table is None:
            Block.decoded += 1
            of = lambda c, t: np.frombuffer(self.row[c].as_buffer(), t)
            size, off = of("sizes", np.int64), of("offsets", np.int32)
            term = self.known[of("ids", np.int32)]
            hit = np.flatnonzero(term >= 0)
            hit = hit[np.argsort(term[hit], kind="stable")]
            row = np.repeat(np.arange(len(size)), np.diff(off))[hit]
            term = term[hit]
            impact = weight(self.idf[term], of("counts", np.int32)[hit].astype(np.float64), size[row].astype(np.float64), self.mean)
            self.table = row, impact, np.searchsorted(term, np.arange(len(self.idf) + 1)), of("none", np.uint8).astype(np.int64), of("docs", np.int64)
        row, impact, begin, none, docs = self.table
        count = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(row[at], impact[at], len(docs)).astype(np.int64), none, docs  # sums of integers far below 2^53


def search(batches: Iterator[pa.RecordBatch], queries: Queries, idf: np.ndarray, mean: float, k: int, floors: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A part's best k of each query; without floors, of each query's best blocks alone."""
    best = [Best(k, 0 if floors is None else int(floors[q])) for q in range(len(queries))]
    most = max(1, HELD // (16 * max(len(idf), len(queries), 1)))

    def run(blocks: list[Block]) -> None:
        bounds = np.array([queries.bounds(x.peak) for x in blocks])
        for q, own in enumerate(best):
            at = queries.flat[queries.off[q] : queries.off[q + 1]]
            mine = bounds[:, q]
            for i in [int(mine.argmax())] if floors is None else np.argsort(-mine, kind="stable"):
                if mine[i] < own.floor:
                    break
                own.offer(*blocks[i].score(at))

    held: list[Block] = []
    for b in batches:
        for i in range(b.num_rows):
            held.append(Block({n: b.column(j)[i] for j, n in enumerate(b.schema.names)}, queries, idf, mean))
            if len(held) == most:
                run(held)
                held = []
    if held:
        run(held)
    q = np.repeat(np.arange(len(best)), [len(x.score) for x in best])
    doc, none, score = (np.concatenate([np.zeros(0, np.int64), *(getattr(x, c) for x in best)]) for c in ("doc", "none", "score"))
    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(doc, mask=none > 0), pa.array(score)], ["query", "doc_id", "score"])


def frequencies(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[pa.RecordBatch]:
    """In how many documents of a part each of the queries' terms is, from (terms, found)."""
    df = np.zeros(max(len(queries.vocabulary), 1), np.int64)
    for b in batches:
        for i in range(b.num_rows):
            code = queries.codes(parted(b.column(0)[i]))
            df[code[code >= 0]] += np.frombuffer(b.column(1)[i].as_buffer(), np.int32)[code >= 0]
    has = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has])], ["id", "df"])


def _answer(index: DataFrame, total: tuple[int, float], rows: list, k: int) -> DataFrame:
    spark, (n, mean) = index.sparkSession, total
    queries = Queries([r["text"] for r in rows])
    found = index.select("terms", "found").mapInArrow(lambda bs: trimmed(frequencies(bs, queries)), "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()  # at most the queries' vocabulary
    df = np.zeros(max(len(queries.vocabulary), 1))
    for r in found:
        df[r["id"]] = r["df"]
    idf = np.array([math.log(1.0 + (n - x + 0.5) / (x + 0.5)) for x in df])

    out = "query int, doc_id long, score long"
    rank = lambda: F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id"))
    seeds = index.mapInArrow(lambda bs: trimmed(search(bs, queries, idf, mean, k, None)), out)
    floors = np.zeros(len(rows), np.int64)
    for r in seeds.withColumn("nth", rank()).where(F.col("nth") == k).collect():  # one row a query
        floors[r["query"]] = r["score"]
    hits = index.mapInArrow(lambda bs: trimmed(search(bs, queries, idf, mean, k, floors)), out).withColumn("rank", rank()).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "query int, item_id long")
    return hits.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", F.col("score").alias("score_e6"))


def top_k(
    docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", query_text: str = "text", query_id: str = "item_id", batch_bytes: int = BATCH
) -> DataFrame:
    """(item_id, rank, doc_id, score_e6): for each query, the k documents with the highest BM25 scores, exactly.

    Terms are lower-cased runs of letters and digits; a query's repeated term counts once. A document must score above 0,
    so a query may have fewer than k rows, and one without terms (null or empty) has none. Equal scores are ranked by
    doc_id, nulls last. Null and empty documents count among the documents and are never found. Equal documents are each
    found, and equal queries each answered. No document or no query, no row. Identifiers are integers. Other columns are ignored.
    The texts are read once. Queries of ``batch_bytes`` together, or so, read the index, which bounds what a task holds.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "topk")
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = queries.select(F.col(f"`{query_id}`").cast("long").alias("item_id"), F.col(f"`{query_text}`").alias("text")).where("text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text") + 64).cast("long")).first()[0] or 0
    parts = -(-size // batch_bytes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score_e6 long")
    if not parts:
        return out
    index = work.write(slim.mapInArrow(lambda bs: trimmed(index_blocks(bs)), INDEX), "index")
    total = index.agg(F.sum("many").alias("n"), F.sum("total").alias("size")).first()
    if not total["n"]:
        return out
    for i in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()  # about batch_bytes
        if rows:
            got = _answer(index, (total["n"], max(total["size"] / total["n"], 1e-9)), rows, k)
            out = got if parts == 1 else out.unionByName(got)
    return out


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
size AS (SELECT doc_id, count(*) AS size FROM words GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM words)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words GROUP BY doc_id, term),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
weight AS (
  SELECT tf.doc_id, tf.term, floor(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * {K1 + 1.0}::DOUBLE)
         / (tf + {K1}::DOUBLE * ({1.0 - B}::DOUBLE + {B}::DOUBLE * size / mean)) * {UNIT}::DOUBLE + 0.5::DOUBLE)::BIGINT AS impact
  FROM tf JOIN df USING (term) JOIN size USING (doc_id), total),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
score AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score_e6 FROM asked JOIN weight USING (term) GROUP BY item_id, doc_id HAVING sum(impact) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score_e6
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score_e6 DESC, doc_id) AS rank FROM score) WHERE rank <= 10
"""
