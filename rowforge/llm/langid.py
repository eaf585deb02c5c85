"""Language identification with language-bitmask n-gram filters.

The filters of all languages share their hash positions and lie bit-sliced in one array: a slot holds a bit for each
language, so the AND of an n-gram's slots is the set of languages whose filter contains it. Each language's popcount over
a text, less the false positives that its filter's fill makes expected, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, text_buffers

N = 4  # bytes; an n-gram is its own 32-bit key
LARGE = 1_000_000  # n-grams of a sample
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
SCHEMA = "doc_id long, lang_id string, score double, margin double"


def keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of the n-gram at each byte of lower-cased texts, whether it lies within its text, and the n + 1 offsets of texts."""
    data, off = text_buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    d = np.concatenate([data, np.zeros(N, np.uint8)]).astype(np.uint32)
    n = len(data)
    key = d[:n].copy()
    for i in range(1, N):
        key |= d[i : n + i] << np.uint32(8 * i)
    inside = np.ones(n + N, bool)
    for i in range(1, N):
        inside[np.maximum(off[1:] - i, 0)] = False  # a shorter text's mark falls into the one before, whose last n-grams are out too
    whole = np.diff(off) >= N
    if not whole.all():
        for i in np.flatnonzero(~whole):
            inside[off[i] : off[i + 1]] = False
        for i in np.flatnonzero(whole):  # marks of short neighbours that reached too far back
            inside[off[i] : off[i + 1] - N + 1] = True
    return key, inside[:n], off


@dataclass(frozen=True)
class Filters:
    """slots[i] has bit l where language l set it; hashes positions an n-gram."""

    languages: tuple[str, ...]
    slots: np.ndarray
    false: np.ndarray  # of each language, the chance that its filter contains an n-gram that it wasn't given
    hashes: int

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], bits: int = 20, hashes: int = 3) -> Filters:
        names = tuple(sorted(grams))
        if len(names) > 64:
            raise ValueError(f"{len(names)} languages; the bitmask holds 64")
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(names))
        slots = np.zeros(1 << bits, kind)
        for i, name in enumerate(names):
            for at in places(grams[name], bits, hashes):
                slots[at] |= kind(1 << i)
        fill = np.array([((slots >> kind(i)) & kind(1)).mean() for i in range(len(names))]) if names else np.zeros(0)
        return cls(names, slots, fill**hashes, hashes)

    def lookup(self, key: np.ndarray) -> np.ndarray:
        """Languages of each n-gram, as a bitmask."""
        bits = int(len(self.slots)).bit_length() - 1
        masks = [self.slots[at] for at in places(key, bits, self.hashes)]
        out = masks[0]
        for m in masks[1:]:
            out = out & m
        return out

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and language, the corrected share of its n-grams in the language's filter; of each text, how many it has."""
        key, inside, off = keys(texts)
        mask = self.lookup(key)
        mask[~inside] = 0
        count = np.maximum(np.diff(off) - N + 1, 0)
        out = np.zeros((len(count), len(self.languages)))
        for i, f in enumerate(self.false):
            held = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(i)) & mask.dtype.type(1), dtype=np.int64)])
            hits = held[off[1:]] - held[off[:-1]]
            out[:, i] = (hits - count * f) / np.maximum(count, 1) / max(1 - f, 1e-9)
        return out, count


def places(key: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    for i in range(hashes):
        yield (key.astype(np.uint64) * _ODD[i]) >> np.uint64(64 - bits)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 2000, least: int = 10, seed: int = 11, **shape: int) -> Filters:
    """Filters of the n-grams that are frequent in a language's sample: about ``per_language`` of its rows, chosen by hash.

    Frequent is ``least`` times or more in a sample of a million n-grams or more, in proportion in a smaller one, and once in
    a small one, so a rare language has a filter too.
    Rows without a language or a text are left out. Without any labelled row there is no language.
    """
    t, name = F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("name")
    known = docs.select(t, name).where("t IS NOT NULL AND name IS NOT NULL")
    counts = docs.select(name).where("name IS NOT NULL").groupBy("name").count().limit(65).collect()
    if not counts:
        return Filters.build({})
    if len(counts) > 64:
        raise ValueError("more than 64 languages")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["name"], min(1.0, per_language / r["count"]))])
    picked = known.where(F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1 << 30)) < F.element_at(share, F.col("name")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                key, inside, off = keys(part.column(0))
                names, code = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
                own = np.repeat(code, np.diff(off))[inside]
                for i, n in enumerate(names):
                    k, c = np.unique(key[inside][own == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(n)] * len(k)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], ["name", "gram", "c"])

    rows = picked.mapInArrow(count, "name string, gram long, c long").groupBy("name", "gram").agg(F.sum("c").alias("c"))
    size = F.sum("c").over(W.partitionBy("name"))
    rows = rows.withColumn("floor", F.least(F.lit(float(least)), F.greatest(F.lit(1.0), size * (least / LARGE)))).where("c >= floor")
    found = rows.select("name", "gram").toPandas()  # n-grams of a bounded sample
    return Filters.build({r["name"]: found.loc[found["name"] == r["name"], "gram"].to_numpy().astype(np.uint32) for r in counts}, **shape)


def identify(docs: DataFrame, filters: Filters, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_id, score, margin): the language with the highest corrected share of the whole text's n-grams, and its lead.

    Of equal shares the language that sorts first is taken, with margin 0. A null text, one of fewer bytes than an n-gram, and
    one of which no language has more n-grams than its filter's false positives account for, have no language: null, with
    score and margin 0. Null doc_ids are reported as null, equal rows each. Other columns,
    whatever their names, are ignored. Without filters no row has a language. No row, no result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # a megabyte or eight, whatever the corpus
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        langs = np.array([*own.languages, None], object)
        for b in batches:
            for part in slices(b, 1):
                n = part.num_rows
                if not own.languages:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n))], names)
                    continue
                score, count = own.scores(part.column(1))
                best = score.argmax(1)
                top = score[np.arange(n), best]
                rest = score.copy()
                rest[np.arange(n), best] = -np.inf
                lead = top - (rest.max(1) if len(own.languages) > 1 else 0)
                none = (count == 0) | (top <= 0)
                best[none], top[none], lead[none] = -1, 0, 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs[best], pa.string()), pa.array(top), pa.array(lead)], names)

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, SCHEMA)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
