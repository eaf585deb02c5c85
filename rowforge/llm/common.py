"""What the operators share: the shared folder, row keys, and words of Arrow text as numpy arrays.

A word is a maximal run of bytes other than space, tab, newline, form feed and carriage return, which is RE2's
``\\S+``; in UTF-8 those five bytes occur in no other character, so words are cut on bytes.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
U64 = np.uint64
MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or a local one where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="rowforge-")
    return found.rstrip("/")


class Workspace:
    """Tables written between the jobs of one query, so that a lost executor costs no more than a task's rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/rowforge-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone at exit
            pass


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names that no column has, whatever its case."""
    have, out = {x.lower() for x in taken}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


BROADCAST = 64 << 20  # bytes that a table may take to be broadcast


def fits(table: DataFrame, row: int, most: int) -> bool:
    """Whether a written table's rows, of ``row`` bytes each as a broadcast holds them, take at most ``most`` bytes; they are counted."""
    return table.count() * row <= most


def buckets(df: DataFrame, text: str, each: int = 16 << 20, least: int | None = None) -> int:
    """Hash ranges of a packed shuffle: one for ``each`` bytes of text, which are counted, and at least ``least``, or one for each of the shuffle's partitions."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0
    return max(1, -(-total // each), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if least is None else least)


def row_order(df: DataFrame, first: Iterable[str] = ()) -> Column:
    """A struct that orders rows by ``first`` (nulls last), then by all that they hold, so ties are between equal rows."""
    parts = []
    for c in first:
        parts += [F.col(f"`{c}`").isNull().cast("int"), F.col(f"`{c}`")]
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)], content_key(df).alias("k"))


def content_key(df: DataFrame) -> Column:
    """64 bits of all columns; map columns, which have no hash, count through their JSON."""
    cols = [F.to_json(F.col(f"`{f.name}`")) if "map" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*cols) if cols else F.lit(0)


def spread(seed: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    z = seed.astype(U64, copy=True)
    z ^= z >> U64(30)
    z *= U64(0xBF58476D1CE4E5B9)
    z ^= z >> U64(27)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(31)
    return z


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch of texts: start and end bytes, and the range of words of each text."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = data, off = text_buffers(texts)
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        solid = ~_SPACE[data]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.solid = solid
        self.first = np.searchsorted(self.starts, off)  # words of text i: first[i] to first[i + 1]
        self.counts = np.diff(self.first)

    def array(self) -> pa.LargeBinaryArray:
        """The words as an Arrow array over a copy of their bytes."""
        at = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=at[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(at), pa.py_buffer(self.data[self.solid])])

    def hashes(self) -> np.ndarray:
        """64 bits of each word; each distinct word is hashed once."""
        if not len(self.starts):
            return np.zeros(0, U64)
        coded = self.array().dictionary_encode()
        of = xxhash.xxh3_64_intdigest
        return np.fromiter((of(w) for w in coded.dictionary.to_pylist()), U64, len(coded.dictionary))[coded.indices.to_numpy()]


def slices(batch: pa.RecordBatch, text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        yield batch.slice(a, b - a)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words, and the n + 1 offsets by text. A shorter text, unless empty, has one: all its words."""
    h, count = words.hashes(), words.counts
    many = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    off = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=off[1:])
    owner = np.repeat(np.arange(len(many)), many)
    at = np.arange(off[-1]) - off[owner] + words.first[owner]
    end = words.first[owner + 1]
    h = np.concatenate([h, np.zeros(n, U64)])
    out = np.zeros(off[-1], U64)
    for j in range(n):
        part = np.where(at + j < end, h[at + j], U64(0))
        out = out * U64(0x9E3779B97F4A7C15) + part
    return spread(out), off


def trimmed(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts; after the last, the memory that a task has freed goes back to the system, as Python workers live on."""
    try:
        yield from parts
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
