"""Byte-level BPE by corpus-level merge replay.

Whole texts are cut into words, and blocks of texts hand on their distinct words by hash range. A range lays out all distinct
words that the corpus has there as one array of byte symbols, and an inverted index from the rank of a token pair to the
positions where it stands applies every merge to all of them together, in rank order. A merge touches only its positions and their
neighbours: the pairs that it makes there enter the index, and those that it breaks are found stale when their turn comes. So
each distinct word of the corpus is merged once; the tokens go back to the blocks, whose texts copy those of their words.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, buckets, slices, text_buffers, trimmed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"
LETTER, NUMBER, SPACE, OTHER = range(4)
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def kind(point: int) -> int:
    """Letter, number, white space or other, as the pattern's classes have it."""
    if point in _WHITE:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(point))[0], OTHER) if point < 0x110000 else OTHER


_ASCII = np.array([kind(i) for i in range(128)], np.uint8)


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the words of UTF-8 texts: what the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ finds in each text."""
    at = np.flatnonzero((data < 0x80) | (data >= 0xC0))  # first bytes of characters
    lead = data[at]
    cls = np.empty(len(at), np.uint8)
    low = lead < 0x80
    cls[low] = _ASCII[lead[low]]
    far = np.flatnonzero(~low)
    if len(far):
        p = at[far]
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (wide[p + i].astype(np.uint32) for i in range(4))
        point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        known, back = np.unique(point, return_inverse=True)
        cls[far] = np.fromiter((kind(int(x)) for x in known), np.uint8, len(known))[back]
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.zeros(len(data) + 1, bool)  # first bytes of texts
    fresh[off] = True
    new_text = fresh[at]
    run = new_text.copy()
    run[0] = True
    run[1:] |= cls[1:] != cls[:-1]
    blank = lead == 32
    start = run.copy()
    start[1:] &= ~((cls[1:] != SPACE) & blank[:-1] & ~new_text[1:])  # a space before a word is its first character
    heads = np.flatnonzero(run)
    tails = np.append(heads[1:], n)
    white = (cls[heads] == SPACE) & (tails - heads > 1) & (tails < n)
    last = tails[white]
    last = last[~new_text[last]]
    start[last - 1] = True  # the last of several spaces, but at a text's end
    mark = np.flatnonzero((lead == 39) & start)
    for i in mark:
        if i + 1 < n and cls[i + 1] == LETTER and not new_text[i + 1]:
            two = bytes(lead[i + 1 : i + 3])
            size = 1 if two[:1] in (b"s", b"t", b"m", b"d") else 2 if two in (b"re", b"ve", b"ll") and not new_text[i + 2] else 0
            if size:
                start[i + 1] = False
                if i + 1 + size < n and cls[i + 1 + size] == LETTER:
                    start[i + 1 + size] = True
    return at[start]


class Vocabulary:
    """Tokens by rank, and the rank of each pair of tokens that joins to a token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens)}
        self.bytes = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        keys, joined = [], []
        for r, t in enumerate(tokens):
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joined.append(r)
        self.keys, self.joined = np.array(keys, np.int64), np.array(joined, np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)  # open addressing
        left, slot = np.arange(len(keys)), self.slot(self.keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several, one stays
            out = self.slots[slot] != left
            left, slot = left[out], (slot[out] + 1) & ((1 << self.bits) - 1)
        self.array = pa.array(tokens, pa.large_binary())

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    @classmethod
    @lru_cache(2)
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
        return cls([ranks[i] for i in range(len(ranks))])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left << 32 | right
        slot = self.slot(key)
        i = self.slots[slot]
        hit = self.keys[i] == key
        rank = np.where(hit & (i >= 0), self.joined[i], -1)
        at = np.flatnonzero(~hit & (i >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            i = self.slots[slot[at]]
            hit = self.keys[i] == key[at]
            rank[at] = np.where(hit & (i >= 0), self.joined[i], -1)
            at = at[~hit & (i >= 0)]
        return rank


def replay(vocabulary: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, and the n + 1 offsets of each word's, for words given as bytes and offsets."""
    n = len(data)
    sym = vocabulary.bytes[data]
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    nxt[off[1:][np.diff(off) > 0] - 1] = -1
    prv[off[:-1][np.diff(off) > 0]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = vocabulary.pair(sym[at], sym[nxt[at]])
        ok = rank >= 0
        at, rank = at[ok], rank[ok]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for a, b in zip(cut, cut[1:]):
            r = int(rank[a])
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(heap, r)

    enter(np.flatnonzero(nxt >= 0))
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        p = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
        p = p[alive[p]]
        p = p[nxt[p] >= 0]
        p = p[vocabulary.pair(sym[p], sym[nxt[p]]) == r]
        if not len(p):
            continue
        q = nxt[p]
        chained = q[:-1] == p[1:]
        if chained.any():  # of pairs that overlap, as in a a a, every other one from the left
            head = np.append(True, ~chained)
            nth = np.arange(len(p)) - np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))
            p = p[nth % 2 == 0]
            q = nxt[p]
        after = nxt[q]
        sym[p] = r
        alive[q] = False
        nxt[p] = after
        has = after >= 0
        prv[after[has]] = p[has]
        before = prv[p]
        enter(np.unique(np.concatenate([before[before >= 0], p[has]])))
    kept = np.flatnonzero(alive)
    return sym[kept], np.searchsorted(kept, off)


def text_buffers_of_binary(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = words.cast(pa.large_binary())
    off = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    return np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def decode(ids: np.ndarray, off: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of each text."""
    body, at = text_buffers_of_binary(vocabulary.array.take(pa.array(ids))) if len(ids) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return [body[at[a] : at[b]].tobytes() for a, b in zip(off, off[1:])]


PASSED = "key long, block long, bucket int, docs binary, none binary, gone binary, first binary, route binary, codes binary, words binary, sizes binary, sound binary"
_NAMES = [f.split()[0] for f in PASSED.split(", ")]
_KINDS = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 9)


def squeeze(x: np.ndarray) -> bytes:
    """Integers below 2^32 by planes of their bytes, compressed."""
    x = np.ascontiguousarray(x, np.uint32)
    return pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def unsqueeze(data: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def cut(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts (doc_id, text): a row with the texts as codes of the block's words, and one for the words of each range.

    Words have their range as key, texts one of their own, below 0, with which they pass through merge().
    """
    block, codec = TaskContext.get().partitionId() << 24, pa.Codec("zstd", compression_level=3)
    for b in batches:
        for part in slices(b, 1):
            texts, docs = part.column(1), part.column(0)
            data, off = text_buffers(texts)
            starts = word_starts(data, off)
            edges = np.append(starts, len(data)).astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            codes = coded.indices.to_numpy()
            often = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")  # small codes are frequent
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            words = coded.dictionary.take(pa.array(often))
            route = np.fromiter((xxhash.xxh3_64_intdigest(w) % ranges for w in words.to_pylist()), np.int64, len(words))
            none, gone = (x.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() for x in (docs, texts))
            first = np.searchsorted(starts, off).astype(np.int64).tobytes()
            rows = [(-1 - block, block, -1, docs.fill_null(0).to_numpy().tobytes(), none, gone, first, squeeze(route), squeeze(rank[codes]), None, None, None)]
            order = np.argsort(route, kind="stable")
            body, at = text_buffers_of_binary(words.take(pa.array(order)))
            size = np.diff(at)
            edge = np.append(np.flatnonzero(np.append(True, np.diff(route[order]) != 0)), len(order)) if len(order) else [0]
            for x, y in zip(edge, edge[1:]):
                bucket, said = int(route[order[x]]), codec.compress(body[at[x] : at[y]].tobytes(), asbytes=True)
                rows.append((bucket, block, bucket, *[None] * 6, said, pa.py_buffer(np.uint32([y - x])).to_pybytes() + squeeze(size[x:y]), None))
            block += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)


def merge(batches: list[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Of a range: the tokens of each block's words there, and which words they don't decode to, if any. A block's texts come out as they are."""
    blocks, said, sizes = [], [], []
    for b in batches:
        if b.num_rows and b.column(0)[0].as_py() < 0:
            yield b
            continue
        for i in range(b.num_rows):
            packed = b.column(10)[i].as_buffer()
            sizes.append(unsqueeze(packed.slice(4), int(np.frombuffer(packed, np.uint32, 1)[0])))
            said.append(pa.decompress(b.column(9)[i].as_buffer(), int(sizes[-1].sum()), "zstd", asbytes=True))
            blocks.append((b.column(1)[i].as_py(), b.column(2)[i].as_py()))
    if not blocks:
        return
    size = np.concatenate(sizes)
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(b"".join(said))]).dictionary_encode()
    data, off = text_buffers_of_binary(coded.dictionary)
    ids, ioff = replay(vocabulary, data, off)
    back, at = text_buffers_of_binary(vocabulary.array.take(pa.array(ids)))
    sound = at[ioff] == off  # where tokens end and words do
    sound = sound[:-1] & sound[1:]
    if len(back) != len(data) or not (same := back == data).all():
        sound &= np.array([len(back) == len(data) and bool(same[x:y].all()) for x, y in zip(off, off[1:])], bool)
    code, done = coded.indices.to_numpy(), 0
    count = np.diff(ioff)
    for (block, bucket), s in zip(blocks, sizes):
        own = code[done : done + len(s)]
        done += len(s)
        n = count[own]
        flat = ids[np.repeat(ioff[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        row = (0, block, bucket, *[None] * 6, squeeze(flat), pa.py_buffer(np.uint32([len(n)])).to_pybytes() + squeeze(n), b"" if sound[own].all() else sound[own].astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _KINDS)], _NAMES)


def assemble(rows: pa.Table) -> pa.Table:
    """The result's rows of a block, from its texts' codes and its words' tokens by range."""
    out = []
    rows = rows.combine_chunks()
    at = dict(zip(rows.column(2).to_pylist(), range(rows.num_rows)))
    if -1 in at:
        i = at.pop(-1)
        said = [rows.column(c)[i].as_buffer() for c in range(3, 9)]
        docs, none, gone, first = (np.frombuffer(x, k) for x, k in zip(said, (np.int64, np.uint8, np.uint8, np.int64)))
        parts = [[rows.column(c)[j].as_buffer() for c in (9, 10, 11)] for _, j in sorted(at.items())]
        counts = [unsqueeze(p[1].slice(4), int(np.frombuffer(p[1], np.uint32, 1)[0])) for p in parts]
        ids = [unsqueeze(p[0], int(n.sum())) for p, n in zip(parts, counts)]
        sound = [np.frombuffer(p[2], np.uint8) if len(p[2]) else np.ones(len(n), np.uint8) for p, n in zip(parts, counts)]
        nothing = np.zeros(0, np.int64)
        counts, ids, sound = (np.concatenate([*x, nothing]) for x in (counts, ids, sound))
        order = np.argsort(unsqueeze(said[4], len(counts)), kind="stable")
        many, begin, good = (np.zeros(len(counts), np.int64) for _ in range(3))
        many[order], begin[order], good[order] = counts, np.cumsum(counts) - counts, sound
        code = unsqueeze(said[5], int(first[-1]))
        n = many[code]
        done = np.append(0, np.cumsum(n))
        flat = ids[np.repeat(begin[code] - done[:-1], n) + np.arange(done[-1])].astype(np.int32)
        off, bad = done[first], np.append(0, np.cumsum(good[code] == 0))[first]
        gone = gone.astype(bool)
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=np.append(gone, False)), pa.array(flat))
        out.append(pa.RecordBatch.from_arrays([pa.array(docs, mask=none.astype(bool)), pa.array(np.diff(off), mask=gone), lists, pa.array(np.diff(bad) == 0, mask=gone)], [f.split()[0] for f in SCHEMA.split(", ")]))
    return pa.Table.from_batches(out)


def bpe_encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): the whole text's tokens, and whether they decode to the text's bytes.

    The vocabulary is a file of base64 tokens with their ranks, which every executor must be able to read at ``path``. No
    special tokens: their strings are ordinary text. An empty text has no tokens; a null text has null tokens and a null
    count. Null doc_ids are reported as null and equal rows each; a doc_id is an integer. Other columns, whatever their names, are
    ignored. No row, no result.
    """
    ranges = buckets(docs, text, 32 << 20, 1)
    blocks = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(lambda bs: trimmed(cut(bs, ranges)), PASSED)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed(merge(list(batches), Vocabulary.load(path)))

    return blocks.groupBy("key").applyInArrow(merged, PASSED).groupBy("block").applyInArrow(assemble, SCHEMA)


def bpe_decode(encoded: DataFrame, path: str = VOCABULARY, ids: str = "token_ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) from token ids; null ids give a null text, none an empty one; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            off = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=off[1:])
            gone = lists.is_null().to_pylist()
            out = [None if g else x.decode("utf-8", "replace") for x, g in zip(decode(flat, off, vocabulary), gone)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{ids}`")).mapInArrow(run, "doc_id long, text string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
