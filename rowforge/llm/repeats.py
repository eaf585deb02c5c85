"""Suffix-array dedup: repeated windows by a depth-limited radix sort.

Of the suffix array only the order through the first ``window`` words is needed: suffixes that agree that far are the
repeated windows. Every word starts a suffix. Suffixes go to hash ranges by their window's minimizer, the least hash of its
runs of a few words, so equal windows meet, and neighbours that share a minimizer travel as one run with its words once.
In a range the words are coded by a dictionary, and a pass for each two words of depth, most significant first, splits the
groups by those words' codes; a suffix alone in its group is dropped at once, so later passes see few, and groups that a pass doesn't
split aren't sorted again. The groups left after the last pass are equal windows, word by word. Hashes only route.

Hot passages: a task's equal runs are combined before the shuffle, as only the first of them can be the first of all. A
minimizer that a sample shows to be in very many runs routes nothing: its windows go each by the hash of all their words, so
those that straddle the passage's ends are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST, U64, Words, Workspace, buckets, fits, fresh, slices, spread, trimmed

WINDOW = 50
RUN = 10  # words of a minimizer, of half the window if that is less
HOT = 20_000  # runs of a minimizer that is split
SAMPLE = 64  # one row of so many is looked at for such minimizers
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_FLUSH = 1 << 20  # suffixes
RANGE = 6 << 20  # bytes of text a hash range, whose runs have some three times as many
_COLS = ("docs", "none", "texts", "run_doc", "run_start", "run_size", "run_kind", "run_bytes")
_KINDS = (np.int64, np.uint8, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint32)  # a run may be as long as its text
PACKED = "bucket int, " + ", ".join(f"{c} binary" for c in (*_COLS, "words"))
_PLAIN, _AGAIN, _KNOWN = range(3)  # a run; one that its task has again, later; one that its task has had before, without its words


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, where so many follow; texts aren't looked at."""
    n = len(h)
    if n < size:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, _BASE, U64))
        back = np.cumprod(np.full(n, _BACK, U64))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(h * power, dtype=U64)])
        return spread((total[size:] - total[:-size]) * back[: n - size + 1])


def least_within(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of the ``size`` values from each on, where so many follow."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    wide = np.concatenate([x, np.full(-len(x) % size, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, size)
    ahead = np.minimum.accumulate(wide, 1).ravel()
    behind = np.minimum.accumulate(wide[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def pick(data: np.ndarray, begin: np.ndarray, many: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Stretches of bytes one after another, some ``most`` bytes at a time, as their places take more memory than they do."""
    upto = np.cumsum(many)
    out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint8)
    cut = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(many)]
    kind = np.int32 if len(data) < 1 << 30 else np.int64
    for a, b in zip(cut, cut[1:]):
        n = many[a:b]
        to = np.cumsum(n)
        at = np.repeat((begin[a:b] - to + n).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        lo = int(upto[a] - many[a]) if b > a else 0
        out[lo : lo + len(at)] = data[at]
    return out


class Runs:
    """Runs of neighbouring windows with one minimizer in a batch of texts: text, place, windows, minimizer and bytes of each."""

    def __init__(self, texts: pa.Array, window: int, hot: np.ndarray | None = None):
        words = Words(texts)
        h = words.hashes()
        size = max(1, min(RUN, window // 2))
        many = np.maximum(words.counts - window + 1, 0)
        doc = np.repeat(np.arange(len(many)), many)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        at = start + words.first[doc]
        low = least_within(run_hashes(h, size), window - size + 1)[at]
        edge = np.append(True, (doc[1:] != doc[:-1]) | (low[1:] != low[:-1]))[: len(doc)]
        if hot is not None and len(hot):
            split = np.isin(low, hot)
            edge |= split
            edge[1:] |= split[:-1]
        head = np.flatnonzero(edge)
        self.size = np.diff(np.append(head, len(doc)))
        self.doc, self.start, self.route = doc[head], start[head], low[head]
        if hot is not None and len(hot):
            own = split[head]
            self.route[own] = run_hashes(h, window)[at[head[own]]]
        self.data = words.data
        self.begin, self.end = words.starts[at[head]], words.ends[at[head] + self.size + window - 2]

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs' words, with the white space between them, run after run, and the bytes of each run."""
        n = self.end - self.begin
        return pick(self.data, self.begin, n), n


def pack(batches: Iterator[pa.RecordBatch], window: int, ranges: int, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of (doc_id, text, text hash) by hash range, once for all that are equal in a block of texts."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        ids, none, texts, doc, start, size, route, data, many = (np.concatenate(c) for c in zip(*held))
        bucket = (route % U64(ranges)).astype(np.int64)
        at = np.append(0, np.cumsum(many))
        code = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
        order = np.lexsort((start, texts[doc], ids[doc], none[doc], code))
        where = np.stack([none[doc], ids[doc], texts[doc], start])[:, order]
        new = np.append(True, code[order][1:] != code[order][:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        other = (where != where[:, first]).any(0)  # not the same document's, as equal rows are one
        kind = np.full(len(doc), _PLAIN, np.uint8)
        kind[order[first[other]]] = _AGAIN
        kind[order[~new]] = _KNOWN
        gone = np.zeros(len(doc), bool)
        gone[order[~new & ~other]] = True
        known = kind == _KNOWN
        bucket[known] = (spread((ids ^ texts)[doc[known]].view(U64)) % U64(ranges)).astype(np.int64)
        order = np.flatnonzero(~gone)
        order = order[np.argsort(bucket[order], kind="stable")]
        cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order))
        rows, codec = [], pa.Codec("zstd", compression_level=1)
        for a, b in zip(cut, cut[1:]):
            own = order[a:b]
            used, back = np.unique(doc[own], return_inverse=True)
            with_words = own[kind[own] != _KNOWN]
            said = pick(data, at[with_words], many[with_words]).tobytes()
            values = (ids[used], none[used], texts[used], back, start[own], size[own], kind[own], np.where(kind[own] == _KNOWN, 0, many[own]))
            rows.append((int(bucket[own[0]]), *(v.astype(k).tobytes() for v, k in zip(values, _KINDS)), codec.compress(said, asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], ["bucket", *_COLS, "words"])

    count = docs = 0
    for b in batches:
        for part in slices(b, 1, 4 << 20):
            runs = Runs(part.column(1), window, hot)  # of some bytes of text at a time
            if not len(runs.doc):
                continue
            ids = part.column(0)
            data, many = runs.bytes()
            none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((ids.fill_null(0).to_numpy(), none, part.column(2).to_numpy(), runs.doc + docs, runs.start, runs.size, runs.route, data, many))
            docs, count = docs + part.num_rows, count + int(runs.size.sum())
            if count >= _FLUSH:
                yield from flush()
                held.clear()
                count = docs = 0
    if held:
        yield from flush()


def minimizers(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The minimizers of the runs of texts, and how many runs have each."""
    for b in batches:
        for part in slices(b, 0):
            key, many = np.unique(Runs(part.column(0), window).route.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(many)], ["key", "c"])


def equal_groups(codes: np.ndarray, at: np.ndarray, flagged: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``window`` words another one has too, or that are flagged, group by group, and the group of each.

    A suffix is the place of its first word among the words' codes. A pass for each two words, the first first, sorts within groups.
    """
    own, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    alone: list[np.ndarray] = []
    wide = int(codes.max(initial=0)) + 1
    for depth in range(0, window, 2):
        digit = codes[at[own] + depth].astype(np.int64)
        if depth + 1 < window:
            digit = digit * wide + codes[at[own] + depth + 1]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        many = np.diff(np.append(head, len(group)))
        differs = digit != np.repeat(digit[head], many)
        if depth and not differs.any():
            continue
        split = np.repeat(np.logical_or.reduceat(differs, head), many) if len(head) else differs
        some = np.flatnonzero(split)
        order = some[np.lexsort((digit[some], group[some]))] if depth else some[np.argsort(digit[some])]
        own[some], digit[some] = own[order], digit[order]  # groups keep their places
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))[: len(group)]
        group = np.cumsum(new) - 1
        single = np.bincount(group)[group] == 1 if len(group) else np.zeros(0, bool)
        alone.append(own[single & flagged[own]])
        own, group = own[~single], group[~single]
        group = np.cumsum(np.append(True, group[1:] != group[:-1])[: len(group)]) - 1
    more = np.concatenate([*alone, np.zeros(0, np.int64)]).astype(np.int64)
    last = int(group[-1]) + 1 if len(group) else 0
    return np.concatenate([own, more]), np.concatenate([group, last + np.arange(len(more))])


def repeated_runs(batches: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """Of a hash range: (doc_id, text, start, stop, kept) for runs of windows that occur again; kept marks first occurrences."""
    cols: list[list[np.ndarray]] = [[] for _ in _COLS]
    said: list[bytes] = []
    docs, codec = 0, pa.Codec("zstd")
    for b in batches:
        for i in range(b.num_rows):
            values = [np.frombuffer(b.column(c + 1)[i].as_buffer(), k) for c, k in enumerate(_KINDS)]
            said.append(codec.decompress(b.column(len(_COLS) + 1)[i].as_buffer(), int(values[7].sum()), asbytes=True))
            values[3] = values[3].astype(np.int64) + docs
            docs += len(values[0])
            for c, v in zip(cols, values):
                c.append(v)
    ids, none, texts, doc, start, size, kind, many = (np.concatenate(c) for c in cols)
    start, size = start.astype(np.int64), size.astype(np.int64)
    known = np.flatnonzero(kind == _KNOWN)
    known = (ids[doc[known]], none[doc[known]], texts[doc[known]], start[known], start[known] + size[known] - 1, np.zeros(len(known), bool))
    fresh_ = np.flatnonzero(kind != _KNOWN)
    doc, start, size, kind, many = doc[fresh_], start[fresh_], size[fresh_], kind[fresh_], many[fresh_]
    at = np.append(0, np.cumsum(many, dtype=np.int64))
    words = Words(pa.Array.from_buffers(pa.large_string(), len(many), [None, pa.py_buffer(at), pa.py_buffer(b"".join(said))]))
    del said
    codes = words.array().dictionary_encode().indices.to_numpy() if len(words.starts) else np.zeros(0, np.int32)
    at = words.first
    del words
    run = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    own, group = equal_groups(codes, at[run] + nth, (kind == _AGAIN)[run], window)
    del codes
    run, nth = run[own], nth[own]
    again, place = kind[run] == _AGAIN, start[run] + nth
    a, z, t = ids[doc[run]], none[doc[run]], texts[doc[run]]
    order = np.lexsort((place, t, a, z, group))
    a, z, t, place, group, again = (x[order] for x in (a, z, t, place, group, again))
    same = lambda *xs: np.append(False, np.logical_and.reduce([x[1:] == x[:-1] for x in xs]))[: len(xs[0])]
    marked = np.bincount(group[again], minlength=int(group.max(initial=0)) + 1) > 0
    one = ~same(group, a, z, t, place)  # equal rows are one document
    a, z, t, place, group = (x[one] for x in (a, z, t, place, group))
    kept = ~same(group)
    other = np.append(kept[1:], True)[: len(kept)]
    more = ~(kept & other) | marked[group]
    a, z, t, place, kept = (x[more] for x in (a, z, t, place, kept))
    order = np.lexsort((place, kept, t, a, z))
    a, z, t, place, kept = (x[order] for x in (a, z, t, place, kept))
    joined = same(a, z, t, kept) & np.append(False, place[1:] == place[:-1] + 1)[: len(a)]
    head = np.flatnonzero(~joined)
    tail = np.append(head[1:], len(a)) - 1 if len(head) else head
    out = [np.concatenate(x) for x in zip((a[head], z[head], t[head], place[head], place[tail], kept[head]), known)]
    doc_id = pa.array(out[0], mask=out[1].astype(bool))
    return pa.RecordBatch.from_arrays([doc_id, *(pa.array(x) for x in out[2:])], ["doc_id", "text", "start", "stop", "kept"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, rf_text, start_word, end_word, kept): the words under windows of ``window`` words that occur more than once.

    A span is a union of windows that overlap or touch; end_word is exclusive. kept is true of the first occurrence of its
    windows, by doc_id (nulls last), text hash and place, and false of the others; a word can be under windows of both kinds.
    Windows may repeat within a document. A document of fewer words than a window has none, so null and empty texts have
    none. Rows with equal doc_id and text count as one document. rf_text is the text's hash, to tell rows with one
    doc_id apart. doc_id is an integer or a string of one. Other columns are ignored. No row, no result. ``hot`` and
    ``sample`` steer how windows are routed, not what is found: a minimizer that one row in ``sample`` leads to expect in
    ``hot`` runs is split.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    ranges = buckets(docs, text, RANGE)
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("h")).where("t IS NOT NULL")
    look = slim.where(F.pmod(F.xxhash64("d", "h", F.monotonically_increasing_id()), F.lit(sample)) == 0).select("t")
    found = look.mapInArrow(lambda bs: trimmed(minimizers(bs, window)), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    keys = found.where(F.col("c") * sample >= hot).orderBy(F.desc("c"), "key").limit(100_000).collect()
    split = np.sort(np.array([r["key"] for r in keys], np.int64).view(U64))
    packed = slim.mapInArrow(lambda bs: trimmed(pack(bs, window, ranges, split)), PACKED)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed([repeated_runs(list(batches), window)])

    runs = packed.groupBy("bucket").applyInArrow(reduce, "doc_id long, text long, start long, stop long, kept boolean")
    own = W.partitionBy("doc_id", "text", "kept").orderBy("start")
    ahead = F.max("stop").over(own.rowsBetween(W.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.coalesce(F.col("start") > ahead + window, F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "text", "kept", "island").agg(F.min("start").alias("start_word"), (F.max("stop") + window).alias("end_word"))
    return spans.select("doc_id", F.col("text").alias("rf_text"), "start_word", "end_word", "kept")


def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without spans of words, each given as a list of starts and ends in turn, and the white space after them."""
    words = Words(texts)
    out = []
    for i, own in enumerate(spans.to_pylist()):
        base, end = int(words.off[i]), int(words.off[i + 1])
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        kept, at = [], base
        for a, b in own or ():
            kept.append(words.data[at : words.starts[lo + a]].tobytes())
            at = int(words.starts[lo + b]) if lo + b < hi else end
        kept.append(words.data[at:end].tobytes())
        out.append(b"".join(kept).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars", broadcast_bytes: int = BROADCAST) -> DataFrame:
    """docs, in their columns, with every repeated window but its first occurrence cut from the texts.

    Spans are as in repeated_spans; where a span is cut, the white space after it goes too, and ``n_chars``, if there is
    such a column, counts what is left. A document that loses all its words goes; all others stay, untouched ones as they
    were. Equal rows fare alike. The cuts are broadcast if they take at most ``broadcast_bytes``, else joined by a shuffle.
    """
    work = Workspace(docs.sparkSession, "repeats")
    spans = repeated_spans(docs, window, text, doc_id).where("NOT kept")
    cuts = spans.groupBy("doc_id", "rf_text").agg(F.array_sort(F.collect_list(F.array("start_word", "end_word"))).alias("cuts"))
    cuts = work.write(cuts, "cuts")
    d, h, c = fresh(docs.columns, "rf_doc", "rf_text", "rf_cuts")
    cuts = cuts.select(F.col("doc_id").alias(d), F.col("rf_text").alias(h), F.col("cuts").alias(c))
    spans = cuts.agg(F.sum(F.size(c))).first()[0] or 0
    if fits(cuts, 64, broadcast_bytes - 48 * spans):
        cuts = F.broadcast(cuts)
    on = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(h))
    back = [F.col(f"`{x}`") for x in docs.columns]
    joined = docs.join(cuts, on, "left").select(*back, c)
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, at, 4 << 20)):
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[at] = cut(b.column(at), b.column(b.num_columns - 1)).cast(b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    edited = joined.where(F.col(c).isNotNull()).mapInArrow(lambda bs: trimmed(run(bs)), schema).where(F.col(f"`{text}`").rlike(r"[^ \t\n\f\r]"))
    if n_chars in docs.columns:
        edited = edited.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast(schema[n_chars].dataType))
    return joined.where(F.col(c).isNull()).select(*back).unionByName(edited.select(*back))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rf_text")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(len(w) - {WINDOW - 1})) AS pos FROM d WHERE len(w) >= {WINDOW}),
x AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + {WINDOW}], ' ')) AS k FROM p),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) = 1 AS kept FROM x),
m AS (SELECT doc_id, pos, kept, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, kept ORDER BY pos) + {WINDOW} THEN 0 ELSE 1 END AS new FROM g WHERE n > 1),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kept ORDER BY pos) AS island FROM m)
SELECT doc_id, min(pos)::BIGINT AS start_word, (max(pos) + {WINDOW})::BIGINT AS end_word, kept FROM i GROUP BY doc_id, kept, island
"""
