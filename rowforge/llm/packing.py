"""Best-fit packing of documents into sequences by bin completion.

Only lengths matter to the packing, and there are fewer than ``capacity`` of them however large the corpus is. So the
search runs on the histogram of lengths, a table of bounded size: it answers with fillings and how often each is used.
Documents are then ranked among those of their length, and a document's rank alone says which bin and offset it gets.
The texts are read once, to count words, and never moved. Ranks come from places in sorted files, so a length that a
third of all documents have is spread over as many files as it needs.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, content_key

CAPACITY = 2048
WORK = 16_000_000  # steps of the search: about 10 seconds
SCHEMA = "bin_id long, bin_start long, doc_id long, piece long, start_token long, n_tokens long, bins long, least_bins long"
_NODE = 250  # steps of what is done once a node, about a microsecond each
_HELD = 64  # nodes of the stack whose enumerations are held; those further up are begun again when the search comes back

Filling = tuple[int, ...]


class Packing(NamedTuple):
    """Fillings and how many bins have each; no packing has fewer than ``least`` bins."""

    fillings: list[tuple[Filling, int]]
    bins: int
    least: int


def sums(reach: int, x: int, many: int) -> int:
    """Bits of the sums that up to ``many`` items of length x add to those of ``reach``."""
    step = 1
    while many > 0:
        n = min(step, many)
        reach |= reach << (x * n)
        many -= n
        step *= 2
    return reach


def span(bits: int, width: int) -> int:
    """Bits from 1 to ``width`` above any bit."""
    out, done = bits << 1, 1
    while done < width:
        n = min(done, width - done)
        out |= out << n
        done += n
    return out


def dominated(filling: Filling, free: int, room: int) -> bool:
    """Whether some items of the filling, or none, could give way to one length of ``free``, bits of those left over.

    That is so exactly if the filling is dominated: if another one packs its items into bins of the sizes of its own items.
    An item of the same size as all that give way is no improvement if it is one item for one, else it is.
    """
    waste = room - sum(filling)
    any_sum = 1  # of any items
    two = 0  # of two items or more
    for x in filling:
        two |= (any_sum & ~1) << x | two << x
        any_sum |= any_sum << x
    return bool(free & two) or (waste > 0 and bool(free & span(any_sum, waste)))


def completions(counts: dict[int, int], room: int, wasted: int, step=lambda n: None) -> Iterator[Filling]:
    """The undominated fillings of ``room`` that leave at most ``wasted`` of it, least waste first, then largest items first.

    Each total is enumerated on its own: bits tell which totals the lengths up to each can still make, so no branch ends
    without a filling, and what is enumerated for a total costs steps in its own number. ``step`` is told of the work.
    """
    have = sorted(x for x, c in counts.items() if c > 0 and x <= room)
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for x in have:
        reach.append(sums(reach[-1], x, min(counts[x], room // x)) & mask)
    step(_NODE + len(have))
    available = sum(1 << x for x in have)

    def make(total: int, upto: int) -> Iterator[Filling]:
        """Fillings of a total from the first ``upto`` lengths."""
        if not total:
            yield ()
            return
        top = bisect_right(have, total, 0, upto)
        # lengths below ``low`` can't make the total without a larger one
        low = bisect_left(reach, 1, 1, top + 1, key=lambda r: r >> total & 1) - 1
        for j in range(top - 1, low - 1, -1):
            x = have[j]
            for many in range(min(counts[x], total // x), 0, -1):
                step(1)
                if reach[j] >> (total - many * x) & 1:
                    for rest in make(total - many * x, j):
                        yield (x,) * many + rest

    for total in range(room, max(room - wasted, 0) - 1, -1):
        if not reach[-1] >> total & 1:
            continue
        for filling in make(total, len(have)):
            step(1 + len(filling))
            free = available
            for x in set(filling):
                if filling.count(x) == counts[x]:
                    free ^= 1 << x
            if not dominated(filling, free, room):
                yield filling


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: for each k, items above capacity - k are alone but for those below k, which aren't counted."""
    if not counts:
        return 0
    x = np.array(sorted(counts), np.int64)
    c = np.array([counts[v] for v in x.tolist()], np.int64)
    many, total = (np.concatenate([[0], np.cumsum(v)]) for v in (c, c * x))
    half = int(np.searchsorted(x, capacity // 2, "right"))
    first = np.arange(half + 1)  # k is nothing or one of the lengths up to half
    k = np.append(x[:half], 0)
    first[half] = 0
    alone = np.searchsorted(x, capacity - k, "right")
    free = (many[alone] - many[half]) * capacity - (total[alone] - total[half])  # room beside those that are more than half
    more = -((free - (total[half] - total[first])) // capacity)
    return max(-(-int(total[-1]) // capacity), int(many[-1] - many[half]) + max(0, int(more.max())))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing on the histogram: longest first, each into the fullest bin that has room; bins filled alike move together."""
    rooms: dict[int, list[tuple[Filling, int]]] = {}
    order: list[int] = []  # the rooms that bins have, ascending

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            order.insert(bisect_left(order, room), room)
        rooms[room].append((filling, n))

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            i = bisect_left(order, x)
            if i == len(order):
                room, filling, n = capacity, (), left  # new bins
            else:
                room = order[i]
                filling, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[i]
            each = min(room // x, left)
            used = min(n, left // each)
            put(room - each * x, filling + (x,) * each, used)
            left -= each * used
            if n > used and filling:
                put(room, filling, n - used)
    return [f for group in rooms.values() for f in group]


class _Spent(Exception):
    pass


class _Node:
    """A choice of the search: the fillings around the largest length, each as often as the counts allow and, for another branch, once."""

    __slots__ = ("branches", "tried", "done", "waste")

    def __init__(self) -> None:
        self.branches: Iterator[tuple[Filling, int]] | None = None
        self.tried, self.done, self.waste = 0, None, 0


def pack_lengths(counts: dict[int, int], capacity: int, work: int = WORK) -> Packing:
    """A packing of lengths from 1 to capacity, given with their counts.

    Depth-first branch and bound. The incumbent is best fit decreasing until the search beats it. A node closes bins around the
    largest length left, with each undominated filling in order of waste, as often as the counts allow and, as another branch,
    once. Bins that beat the incumbent leave at most (its bins - 1) * capacity - all tokens of waste: a filling that
    would exceed this isn't enumerated, and a node whose bins and least bins of the rest don't beat it is left. The search ends
    when the incumbent has the least bins, when it has seen everything, or after ``work`` steps, for the problem is NP-hard; in
    the last case bins may be more than least, and the result says so.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    total = sum(n * c for n, c in counts.items())
    if not total:
        return Packing([], 0, 0)
    if max(counts) > capacity:
        raise ValueError("a length above the capacity")
    least, best = least_bins(counts, capacity), best_fit(counts, capacity)
    best_bins = sum(n for _, n in best)
    if best_bins == least:
        return Packing(best, best_bins, least)
    left, steps = dict(counts), 0

    def step(n: int) -> None:
        nonlocal steps
        steps += n
        if steps > work:
            raise _Spent

    def branches(node: _Node) -> Iterator[tuple[Filling, int]]:
        first = max(left)
        left[first] -= 1
        own = {x: c for x, c in left.items() if c}
        left[first] += 1
        for rest in completions(own, capacity - first, (best_bins - 1) * capacity - total - node.waste, step):
            filling = (first, *rest)
            times = min(left[x] // filling.count(x) for x in set(filling))
            yield filling, times
            if times > 1:
                yield filling, 1

    def move(filling: Filling, times: int, back: bool = False) -> None:
        for x in filling:
            c = left.get(x, 0) + (times if back else -times)
            if c:
                left[x] = c
            else:
                left.pop(x, None)

    stack, bins = [_Node()], 0
    try:
        while stack and best_bins > least:
            node = stack[-1]
            if node.done:
                move(*node.done, back=True)
                bins -= node.done[1]
                node.done = None
            if node.branches is None:
                node.branches = islice(branches(node), node.tried, None)
            choice = next(node.branches, None)
            if choice is None:
                stack.pop()
                continue
            node.tried += 1
            filling, times = choice
            step(_NODE)
            waste = node.waste + (capacity - sum(filling)) * times
            if waste > (best_bins - 1) * capacity - total:
                continue
            move(filling, times)
            bins += times
            node.done = choice
            step(_NODE + len(left))
            if not left:
                best = [n.done for n in stack]
                best_bins = bins
            elif bins + least_bins(left, capacity) < best_bins:
                below = _Node()
                below.waste = waste
                stack.append(below)
                if len(stack) > _HELD:
                    stack[-_HELD - 1].branches = None
    except _Spent:
        pass
    return Packing(best, best_bins, least if stack else best_bins)


def slots(fillings: list[tuple[tuple[int, ...], int]], first_bin: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: start ranks, first bins, bins a filling, start offsets; a rank's entry is the last that starts at or before it."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    for filling, times in fillings:
        at = 0
        for x in filling:
            rows.setdefault(x, []).append((used.get(x, 0), first_bin, times, at))
            used[x] = used.get(x, 0) + times
            at += x
        first_bin += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def ranked(lengths: DataFrame, key: str, work: Workspace) -> tuple[DataFrame, list]:
    """Rows with a key, sorted by it, doc_id (nulls last) and content, with ``file`` and ``row``; and (file, key, row, count) of each key's stretches in order.

    A stretch is a key's rows in one file, so there are fewer of them than files and keys together. Rows of one key and
    equal rows go to as many files as they fill, as their places in the input part them.
    """
    order = [key, F.col("doc_id").isNull(), "doc_id", "tie", F.monotonically_increasing_id()]
    rows = lengths.where(F.col(key) > 0).select("doc_id", "tie", "rest", "full")
    sorted_ = work.write(rows.repartitionByRange(*order).sortWithinPartitions(*order), f"by-{key}")
    placed = sorted_.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    first = F.min(F.struct("row", F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    found = placed.groupBy("file", key).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("c"), first).collect()
    found.sort(key=lambda r: (r[key], r["first"]["none"], r["first"]["doc_id"] or 0, r["first"]["tie"], r["file"]))
    return placed, [(r["file"], r[key], r["row"], r["c"]) for r in found]


def best_fit_packing(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, work: int = WORK) -> DataFrame:
    """Bins of at most ``capacity`` words: one row for each piece of a document, with its bin and offset there.

    A document longer than the capacity is cut into full pieces, each a bin of its own, and a remainder, which is packed like
    a short document; pieces count from 0. Documents without words, and null texts, need no room and have no row. Rows with
    a null doc_id are packed and reported as null; equal rows are packed each for itself. Among documents of one length the
    smaller doc_id (nulls last) is placed first. Other columns, whatever their names, are ignored. No row, no result.

    ``bins`` and ``least_bins``, the same in all rows, are how many bins there are and a bound that no packing of these
    pieces is below: the packing is proven the best if they are equal. ``work`` limits the search's steps, not what is packed;
    a search that ends at it leaves its best packing, with bins above least_bins.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    lengths = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), content_key(docs).alias("tie"), F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^ \t\n\f\r]+")).cast("long").alias("n")
    ).where("n > 0").select("doc_id", "tie", F.floor(F.col("n") / capacity).cast("long").alias("full"), (F.col("n") % capacity).alias("rest"))
    lengths = space.write(lengths, "lengths")
    whole, whole_at = ranked(lengths, "full", space)
    short, short_at = ranked(lengths, "rest", space)

    bases, next_bin = [], 0  # of each stretch of whole pieces, its first bin
    for file, k, row, c in whole_at:
        bases.append((file, k, row, next_bin))
        next_bin += k * c
    by_rest: dict[int, int] = {}
    ranks = []
    for file, k, row, c in short_at:
        ranks.append((file, k, row, by_rest.get(k, 0)))
        by_rest[k] = by_rest.get(k, 0) + c
    packing = pack_lengths(by_rest, capacity, work)
    place = slots(packing.fillings, next_bin)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    of_all = [F.lit(next_bin + packing.bins).cast("long").alias("bins"), F.lit(next_bin + packing.least).cast("long").alias("least_bins")]

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, full, r = (b.column(c).to_numpy() for c in (1, 2, 3))
            bins, at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for x in np.unique(n):
                who = np.flatnonzero(n == x)
                start, first, times, offset = place[int(x)]
                i = np.searchsorted(start, r[who], "right") - 1
                bins[who], at[who] = first[i] + r[who] - start[i], offset[i]
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(at), b.column(0), b.column(2), pa.array(full * capacity), b.column(1)], names[:-2])

    at = spark.createDataFrame(ranks, "file string, rest long, first long, base long")
    rank = (F.col("base") + F.col("row") - F.col("first")).alias("rank")
    ends = short.join(F.broadcast(at), ["file", "rest"]).select("doc_id", "rest", "full", rank).mapInArrow(rests, SCHEMA.partition(", bins")[0]).select("*", *of_all)
    at = spark.createDataFrame(bases, "file string, full long, first long, base long")
    pieces = whole.join(F.broadcast(at), ["file", "full"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    full = pieces.select(
        (F.col("base") + (F.col("row") - F.col("first")) * F.col("full") + F.col("piece")).alias("bin_id"), F.lit(0).cast("long").alias("bin_start"), "doc_id", "piece",
        (F.col("piece") * capacity).alias("start_token"), F.lit(capacity).cast("long").alias("n_tokens"), *of_all,
    )
    return ends.unionByName(full.select(*names))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
