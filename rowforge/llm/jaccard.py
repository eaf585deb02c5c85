"""N-gram Jaccard join by T-occurrence search.

Rows of one text are one set of n-grams, known by the text's hash. If two sets reach the threshold t, each shares at least
T = ceil(t |set|) n-grams with the other, so a set with fewer than T n-grams that occur elsewhere has no partner. The
search is DivideSkip with the lists spread over hash ranges of n-grams:

1. Inverted lists: one row of each text goes on; its n-grams go to their hash ranges. Sets travel in blocks, and within a
   block's row a set is two bytes, so what an n-gram costs doesn't grow with the number of ranges.
2. Blocks gather the lengths of their sets' lists. A set short of T lists drops out. Of the others' lists the L = T - need
   longest are left for probing, where need = max(1, T - T / (mu log2 M + 1)) and M is the longest's length; lists that hold
   the set alone count as the shortest. With one order of lists for all sets, a pair then meets ``need`` times in short lists.
3. The short lists are heap-merged bucket by bucket, and pairs that occur in need of them, over all buckets, are
   candidates. A list goes to the bucket of its least set, so the lists that a group of near duplicates shares meet in few
   buckets and its pairs are counted there at once; lists so long that their pairs would burden one task are spread. Of a
   list's sets only those are paired that may still reach the overlap which a pair of their sizes requires, as each has
   so many lists from this one on; so a list that many short texts share makes no pairs that can't be similar.
4. Candidates are looked up in the long lists by binary search: in a part of the candidates, a set's long lists are
   probed in the partner's sorted n-grams. The occurrences in all lists are the overlap, which decides. A pair's part is the
   bucket where it was found, so a set is sent to few parts.

Groups of very many near duplicates have links as the square of their size, so classes and links are found without a row a
link. A long list names its least set as leader; sets that share enough of their n-grams with one leader are a cell. All pairs
in a cell are counted by blocks of two, as products of incidence matrices, of which only sums and a spanning forest go on; 1 to
4 find the pairs that no cell holds. A cell of which a sample shows few links is none. Cells decide how a pair is found, not which are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST, U64, Words, Workspace, buckets, content_key, fits, fresh, grams, row_order, slices, spread, trimmed

N, THRESHOLD, MU = 3, 0.5, 0.01
_FLUSH = 3 << 20  # n-grams
_PAIRS = 1 << 20
_SPREAD = 20  # bits of the squared length from which a list's bucket depends on the n-gram too
_BLOCK = 1024  # sets of one group whose pairs are verified together
CELL = 128  # sets of a cell, and of a list that names its leader, at least
_CELLS = 20_000  # the largest of them, as the driver holds them; sets of others are searched for as all are
_PROBES, _DENSE = 64, 0.05  # sets of a cell's sample, and the share of links among their pairs
_SIDE, _SIDE_BYTES = 2048, 4 << 20  # sets of a cell's block, and bytes of their n-grams


def sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 48-bit n-gram hashes of each text, none for a text without words."""
    h, off = grams(Words(texts), n)
    h = h >> U64(16)
    return [np.unique(h[a:b]) for a, b in zip(off, off[1:])]


def squeeze(gram: np.ndarray) -> bytes:
    """Six bytes an n-gram."""
    return gram.astype(np.uint32).tobytes() + (gram >> U64(32)).astype(np.uint16).tobytes()


def unsqueeze(data: pa.Buffer | bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint16, n, 4 * n).astype(U64) << U64(32) | np.frombuffer(data, np.uint32, n)


def required(size: np.ndarray, t: float) -> np.ndarray:
    """T: the least overlap of a set of a size with any partner."""
    return np.ceil(size * t - 1e-9).astype(np.int64)


def postings(batches: Iterator[pa.RecordBatch], n: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the sets of (text hash, text): by hash range, the n-grams of each set after another. One range gets the sets' names and sizes too."""
    held: list[np.ndarray] = []
    names: list[int] = []
    seen: set[int] = set()
    base, count = TaskContext.get().partitionId() << 20, 0

    def flush() -> pa.RecordBatch:
        nonlocal base
        size = np.array([len(x) for x in held], np.int64)
        gram = np.concatenate(held)
        own = np.repeat(np.arange(len(held), dtype=np.uint16), size)
        bucket = (gram % U64(ranges)).astype(route_kind(ranges))
        order = np.argsort(bucket, kind="stable")
        gram, own, bucket = gram[order], own[order], bucket[order]
        edge = np.searchsorted(bucket, np.arange(ranges + 1))
        main, rows = base % ranges, []
        for i in range(ranges):
            a, b = edge[i], edge[i + 1]
            if a == b and i != main:
                continue
            used, many = np.unique(own[a:b], return_counts=True)
            facts = (np.array(names, np.int64).tobytes(), size.astype(np.int32).tobytes()) if i == main else (b"", b"")
            rows.append((i, base, squeeze(gram[a:b]), used.tobytes(), narrow(many), *facts))
        base += 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 5))], _POSTED)

    for b in batches:
        for part in slices(b, 1):
            for h, x in zip(part.column(0).to_pylist(), sets(part.column(1), n)):
                if len(x) and h not in seen:
                    if held and (count + len(x) > _FLUSH or len(held) == 1 << 16):
                        yield flush()
                        held.clear()
                        names.clear()
                        seen.clear()
                        count = 0
                    seen.add(h)
                    held.append(x)
                    names.append(h)
                    count += len(x)
    if held:
        yield flush()


_POSTED = ["bucket", "block", "grams", "own", "counts", "names", "sizes"]
_SHORT = ["bucket", "grams", "own", "onward", "ids", "sizes", "needs", "cells"]
_LISTS = ["block", "grams", "own", "counts", "lengths", "routes", "leads", "names", "sizes"]
_DIVIDED = "id long, size int, need int, grams binary, short binary, routes binary, onward binary, lead long"


def narrow(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def widen(counts: pa.Buffer, own: np.ndarray) -> np.ndarray:
    return np.frombuffer(counts, np.uint16 if len(counts) == 2 * len(own) else np.uint32).astype(np.int64)


def inverted(batches: list[pa.RecordBatch], parts: int, cell: int = 0) -> Iterator[pa.RecordBatch]:
    """Of a hash range: its lists of two sets or more, as (n-gram, list length, bucket, leader) by set, block by block. Lists of fewer than ``cell`` sets have no leader, 0."""
    gram, code, facts = [], [], {}
    for b in batches:
        for i in range(b.num_rows):
            block = b.column(1)[i].as_py()
            g, own, counts, names, sizes = (b.column(c)[i].as_buffer() for c in range(2, 7))
            own = np.frombuffer(own, np.uint16)
            gram.append(unsqueeze(g))
            code.append(np.repeat(own.astype(np.int64) | block << 16, widen(counts, own)))
            if len(names):
                facts[block] = (names.to_pybytes(), sizes.to_pybytes())
    gram, code = np.concatenate(gram), np.concatenate(code)
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    equal = gram[1:] == gram[:-1]
    shared = (np.append(equal, False) | np.append(False, equal))[: len(gram)]
    gram, code = gram[shared], code[order[shared]]
    head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    many = np.diff(np.append(head, len(gram)))
    least = np.minimum.reduceat(code, head) if len(gram) else code
    wide = np.clip(many * many >> _SPREAD, 1, parts).astype(U64)
    route = (spread(least.view(U64) * U64(0x9E3779B97F4A7C15) + gram[head] % wide) % U64(parts)).astype(route_kind(parts))
    lead = np.where(many >= cell, spread(least.view(U64)) >> U64(32) | U64(1), U64(0)).astype(np.uint32) if cell else np.zeros(len(head), np.uint32)
    route, length, lead = np.repeat(route, many), np.repeat(np.minimum(many, 65535).astype(np.uint16), many), np.repeat(lead, many)
    order = np.lexsort((gram, code))
    gram, code, route, length, lead = gram[order], code[order], route[order], length[order], lead[order]
    block = code >> 16
    cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else [0]
    rows = []
    for a, b in zip(cut, cut[1:]):
        used, counts = np.unique(code[a:b] & 65535, return_counts=True)
        rows.append((int(block[a]), squeeze(gram[a:b]), used.astype(np.uint16).tobytes(), narrow(counts), length[a:b].tobytes(), route[a:b].tobytes(), lead[a:b].tobytes(), *facts.pop(int(block[a]), (b"", b""))))
    rows += [(block, b"", b"", b"", b"", b"", b"", *f) for block, f in facts.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 8))], _LISTS)


def route_kind(parts: int) -> type:
    return np.uint16 if parts <= 1 << 16 else np.uint32


def divide(batches: list[pa.RecordBatch], t: float, mu: float, parts: int) -> Iterator[pa.RecordBatch]:
    """Of a block: all its sets with their sizes; those with T shared n-grams also with these in order, the short lists among them with their buckets, need, and the leader that near of their n-grams share, if any."""
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    names = size = np.zeros(0, np.int64)
    for b in batches:
        for i in range(b.num_rows):
            g, own, counts, lengths, routes, leads, said, sizes = (b.column(c)[i].as_buffer() for c in range(1, 9))
            own = np.frombuffer(own, np.uint16)
            for col, v in zip(cols, (np.repeat(own, widen(counts, own)), unsqueeze(g), np.frombuffer(lengths, np.uint16), np.frombuffer(routes, route_kind(parts)), np.frombuffer(leads, np.uint32))):
                col.append(v)
            if len(said):
                names, size = np.frombuffer(said, np.int64), np.frombuffer(sizes, np.int32)
    own, gram, length, route, lead = (np.concatenate(x) for x in cols)
    leader = leaders(own, lead, size, max(0.25, (3 * t - 1) / (1 + t)))  # two links from a set of equal size, at least
    del lead, cols
    order = np.lexsort((gram, length, own))
    own, gram, length, route = own[order], gram[order], length[order], route[order]
    edge = np.searchsorted(own, np.arange(len(names) + 1))
    rows, weight = [], 0
    for i, (name, s, need_all) in enumerate(zip(names.tolist(), size.tolist(), required(size, t).tolist())):
        a, b = edge[i], edge[i + 1]
        if b - a < need_all:
            rows.append((name, s, None, None, None, None, None, None))
            continue
        longest = int(length[b - 1])
        long = min(need_all - 1, int(need_all / (mu * math.log2(longest) + 1)))
        mine = gram[a:b]
        onward = np.minimum(np.arange(b - a, long, -1), 65535).astype(np.uint16)  # lists from each on; 65535 may be more
        rows.append((name, s, need_all - long, squeeze(np.sort(mine)), squeeze(mine[: len(mine) - long]), route[a : b - long].tobytes(), onward.tobytes(), leader[i] or None))
        weight += 16 * int(b - a)
        if weight > 8 << 20:
            yield _divided(rows)
            rows, weight = [], 0
    yield _divided(rows)


def _divided(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], ["id", "size", "need", "grams", "short", "routes", "onward", "lead"])


def leaders(own: np.ndarray, lead: np.ndarray, size: np.ndarray, near: float) -> list[int]:
    """Of each set the leader that most of its lists name, if they are ``near`` of its size, or 0."""
    out = np.zeros(len(size), np.int64)
    some = lead > 0
    key, many = np.unique(own[some].astype(np.int64) << 32 | lead[some], return_counts=True)
    order = np.lexsort((many, key >> 32))
    last = order[np.append(np.diff(key[order] >> 32) != 0, True)[: len(order)]]
    last = last[many[last] >= near * size[key[last] >> 32]]
    out[key[last] >> 32] = key[last] & 0xFFFFFFFF
    return out.tolist()


def short_lists(batches: Iterator[pa.RecordBatch], parts: int, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets' short lists by bucket, each with its sets' sizes, needs and cells (0: none) once. cells: sorted leaders."""
    for b in batches:
        short = [unsqueeze(x) for x in b.column(4).to_pylist()]
        at = np.array([len(x) for x in short], np.int64)
        gram = np.concatenate(short) if short else np.zeros(0, U64)
        if not len(gram):
            continue
        bucket = np.frombuffer(b"".join(b.column(5).to_pylist()), route_kind(parts)).astype(np.int32)
        onward = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint16)
        ids, size, need = (b.column(c).to_numpy() for c in range(3))
        lead = b.column(7).fill_null(0).to_numpy()
        cell = np.searchsorted(cells, lead)
        cell = np.where(np.append(cells, -1)[cell] == lead, cell + 1, 0)
        own = np.repeat(np.arange(b.num_rows), at)
        order = np.lexsort((gram, bucket))
        gram, own, bucket, onward = gram[order], own[order], bucket[order], onward[order]
        cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket))
        rows = []
        for x, y in zip(cut, cut[1:]):
            used, back = np.unique(own[x:y], return_inverse=True)
            g = gram[x:y]
            code = back.astype(np.uint32 if len(used) > 65535 else np.uint16)
            facts = (ids[used], size[used].astype(np.int32), need[used].astype(np.int32), cell[used].astype(np.int32))
            rows.append((int(bucket[x]), squeeze(g), *(v.tobytes() for v in (code, onward[x:y], *facts))))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], _SHORT)


def _expand(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Ranges start, start + 1, ... of the given lengths, one after another."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


def most_common(of: np.ndarray, cell: np.ndarray, many: int) -> np.ndarray:
    """Of each of ``many`` lists the cell of most of its sets that have one, or 0."""
    out = np.zeros(many, np.int64)
    some = cell > 0
    key, count = np.unique(of[some] << 32 | cell[some], return_counts=True)
    order = np.lexsort((count, key >> 32))
    out[key[order] >> 32] = key[order] & 0xFFFFFFFF  # the last of a list stays
    return out


def merge(batches: list[pa.RecordBatch], t: float, parts: int) -> Iterator[pa.RecordBatch]:
    """Of a bucket: pairs of sets in its short lists, with how many lists hold both; those that can't be similar, or are of one cell, are left out.

    The arrivals are sorted, so a heap merges their pieces of lists into whole lists. Lists with one least set are taken
    together: where they have many sets in common, the product of their incidence matrix with itself counts all pairs.
    """
    name, pieces, facts = int(batches[0].column(0)[0].as_py()), [], []
    for b in batches:
        for i in range(b.num_rows):
            gram, own, onward, names, size, need, *cells = (b.column(c)[i].as_buffer() for c in range(1, b.num_columns))
            names = np.frombuffer(names, np.int64)
            own = np.frombuffer(own, np.uint32 if len(names) > 65535 else np.uint16)
            pieces.append((unsqueeze(gram), names[own], np.frombuffer(onward, np.uint16)))
            facts.append((names, np.frombuffer(size, np.int32), np.frombuffer(need, np.int32), np.frombuffer(cells[0], np.int32) if cells else np.zeros(len(names), np.int32)))
    known, first = np.unique(np.concatenate([f[0] for f in facts]), return_index=True)  # in order of id
    size, need, cell = (np.concatenate([f[k] for f in facts])[first].astype(np.int64) for k in (1, 2, 3))
    base, runs = 0, []
    for g, *_ in pieces:
        cut = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        runs.append(zip(g[cut].tolist(), (cut + base).tolist(), np.diff(np.append(cut, len(g))).tolist()))
        base += len(g)
    merged = np.array(list(heapq.merge(*runs)), dtype=object).reshape(-1, 3) if len(pieces) > 1 else np.array(list(runs[0]), dtype=object).reshape(-1, 3)
    begin, many = merged[:, 1].astype(np.int64), merged[:, 2].astype(np.int64)
    gram = merged[:, 0].astype(U64)
    at = _expand(begin, many)
    own = np.searchsorted(known, np.concatenate([p[1] for p in pieces]))[at]
    onward = np.concatenate([p[2] for p in pieces])[at]
    head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))  # pieces of one list
    length = np.add.reduceat(many, head)
    start = np.cumsum(length) - length
    # in a list, sets by size: a set's partners that are no smaller are those that follow, up to a size
    of_list = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((own, size[own], of_list))
    own, onward = own[order], onward[order].astype(np.int64)
    onward[onward == 65535] = 1 << 40
    reach = onward - 1 + need[own]  # the overlap that a set can have with one that it meets here first, or need'th
    top = np.minimum(np.floor(size[own] / t + 1e-9), np.floor(reach * ((1 + t) / t) + 1e-9) - size[own]).astype(np.int64)
    wide = int(size.max(initial=0)) + 1
    after = np.searchsorted(of_list * wide + size[own], of_list * wide + np.clip(top, -1, wide - 1), "right") - np.arange(len(own)) - 1
    after = np.maximum(after, 0)
    # a set meets those after it; where a cell prevails in a list, its sets meet none, and the others also those of the cell before them
    begin, end = np.arange(len(own)) + 1, np.arange(len(own)) + 1 + after
    major = np.zeros(len(own), bool)
    if cell.any():
        prevails = most_common(of_list, cell[own], len(length))
        major = (cell[own] > 0) & (cell[own] == prevails[of_list])
        mixed = (prevails[of_list] > 0) & ~major
        begin[mixed] = np.searchsorted(of_list * wide + size[own], (of_list * wide + np.ceil(size[own] * t - 1e-9).astype(np.int64))[mixed])
        end[major] = begin[major]
    meets = end - begin
    least = np.minimum.reduceat(own, start)
    keep = length > 1
    order = np.argsort(least[keep], kind="stable")
    start, length, least = start[keep][order], length[keep][order], least[keep][order]
    groups = np.append(np.flatnonzero(np.append(True, least[1:] != least[:-1])), len(least)) if len(least) else np.zeros(1, np.int64)

    def out(a: np.ndarray, b: np.ndarray, n: np.ndarray, part: np.ndarray | int) -> pa.RecordBatch:
        fit = np.minimum(size[a], size[b]) >= np.maximum(size[a], size[b]) * t - 1e-9
        a, b, n = a[fit], b[fit], n[fit]
        part = np.broadcast_to((name + part) % parts, fit.shape)[fit].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(known[a]), pa.array(known[b]), pa.array(n.astype(np.int64)), pa.array(np.minimum(need[a], need[b]).astype(np.int32)), pa.array(part)], ["a", "b", "n", "need", "part"])

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (cell[a] != cell[b]) | (cell[a] == 0)

    def count(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        two = a != b  # equal rows are one set
        a, b = a[two], b[two]
        pair, n = np.unique(np.minimum(a, b).astype(U64) << U64(32) | np.maximum(a, b).astype(U64), return_counts=True)
        return out((pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64), n, 0)

    few: list[np.ndarray] = []  # lists whose pairs are made one by one
    held = 0

    def make() -> Iterator[pa.RecordBatch]:
        at = np.concatenate(few)
        where = _expand(start[at], length[at])
        where = where[meets[where] > 0]
        slot = np.cumsum(meets[where]) // _PAIRS
        for chunk in np.split(where, np.flatnonzero(np.diff(slot)) + 1):
            left = np.repeat(chunk, meets[chunk])
            right = _expand(begin[chunk], meets[chunk])
            if cell.any():
                good = ((right > left) | major[right] & (after[right] >= left - right)) & apart(own[left], own[right])
                left, right = left[good], right[good]
            a, b = own[left], own[right]
            far = np.minimum(onward[left], onward[right]) - 1 + np.minimum(need[a], need[b])
            good = (size[a] + size[b]) * (t / (1 + t)) - 1e-9 <= far
            yield count(a[good], b[good])

    for x, y in zip(groups, groups[1:]):
        m = length[x:y]
        pairs = int(meets[_expand(start[x:y], m)].sum())
        if y - x > 1 and pairs > 2048:
            sets_, back = np.unique(own[_expand(start[x:y], m)], return_inverse=True)
            g, mine = len(sets_), cell[sets_]
            inner = (mine > 0) & (mine == most_common(np.zeros(g, np.int64), mine, 1)[0])
            rest = np.flatnonzero(~inner)  # no two of the others are a pair
            if len(rest) * g * (y - x) <= 400 * pairs:
                held_in = np.zeros((g, y - x), np.float32)
                held_in[back, np.repeat(np.arange(y - x), m)] = 1
                step = max(1, _PAIRS // g)
                for i in range(0, len(rest), step):
                    c = held_in[rest[i : i + step]] @ held_in.T
                    i_, b = np.nonzero(c)
                    a = rest[i_ + i]
                    good = (inner[b] | (b > a)) & apart(sets_[a], sets_[b])
                    a, b, n = a[good], b[good], c[i_[good], b[good]]
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    yield out(sets_[a], sets_[b], n, a // _BLOCK)
                continue
        few.append(np.arange(x, y))
        held += pairs
        if held >= _PAIRS:
            yield from make()
            few.clear()
            held = 0
    if few:
        yield from make()


def probe(pairs: list[pa.RecordBatch], members: list[pa.RecordBatch], t: float) -> pa.RecordBatch:
    """Of a part of the candidates: (a, b, overlap, size_a, size_b) of the pairs that reach the threshold."""
    grams, size = {}, {}
    for b in members:
        for i, s, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            grams[i], size[i] = unsqueeze(g), s
    found = []
    for b in pairs:
        out = []
        for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            p, q = grams[x], grams[y]
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            n = int((q[at] == p).sum())
            if n >= t * (size[x] + size[y] - n) - 1e-9:
                out.append((x, y, n, size[x], size[y]))
        found.append(np.array(out, np.int64).reshape(-1, 5))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate([np.zeros((0, 5), np.int64), *found]).T], ["a", "b", "overlap", "size_a", "size_b"])


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``one`` shares with each of ``two``: a product of incidence matrices where an n-gram is in many of both, else pair by pair."""
    n, m = len(one), len(two)
    out = np.zeros((n, m), np.float32)
    sides = []
    for each in (one, two):
        gram, own = np.concatenate([*each, np.zeros(0, U64)]), np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
        order = np.argsort(gram, kind="stable")
        sides.append((gram[order], own[order]))
    (p, a), (q, b) = sides
    both = np.intersect1d(p, q)
    (p0, p1), (q0, q1) = ((np.searchsorted(x, both), np.searchsorted(x, both, "right")) for x in (p, q))
    times = (p1 - p0) * (q1 - q0)
    for columns in np.array_split(np.flatnonzero(times * 100 > n * m), max(1, int((times * 100 > n * m).sum()) // 512 + 1)):
        left, right = np.zeros((n, len(columns)), np.float32), np.zeros((m, len(columns)), np.float32)
        for held, own, lo, hi in ((left, a, p0, p1), (right, b, q0, q1)):
            many = hi[columns] - lo[columns]
            held[own[_expand(lo[columns], many)], np.repeat(np.arange(len(columns)), many)] = 1
        out += left @ right.T
    few = np.flatnonzero(times * 100 <= n * m)
    for columns in np.split(few, np.flatnonzero(np.diff(np.cumsum(times[few]) // _PAIRS)) + 1):
        many = p1[columns] - p0[columns]
        left = _expand(p0[columns], many)
        times_ = np.repeat(q1[columns] - q0[columns], many)
        right = _expand(np.repeat(q0[columns], many), times_)
        at = a[np.repeat(left, times_)].astype(np.int64) * m + b[right]
        out += np.bincount(at, minlength=n * m).reshape(n, m)
    return out


def similar(one: list[np.ndarray], two: list[np.ndarray], size: np.ndarray, other: np.ndarray, t: float) -> np.ndarray:
    """Which sets of ``one`` and ``two``, of the given sizes, reach the threshold."""
    n = overlaps(one, two)
    out = np.zeros(n.shape, bool)
    for i in range(0, len(n), 256):  # in double precision, as probe
        part = n[i : i + 256].astype(np.float64)
        out[i : i + 256] = part >= t * (size[i : i + 256, None] + other[None] - part) - 1e-9
    return out


def density(batches: list[pa.RecordBatch], t: float) -> pa.RecordBatch:
    """(leader, whether it is dense) of a sample of a cell's (leader, size, n-grams)."""
    grams, size = [unsqueeze(x) for b in batches for x in b.column(2).to_pylist()], np.array([s for b in batches for s in b.column(1).to_pylist()], np.int64)
    hit = similar(grams, grams, size, size, t)
    n = len(grams)
    return pa.RecordBatch.from_arrays([batches[0].column(0)[:1], pa.array([n > 1 and int(hit.sum()) - n >= _DENSE * n * (n - 1)])], ["lead", "dense"])


def within(batches: list[pa.RecordBatch], t: float) -> pa.RecordBatch:
    """Of two blocks of a cell, or one with itself: (id, null, links to rows that have a set of the other block), and a forest (a, b, null) of the links.

    A row is (leader, block, block, own block, id, size, rows of that text, n-grams); equal rows are one set.
    """
    i, j, side, ids, size, c = (np.concatenate([b.column(k).to_numpy() for b in batches]).astype(np.int64) for k in range(1, 7))
    _, first = np.unique(ids, return_index=True)
    texts = [x for b in batches for x in b.column(7).to_pylist()]
    one, two = first[side[first] == i[0]], first[side[first] == j[0]]
    grams = {k: unsqueeze(texts[k]) for k in first.tolist()}
    del texts
    hit = similar([grams[k] for k in one.tolist()], [grams[k] for k in two.tolist()], size[one], size[two], t)
    alone = i[0] == j[0]
    if alone:
        np.fill_diagonal(hit, False)
    links = [(one, hit @ c[two].astype(np.float64))] if alone else [(one, hit @ c[two].astype(np.float64)), (two, c[one].astype(np.float64) @ hit)]
    # breadth first; a set of the second block is numbered from len(one) on, or as in the first if they are one
    back, gap = np.ascontiguousarray(hit.T), 0 if alone else len(one)
    nodes = one if alone else np.concatenate([one, two])
    fresh_, a, b = np.ones(len(nodes), bool), [], []
    for root in range(len(one)):
        if not fresh_[root]:
            continue
        fresh_[root], todo = False, [root]
        while todo:
            x = todo.pop()
            lo, row = (gap, hit[x]) if x < len(one) else (0, back[x - gap])
            new = np.flatnonzero(row & fresh_[lo : lo + len(row)]) + lo
            fresh_[new] = False
            a.append(np.full(len(new), root))
            b.append(new)
            todo += new.tolist()
    edges = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b)]
    some = [(ids[at[n > 0]], np.round(n[n > 0]).astype(np.int64)) for at, n in links]
    far, known = len(edges[0]), sum(len(x) for x, _ in some)
    cols = (np.concatenate([ids[nodes[edges[0]]], *(x for x, _ in some)]), np.concatenate([ids[nodes[edges[1]]], np.zeros(known, np.int64)]), np.concatenate([np.zeros(far, np.int64), *(n for _, n in some)]))
    is_edge = np.arange(far + known) < far
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], mask=~is_edge), pa.array(cols[2], mask=is_edge)], ["a", "b", "links"])


def set_pairs(docs: DataFrame, work: Workspace, n: int = N, t: float = THRESHOLD, text: str = "text", mu: float = MU, broadcast_bytes: int = BROADCAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b, overlap, size_a, size_b), a < b, of different texts, by hash, whose similarity is t or more; sizes (id, size) of all texts with words; copied (id, c) of texts that c > 1 rows have."""
    pairs, _, sizes, copied = search(docs, work, n, t, text, mu, broadcast_bytes, 0)
    return pairs, sizes, copied


def search(
    docs: DataFrame, work: Workspace, n: int, t: float, text: str = "text", mu: float = MU, broadcast_bytes: int = BROADCAST, cell: int = CELL
) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame]:
    """As set_pairs, but the pairs without those of cells, and after them what ``within`` gives for the cells, None if there is no cell. cell: sets of a cell at least; 0 for none.

    One row of each text is searched for, or several that are equal in all columns. The copied texts are broadcast if they take at most
    ``broadcast_bytes``, else joined by a shuffle.
    """
    if not 0 < t <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    ranges = buckets(docs, text)
    slim = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("t"), content_key(docs).alias("at")).where("t IS NOT NULL")
    copied = work.write(slim.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first")).where("c > 1"), "copied")
    first = copied.select("h", "first")
    small = fits(copied, 48, broadcast_bytes)
    if small:
        once = slim.join(F.broadcast(first), "h", "left").where("first IS NULL OR at = first").select("h", "t")
    else:
        once = slim.join(first, "h", "left").where("first IS NULL OR at = first").select("h", "t").sortWithinPartitions("h")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed(inverted(list(batches), ranges, cell))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed(divide(list(batches), t, mu, ranges))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed(merge(list(batches), t, ranges))

    packed = once.mapInArrow(lambda bs: trimmed(postings(bs, n, ranges)), "bucket int, block long, " + ", ".join(f"{c} binary" for c in _POSTED[2:]))
    by_set = packed.groupBy("bucket").applyInArrow(lists, "block long, " + ", ".join(f"{c} binary" for c in _LISTS[1:]))
    divided = work.write(by_set.groupBy("block").applyInArrow(split, _DIVIDED), "divided")
    searched = divided.where("need IS NOT NULL")
    sides = dense_cells(searched, t, cell) if cell else {}
    inside = None
    if sides:
        member = spark_cells(searched, sides).join(F.broadcast(copied) if small else copied, F.col("id") == F.col("h"), "left")
        member = member.select("lead", F.pmod(F.xxhash64("id"), "sides").alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("k"), "id", "size", F.coalesce("c", F.lit(1)).alias("c"), "grams")
        member = member.select("lead", F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "side", "id", "size", "c", "grams")

        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from trimmed([within(list(batches), t)])

        inside = work.write(member.groupBy("lead", "i", "j").applyInArrow(inner, "a long, b long, links long"), "cells")
    leads = np.array(sorted(sides), np.int64)
    short = searched.mapInArrow(lambda bs: trimmed(short_lists(bs, ranges, leads)), "bucket int, " + ", ".join(f"{c} binary" for c in _SHORT[1:]))
    met = short.groupBy("bucket").applyInArrow(pairs, "a long, b long, n long, need int, part int")
    candidates = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"), F.min("part").alias("part")).where("n >= need").select("part", "a", "b")
    candidates = work.write(candidates, "candidates")
    needed = candidates.select(F.col("part").alias("at"), F.explode(F.array("a", "b")).alias("id")).distinct()
    members = needed.join(searched.select("id", "size", "grams"), "id").select("at", "id", "size", "grams")

    def verify(p: pa.Table, m: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(trimmed([probe(p.to_batches(), m.to_batches(), t)])))

    found = candidates.groupBy("part").cogroup(members.groupBy("at")).applyInArrow(verify, "a long, b long, overlap long, size_a long, size_b long")
    return work.write(found, "pairs"), inside, divided.select("id", F.col("size").cast("long").alias("size")), copied.select(F.col("h").alias("id"), "c")


def dense_cells(searched: DataFrame, t: float, least: int) -> dict[int, int]:
    """Leaders of the cells of ``least`` sets or more of which a sample shows links enough, and the blocks that each is cut into."""
    known = searched.where("lead IS NOT NULL").groupBy("lead").agg(F.count(F.lit(1)).alias("g"), F.sum(F.octet_length("grams").cast("long")).alias("bytes"))
    large = {r.lead: r for r in known.where(F.col("g") >= least).orderBy(F.desc("g"), "lead").limit(_CELLS).collect()}
    if not large:
        return {}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed([density(list(batches), t)])

    some = spark_cells(searched, {k: max(1, r.g // _PROBES) for k, r in large.items()}).where(F.pmod(F.xxhash64("id", F.lit(1)), "sides") == 0)
    dense = some.select("lead", "size", "grams").groupBy("lead").applyInArrow(look, "lead long, dense boolean").where("dense").collect()
    return {r.lead: -(-max(large[r.lead].g * _SIDE_BYTES, large[r.lead].bytes * _SIDE) // (_SIDE * _SIDE_BYTES)) for r in dense}


def spark_cells(searched: DataFrame, sides: dict[int, int]) -> DataFrame:
    """The sets of the given cells, with the number that is given for each."""
    given = searched.sparkSession.createDataFrame(pa.table({"lead": pa.array(sides.keys(), pa.int64()), "sides": pa.array(sides.values(), pa.int64())}))
    return searched.where("lead IS NOT NULL").select("id", "size", "grams", "lead").join(F.broadcast(given), "lead")


def classes_of(pairs: DataFrame, inside: DataFrame | None, work: Workspace) -> DataFrame:
    """(node, root): the least set that links connect with each set that has any."""
    edges = pairs.select("a", "b").mapInArrow(forest, "a long, b long")
    if inside is not None:
        edges = edges.unionByName(inside.where("b IS NOT NULL").select("a", "b").mapInArrow(forest, "a long, b long"))
    elif not pairs.limit(1).count():
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return components(edges, work)


def jaccard_classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", broadcast_bytes: int = BROADCAST) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of docs: all links of its set of word n-grams with similarity t or more.

    n_links counts the other rows whose sets have that similarity to the row's, copies of its own text among them; copies are
    counted, never expanded into pairs. class_id is the smallest doc_id of the rows that links connect, directly or through
    others, so a row without links has its own. A text of fewer than n words, unless it has none, has one n-gram, of all its
    words; words are as in common. Texts without words (null, empty) have no n-gram and no link. Rows with a null doc_id have
    links and a class as others, and a null class_id where all of a class are null; equal rows, and rows of one doc_id, are
    counted each. Texts are equal if their 64-bit hashes are, n-grams if 48 bits of theirs are. Other columns are ignored. No
    row, no result.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    pairs, inside, sizes, copied = search(rows, work, n, t, broadcast_bytes=broadcast_bytes, cell=CELL)
    copies = work.write(copied.join(sizes, "id").groupBy("id").agg(F.max("c").alias("c")), "copies")  # those with words
    some = fits(copies, 32, broadcast_bytes)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    many = copies.select(F.col("id").alias("b"), "c")
    links = both.join(F.broadcast(many) if some else many, "b", "left").groupBy(F.col("a").alias("id")).agg(F.sum(F.coalesce("c", F.lit(1))).alias("links"))
    if inside is not None:
        links = links.unionByName(inside.where("b IS NULL").select(F.col("a").alias("id"), "links"))
    links = links.unionByName(copies.select("id", (F.col("c") - 1).alias("links"))).groupBy("id").agg(F.sum("links").alias("links"))
    roots = classes_of(pairs, inside, work)
    linked = links.join(roots, F.col("id") == F.col("node"), "left")
    linked = work.write(linked.select("id", "links", F.coalesce("root", "id").alias("root")), "linked")
    joined = rows.select("doc", F.xxhash64("text").alias("id"), F.col("text").isNull().alias("none"))
    joined = joined.select("doc", F.when(~F.col("none"), F.col("id")).alias("id"))
    joined = work.write(joined.join(F.broadcast(linked) if fits(linked, 48, broadcast_bytes) else linked, "id", "left").select("doc", "root", "links"), "rows")
    classes = work.write(joined.where("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("class")), "classes")
    classes = F.broadcast(classes) if fits(classes, 32, broadcast_bytes) else classes
    out = joined.join(classes, "root", "left")
    return out.select(F.col("doc").alias("doc_id"), F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("class")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's pairs, as few as connect the same sets: an edge (a, b) for each set but one of every group."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    edges = [(x, find(x)) for x in list(parent)]
    cols = list(zip(*[e for e in edges if e[0] != e[1]])) or [[]] * 2
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root): the least node of each node's connected component, for edges (a, b).

    Nodes take the least root among themselves and their neighbours, then their root's root, until none changes; each round
    is written, so a lost executor costs no more than part of a round. Rounds grow with the logarithm of the longest chain.
    """
    both = work.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = work.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), "roots-0")
    turn = 0
    while True:
        turn += 1
        other = roots.select(F.col("node").alias("b"), F.col("root").alias("near"))
        best = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        # a root's own new root is what its members say is least: hooks of whole trees, then pointer jumping
        hooked = roots.join(best, "node").select("node", "root", F.least("root", "near").alias("new"))
        hook = hooked.groupBy(F.col("root").alias("key")).agg(F.min("new").alias("jump"))
        next_roots = hooked.join(hook, F.col("root") == F.col("key")).select("node", F.col("root").alias("old"), F.least("new", "jump").alias("root"))
        jump = next_roots.select(F.col("node").alias("key"), F.col("root").alias("jump"))
        stepped = next_roots.join(jump, F.col("root") == F.col("key"), "left").select("node", "old", F.least("root", F.coalesce("jump", "root")).alias("root"))
        stepped = work.write(stepped, f"roots-{turn}")
        changed = stepped.where("old <> root").limit(1).count()
        work.drop(f"roots-{turn - 1}")
        roots = stepped.select("node", "root")
        if not changed:
            return roots


def near_dedup(docs: DataFrame, n: int = N, t: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", broadcast_bytes: int = BROADCAST) -> DataFrame:
    """One row of each group of near duplicates, in docs' columns: a group is a connected component of pairs with similarity t or more.

    The row with the smallest doc_id stays (nulls last), ties going to the smaller hash of the whole row. Rows with equal
    sets of n-grams, copies among them, are one group with their neighbours; of rows equal in every column one stays. Texts
    without words (null, empty) are like nothing, and all stay. The groups' sets are broadcast if they take at most
    ``broadcast_bytes``, else joined by a shuffle; only grouped rows are then shuffled.
    """
    work = Workspace(docs.sparkSession, "near")
    node, root, nth, order = fresh(docs.columns, "rf_set", "rf_root", "rf_nth", "rf_order")
    known = docs.withColumns({order: row_order(docs, [c for c in (doc_id,) if c in docs.columns]), node: F.when(F.col(f"`{text}`").isNotNull(), F.xxhash64(F.col(f"`{text}`")))})
    pairs, inside, sizes, copied = search(docs, work, n, t, text, broadcast_bytes=broadcast_bytes, cell=CELL)
    roots = classes_of(pairs, inside, work)
    alone = copied.join(sizes, "id").join(roots.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.col("id").alias("root"))
    groups = work.write(roots.unionByName(alone).select(F.col("node").alias(node), F.col("root").alias(root)).distinct(), "groups")
    if fits(groups, 32, broadcast_bytes):
        groups = F.broadcast(groups)
    joined = known.join(groups, node, "left")
    back = [F.col(f"`{c}`") for c in docs.columns]
    first = W.partitionBy(root).orderBy(order)
    once = joined.where(F.col(root).isNotNull()).withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*back)
    return joined.where(F.col(root).isNull()).select(*back).unionByName(once)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i + 1 : i + {N}], ' ') AS g
      FROM (SELECT r, w, unnest(range(greatest(1, len(w) - {N - 1}))) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT r, count(*) AS n FROM g GROUP BY r),
o AS (SELECT x.r AS a, y.r AS b, count(*) AS overlap FROM g x JOIN g y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN s sa ON sa.r = a JOIN s sb ON sb.r = b WHERE overlap >= {THRESHOLD} * (sa.n + sb.n - overlap)),
near AS (SELECT r AS a, r AS b FROM d UNION SELECT near.a, e.b FROM near JOIN e ON near.b = e.a)
SELECT d.doc_id, (SELECT min(x.doc_id) FROM near JOIN d x ON x.r = near.b WHERE near.a = d.r) AS class_id,
       (SELECT count(*) FROM e WHERE e.a = d.r)::BIGINT AS n_links
FROM d
"""
