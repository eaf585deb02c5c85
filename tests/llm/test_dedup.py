"""Exact dedup, the n-gram Jaccard join and repeated windows against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowforge.llm import jaccard, repeats
from rowforge.llm.exact_dedup import exact_dedup, misra_gries, prune
from rowforge.llm.jaccard import components, jaccard_classes, merge, near_dedup, set_pairs, squeeze
from rowforge.llm.common import Words, Workspace
from rowforge.llm.repeats import pack, remove_repeats, repeated_runs, repeated_spans, run_hashes

from .helpers import DOCS, mutate, nasty, rows_of, words


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(1)
    data = [b"hot"] * 400 + [b"warm"] * 150 + [b"%d" % rng.randint(0, 10_000) for _ in range(1000)]
    rng.shuffle(data)
    batches = [pa.RecordBatch.from_arrays([pa.array(data[i : i + 97], pa.binary())], ["d"]) for i in range(0, len(data), 97)]
    held, true = misra_gries(batches, 20), Counter(data)
    assert len(held) <= 20 and {b"hot", b"warm"} <= set(held)
    assert all(true[k] - len(data) / 21 <= v <= true[k] for k, v in held.items())
    assert prune({1: 3, 2: 2, 3: 1}, 2) == {1: 2, 2: 1}


@pytest.mark.parametrize("counters,least,broadcast", [(1024, 16, 10**8), (2, 2, 10**8), (4, 3, 0)])
def test_exact_dedup(spark, counters, least, broadcast):
    rng = random.Random(2)
    texts = [rng.choice([None, "", "hot", "hot", "hot", *(f"t{i}" for i in range(40))]) for _ in range(400)]
    df = spark.createDataFrame(rows_of(texts, [rng.randint(0, 10**6) for _ in texts]), DOCS)
    got = exact_dedup(df, counters=counters, least=least, broadcast_bytes=broadcast).collect()
    first = {}
    for r in df.collect():
        if r.text is not None:
            first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    assert sorted((r.text, r.doc_id) for r in got if r.text is not None) == sorted(first.items())
    assert sum(r.text is None for r in got) == sum(t is None for t in texts)


def test_exact_dedup_edge_cases(spark):
    df = nasty(spark)
    got = exact_dedup(df)
    assert got.columns == df.columns
    rows = got.collect()
    by = Counter(r.text for r in rows)
    assert by[None] == 2 and all(n == 1 for t, n in by.items() if t is not None)
    assert next(r.doc_id for r in rows if r.text == "a b c d e f") == 0  # a null doc_id comes last, of equal rows one stays
    assert exact_dedup(df.limit(0)).count() == 0


def grams(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_pairs(docs, t=0.5):
    sets = {i: grams(x) for i, x in docs}
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n >= t * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                    out[a, b] = (n, len(sets[a]), len(sets[b]))
    return out


def text_pairs(spark, df, t=0.5):
    """What set_pairs finds, as the brute-force version gives it: by doc_id, which must tell the texts apart."""
    pairs, _, _ = set_pairs(df, Workspace(spark, "t"), t=t)
    name = {r.h: r.doc_id for r in df.select(F.xxhash64("text").alias("h"), "doc_id").collect()}
    out = {}
    for r in pairs.collect():
        (a, n), (b, m) = sorted([(name[r.a], r.size_a), (name[r.b], r.size_b)])
        out[a, b] = (r.overlap, n, m)
    return out


def brute_classes(rows, t=0.5):
    """(doc_id, class_id, n_links) of each row."""
    pairs = set(brute_pairs(list(enumerate(x for _, x in rows)), t))
    group, links = list(range(len(rows))), [0] * len(rows)
    for a, b in pairs:
        links[a], links[b] = links[a] + 1, links[b] + 1
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    ids = defaultdict(list)
    for g, (d, _) in zip(group, rows):
        ids[g] += [d] if d is not None else []
    return Counter((d, min(ids[g], default=None), n) for g, (d, _), n in zip(group, rows, links))


@pytest.mark.parametrize("seed,t", [(3, 0.5), (4, 0.8), (5, 0.25)])
def test_jaccard_join(spark, seed, t):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 300)}" for _ in range(rng.choice([2, 5, 40, 90]))] for _ in range(10)]
    texts = [" ".join(mutate(rng, rng.choice(bases), rng.randint(0, 10), 300)) for _ in range(220)]
    once = list(enumerate(dict.fromkeys(texts)))
    assert text_pairs(spark, spark.createDataFrame(once, "doc_id long, text string"), t) == brute_pairs(once, t)
    rows = [(i if rng.random() < 0.9 else None, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 10**8):
        got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df, t=t, broadcast_bytes=most).collect())
        assert got == brute_classes(rows, t)


def test_jaccard_join_of_a_large_group(spark):
    """A group so large that its lists are spread and counted by blocks."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    docs = list(enumerate(dict.fromkeys(" ".join(mutate(rng, base, 3, 10_000)) for _ in range(500))))
    assert text_pairs(spark, spark.createDataFrame(docs, "doc_id long, text string")) == brute_pairs(docs)


@pytest.mark.parametrize("t", [0.5, 0.3])
def test_jaccard_join_of_short_texts_that_share_a_list(spark, t):
    """One n-gram in all of 3,000 short texts, whose pairs can't be similar unless they share more."""
    rng = random.Random(9)
    docs = list(enumerate(dict.fromkeys(f"in the end {' '.join(f'x{rng.randint(0, 400)}' for _ in range(rng.choice([0, 1, 1, 2, 3])))}" for _ in range(900))))
    assert text_pairs(spark, spark.createDataFrame(docs, "doc_id long, text string"), t) == brute_pairs(docs, t)


def test_lists_of_short_texts_make_few_pairs():
    """A list of 20,000 sets of two n-grams, which hold nothing else that is shared, makes no pair."""
    many = 20_000
    ids, pair = np.arange(many, dtype=np.int64), np.full(many, 2, np.int32)
    row = [7, squeeze(np.full(many, 5, np.uint64)), np.arange(many, dtype=np.uint16), np.ones(many, np.uint16), ids, pair, np.ones(many, np.int32)]
    row = [row[0], row[1], *(x.tobytes() for x in row[2:])]
    batch = pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i == 0 else pa.binary()) for i, v in enumerate(row)], [*"abcdefg"])
    assert sum(b.num_rows for b in merge([batch], 0.5, 8)) == 0


def test_jaccard_edge_cases(spark):
    df = nasty(spark)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df).collect())
    assert got == brute_classes([(r.doc_id, r.text) for r in df.collect()])
    assert got[0, 0, 5] == 3 and got[None, 0, 5] == 1 and got[3, 3, 0] == 1 and got[1, 1, 0] == 1
    assert jaccard_classes(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_classes(df, t=0)


def groups_of_near_duplicates(seed, many):
    """Texts of two large groups that share half of their words, with copies, texts farther off, and texts of their own."""
    rng = random.Random(seed)
    one, two = ([f"{c}{i}" for i in range(60)] for c in "xy")
    two = one[:30] + two[:30]
    texts = [" ".join(mutate(rng, rng.choice([one, one, two]), rng.choice([0, 1, 1, 1, 2, 2, 4, 8, 16]), 300)) for _ in range(many)]
    texts += [" ".join(one[i : i + 20]) for i in range(0, 40, 4)] + [" ".join(f"w{rng.randint(0, 300)}" for _ in range(50)) for _ in range(20)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("t", [0.5, 0.8, 0.25])
def test_cells(spark, monkeypatch, t):
    """Groups so large that they are cells, of several blocks each, beside sets of no cell that they link to."""
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "_SIDE", 24)
    texts = groups_of_near_duplicates(11, 260)
    rows = [(i if i % 9 else None, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    inside = jaccard.search(df, Workspace(spark, "t"), 3, t, cell=16)[1]
    assert inside.where("b IS NULL").count() > 50
    want = brute_classes(rows, t)
    for most in (0, 10**8):
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df, t=t, broadcast_bytes=most).collect()) == want
    first = brute_classes(list(enumerate(texts)), t)
    df = spark.createDataFrame(rows_of(texts), DOCS)
    assert sorted(r.doc_id for r in near_dedup(df, t=t).collect()) == sorted({c for _, c, _ in first})


@pytest.mark.parametrize("operator", [jaccard_classes, near_dedup])
def test_links_of_a_large_group_take_no_row_each(spark, monkeypatch, operator):
    """600 near duplicates, with some 180,000 links: no table written on the way has more than a few rows a text."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = list(dict.fromkeys(" ".join(mutate(rng, base, 3, 10_000)) for _ in range(600)))
    seen, write = {}, Workspace.write

    def counted(self, df, name):
        out = write(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "write", counted)
    assert operator(spark.createDataFrame(rows_of(texts), DOCS)).count() == (1 if operator is near_dedup else len(texts))
    assert max(seen.values()) < 8 * len(texts)


def test_a_cell_of_few_links_is_none(spark, monkeypatch):
    """Texts that share all their n-grams with a long one, and few with each other, are searched for as all are."""
    monkeypatch.setattr(jaccard, "CELL", 8)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(900)]
    texts = [" ".join(base)] + [" ".join(base[i : i + 12]) for i in sorted(rng.sample(range(880), 160))]
    rows = list(enumerate(texts))
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_classes(rows)


def test_overlaps():
    rng = np.random.default_rng(14)
    one, two = ([np.unique(np.append(rng.integers(0, 400, 30), np.arange(many))).astype(np.uint64) for _ in range(n)] for n, many in ((30, 9), (41, 5)))
    got = jaccard.overlaps(one, two)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in two] for x in one]
    assert jaccard.overlaps(one, []).shape == (30, 0)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("broadcast", [0, 10**8])
def test_near_dedup(spark, broadcast):
    rng = random.Random(8)
    bases = [[f"w{rng.randint(0, 500)}" for _ in range(30)] for _ in range(12)]
    docs = [(i, " ".join(mutate(rng, rng.choice(bases), rng.randint(0, 6), 500))) for i in range(150)]
    group = {i: i for i, _ in docs}
    for a, b in sorted(brute_pairs(docs)):
        x, y = group[a], group[b]
        group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    df = spark.createDataFrame(rows_of([t for _, t in docs]), DOCS)
    assert sorted(r.doc_id for r in near_dedup(df, broadcast_bytes=broadcast).collect()) == sorted(set(group.values()))


def test_near_dedup_edge_cases(spark):
    df = nasty(spark)
    got = near_dedup(df)
    assert got.columns == df.columns
    by = Counter(r.text for r in got.collect())
    assert by["a b c d e f"] == 1 and by[""] == 1 and by[None] == 2 and by["x"] == 1 and sum(by.values()) == 9
    assert near_dedup(df.limit(0)).count() == 0


def brute_windows(rows, window):
    """Words under repeated windows of distinct (doc_id, text), by whether the window is kept."""
    where = defaultdict(list)
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        for i in range(len(w) - window + 1):
            where[tuple(w[i : i + window])].append((d, i))
    marked = defaultdict(set)
    for at in where.values():
        if len(at) > 1:
            for nth, (d, i) in enumerate(at):
                marked[d, nth == 0] |= set(range(i, i + window))
    return marked


def passages(rng, many=60):
    shared = [[f"w{rng.randint(0, 50)}" for _ in range(20)] for _ in range(5)]
    texts = []
    for _ in range(many):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(shared) if rng.random() < 0.5 else [f"x{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 15))]
        texts.append(" ".join(w))
    return texts


def marks(rows):
    """Words of disjoint spans (doc_id, start, end, kept) by (doc_id, kept)."""
    got = defaultdict(set)
    for d, start, end, kept in rows:
        span = set(range(start, end))
        assert not got[d, kept] & span
        got[d, kept] |= span
    return {k: v for k, v in got.items() if v}


@pytest.mark.parametrize("window,hot", [(2, 20_000), (5, 4), (12, 20_000), (12, 2)])
def test_repeated_spans(spark, window, hot):
    texts = passages(random.Random(window))
    df = spark.createDataFrame(rows_of(texts), DOCS)
    spans = repeated_spans(df, window, hot=hot, sample=1).collect()
    want = brute_windows([(i, t) for i, t in enumerate(texts)], window)
    assert marks((r.doc_id, r.start_word, r.end_word, r.kept) for r in spans) == {k: v for k, v in want.items() if v}


def ranges_of(texts, window, ranges, hot=None, ids=None):
    """pack() and repeated_runs() without Spark: batches by range, and the marked words."""
    by = defaultdict(list)
    for i in range(0, len(texts), 20_000):
        t = texts[i : i + 20_000]
        at = ids[i : i + 20_000] if ids else range(i, i + len(t))
        batch = pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(t, pa.string()), pa.array([hash(x) for x in t], pa.int64())], ["d", "t", "h"])
        for b in pack(iter([batch]), window, ranges, hot):
            for k, n in enumerate(b.column(0).to_pylist()):
                by[n].append(b.slice(k, 1))
    spans = set()
    for own in by.values():
        for r in repeated_runs(own, window).to_pylist():
            spans |= {(r["doc_id"], i, r["kept"]) for i in range(r["start"], r["stop"] + 1)}
    got = defaultdict(set)
    for d, i, kept in spans:
        got[d, kept] |= set(range(i, i + window))
    return by, got


def test_windows_are_compared_by_words(monkeypatch):
    """With all hashes equal, every window meets every other, and only equal words make a repeat."""
    texts = passages(random.Random(31))
    texts += texts[:5] + [" \n".join(words(t)) for t in texts[5:9]]
    monkeypatch.setattr(repeats, "run_hashes", lambda h, size: np.zeros(max(len(h) - size + 1, 0), np.uint64))
    for window in (3, 8):
        by, got = ranges_of(texts, window, 4)
        assert sum(len(x) for x in by.values()) <= 4
        assert got == brute_windows(list(enumerate(texts)), window)


def test_windows_of_many_flushes(monkeypatch):
    """Runs that are combined within blocks, among them equal rows and rows of one id, still find the first of all."""
    rng = random.Random(32)
    texts = passages(rng, 80)
    texts += [rng.choice(texts) for _ in range(80)]
    ids = [rng.choice([None, *range(40)]) for _ in texts]
    monkeypatch.setattr(repeats, "_FLUSH", 200)
    want = defaultdict(list)
    rows = sorted({(d, t) for d, t in zip(ids, texts)}, key=lambda r: (r[0] is None, r[0] or 0, hash(r[1])))
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 5):
            want[tuple(w[i : i + 6])].append((d, i))
    marked = defaultdict(set)
    for at in want.values():
        for nth, (d, i) in enumerate(at if len(at) > 1 else []):
            marked[d, nth == 0] |= set(range(i, i + 6))
    _, got = ranges_of(texts, 6, 3, ids=ids)
    assert {k: v for k, v in got.items() if v} == marked


def test_largest_doc_id_is_no_null():
    """2^63 - 1 sorts before null, and both come back as they were."""
    text = " ".join(f"w{i}" for i in range(8))
    _, got = ranges_of([text] * 3, 8, 2, ids=[None, 2**63 - 1, 5])
    assert got == {(5, True): set(range(8)), (2**63 - 1, False): set(range(8)), (None, False): set(range(8))}


def test_one_window_in_very_many_documents():
    """100,000 documents share 50 words: no range gets more than its share, as the passage's windows are combined and those at its ends spread."""
    shared = " ".join(f"s{i}" for i in range(50))
    texts = [f"a{i} {shared} b{i}" for i in range(100_000)]
    keys = [b for b in repeats.minimizers(iter([pa.RecordBatch.from_arrays([pa.array(texts[:2000])], ["t"])]), 50)]
    hot = np.array([k for b in keys for k, c in zip(*(x.to_pylist() for x in b.columns)) if c > 500], np.int64).view(np.uint64)
    by, got = ranges_of(texts, 50, 32, np.sort(hot))
    load = [sum(b.nbytes for b in own) for own in by.values()]
    held = [sum(len(b.column(8)[0].as_buffer()) // 4 for b in own) for own in by.values()]
    assert max(load) < 3 * sum(load) / 32 and max(held) < 3 * sum(held) / 32
    assert got[0, True] == set(range(1, 51)) and len(got) == 100_000 and all(v == set(range(1, 51)) for v in got.values())


def test_repeats_of_a_run_longer_than_16_bits(spark):
    """One minimizer in 199,951 windows, before documents that share a passage."""
    shared = " ".join(f"s{i}" for i in range(200))
    texts = ["a " * 200_000, *(f"b{i} {shared} c{i}" for i in range(6)), *(" ".join(f"x{i}-{j}" for j in range(80)) for i in range(6))]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.kept) for r in repeated_spans(spark.createDataFrame(rows_of(texts), DOCS).coalesce(1)).collect())
    assert got == [(0, 0, 50, True), (0, 1, 200_000, False), (1, 1, 201, True), *((i, 1, 201, False) for i in range(2, 7))]


def test_windows_that_share_a_half_are_told_apart_by_64_bits(spark):
    """The hashes of each pair's words have their upper 32 bits in common; the shared word has the least hash."""
    pairs = [("w104292", "w200586"), ("w168493", "w268794"), ("w92172", "w101124")]
    for a, b in pairs:
        x, y = (int(v) for v in run_hashes(Words(pa.array([f"{a} {b}"])).hashes(), 1))
        assert x != y and x >> 32 == y >> 32
    texts = [t for p in pairs for w in p for t in (f"w49060 {w}", f"{w} w49060")]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    assert repeated_spans(df, 2).count() == 0 and remove_repeats(df, 2).count() == len(texts)
    assert repeated_spans(df.union(df.withColumn("doc_id", F.col("doc_id") + 100)), 2).count() == 2 * len(texts)


def test_remove_repeats(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [f"alpha beta {shared} gamma", f"delta {shared}\n epsilon", shared, "short text", None, ""]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    for broadcast in (0, 10**8):
        got = {r.doc_id: r for r in remove_repeats(df, broadcast_bytes=broadcast).collect()}
        assert got[0].text == texts[0] and got[1].text == "delta epsilon" and got[1].n_chars == 13
        assert 2 not in got and got[3].text == "short text" and got[4].text is None and got[5].text == ""


def test_repeats_edge_cases(spark):
    df = nasty(spark)
    got = remove_repeats(df, window=6)
    assert got.columns == df.columns
    by = Counter(r.text for r in got.collect())
    assert by["a b c d e f"] == 3  # the first document's equal rows fare alike; the other copies lose all their words
    assert by[None] == 2 and by[""] == 1 and by["   \n\t"] == 1
    assert repeated_spans(df.limit(0)).count() == 0 and remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeated_spans(df, 1)
