"""Packing, the quality classifier, license scans, language ID, BPE, top-k and WARC."""

import gzip
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from rowforge.llm import bpe, langid, licenses, packing, quality, topk, warc
from rowforge.llm.common import Workspace

from .helpers import DOCS, nasty, rows_of, words


# -- packing


def fewest(lengths, capacity):
    """Fewest bins, by trying all."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                bins[j] += lengths[i]
                go(i + 1, bins)
                bins[j] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def used_by(fillings):
    used = Counter()
    for f, n in fillings:
        for x in f:
            used[x] += n
    return used


def test_packing_is_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 17, 30])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        out = packing.pack_lengths(Counter(lengths), capacity)
        assert all(sum(f) <= capacity for f, _ in out.fillings)
        assert used_by(out.fillings) == Counter(lengths)
        assert sum(n for _, n in out.fillings) == out.bins == out.least == fewest(lengths, capacity)


def fits_into(items, bins):
    """Whether the items can be parted among bins of these sizes, by trying all."""
    if not items:
        return True
    seen = set()
    for i, b in enumerate(bins):
        if items[0] <= b and b not in seen:
            seen.add(b)
            if fits_into(items[1:], bins[:i] + (b - items[0],) + bins[i + 1 :]):
                return True
    return False


def test_completions_are_the_undominated_fillings():
    """30 items and more, many of them small, against all fillings and Martello and Toth's dominance."""
    rng = random.Random(21)
    for _ in range(30):
        room = rng.randint(7, 13)
        counts = Counter(rng.choice([2, 3, rng.randint(2, 5), rng.randint(3, room + 3)]) for _ in range(rng.randint(30, 45)))
        have = sorted(x for x in counts if x <= room)
        every = [()]
        for x in have:
            every = [f + (x,) * k for f in every for k in range(counts[x] + 1) if sum(f) + k * x <= room]
        every = [tuple(sorted(f, reverse=True)) for f in every]
        want = {f for f in every if not any(g != f and fits_into(f, g) for g in every)}
        got = list(packing.completions(counts, room, room))
        assert len(got) == len(set(got)) and set(got) == want
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
        assert list(packing.completions(counts, room, 1)) == [f for f in got if sum(f) >= room - 1]


def test_packing_bounds():
    """The bound is below every packing, best fit is a packing, and the search's result lies between."""
    rng = random.Random(22)
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        low, high = sorted((rng.randint(1, capacity), rng.randint(1, capacity)))
        counts = Counter(rng.randint(low, high) for _ in range(rng.randint(1, 60)))
        fit = packing.best_fit(counts, capacity)
        assert used_by(fit) == counts and all(sum(f) <= capacity for f, _ in fit)
        out = packing.pack_lengths(counts, capacity, 20_000)
        assert used_by(out.fillings) == counts and packing.least_bins(counts, capacity) <= out.least <= out.bins <= sum(n for _, n in fit)
        if sum(counts.values()) <= 9:
            assert packing.least_bins(counts, capacity) <= fewest(list(counts.elements()), capacity)


def test_packing_search_beats_best_fit_and_ends():
    beaten = packing.pack_lengths(Counter({44: 6, 24: 6, 36: 6, 22: 6, 21: 6, 8: 6, 4: 6}), 53)
    assert beaten.bins == beaten.least <= sum(n for _, n in packing.best_fit({44: 6, 24: 6, 36: 6, 22: 6, 21: 6, 8: 6, 4: 6}, 53))
    rng = random.Random(23)
    hard = Counter(rng.randint(250, 480) for _ in range(100))
    began = time.monotonic()
    out = packing.pack_lengths(hard, 1000, 200_000)
    assert time.monotonic() - began < 20 and out.least <= out.bins and used_by(out.fillings) == hard
    small = Counter(rng.choice(range(9, 36)) for _ in range(111))  # many small lengths in one bin
    out = packing.pack_lengths(small, 2048)
    assert out.bins == out.least == math.ceil(sum(small.elements()) / 2048) and time.monotonic() - began < 30
    huge = {x: 10**9 + x for x in range(1, 2049, 7)}
    out = packing.pack_lengths(huge, 2048)
    assert used_by(out.fillings) == Counter(huge) and out.least <= out.bins


def check_bins(rows, docs, capacity):
    per = defaultdict(list)
    for r in rows:
        per[r.bin_id].append((r.bin_start, r.n_tokens))
    for spans in per.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= capacity
    want = Counter((d, len(words(t))) for d, t in docs if words(t))
    got = Counter()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start_token, r.n_tokens))
    assert sum(n for (_, n), k in want.items() for _ in range(k)) == sum(r.n_tokens for r in rows)
    for (d, n), k in want.items():
        if sum(x == d for x, _ in want) == 1 and k == 1:
            at = 0
            for start, m in sorted(pieces[d]):
                assert start == at
                at += m
            assert at == n
    return len(per), got


def test_packing(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 9, 10, 16, 31, 50, 77])))) for i in range(300)]
    rows = packing.best_fit_packing(spark.createDataFrame(docs, "doc_id long, text string"), capacity=32, work=200_000).collect()
    bins, _ = check_bins(rows, docs, 32)
    total = sum(len(words(t)) for _, t in docs)
    rests = [len(words(t)) % 32 for _, t in docs]
    out = packing.pack_lengths(Counter(r for r in rests if r), 32, 200_000)
    full = sum(len(words(t)) // 32 for _, t in docs)
    assert bins == out.bins + full and {(r.bins, r.least_bins) for r in rows} == {(bins, out.least + full)}
    assert math.ceil(total / 32) <= bins


def test_packing_of_one_hot_length(spark):
    """Rows of one length, ties and nulls among them, are ranked over several files."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else these few rows are one file
    try:
        docs = [(i % 50 if i % 3 else None, "w w w") for i in range(400)] + [(7, "w w w")] * 200 + [(i, "w " * 40) for i in range(60)]
        rows = packing.best_fit_packing(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), capacity=16).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    bins, _ = check_bins(rows, docs, 16)
    assert bins == rows[0].bins == rows[0].least_bins
    assert Counter((r.doc_id, r.n_tokens) for r in rows if r.n_tokens == 3) == Counter((d, 3) for d, t in docs if len(t) < 9)


def test_packing_edge_cases(spark):
    df = nasty(spark)
    rows = packing.best_fit_packing(df, capacity=64).collect()
    check_bins(rows, [(r.doc_id, r.text) for r in df.collect()], 64)
    assert {r.doc_id for r in rows} == {0, 4, 5, 6, 7, 8, None}
    assert packing.best_fit_packing(df.limit(0)).count() == 0


# -- quality


def test_bradley_terry_matches_gradient_descent():
    rng = np.random.default_rng(3)
    d = rng.normal(0.4, 1, (500, 4))
    w = quality.bradley_terry(d, np.zeros_like(d), ridge=0.1)
    v = np.zeros(4)
    for _ in range(5000):
        p = 1 / (1 + np.exp(d @ v))
        v -= 0.3 * (-(d * p[:, None]).mean(0) + 0.1 * v)
    assert np.allclose(w, v, atol=1e-4)


def test_best_level_is_the_least_error():
    rng = np.random.default_rng(4)
    for _ in range(30):
        s, g, w = rng.integers(0, 6, 20).astype(float), rng.random(20) < 0.5, rng.random(20) + 0.1
        _, cut = quality.best_level(s, g, w)
        wrong = lambda c: w[(s >= c) != g].sum()
        assert wrong(cut) == pytest.approx(min(wrong(c) for c in [-np.inf, np.inf, *(s + 0.5), *(s - 0.5)]))


def test_quality_cut_is_a_quantile_of_all_scores(spark):
    """The level comes from all labelled documents, not from the sample, and the cut from all documents."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ranker = quality.fit(docs, labels, per_class=4, pairs=100)
    quality_of = {}
    for r in labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").collect():
        quality_of[r.doc_id] = min(quality_of.get(r.doc_id, 1), r.quality)
    rows = quality.quality_scores(docs, ranker, "text", "score", "keep").collect()
    known = [(r.score, bool(quality_of[r.doc_id])) for r in rows if r.doc_id in quality_of]
    assert 8 < len(known) < len(rows)
    wrong = lambda c: sum((s >= c) != g for s, g in known)
    best = min([s for s, _ in known] + [math.inf], key=lambda c: (wrong(c), c))
    rejected = sum(s < best for s, _ in known)
    assert ranker.level == rejected / len(known) and 0 < ranker.level < 1
    assert ranker.cut == sorted(r.score for r in rows)[rejected * len(rows) // len(known)]
    assert all(r.keep == (r.score >= ranker.cut) for r in rows)


def test_quality_against_plain_python(spark):
    """Features, pairs, weights, level and cut recomputed without Spark; the query's rows are those that reach the cut."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(10**9, "", "en", "web", 0), (10**9 + 1, None, "en", "web", 0), (10**9 + 2, "ÄB x" * 3 + " \n\n" + "y" * 40, "en", "web", 0)], DOCS)
    docs = docs.unionByName(odd)

    def of(text):
        t, w = text or "", words(text)
        n, chars = max(len(w), 1), max(len(t), 1)
        share = lambda pattern: math.sqrt(len(regex.findall(pattern, t)) / chars)
        solid = sum(map(len, w))
        return [share(r"[#$%&*|!<>{}=+~^@\\/_\[\]]"), share(r"\p{Lu}"), share("[0-9]"), share("[.?,;:]"), len(set(w)) / n, min(solid / n, 30), sum(len(x) > 20 for x in w) / n, math.log1p(n), math.log1p(n / (t.count("\n") + 1))]

    x = {r.doc_id: of(r.text) for r in docs.collect()}
    good = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            good[r.doc_id] = min(good.get(r.doc_id, 1), int(r.quality > 0))
    rows = sorted((good[d], d) for d in x if d in good)
    a, g = np.array([x[d] for _, d in rows]), np.array([q == 1 for q, _ in rows])
    rng = np.random.default_rng(7)
    i, j = rng.choice(np.flatnonzero(g), 5000), rng.choice(np.flatnonzero(~g), 5000)
    centre, scale = a.mean(0), np.where(a.std(0) < 1e-9, 1, a.std(0))
    d = (a[i] - a[j]) / scale
    w = np.zeros(a.shape[1])
    for _ in range(50):  # Newton's steps on the logistic loss
        q = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), -(d * q[:, None]).mean(0) + 1e-3 * w)
    score = {k: float(((np.array(v) - centre) / scale) @ w) for k, v in x.items()}
    known = [(score[k], bool(v)) for k, v in good.items() if k in score]
    wrong = lambda c: sum((s >= c) != v for s, v in known)
    best = min([s for s, _ in known] + [math.inf], key=lambda c: (wrong(c), c))
    cut = sorted(score.values())[sum(s < best for s, _ in known) * len(score) // len(known)]
    got = {r.doc_id: r.score for r in quality.quality_filter(docs, labels, score="score", only=["doc_id"], pairs=5000).collect()}
    sure = {k for k, s in score.items() if abs(s - cut) > 1e-3}
    assert len(sure) > 0.95 * len(score) and {k for k in got if k in sure} == {k for k in sure if score[k] >= cut}
    assert all(got[k] == pytest.approx(score[k], abs=1e-3) for k in got)


def test_level_and_quantile_over_partitions(spark):
    rng = random.Random(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else these few rows are one partition
    try:
        for spread in (3, 40, 10**6):
            rows = [(rng.randint(-spread, spread) / 7, rng.randint(0, 1)) for _ in range(200)]
            rows = [(s, int(rng.random() < 0.2) if s < 0 else g | int(rng.random() < 0.5)) for s, g in rows]
            df = spark.createDataFrame(rows, "score double, good int")
            wrong = lambda c: sum((s >= c) != bool(g) for s, g in rows)
            best = min([s for s, _ in rows] + [math.inf], key=lambda c: (wrong(c), c))
            assert quality.labelled_level(df) == (sum(s < best for s, _ in rows), len(rows))
            for rank in (0, 77, 199):
                assert quality.score_at(df, rank) == sorted(s for s, _ in rows)[rank]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_quality_held_out(spark):
    """Accuracy over half of the labels, learned from the other half."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ranker = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    scored = quality.quality_scores(docs, ranker, "text", "score", "keep").join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "keep").collect()
    right = [bool(r.quality) == r.keep for r in scored]
    good = [r.keep for r in scored if r.quality]
    assert sum(right) / len(right) > 0.9 and sum(good) / len(good) > 0.95


def test_quality_edge_cases(spark):
    df = nasty(spark)
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 0), (None, 1, 0), (6, None, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_filter(df, labels, score="points", per_class=10, pairs=100)
    assert out.columns == [*df.columns, "points"] and all(r.points == r.points for r in out.collect())
    assert quality.quality_filter(df, labels).columns == df.columns
    assert quality.quality_filter(df, labels.limit(0)).count() == df.count()  # nothing can be learned, so all stay
    assert quality.quality_filter(df.limit(0), labels).count() == 0


# -- licenses


def brute_scan(text, notices):
    low, out = licenses.lower(text), []
    for name, notice in notices.items():
        k = licenses.errors(notice)
        for m in regex.finditer(f"(?e)(?:{regex.escape(notice, special_only=True)}){{e<={k}}}", low):
            out.append((name, m.start(), m.end(), sum(m.fuzzy_counts)))
    return sorted(f for f in out if not any(g[3] < f[3] and g[1] < f[2] and f[1] < g[2] for g in out))


def test_closest_of_very_many_finds():
    rng = random.Random(41)
    for _ in range(200):
        found = [(rng.choice("ab"), a, a + rng.randint(1, 9), rng.randint(0, 4)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 12)))]
        assert licenses.closest(found) == [f for f in found if not any(g[3] < f[3] and g[1] < f[2] and f[1] < g[2] for g in found)]
    scanner, began = licenses.Scanner(licenses.NOTICES), time.monotonic()
    assert len(scanner.scan("x all rights reserved. licensed under cc by-sa 4.0, " * 20_000)) == 40_000
    assert time.monotonic() - began < 30


def test_license_scan_finds_what_the_whole_text_search_finds():
    rng, notices = random.Random(5), licenses.NOTICES
    scanner = licenses.Scanner(notices)
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(" ".join(rng.choice(["the", "under", "license", "code", "version", "all", "2.0"]) for _ in range(rng.randint(3, 20))))
            n = list(rng.choice(list(notices.values())).title())
            for _ in range(rng.randint(0, 3)):
                n[rng.randrange(len(n))] = rng.choice("abz ")
            parts.append("".join(n))
        text = ". ".join(parts)
        assert sorted(scanner.scan(text)) == brute_scan(text, notices)


def test_license_spans(spark):
    text = "Intro. LICENSED UNDER THE APACHE LICENCE, Version 2.0 here. İ then licensed under cc by-nc 4.0"
    rows = licenses.license_scan(spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "All rights reserved")], "doc_id long, text string")).collect()
    by = {r.notice: r for r in rows}
    assert set(by) == {"apache-2.0", "cc-by-nc-4.0", "reserved"} and by["reserved"].doc_id is None
    a = by["apache-2.0"]
    assert text[a.start : a.stop].lower() == "licensed under the apache licence, version 2.0" and a.edits == 1
    n = nasty(spark)
    assert licenses.license_scan(n).count() == 0 and licenses.license_scan(n.limit(0)).count() == 0


# -- language ID


def test_langid_scores_match_sets():
    filters = langid.Filters.build({"a": np.frombuffer(b"abcdbcde", np.uint32), "b": np.frombuffer(b"wxyz", np.uint32)}, bits=12)
    texts = pa.array(["ABCDE", "wxyz wxyz", "abc", "", None, "ab", "zzzzzz"])
    score, count = filters.scores(pc_fill(texts))
    assert count.tolist() == [2, 6, 0, 0, 0, 0, 3]
    key, inside, off = langid.keys(pc_fill(texts))
    for i, t in enumerate(texts.to_pylist()):
        own = [bytes(np.array([k], np.uint32)) for k in key[off[i] : off[i + 1]][inside[off[i] : off[i + 1]]]]
        low = (t or "").lower().encode()
        assert own == [low[j : j + 4] for j in range(max(0, len(low) - 3))]
    assert score[0, 0] > 0.5 > score[0, 1] and score[1, 1] > score[1, 0]


def test_langid_against_sets(spark):
    """Slots, popcounts, the correction for false positives and the decision, recomputed one n-gram at a time."""
    rng = random.Random(42)
    letters = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop"}
    texts = [(i, "".join(rng.choice(letters[c]) for _ in range(rng.randint(0, 60)))) for i in range(90) for c in [rng.choice("abc")]] + [(90, "漢字漢字漢字"), (91, None), (92, "qrs")]
    given = {c: {"".join(rng.choice(x) for _ in range(4)) for _ in range(300)} for c, x in letters.items()}
    code = lambda g: int.from_bytes(g.encode(), "little")
    bits, hashes = 11, 3
    filters = langid.Filters.build({c: np.array([code(g) for g in gs], np.uint32) for c, gs in given.items()}, bits=bits, hashes=hashes)
    where = lambda k: [(k * int(langid._ODD[i]) & (1 << 64) - 1) >> 64 - bits for i in range(hashes)]
    held = {c: {s for g in gs for s in where(code(g))} for c, gs in given.items()}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), filters).collect()}
    for d, t in texts:
        raw = (t or "").lower().encode()
        own = [int.from_bytes(raw[i : i + 4], "little") for i in range(len(raw) - 3)]
        score = {}
        for c in given:
            false = (len(held[c]) / 2**bits) ** hashes
            score[c] = (sum(all(s in held[c] for s in where(k)) for k in own) - len(own) * false) / max(len(own), 1) / (1 - false)
        first, second = sorted(score, key=lambda c: (-score[c], c))[:2]
        if score[first] <= 0:
            assert (got[d].lang_id, got[d].score, got[d].margin) == (None, 0, 0)
        else:
            assert got[d].lang_id == first and got[d].score == pytest.approx(score[first]) and got[d].margin == pytest.approx(score[first] - score[second])
    assert got[90].lang_id is None and sum(r.lang_id is not None for r in got.values()) > 60


def pc_fill(texts):
    import pyarrow.compute as pc

    return pc.fill_null(texts, "")


def test_langid_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = langid.train(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 AND n_chars > 100")
    got = langid.identify(rest, filters).join(rest.select("doc_id", "lang"), "doc_id").select("lang_id", "lang").collect()
    assert sum(r.lang_id == r.lang for r in got) / len(got) > 0.95


def test_langid_of_a_rare_language(spark):
    """Three short documents are enough for a language beside one of many."""
    rare = ["ngomso siya kuthetha", "namhlanje bayahamba kakhulu", "abantwana bafunda isixhosa"]
    rows = [(i, f"the weather of today number {i} is good and the people walk home", "en") for i in range(300)] + [(1000 + i, t, "xh") for i, t in enumerate(rare)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    assert all(got[d].lang_id == lang for d, _, lang in rows) and got[1000].score > 0.9


def test_langid_edge_cases(spark):
    df = nasty(spark)
    rows = langid.identify(df, langid.train(df, least=1)).collect()
    assert len(rows) == df.count() and sum(r.lang_id is None for r in rows) == 4  # null, empty and too short texts; blanks are bytes
    assert all(r.lang_id is None for r in langid.identify(df, langid.train(df.limit(0))).collect())
    assert langid.identify(df.limit(0), langid.train(df)).count() == 0


# -- BPE


def test_bpe_matches_tiktoken(spark):
    import base64

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", "Hello  world", " lead and trail  ", "it's we'll I've 'tis don't'd", "aaa aaaa aaaaa", "1234 56,78", "naïve 漢字 🙂\n\n  \t x", "<|endoftext|>", "\r\n   　a", "'s's 'S 're're"]
    texts += ["".join(rng.choice("ab '\n1.é漢  stldvre") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = bpe.bpe_encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert r.token_ids == enc.encode_ordinary(texts[r.doc_id]), texts[r.doc_id]
        assert r.round_trip and r.n_tokens == len(r.token_ids)


def test_bpe_edge_cases(spark):
    df = nasty(spark)
    out = bpe.bpe_encode(df)
    back = bpe.bpe_decode(out).groupBy("doc_id", "text").count()
    assert Counter({(r.doc_id, r.text): r["count"] for r in back.collect()}) == Counter((r.doc_id, r.text) for r in df.collect())
    assert all((r.token_ids is None) == (r.round_trip is None) for r in out.collect())
    assert bpe.bpe_encode(df.limit(0)).count() == 0


# -- top-k


def brute_top(docs, queries, k):
    term = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    tf = [(d, Counter(term(t)), len(term(t))) for d, t in docs]
    n, mean = len(docs), max(sum(s for *_, s in tf) / max(len(docs), 1), 1e-9)
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for q, text in queries:
        scored = []
        for d, c, s in tf:
            total = 0
            for w in set(term(text)):
                if c[w]:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    total += math.floor(idf * (c[w] * 2.2) / (c[w] + 1.2 * (1 - 0.75 + 0.75 * s / mean)) * 1e6 + 0.5)
            if total > 0:
                scored.append((-total, d is None, d))
        out += [(q, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,batch", [(1, 10**6), (7, 10**6), (1000, 400)])
def test_top_k(spark, k, batch):
    rng = random.Random(k)
    docs = [(i, " ".join(f"t{int(rng.expovariate(0.15))}" for _ in range(rng.randint(0, 40)))) for i in range(900)]
    queries = [(i, " ".join(f"T{rng.randint(0, 30)}" for _ in range(rng.randint(0, 5)))) for i in range(12)]
    got = topk.top_k(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string"), k, batch_bytes=batch)
    assert sorted((r.item_id, r.rank, r.doc_id, r.score_e6) for r in got.collect()) == brute_top(docs, queries, k)


def test_top_k_leaves_blocks_unscored():
    """Of 40 blocks of one part, those that can't reach the kth score are skipped before their forward index is decoded."""
    rng = random.Random(51)
    docs = [(i, " ".join(f"t{int(rng.expovariate(0.05))}" for _ in range(20)) + (" rare thing" if i % 997 == 5 else "")) for i in range(40 * topk.BLOCK)]
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs[a : a + 2048]]), pa.array([t for _, t in docs[a : a + 2048]])], ["d", "t"]) for a in range(0, len(docs), 2048)]
    index = list(topk.index_blocks(iter(batches)))
    asked = [(1, "rare thing t3"), (2, "Thing"), (3, "nowhere")]
    queries = topk.Queries([t for _, t in asked])
    df = np.zeros(len(queries.vocabulary))
    for b in topk.frequencies(iter(pa.RecordBatch.from_arrays([b.column("terms"), b.column("found")], ["t", "f"]) for b in index), queries):
        df[b.column(0).to_numpy()] += b.column(1).to_numpy()
    size = [len(t.split()) for _, t in docs]
    idf = np.array([math.log(1 + (len(docs) - x + 0.5) / (x + 0.5)) for x in df])
    before = topk.Block.decoded
    got = [b for b in topk.search(iter(index), queries, idf, sum(size) / len(docs), 5, np.zeros(3, np.int64))][0].to_pylist()
    assert len(index) == 40 and 0 < topk.Block.decoded - before < 20
    rows = sorted((asked[r["query"]][0], -r["score"], r["doc_id"]) for r in got)
    want = brute_top(docs, asked, 5)
    assert rows == sorted((q, -s, d) for q, _, d, s in want)


def test_top_k_of_the_largest_doc_id():
    best = topk.Best(2, 0)
    best.offer(np.array([7, 7, 7]), np.array([1, 0, 0]), np.array([0, 2**63 - 1, 4]))
    assert best.doc.tolist() == [4, 2**63 - 1] and best.none.tolist() == [0, 0]


def test_top_k_edge_cases(spark):
    df = nasty(spark)
    queries = spark.createDataFrame([(1, "a b zzz", 1), (2, None, 1), (3, "", 1), (1, "a b zzz", 1), (4, "done", 1)], "item_id long, text string, rank int")
    rows = topk.top_k(df, queries, 20).collect()
    assert Counter(r.item_id for r in rows) == {1: 12, 4: 1}  # an equal query is answered twice
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"]) if r.item_id == 1][-1] is None
    assert topk.top_k(df.limit(0), queries).count() == 0 and topk.top_k(df, queries.limit(0)).count() == 0


# -- WARC


def test_warc_round_trip(spark):
    import hashlib

    work = Workspace(spark, "warc-test")
    bodies = [(1, "http://a/\r\nx", "é" * 100_000), (2, None, ""), (3, "http://c", None), (None, "http://d", "plain"), (5, "http://e", "y" * 131_072), (5, "http://e", "y" * 131_072)]
    pages = spark.createDataFrame(bodies, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    assert sum(r.records for r in warc.write_warc(pages, f"{work.path}/files").collect()) == 5
    rows = warc.read_warc(spark, f"{work.path}/files", 65_536).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.path, r.record_id, r.page_id].append(r)
    want = Counter(b.encode() for *_, b in bodies if b is not None)
    got = Counter()
    for chunks in per.values():
        runs = [list(g) for _, g in itertools.groupby(sorted(chunks, key=lambda r: r.chunk_no), key=lambda r: r.chunk_no)]
        for nth in range(len(runs[0])):  # equal rows make equal records
            body = b""
            for g in runs:
                assert g[nth].chunk_start == len(body)
                body += bytes(g[nth].data)
                assert hashlib.sha256(body).hexdigest() == g[nth].digest
            got[body] += 1
    assert got == want and max(r.n_bytes for r in rows) <= 65_536
    assert warc.write_warc(pages.limit(0), f"{work.path}/none").count() == 0


def test_warc_streams_and_refuses_what_is_broken(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_warc(spark, f"file://{tmp_path}", 2).collect()
    assert len(rows) == 12 and {r.is_last for r in rows if r.chunk_no == 2} == {True} and rows[0].uri is None
    for name, body in (("cut", record[:-9]), ("noise", b"no record"), ("digest", record.replace(b"\r\n\r\n", b"\r\nWARC-Payload-Digest: sha256:00\r\n\r\n", 1))):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.warc").write_bytes(body)
        with pytest.raises(Exception):
            warc.read_warc(spark, f"file://{folder}").collect()
    import io

    big = b"WARC/1.0\r\nContent-Length: 40000000\r\n\r\n"
    seen = 0
    for row in warc.chunks(io.BytesIO(big + b"z" * 40_000_000 + b"\r\n\r\n"), 1 << 16):
        assert len(row[-1]) <= 1 << 16
        seen += row[6]
    assert seen == 40_000_000
