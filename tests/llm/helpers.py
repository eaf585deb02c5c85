"""Small tables with all that may go wrong, and brute-force words."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the input.
CLASH = ["rf_digest", "rf_order", "rf_winner", "rf_set", "rf_root", "rf_cuts", "rf_keep", "rank", "score", "bucket"]


def rows_of(texts: list[str | None], ids: list[int | None] | None = None) -> list[tuple]:
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, "en", "web", None if t is None else len(t)) for i, t in zip(ids, texts)]


def nasty(spark, extra: bool = True):
    """Nulls in each column, empty and blank texts, one very long, ties, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = rows_of(["a b c d e f", "", "   \n\t", None, long, "a b c d e f", "naïve café — 漢字 🙂 done", "x", "a b c d e f"])
    rows += [rows[0], rows[0], (None, "a b c d e f", None, None, None), (None, None, None, None, None), (None, "only here", "en", "web", 9), (4, long, "fr", "web", len(long))]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASH}) if extra else df


def words(text: str | None) -> list[str]:
    return re.findall(r"[^ \t\n\f\r]+", text or "")


def mutate(rng: random.Random, base: list[str], edits: int, vocabulary: int) -> list[str]:
    out = list(base)
    for _ in range(edits):
        i, r = rng.randrange(len(out)), rng.random()
        if r < 0.5:
            out[i] = f"w{rng.randint(0, vocabulary)}"
        elif r < 0.75 and len(out) > 2:
            del out[i]
        else:
            out.insert(i, f"w{rng.randint(0, vocabulary)}")
    return out
