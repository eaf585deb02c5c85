"""License scan: fuzzy search for short notices.

A notice of which at most k characters are edited still holds, unchanged, at least one of any k + 1 pieces it is cut
into. One automaton finds the pieces of all notices in one pass over a text; each find marks the only stretch where its
notice could lie; the regex library's bounded-error matching decides there and gives the span and the edits. What is
found is what that matching finds in the whole text, which the tests compare.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTICES = {
    "apache-2.0": "licensed under the apache license, version 2.0",
    "apache-2.0-file": "you may not use this file except in compliance with the license",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted, free of charge, to any person obtaining a copy",
    "bsd-grant": "redistribution and use in source and binary forms, with or without modification, are permitted",
    "gpl-3.0": "licensed under the gnu general public license, version 3",
    "gpl-grant": "under the terms of the gnu general public license",
    "lgpl": "gnu lesser general public license",
    "agpl": "gnu affero general public license",
    "mpl-2.0": "mozilla public license, version 2.0",
    "isc-grant": "permission to use, copy, modify, and/or distribute this software for any purpose",
    "cc-by-nc-4.0": "licensed under cc by-nc 4.0",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-sa-4.0": "licensed under cc by-sa 4.0",
    "cc0": "released into the public domain under cc0",
    "spdx": "spdx-license-identifier:",
    "reserved": "all rights reserved",
}
SCHEMA = "doc_id long, notice string, start long, stop long, edits int"


def lower(text: str) -> str:
    """Lower case that keeps every character's place: one that would become several stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def errors(notice: str, per: int = 12, most: int = 4) -> int:
    """Edits allowed: one for each ``per`` characters, ``most`` at most; none below ``per``."""
    return min(most, len(notice) // per)


@dataclass(frozen=True)
class Notice:
    name: str
    text: str
    edits: int
    pattern: regex.Pattern

    @classmethod
    def of(cls, name: str, text: str) -> Notice:
        k = errors(text)
        return cls(name, text, k, regex.compile(f"(?e)(?:{regex.escape(text, special_only=True)}){{e<={k}}}"))

    def pieces(self) -> list[tuple[str, int]]:
        cuts = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]

    def spans(self, low: str, at: int, to: int) -> Iterator[tuple[int, int, int]]:
        for m in self.pattern.finditer(low, at, to):
            yield m.start(), m.end(), sum(m.fuzzy_counts)


class Scanner:
    def __init__(self, notices: dict[str, str]):
        self.notices = [Notice.of(n, t) for n, t in notices.items()]
        held: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for piece, at in n.pieces():
                held.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in held.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(notice, start, stop, edits) in order of notice and start; spans of one notice don't overlap."""
        low = lower(text)
        where: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(low):
            for i, at in uses:
                n = self.notices[i]
                start = end + 1 - size - at
                a, b = max(0, start - n.edits), min(len(low), start + len(n.text) + n.edits)
                own = where.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        out = []
        for i in sorted(where):
            n = self.notices[i]
            merged: list[list[int]] = []
            for a, b in sorted(where[i]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                out += [(n.name, *s) for s in n.spans(low, a, b)]
        return closest(out)


def closest(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Without the finds that overlap one of another notice with fewer edits, as CC BY-NC is also near to CC BY-SA."""
    starts: list[int] = []  # of what finds with fewer edits cover, and where it ends
    stops: list[int] = []
    kept = set()
    for edits in sorted({f[3] for f in found}):
        level = [f for f in found if f[3] == edits]
        for f in level:
            i = bisect_right(stops, f[1])
            if i == len(stops) or starts[i] >= f[2]:
                kept.add(f)
        covered = sorted([*zip(starts, stops), *((f[1], f[2]) for f in level)])
        starts, stops = [], []
        for a, b in covered:
            if stops and a <= stops[-1]:
                stops[-1] = max(stops[-1], b)
            else:
                starts.append(a)
                stops.append(b)
    return [f for f in found if f in kept]


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", notices: dict[str, str] | None = None) -> DataFrame:
    """A row (doc_id, notice, start, stop, edits) for each find; start and stop count characters of the text, from 0.

    Case is ignored. An edit inserts, deletes or replaces a character; a notice allows one for each 12 characters, 4 at
    most. A document can hold several notices and several finds of one; finds of one notice don't overlap, the leftmost
    counting first, and a find gives way to an overlapping one of another notice with fewer edits. Null and empty texts have none. A null doc_id is reported as null; equal rows are each reported. Other
    columns, whatever their names, are ignored. No row, no result. Texts of any length are scanned whole.
    """
    given = dict(NOTICES if notices is None else notices)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                value = b.column(1)[i].as_py()
                if value:
                    found = scanner.scan(value)
                    if found:
                        d = b.column(0)[i].as_py()
                        rows += [(d, *f) for f in found]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()))], names)

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(scan, SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
