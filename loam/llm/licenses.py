"""License scans: fingerprints propose templates, banded alignment reports coverage.

Texts and templates become words of ASCII letters and digits, lower-cased. Of the hashes
of every ``size`` successive words the least of every ``window`` successive ones is kept,
so any shared run of ``size + window - 1`` words shares a fingerprint (Schleimer,
Wilkerson, Aiken 2003). An inverted index of the templates' fingerprints picks candidates:
long templates by ``LONG`` fingerprints, notices of a few words by ``SHORT`` ones, of which
they keep all, as there is little to choose from. A long candidate must share so many
grams within the band of a place that places with fewer can't reach ``COVERAGE``; only
those are left out. A banded alignment of the whole template around each place, by words, counts the
template words that the text has in order, and where the matched words begin and end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import ceil
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import narrow_input
from .textscan import PowerTable, buffers, chained, lower_table, steps, tokens


class Winnow(NamedTuple):
    #: Words of a gram, and grams of a window.
    size: int
    window: int


#: Finds any shared run of three words, the length of the shortest notice, and any of seven in a long template.
SHORT, LONG = Winnow(2, 2), Winnow(4, 4)
#: Words by which the text may run ahead of or behind the template.
BAND = 8
#: Share of a template's words that a report needs.
COVERAGE = 0.75
#: Of overlapping reports of templates of at least so many words only the best stays (the same header of two versions).
RIVALS = 50
#: Bits of a word offset in an alignment cell, and places aligned at a time.
_BITS, _ABREAST = 20, 256

# The wording of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"
    ),
    "All-rights-reserved": "All rights reserved.",
} | {path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

_WORD = re.compile(r"[a-z0-9]+")
_ANY_CASE = re.compile(r"[A-Za-z0-9]+")
MATCHES = "array<struct<license:string,start:int,end:int,matched:int,coverage:double>>"


def _fold() -> np.ndarray:
    return lower_table()


def _gap() -> np.ndarray:
    gap = np.ones(256, dtype=bool)
    gap[48:58] = gap[97:123] = False
    return gap


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least of every ``window`` successive hashes (all equals of it; of all if there are fewer)."""
    if not len(grams):
        return np.arange(0)
    windows = np.lib.stride_tricks.sliding_window_view(grams, min(window, len(grams)))
    least = windows.min(axis=1)
    kept = np.zeros(len(grams), dtype=bool)
    for k in range(windows.shape[1]):
        kept[k : k + len(least)] |= windows[:, k] == least
    return np.flatnonzero(kept)


def align_many(template: np.ndarray, text: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest common subsequences within the bands of ``starts``, of text words from ``low`` to before ``high``.

    Words are numbers. ``(lengths, firsts, ends)`` in words of ``text``: more matches win, then the
    first word nearest the place of its template word, then the later first word, then the earlier end.
    """
    width, n = 2 * BAND + 1, len(template)
    one, near, last = 1 << (2 * _BITS + 5), 2 * _BITS, (1 << _BITS) - 1
    # A cell is (matched, nearness, first, -end) in the bits of a number, words counted from start - BAND.
    at = starts[:, None] - BAND + np.arange(n + width - 1)
    inside = (at >= low[:, None]) & (at < high[:, None])
    window = np.where(inside, text[np.clip(at, 0, len(text) - 1)], -1) if len(text) else np.full(at.shape, -1)
    shift = np.arange(width)
    fresh = one + ((BAND - np.abs(shift - BAND)) << near) + (shift << _BITS)
    row = np.zeros((len(starts), width + 1), np.int64)
    for i, word in enumerate(template.tolist()):
        same = window[:, i : i + width] == word
        # row is of the template word before: the same text word stands one cell further on.
        now = row[:, 1:].copy()
        if same.any():
            before = row[:, :-1]
            grown = np.where(before > 0, ((before >> _BITS) << _BITS) + one, fresh + (i << _BITS)) + (last - (i + shift + 1))
            np.maximum(now, np.where(same, grown, 0), out=now)
        row[:, :-1] = np.maximum.accumulate(now, axis=1)
    best = row.max(axis=1)
    base = starts - BAND
    return best // one, base + ((best >> _BITS) & last), base + last - (best & last)


def align(template: list[str], text: list[str], start: int) -> tuple[int, int, int]:
    """Longest common subsequence within the band of ``start``; ``(length, first, end)`` in words of ``text``."""
    number = {w: k for k, w in enumerate(dict.fromkeys(template))}
    ids = [np.array([number.get(w, -2) for w in words], np.int64) for words in (template, text)]
    n, first, end = (int(x[0]) for x in align_many(*ids, np.array([start]), np.array([0]), np.array([len(text)])))
    return (n, first, end) if n else (0, 0, 0)


def free(taken: list[tuple[int, int]], low: int, high: int) -> Iterator[tuple[int, int]]:
    """The parts of ``low`` to ``high`` outside the sorted, disjoint ``taken``."""
    i = bisect_left(taken, (low, low))
    i -= i > 0 and taken[i - 1][1] > low
    while i < len(taken) and taken[i][0] < high:
        if taken[i][0] > low:
            yield low, taken[i][0]
        low = taken[i][1]
        i += 1
    if low < high:
        yield low, high


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.powers = PowerTable()
        self.words = {name: _WORD.findall(text.lower()) for name, text in templates.items()}
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for words in self.words.values() for w in words))}
        self.ids = {name: np.array([self.number[w] for w in words], np.int64) for name, words in self.words.items()}
        self.need = {name: ceil(COVERAGE * len(words)) for name, words in self.words.items()}
        postings: dict[int, list[tuple[str, int]]] = defaultdict(list)
        prints: dict[int, set[int]] = defaultdict(set)
        long, self.least = {}, []
        for name, words in self.words.items():
            raw, offsets = buffers(pa.array([" ".join(words)]))
            hashes = tokens(raw, offsets, self.powers, _fold(), _gap()).hashes
            grams = chained(hashes, SHORT.size)
            # Of the matched words' neighbours at most one is parted by each missing word, and at most one more
            # by each step of the text ahead, of which there are as many as missing words and the band's width.
            least = self.need[name] - 1 - 2 * (len(words) - self.need[name]) - 2 * BAND
            if least > 1:
                marks = chained(hashes, LONG.size)
                for h in marks[winnow(marks, LONG.window)]:
                    prints[int(h)].add(len(long))
                long[name] = grams
                self.least.append(least)
                continue
            for place, h in enumerate(grams):
                postings[int(h)].append((name, place))
        self.postings = dict(postings)
        self.keys = np.array(sorted(self.postings), dtype=np.uint64)
        self.prints = dict(prints)
        self.print_keys = np.array(sorted(self.prints), dtype=np.uint64)
        self.long = list(long)
        self.long_keys = np.unique(np.concatenate([*long.values(), np.zeros(0, np.uint64)]))
        self.counts = np.zeros((len(self.long_keys), len(long)), np.int32)
        self.offsets = []
        for t, grams in enumerate(long.values()):
            key = np.searchsorted(self.long_keys, grams)
            np.add.at(self.counts[:, t], key, 1)
            order = np.argsort(key, kind="stable")
            self.offsets.append((order, np.concatenate([[0], np.cumsum(self.counts[:, t])])))

    def _long_places(self, at: np.ndarray, keys: np.ndarray, candidates: list[int]) -> Iterator[tuple[str, set[int]]]:
        """Places of the long templates ``candidates``, from the text's places ``at`` of the long grams ``keys``."""
        candidates = [t for t in candidates if self.least[t] <= len(at)]
        if not candidates:
            return
        present, n = np.unique(keys, return_counts=True)
        shared = np.minimum(self.counts[np.ix_(present, candidates)], n[:, None]).sum(axis=0)
        for t in (t for t, held in zip(candidates, shared.tolist(), strict=True) if held >= self.least[t]):
            order, bounds = self.offsets[t]
            many = self.counts[keys, t]
            rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            starts, hits = np.unique(np.repeat(at, many) - order[np.repeat(bounds[keys], many) + rank], return_counts=True)
            sums = np.concatenate([[0], np.cumsum(hits)])
            near = sums[np.searchsorted(starts, starts + BAND, side="right")] - sums[np.searchsorted(starts, starts - BAND)]
            if len(kept := starts[near >= self.least[t]]):
                yield self.long[t], set(kept.tolist())

    def hits(self, texts: pa.Array) -> Iterator[dict[str, set[int]]]:
        """Per text the word places at which templates may begin."""
        raw, offsets = buffers(texts)
        for a, b in steps(offsets):
            found = tokens(raw, offsets[a : b + 1], self.powers, _fold(), _gap())
            grams, marks = chained(found.hashes, SHORT.size), chained(found.hashes, LONG.size)
            hit, _ = self._find(self.keys, grams)
            far, key = self._find(self.long_keys, grams)
            marked, _ = self._find(self.print_keys, marks)
            for lo, hi in zip(found.bounds[:-1], found.bounds[1:], strict=True):
                places: dict[str, set[int]] = defaultdict(set)
                end, last = max(hi - SHORT.size + 1, lo), max(hi - LONG.size + 1, lo)
                if hit[lo:end].any():
                    kept = winnow(grams[lo:end], SHORT.window)
                    for place in kept[hit[lo:end][kept]]:
                        for name, offset in self.postings[int(grams[lo + place])]:
                            places[name].add(int(place) - offset)
                if marked[lo:last].any():
                    kept = winnow(marks[lo:last], LONG.window)
                    candidates = sorted({t for place in kept[marked[lo:last][kept]] for t in self.prints[int(marks[lo + place])]})
                    at = np.flatnonzero(far[lo:end])
                    places.update(self._long_places(at, key[lo:end][at], candidates))
                yield places

    @staticmethod
    def _find(keys: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(grams), bool), np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return keys[at] == grams, at

    def _spans(self, name: str, text: np.ndarray, starts: set[int]) -> Iterator[tuple[int, int, int]]:
        """``(matched, first, end)`` of one template: most words first, then the tighter, then the earlier.

        A place whose match meets a better one is aligned again in the words left beside that.
        """
        template, need = self.ids[name], self.need[name]
        n, taken, rest = len(template), [], []
        for start in sorted(starts):
            if start >= 0 and np.array_equal(text[start : start + n], template):
                if not taken or taken[-1][1] <= start:
                    taken.append((start, start + n))
            else:
                rest.append(start)
        yield from ((n, *span) for span in taken)
        member = np.concatenate([[0], np.cumsum(np.isin(text, template))])

        def aligned(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
            out = []
            parts = [p for p in parts if member[p[2]] - member[p[1]] >= need]
            for k in range(0, len(parts), _ABREAST):
                start, low, high = np.array(parts[k : k + _ABREAST]).T
                for part, m, first, end in zip(parts[k : k + _ABREAST], *(x.tolist() for x in align_many(template, text, start, low, high)), strict=True):
                    if m >= need:
                        out.append((-m, end - first, first, end, *part))
            return out

        around = [(start, *part) for start in rest for part in free(taken, max(start - BAND, 0), min(start + n + BAND, len(text)))]
        heap = aligned(around)
        heapify(heap)
        while heap:
            m, _, first, end, start, low, high = heappop(heap)
            if list(free(taken, first, end)) == [(first, end)]:
                taken.insert(bisect_left(taken, (first, end)), (first, end))
                yield -m, first, end
            else:
                for again in aligned([(start, *part) for part in free(taken, low, high)]):
                    heappush(heap, again)

    def report(self, text: str, places: dict[str, set[int]]) -> list[tuple[str, int, int, int, float]]:
        """``(license, start, end, matched, coverage)`` by start, then license; offsets are code points.

        Of overlapping places of one template the one with most matched words stays; of overlapping
        places of several long templates too, if its coverage is no less.
        """
        found = [m.span() for m in _ANY_CASE.finditer(text)]
        words = np.array([self.number.get(text[a:b].lower(), -2) for a, b in found], np.int64)
        out = [(name, first, end, n, n / len(self.words[name])) for name, starts in places.items() for n, first, end in self._spans(name, words, starts)]
        beaten, near = set(), []
        for r in sorted((r for r in out if len(self.words[r[0]]) >= RIVALS), key=lambda r: r[1]):
            near = [s for s in near if s[2] > r[1]]
            for s in near:
                better, worse = (s, r) if (s[3], s[4]) > (r[3], r[4]) else (r, s)
                if better[4] >= worse[4] and (better[3], better[4]) != (worse[3], worse[4]):
                    beaten.add(worse)
            near.append(r)
        return sorted(((r[0], found[r[1]][0], found[r[2] - 1][1], *r[3:]) for r in out if r not in beaten), key=lambda r: (r[1], r[0]))


def _scanned(batches: Iterator[pa.RecordBatch], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    index = Index(templates)
    fields = ("license", "start", "end", "matched", "coverage")
    kind = pa.list_(pa.struct(list(zip(fields, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True))))
    for batch in batches:
        texts = batch.column(1)
        rows = [
            [dict(zip(fields, r, strict=True)) for r in index.report(texts[i].as_py(), places)] if places else []
            for i, places in enumerate(index.hits(texts))
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "matches"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_matches, matches)``, one row per row of ``docs``.

    Null and empty texts have no matches; very long texts are scanned whole; of places of
    one template that overlap the one with most matched words is reported, then the tighter,
    then the earlier; of overlapping reports of templates of ``RIVALS`` words or more the one
    with most matched words and no less coverage stays, and equals all stay; templates of fewer than ``SHORT.size`` words never match; repeated
    rows each get their row; other columns are ignored; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    templates = {k: v for k, v in templates.items() if len(_WORD.findall(v.lower())) >= SHORT.size}
    return (
        narrow_input(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
        .mapInArrow(lambda it: _scanned(it, templates), f"doc_id long, matches {MATCHES}")
        .select("doc_id", F.size("matches").cast("long").alias("n_matches"), "matches")
    )
