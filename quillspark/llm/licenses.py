"""License scans: winnowed fingerprints find candidate places, banded alignment judges them.

Each template is a sequence of words.  The hashes of its ``GRAM``-word strings
are winnowed, the least of every ``WINDOW`` in a row, into an inverted index of
(template, place); texts are winnowed alike, so any run of ``GRAM + WINDOW - 1``
words shared with a template meets it in the index.  Hits of a template on
nearby diagonals are one candidate, which a local alignment in a band around
them turns into matched words and a span.  Templates are a list the caller
gives, so the index is as small as they are and is all that is broadcast.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a fingerprint, and fingerprints of which the least is kept.
GRAM, WINDOW = 3, 2

#: Words by which an alignment may leave the diagonal of its hits.
BAND = 8

#: Share of a template's words from which a match is reported.
COVERAGE = 0.8

#: Notices of common licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

_WORD = re.compile(r"\w+")

FOUND = "doc_id long, license string, template int, coverage double, matched long, template_words long, start long, end long"


def fingerprints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of word ids, and the places of their first words; too few words give all there are."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    if n <= WINDOW:
        at = np.arange(n)
    else:
        rows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.unique(np.argmin(rows, axis=1) + np.arange(len(rows)))
    return h[at], at


def word_ids(words: list[str], memo: dict[str, int]) -> np.ndarray:
    if len(memo) > 1 << 20:
        memo.clear()
    return np.fromiter((memo[w] if w in memo else memo.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """``(matched words, first, end)`` of the best local alignment with ``word place - template place`` within ``band`` of ``diagonal``.

    A match scores 2 and a skipped word of either side costs 1; ties go to the
    one that ends first.
    """
    width, n = 2 * band + 1, len(words)
    none = (0, 0, -1)
    row, best, end = [none] * width, none, 0
    for i, own in enumerate(template):
        new = []
        left = none
        for d in range(width):
            j = i + diagonal - band + d
            cell = none
            if 0 <= j < n:
                if words[j] == own:
                    score, matched, first = row[d]
                    cell = (score + 2, matched + 1, first if first >= 0 else j)
                for score, matched, first in (row[d + 1] if d + 1 < width else none, left):
                    if score > 1 and score - 1 > cell[0]:
                        cell = (score - 1, matched, first)
                if cell[0] > best[0]:
                    best, end = cell, j + 1
            new.append(cell)
            left = cell
        row = new
    return best[1], best[2], end


class Index:
    """Templates as words, and their fingerprints as an inverted index."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.names, self.words = [], []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        memo: dict[str, int] = {}
        for name, texts in templates.items():
            for k, text in enumerate(texts):
                words = _WORD.findall(text.lower())
                # every gram of a template is indexed, so only the text's choice of grams decides
                for at in range(len(words) - GRAM + 1):
                    h = int(fingerprints(word_ids(words[at : at + GRAM], memo))[0][0])
                    places[h].append((len(self.words), at))
                self.names.append((name, k))
                self.words.append(words)
        self.places = dict(places)
        self.hashes = np.array(sorted(self.places), np.uint64)

    def scan(self, text: str, coverage: float, memo: dict[str, int]) -> list[tuple]:
        """``(license, template, coverage, matched, template words, start, end)`` of a text's matches, in order."""
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [text[s:e].lower() for s, e in spans]
        hashes, at = fingerprints(word_ids(words, memo))
        if not len(self.hashes) or not len(hashes):
            return []
        slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[slot] == hashes
        diagonals: dict[int, dict[int, int]] = defaultdict(dict)  # template -> diagonal -> place of its last hit
        for h, p in zip(hashes[hit].tolist(), at[hit].tolist(), strict=True):
            for t, q in self.places[h]:
                diagonals[t][p - q] = p
        found = []
        for t, hits in diagonals.items():
            size, past = len(self.words[t]), 0
            todo = sorted(hits)
            while todo:
                # diagonals side by side share one alignment, whose band holds the band of each
                first = todo[0]
                side = bisect_right(todo, first + BAND)
                last = todo[side - 1]
                low = max(0, past, first - BAND)
                matched, s, e = align(self.words[t], words[low : last + size + BAND], (first + last) // 2 - low, BAND + (last - first + 1) // 2)
                if matched >= coverage * size:
                    past = low + e
                    found.append((-matched / size, -matched, spans[low + s][0], spans[past - 1][1], t))
                    # a hit beyond the match may be of another one
                    todo = [d for d in todo if hits[d] >= past]
                else:
                    todo = todo[side:]
        out: list[tuple] = []
        taken: list[tuple[int, int]] = []
        for share, matched, s, e, t in sorted(found):
            if not any(s < b and a < e for a, b in taken):
                taken.append((s, e))
                out.append((*self.names[t], -share, -matched, len(self.words[t]), s, e))
        return sorted(out, key=lambda r: r[5:])


def _scan(held, coverage: float):
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = held.value, {}
        for batch in batches:
            rows = [(key, *r) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if text.is_valid for r in index.scan(text.as_py(), coverage, memo)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each place of ``docs`` (``doc_id``, ``text``) that covers a template's words.

    ``start`` and ``end`` are code points, end exclusive.  Where matches
    overlap, the fuller one stays, then the longer, then the one that starts
    first.  Null and empty texts have none; repeated rows report each; an empty
    table gives no rows; other columns are not read.  No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(held, coverage), FOUND)
