"""License scan: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates and texts are compared without case, space and punctuation. The inverted index holds, for each template, the hashes of K
characters that winnowing picks (the least of each W neighbouring ones); a text is looked up at every place, so any K + W - 1 characters
that it shares with a template are found. The hits of a template on neighbouring diagonals make one candidate; at each hit that no match
has covered yet its words are aligned with the template's within a band; what is reported is the share of the template's words that match and the span in the text.

The index has the size of the templates, whatever the input, and goes to the executors with the code; the scan is one narrow pass in
Arrow batches over whole texts.

Defined results: null and empty texts match nothing; null ids are carried through; repeated rows report alike; an empty table gives
an empty result; other columns are ignored. Templates with fewer than K letters and digits are never found.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import span_hashes

K, W = 12, 6
BAND = 8
COVER = 0.8
CHUNK_BYTES = 1 << 20

# Notices as they are commonly written.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_WORD = re.compile(r"[^\W_]+")
#: Lower-case letters, digits and all bytes beyond ASCII as they are; 0 for what doesn't count.
_FOLD = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _FOLD[_b] = _b + 32 if 65 <= _b <= 90 else _b if _b >= 128 or 48 <= _b <= 57 or 97 <= _b <= 122 else 0


def _grams(folded: np.ndarray) -> np.ndarray:
    n = len(folded) - K + 1
    return span_hashes(folded, np.arange(n), np.arange(K, n + K)) if n > 0 else np.zeros(0, dtype=np.uint64)


def winnow(hashes: np.ndarray, window: int = W) -> np.ndarray:
    """Places of the least hash of each window, the last of equal ones; of all hashes where there are fewer."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (np.arange(len(views)) + views.argmin(1)))


def align(text: list[str], template: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Template words matched, and the first and last text word of the best alignment within a band around a diagonal."""
    if text[shift : shift + len(template)] == template and shift >= 0:
        return len(template), shift, shift + len(template) - 1
    # score, matches, first, last by text place; a match is worth 2, a skipped or changed word costs 1; text around it is free
    last_row: dict[int, tuple[int, int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(text), i + shift + band + 1)):
            before = last_row.get(j - 1, (-i, 0, -1, -1))
            if text[j] == word:
                best = (before[0] + 2, before[1] + 1, before[2] if before[2] >= 0 else j, j)
            else:
                best = (before[0] - 1, *before[1:])
            for other in (last_row.get(j), row.get(j - 1)):
                if other and other[0] - 1 > best[0]:
                    best = (other[0] - 1, *other[1:])
            row[j] = best
        last_row = row
    _, n, first, last = max(last_row.values(), default=(0, 0, -1, -1))
    return n, first, last


class LicenseIndex:
    """Fingerprints of the templates, and their words."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [[w.lower() for w in _WORD.findall(templates[n])] for n in self.names]
        entries = []
        self.sizes = []
        for t, name in enumerate(self.names):
            folded = _FOLD[np.frombuffer(templates[name].encode(), dtype=np.uint8)]
            folded = folded[folded > 0]
            self.sizes.append(len(folded))
            h = _grams(folded)
            entries += [(int(h[p]), t, int(p)) for p in winnow(h)]
        entries.sort()
        self.keys = np.array([e[0] for e in entries], dtype=np.uint64)
        self.owner = [(e[1], e[2]) for e in entries]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scan(self, texts: list[str | None], cover: float = COVER) -> list[tuple[int, str, float, int, int, int]]:
        """(row, license, coverage, start, end, words matched) of each match; start and end in characters."""
        out: list[tuple[int, str, float, int, int, int]] = []
        lo = 0
        while lo < len(texts):
            parts: list[bytes] = []
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < CHUNK_BYTES):
                parts.append((texts[hi] or "").encode("utf-8", "surrogatepass"))
                size += len(parts[-1])
                hi += 1
            out += self._scan(lo, parts, cover)
            lo = hi
        return out

    def _scan(self, row0: int, parts: list[bytes], cover: float) -> list[tuple[int, str, float, int, int, int]]:
        data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        folded = _FOLD[data]
        place = np.flatnonzero(folded)  # bytes that count
        hashes = _grams(folded[place])
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)]) if len(hashes) and len(self.keys) else np.zeros(0, dtype=np.int64)
        at = at[np.isin(hashes[at], self.keys)]
        begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}  # hits (diagonal, place) by row and template
        for p in at.tolist():
            row = int(np.searchsorted(begins, place[p], side="right")) - 1
            if place[p + K - 1] >= begins[row + 1]:
                continue
            lo, hi = np.searchsorted(self.keys, [hashes[p]], side="left")[0], np.searchsorted(self.keys, [hashes[p]], side="right")[0]
            for t, tp in self.owner[lo:hi]:
                groups.setdefault((row, t), []).append((p - tp, p))
        found: dict[int, list[tuple[int, float, int, int, int]]] = {}
        for (row, t), hits in groups.items():
            hits.sort()
            starts = [k for k, x in enumerate(hits) if not k or x[0] - hits[k - 1][0] > 4 * BAND]
            low, high = np.searchsorted(place, begins[row]), np.searchsorted(place, begins[row + 1]) - 1
            size = len(self.words[t])
            for begin, end in zip(starts, [*starts[1:], len(hits)]):
                slack = 8 * BAND
                a, b = place[min(max(hits[begin][0] - slack, low), high)], place[max(min(hits[end - 1][0] + self.sizes[t] + slack, high), low)] + 1
                while a > begins[row] and data[a] & 0xC0 == 0x80:  # not within a character
                    a -= 1
                base = len(parts[row][: a - begins[row]].decode("utf-8", "replace"))
                piece = bytes(data[a:b]).decode("utf-8", "replace")
                words = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(piece)]
                ends = np.array([len(piece[: w[1]].encode("utf-8", "surrogatepass")) for w in words] if not piece.isascii() else [w[1] for w in words], dtype=np.int64)
                spans: list[tuple[int, int]] = []  # words of the matches, in order
                tried: set[tuple[int, int, int]] = set()
                for d, p in sorted(hits[begin:end], key=lambda x: x[1]):
                    # the words at the diagonal and at the hit
                    shift, own = np.searchsorted(ends, [max(place[min(max(d, low), high)], a) - a, place[p] - a], side="right").tolist()
                    while True:
                        k = bisect.bisect_right(spans, (own, len(words)))
                        lo, hi = spans[k - 1][1] + 1 if k else 0, spans[k][0] if k < len(spans) else len(words)
                        if own < lo or (shift, lo, hi) in tried:
                            break
                        tried.add((shift, lo, hi))
                        lo, hi = max(lo, shift - 2 * BAND), min(hi, shift + size + 2 * BAND)
                        n, i, j = align([w[2] for w in words[lo:hi]], self.words[t], shift - lo)
                        if i < 0 or n < cover * size:
                            break
                        i, j = i + lo, j + lo
                        bisect.insort(spans, (i, j))
                        found.setdefault(row, []).append((-n, -n / size, base + words[i][0], base + words[j][1], t))
        out = []
        for row, matches in found.items():
            taken: list[tuple[int, int]] = []
            for n, share, start, end, t in sorted(matches):  # of matches that overlap, that with most words stays
                if all(end <= x or start >= y for x, y in taken):
                    taken.append((start, end))
                    out.append((row0 + row, self.names[t], -share, start, end, -n))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """One row per match: id, license, coverage, start_char, end_char, n_words."""
    index = LicenseIndex(TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "license", "coverage", "start_char", "end_char", "n_words"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = index.scan(part.column("__text").to_pylist(), cover)
                ids = part.column(id_col).take(pa.array([f[0] for f in found], type=pa.int64()))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k + 1] for f in found], type=kind) for k, kind in enumerate(kinds))], names=names)

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, license string, coverage double, start_char long, end_char long, n_words long")
