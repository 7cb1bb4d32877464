"""License scans: winnowed template fingerprints, an inverted index, banded alignment.

Texts become lower-case words. Shingles of ``SHINGLE`` words are hashed, and of
every ``WINDOW`` consecutive hashes the least is kept (winnowing), in templates
and documents alike; a run of SHINGLE + WINDOW - 1 equal words is sure to share
a fingerprint. The index leads from a fingerprint to template positions, which
give candidate diagonals. Around each, local alignments in a band, one after the
other over the words that none has taken, count
matched words; its coverage of the template and its span are reported.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import arrow_map, narrow, table
from tidemark.llm.decontam import words

SHINGLE, WINDOW, BAND = 3, 3, 8
#: Least share of a template's words that a match covers.
COVERAGE = 0.6
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

# Public license notices.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-notice": "Released under the MIT License.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of each shingle; one with an unknown word (0) has the largest value."""
    n = len(ids) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    known = np.ones(max(n, 0), bool)
    for j in range(SHINGLE if n > 0 else 0):
        part = ids[j : j + n]
        known &= part > 0
        out = (out ^ part.astype(np.uint64)) * _MULTIPLIER
        out ^= out >> np.uint64(31)
    return np.where(known, out, _NONE)


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the least hash of each window (the last of equal ones)."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= WINDOW:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(np.arange(len(view)) + WINDOW - 1 - np.argmin(view[:, ::-1], axis=1))


def align(template: np.ndarray, ids: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and last + 1 document word) of the best local alignment.

    Cells lie within ``band`` of the diagonal (document position - template
    position). A match scores 2, a replaced, added or missing word -1.
    No alignment holds a word with a negative id.
    """
    best, width = (0, 0, 0, 0), 2 * band + 1
    # per cell of a row: score, matches, first document word
    row: list[tuple[int, int, int]] = [(0, 0, 0)] * (width + 1)
    for i, t in enumerate(template.tolist()):
        new: list[tuple[int, int, int]] = []
        left = (0, 0, 0)
        for b in range(width):
            j = i + diagonal + b - band
            if not 0 <= j < len(ids) or ids[j] < 0:
                cell = (0, 0, 0)
            else:
                s, m, f = row[b]
                same = ids[j] == t
                cell = (s + 2, m + 1, f if s else j) if same else (s - 1, m, f)
                s, m, f = row[b + 1]
                if s - 1 > cell[0]:
                    cell = (s - 1, m, f)
                if left[0] - 1 > cell[0]:
                    cell = (left[0] - 1, left[1], left[2])
                if cell[0] <= 0:
                    cell = (0, 0, 0)
                elif same and cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
            new.append(cell)
            left = cell
        row = [*new, (0, 0, 0)]
    return best[1:]


class Index:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted(templates)
        self.ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(templates[n])], np.int64) for n in self.names]
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.ids):
            h = hashes(ids)
            for at in winnow(h).tolist():
                found[int(h[at])].append((t, at))
        keys = sorted(found)
        self.keys, self.places = np.array(keys, np.uint64), [found[k] for k in keys]

    def search(self, found: list[bytes]) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, first word, last word + 1, matched words), apart from each other, in order."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        known = ids > 0
        if not (known[2:] & known[1:-1] & known[:-2]).any():
            return []
        h = hashes(ids)
        chosen = winnow(h)
        chosen = chosen[h[chosen] != _NONE]
        which = np.minimum(np.searchsorted(self.keys, h[chosen]), len(self.keys) - 1)
        hit = self.keys[which] == h[chosen]
        diagonals: dict[int, set[int]] = defaultdict(set)
        for p, k in zip(chosen[hit].tolist(), which[hit].tolist()):
            for t, at in self.places[k]:
                diagonals[t].add(p - at)
        out = []
        for t, some in diagonals.items():
            last = None
            for d in sorted(some):
                if last is not None and d - last <= BAND // 2:
                    continue
                last = d
                left = ids
                while True:  # copies within the band of each other are found one by one
                    matched, first, end = align(self.ids[t], left, d)
                    if matched < COVERAGE * len(self.ids[t]):
                        break
                    out.append((self.names[t], matched / len(self.ids[t]), first, end, matched))
                    left = left.copy() if left is ids else left
                    left[first:end] = -1
        free, kept = np.ones(len(ids), bool), []
        for m in sorted(out, key=lambda m: (-m[4], -m[1], m[0], m[2])):  # the longest first; ties by coverage, name, place
            if free[m[2] : m[3]].all():
                free[m[2] : m[3]] = False
                kept.append(m)
        return sorted(kept, key=lambda m: m[2])


def _scan(index: Index):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                hits = index.search(found)
                at = [m.span() for m in _WORD.finditer(text)] if hits else []
                spans = [{"license": n, "coverage": c, "start": at[a][0], "end": at[b - 1][1], "matched": m} for n, c, a, b, m in hits]
                rows.append((doc_id, len(found), sum(m for *_, m in hits), ",".join(sorted({n for n, *_ in hits})), spans))
            columns = list(zip(*rows)) or [()] * 5
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), kind]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_words", "n_matched", "licenses", "matches"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: its licenses and matches (coverage, code-point span, matched words).

    Null and empty texts match nothing; equal texts match alike; overlapping
    matches leave the one with most words; long texts are scanned whole; further
    columns are ignored; an empty table gives no rows.
    """
    return arrow_map(narrow(docs, "doc_id", "text"), _scan(Index(templates)), "doc_id bigint, n_words bigint, n_matched bigint, licenses string, matches array<struct<license:string,coverage:double,start:bigint,end:bigint,matched:bigint>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document, rules as in ``scan``."""
    return scan(table(spark, sf_dir, "documents"))
