"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

License templates are cut into words; hashes of ``GRAM`` words are winnowed (the least of each window of ``WINDOW``
neighbours is kept), and an inverted index leads from a fingerprint to templates and places. Texts are winnowed alike,
so any match of GRAM + WINDOW - 1 words shares a fingerprint; shorter templates are looked up whole, at every place.
Hits of a text near one diagonal are a candidate; it is aligned with its template inside a band around its diagonals
(matches against gaps and substitutions), which gives the matched words, the coverage of the template and the span in
the text.

Defined results: texts without a word have no finding; a template found several times in a text gives a row for each
place; of overlapping findings of one text the one with more matched words stays (ties: the template that sorts
first); repeated rows each get their findings; templates without a word are never found; empty tables give an empty
result. Columns other than the id and the text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.text import flat, ngram_hashes, ngram_starts, own, slices, word_hashes

GRAM, WINDOW, BAND = 3, 2, 8

#: Public license notices, by identifier.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-2-Clause-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-short": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": 'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.',
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the least hash of each window, the last of equals."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))], np.int64) if n else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(n - window + 1) + window - 1 - views[:, ::-1].argmin(axis=1))


class Fingerprints:
    """Fingerprint of ``gram`` words -> (template, place), as sorted arrays."""

    def __init__(self, gram: int, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.gram = gram
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        self.low = np.zeros(1 << 20, bool)
        self.low[self.keys & np.uint64(0xFFFFF)] = True


class TemplateIndex:
    """Inverted indexes of templates: one of winnowed fingerprints, and one for each length of templates that are too
    short for winnowing to be sure to pick their fingerprint; these are looked up at every place."""

    def __init__(self, templates: list[tuple[str, list[int]]]):
        self.names = [t[0] for t in templates]
        self.words = [np.array(t[1], np.int64) for t in templates]
        long, short = [], {}
        for k, w in enumerate(self.words):
            if len(w) >= GRAM + WINDOW - 1:
                h = ngram_hashes(w, GRAM)
                long += [(int(h[p]), k, int(p)) for p in winnow(h, WINDOW)]
            else:
                short.setdefault(len(w), []).append((int(ngram_hashes(w, len(w))[0]), k, 0))
        self.winnowed = Fingerprints(GRAM, long)
        self.whole = [Fingerprints(n, rows) for n, rows in sorted(short.items())]


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """(score, matched words, first, last word of the text) of the best local alignment between two diagonals (place in
    the text minus place in the template): +2 a match, -1 a gap or a substitution. Of equal scores the one that ends
    first in the template, then in the text."""
    width = high - low + 1
    padded = np.full(len(template) + width, -1, np.int64)  # the band's words of the text, from place ``low`` on
    real = np.zeros(len(padded), bool)
    a, z = max(low, 0), min(low + len(padded), len(text))
    if a >= z:
        return 0, 0, -1, -1
    padded[a - low : z - low], real[a - low : z - low] = text[a:z], True
    place = np.arange(width)
    score, matched, begin = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1, np.int64)
    best = (0, 0, -1, -1)
    for i, word in enumerate(template.tolist()):
        here = real[i : i + width]
        hit = (padded[i : i + width] == word) & here
        s, k, f = score + np.where(hit, 2, -1), matched + hit, begin
        # a gap in the text: from the row before, one diagonal on
        up = np.append(score[1:] - 1, -1)
        gap = up > s
        s = np.where(gap, up, s)
        k, f = np.where(gap, np.append(matched[1:], 0), k), np.where(gap, np.append(begin[1:], -1), f)
        f = np.where((f < 0) | (s <= 0), low + i + place, f)
        s = np.where(here, np.maximum(s, 0), 0)
        k = np.where(s > 0, k, 0)
        # a gap in the template: along the row, one off for each step, so the greatest of what came before plus its place
        reach = s + place
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, place, 0))
        s = np.where(here, np.maximum(top - place, 0), 0)
        score, matched, begin = s, np.where(s > 0, k[source], 0), np.where(s > 0, f[source], -1)
        d = int(score.argmax())
        if score[d] > best[0]:
            best = (int(score[d]), int(matched[d]), int(begin[d]), low + i + d)
    return best


def bands(diagonals: list[int], length: int) -> list[tuple[int, int]]:
    """Bands around hits of one template of ``length`` words: hits that lie near each other are one candidate, whose
    band covers them all; copies of a template that follow each other are a length apart, so they stay two."""
    out: list[tuple[int, int]] = []
    near = min(4 * BAND, max(1, length // 2))
    for d in sorted(set(diagonals)):
        if out and d - out[-1][1] <= near and d - out[-1][0] < length:
            out[-1] = (out[-1][0], d)
        else:
            out.append((d, d))
    margin = min(BAND, max(1, length // 2))
    return [(a - margin, z + margin) for a, z in out]


def scan(values: np.ndarray, offsets: np.ndarray, index: TemplateIndex, least: float) -> list[tuple[int, str, float, int, int, int]]:
    """(row, template, coverage, matched, first, last word) of all findings in rows of word hashes."""
    found: dict[int, list[tuple[int, int]]] = {}

    def look_up(at: Fingerprints, hashes: np.ndarray, some: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        maybe = some[at.low[hashes[some] & np.uint64(0xFFFFF)]]
        lo, hi = np.searchsorted(at.keys, hashes[maybe], "left"), np.searchsorted(at.keys, hashes[maybe], "right")
        for g, a, b in zip(maybe.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in range(a, b):
                found.setdefault(int(row[g]), []).append((int(at.template[k]), int(place[g] - at.place[k])))

    def grams(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, counts = ngram_starts(offsets, n)
        row = np.repeat(np.arange(len(counts)), counts)
        return ngram_hashes(values, n)[starts] if len(starts) else np.empty(0, np.uint64), counts, row, starts - offsets[row]

    if len(index.winnowed.keys):
        hashes, counts, row, place = grams(GRAM)
        # winnowing over all rows at once; a window never reaches into the next row
        less = np.zeros(len(hashes), bool)
        same = row[1:] == row[:-1]
        less[1:] |= same & (hashes[1:] <= hashes[:-1])
        less[:-1] |= same & (hashes[:-1] < hashes[1:])
        less[(np.cumsum(counts) - 1)[counts == 1]] = True
        look_up(index.winnowed, hashes, np.flatnonzero(less), row, place)
    for at in index.whole:
        hashes, _, row, place = grams(at.gram)
        look_up(at, hashes, np.arange(len(hashes)), row, place)
    out = []
    for r, hits in sorted(found.items()):
        text = values[offsets[r] : offsets[r + 1]]
        by: dict[int, list[int]] = {}
        for t, diagonal in hits:
            by.setdefault(t, []).append(diagonal)
        spans = []
        for t, diagonals in by.items():
            for low, high in bands(diagonals, len(index.words[t])):
                _, matched, first, last = align(index.words[t], text, low, high)
                if (cover := matched / len(index.words[t])) >= least:
                    spans.append((-matched, index.names[t], cover, first, last))
        taken: list[tuple[int, int]] = []
        for matched, name, cover, first, last in sorted(spans):
            if all(last < a or first > z for a, z in taken):
                taken.append((first, last))
                out.append((r, name, cover, -matched, first, last))
    return out


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None, least_coverage: float = 0.7) -> DataFrame:
    """Rows (id, t, license, coverage, matched, first_word, last_word); t is a hash of the text."""
    spark = docs.sparkSession
    given = sorted((templates or TEMPLATES).items())
    hashed = spark.createDataFrame(given, "name string, body string").select("name", word_hashes("body").alias("w")).collect()
    shared = spark.sparkContext.broadcast(TemplateIndex([(r[0], r[1]) for r in hashed if r[1]]))
    fed = docs.select(own(key).alias("id"), F.xxhash64(own(text)).alias("t"), word_hashes(own(text)).alias("w"))
    schema = fed.selectExpr("id", "t", "'' license", "cast(0 as double) coverage", "0L matched", "0L first_word", "0L last_word").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for x in slices(batches, "w", budget=1_000_000):
            values, offsets = flat(x.column("w"))
            found = scan(values, offsets, index, least_coverage)
            if found:
                at = pa.array([f[0] for f in found], pa.int64())
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array([f[k + 1] for f in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([x.column("id").take(at), x.column("t").take(at), *cols], names=[f.name for f in schema.fields])

    return fed.mapInArrow(run, schema)


def op1_query(spark, sf_dir) -> DataFrame:
    from hearsay.runtime import table

    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "license", "coverage", "matched", "first_word", "last_word")
