"""License scans: Dice coefficient over word bigrams against templates.

Text is normalised (A-Z lower-cased, every ASCII byte that is no letter or digit
a space) and compared with each template by the Dice coefficient of the two
multisets of word bigrams. Compared is, of every document, every window of
consecutive lines, so each line, each paragraph, the whole text and a text of
several paragraphs inside a longer one; where several windows overlap the best
counts.

Pruning is exact. A window of n bigrams can reach the threshold t with a template
of m bigrams only where m * t / (2 - t) <= n <= m * (2 - t) / t, and only if at
least m * t / (2 - t) of its bigrams occur in the template. A first or last line
that adds no common bigram lowers the coefficient, so windows with one are left
aside. Bigrams are looked up on whole Arrow batches, which leaves almost no text
to look at one by one.

At scale: a map; templates are constants of about a megabyte.

Edge cases: null and empty texts have no windows; windows of one word have
no bigrams and match nothing; ties go to the shorter window, then the earlier, then the
template first in order of its name;
repeated documents are scanned row by row; an empty table gives no rows; very long
texts are read whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, small_batches, texts_of, translated

THRESHOLD = 0.8
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

# Public license texts and the notices by which they are applied.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"].replace(" THIS SOFTWARE IS", " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS", 1)
TEMPLATES["AGPL-3.0-header"] = TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Affero General")
TEMPLATES["LGPL-3.0-header"] = TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Lesser General")
TEMPLATES |= {f"{p.stem}-text": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Templates:
    """The bigrams of templates in order of their names: ``keys`` has the numbers of all, ``counts`` how often each template has each (the last: any other)."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        found = {name: w for name, text in sorted(texts.items()) if len(w := words_of(text)) > 1}
        self.names, self.sizes = list(found), [len(w) - 1 for w in found.values()]
        self.words = {w: k for k, w in enumerate(sorted({w for x in found.values() for w in x}))}
        numbers = [self.numbers(np.array([self.words[w] for w in x])) for x in found.values()]
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *numbers]))
        self.counts = [np.bincount(np.searchsorted(self.keys, x), minlength=len(self.keys) + 1) for x in numbers]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each bigram of known words, -1 for others."""
        a, b = words[:-1].astype(np.int64), words[1:].astype(np.int64)
        return np.where((a >= 0) & (b >= 0), a * len(self.words) + b, -1)

    def grams(self, words: Words) -> np.ndarray:
        """For each word the place in ``keys`` of the bigram that it begins, or the number of keys."""
        out = np.full(len(words.codes), len(self.keys))
        if len(out) > 1 and len(self.keys):
            known = np.array([self.words.get(w, -1) for w in words.vocabulary])[words.codes]
            numbers = self.numbers(known)
            at = np.minimum(np.searchsorted(self.keys, numbers), len(self.keys) - 1)
            out[:-1] = np.where(self.keys[at] == numbers, at, len(self.keys))
        return out

    def windows(self, t: int, grams: np.ndarray, lines: np.ndarray) -> list[tuple[float, int, int]]:
        """(score, first line, last line) of the windows of a text that reach the threshold with template t; ``lines`` has the word at which each line begins, and the number of words."""
        m, counts, least = self.sizes[t], self.counts[t], self.sizes[t] * self.threshold / (2 - self.threshold) - 1e-9
        most = int(m * (2 - self.threshold) / self.threshold + 1e-9)
        good = counts[grams] > 0
        good[-1:] = False
        total = np.concatenate([[0], np.cumsum(good)])
        places = np.flatnonzero(good)
        owner = lambda at: np.searchsorted(lines, at, side="right") - 1
        starts, stops = np.unique(owner(places)), np.unique(owner(places + 1))
        starts = starts[total[np.minimum(lines[starts] + most, len(grams))] - total[lines[starts]] >= least]
        rank = np.zeros(len(grams), np.int64)
        order = places[np.argsort(grams[places], kind="stable")]
        first = np.concatenate([[True], np.diff(grams[order]) > 0])[: len(order)]
        rank[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        before, at, out = np.zeros(len(counts), np.int64), 0, []
        for i in starts.tolist():
            s = int(lines[i])
            passed = places[np.searchsorted(places, at) : np.searchsorted(places, s)]
            np.add.at(before, grams[passed], 1)
            at = s
            own = grams[s : s + most]
            shared = np.concatenate([[0], np.cumsum(good[s : s + most] & (rank[s : s + most] - before[own] < counts[own]))])
            ends = stops[np.searchsorted(stops, i) :]
            n = lines[ends + 1] - s - 1
            ends, n = ends[(n >= least) & (n <= most)], n[(n >= least) & (n <= most)]
            scores = 2 * shared[n] / (n + m)
            reached = scores >= self.threshold
            out += zip(scores[reached].tolist(), [i] * int(reached.sum()), ends[reached].tolist())
        return out


def found_in(column: pa.Array, templates: Templates) -> list[list[tuple[int, int, str, float]]]:
    """Per text: (start, end, template, score) in code points, best first where windows overlap, by start."""
    texts = texts_of(column)
    out: list[list] = [[] for _ in range(len(texts))]
    pieces = pc.split_pattern(texts, "\n")
    flat, ends = pieces.values, pieces.offsets.to_numpy()
    words = Words(translated(texts_of(flat), NORMAL))
    grams, begins = templates.grams(words), words.offsets[ends]
    grams[begins[1:][begins[1:] > begins[:-1]] - 1] = len(templates.keys)  # a bigram ends with its text
    known = np.flatnonzero(grams < len(templates.keys))
    owner = np.searchsorted(begins, known, side="right") - 1
    found: dict[int, list] = {}
    for t, (m, counts) in enumerate(zip(templates.sizes, templates.counts, strict=True)):
        n = np.bincount(owner[counts[grams[known]] > 0], minlength=len(texts))
        for d in np.flatnonzero(n >= max(1, m * templates.threshold / (2 - templates.threshold) - 1e-9)).tolist():
            lines = words.offsets[ends[d] : ends[d + 1] + 1] - begins[d]
            if hits := templates.windows(t, grams[begins[d] : begins[d + 1]], lines):
                found.setdefault(d, []).extend((*x, t) for x in hits)
    for d, hits in found.items():
        sizes = pc.utf8_length(flat.slice(ends[d], ends[d + 1] - ends[d])).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(sizes + 1)])
        score, i, j, t = map(np.array, zip(*hits, strict=True))
        a, b = start[i], start[j] + sizes[j]
        order = np.lexsort((t, a, b - a, -score))
        while len(order):
            k = order[0]
            out[d].append((int(a[k]), int(b[k]), templates.names[t[k]], float(score[k])))
            order = order[(j[order] < i[k]) | (i[order] > j[k])]
        out[d].sort()
    return out


SCHEMA = "doc_id bigint, license string, score double, n_licenses bigint, spans string"


def license_scan(docs: DataFrame, doc_id="doc_id", text="text", templates: dict[str, str] | None = None, threshold=THRESHOLD) -> DataFrame:
    """One row per document: its best license (null if none) and score, how many windows match, and all as name:start:end."""
    known = Templates(TEMPLATES if templates is None else templates, threshold)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text"):
            rows = []
            for i, hits in zip(batch.column("doc_id").to_pylist(), found_in(batch.column("text"), known), strict=True):
                best = min(hits, key=lambda x: (-x[3], x[2])) if hits else None
                rows.append((i, best and best[2], best and best[3], len(hits), ",".join(f"{n}:{a}:{b}" for a, b, n, _ in hits)))
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "license", "score", "n_licenses", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(look, SCHEMA)


def op3_licenses(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
