"""License scans: MinHash over overlapping text windows retrieves templates, shingle containment verifies them.

Words are runs of letters and digits, lower-cased in A-Z. A template of m five-word shingles is looked for in
windows of four to five steps of m/4 shingles, so each occurrence lies whole in one of them. A window and a template
are compared by HASHES one-row bands. The window that covers a full or nearly full occurrence has a Jaccard
similarity of at least 0.55 to the template, so all bands miss it with probability below 0.45 ** 24 < 1e-8. Every
retrieved (document, template) is then verified on the document's shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, Words, slices, split

SHINGLE, HASHES, CONTAINMENT = 5, 24, 0.8
_RNG = np.random.default_rng(610)
_XOR = _RNG.integers(1, 2**64, HASHES, dtype=U64)
_MUL = _RNG.integers(1, 2**64, HASHES, dtype=U64) | U64(1)
#: Bytes that end a word: all of ASCII but letters and digits.
_FOLD = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], dtype=np.uint8)

# Notices as the licenses' own texts ask for them, and whole short licenses, named -text.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words(text: pa.Array) -> Words:
    return split(text, lower=True, fold=_FOLD)


class Templates:
    """The shingles of each template and, by window size, its HASHES minima."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        self.sets: list[np.ndarray] = []
        self.classes: dict[int, list[int]] = {}  # step: templates
        for i, name in enumerate(self.names):
            words = _words(pa.array([texts[name]]))
            if len(words.start) < SHINGLE:
                raise ValueError(f"{name} has fewer than {SHINGLE} words")
            self.sets.append(np.unique(words.grams(words.hashes(), SHINGLE)))
            m = len(words.start) - SHINGLE + 1
            self.classes.setdefault(m if m <= 4 else -(-m // 4) * 1000, []).append(i)
        self.minima = [np.array([((s ^ x) * a).min() for x, a in zip(_XOR, _MUL, strict=True)]) for s in self.sets]

    @staticmethod
    def shape(key: int) -> tuple[int, int]:
        """Step and number of steps in a window: short templates slide by one."""
        return (1, key) if key < 1000 else (key // 1000, 5)

    def retrieve(self, grams: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(starts of windows that share a band, template)."""
        found: dict[int, list[np.ndarray]] = {}
        for i, (x, a) in enumerate(zip(_XOR, _MUL, strict=True)):
            hashed = (grams ^ x) * a
            for key, members in self.classes.items():
                step, count = self.shape(key)
                block = np.minimum.reduceat(hashed, np.arange(0, len(hashed), step)) if step > 1 else hashed
                least = block.copy()
                for j in range(1, min(count, len(block))):
                    np.minimum(least[:-j], block[j:], out=least[:-j])
                for t in members:
                    hit = np.flatnonzero(least == self.minima[t][i])
                    if len(hit):
                        found.setdefault(t, []).append(hit * step)
        return [(np.unique(np.concatenate(at)), t) for t, at in sorted(found.items())]


def _best_span(grams: np.ndarray, shingles: np.ndarray) -> tuple[int, int, int]:
    """(common, first, last shingle) of the span, at most a quarter longer than the template, that holds most of its
    distinct shingles; the earliest and then shortest among equals."""
    at = np.flatnonzero(np.isin(grams, shingles))
    room = len(shingles) + -(-len(shingles) // 4)
    best = (0, 0, -1)
    code = np.searchsorted(shingles, grams[at])
    count = np.zeros(len(shingles), int)
    left = common = 0
    for right in range(len(at)):
        count[code[right]] += 1
        common += count[code[right]] == 1
        while at[right] - at[left] >= room or count[code[left]] > 1:
            count[code[left]] -= 1
            common -= count[code[left]] == 0
            left += 1
        if common > best[0]:
            best = (int(common), int(at[left]), int(at[right]))
    return best


def _closest(hits: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of (template, first word, words, containment), those of which no other one that fits better, or as well and is
    longer, covers more than half: so one license of a family is named where its siblings share most of their text."""
    kept: list[tuple[int, int, int, float]] = []
    for t, first, n, share in sorted(hits, key=lambda h: (-h[3], -h[2], h[1], h[0])):
        if all(2 * (min(first + n, a + m) - max(first, a)) <= n for _, a, m, _ in kept):
            kept.append((t, first, n, share))
    return sorted(kept)


def _scan(templates: Templates, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "license_id": [], "first_word": [], "n_words": [], "containment": []}
            for part in slices(batch):
                words = _words(part.column("text"))
                grams = words.grams(words.hashes(), SHINGLE)
                if not len(grams):
                    continue
                ids = part.column("doc_id").to_pylist()
                found: dict[int, list[tuple[int, int, int, float]]] = {}
                for starts, t in templates.retrieve(grams):
                    reach = 5 * (len(templates.sets[t]) // 4 + 1) + len(templates.sets[t])
                    a = np.searchsorted(words.first, starts, "right") - 1
                    b = np.searchsorted(words.first, np.minimum(starts + reach, words.first[-1] - 1), "right") - 1
                    docs = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b, strict=True)]))
                    for d in docs[docs < len(ids)].tolist():
                        own = grams[words.first[d] : max(words.first[d + 1] - SHINGLE + 1, words.first[d])]
                        common, first, last = _best_span(own, templates.sets[t])
                        if common >= containment * len(templates.sets[t]):
                            found.setdefault(d, []).append((t, first, last - first + SHINGLE, common / len(templates.sets[t])))
                for d, hits in sorted(found.items()):
                    for t, first, n, share in _closest(hits):
                        for column, value in zip(out.values(), (ids[d], templates.names[t], first, n, round(share, 6)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("license_id", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))

    return run


def scan(docs: DataFrame, texts: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license_id, first_word, n_words, containment) for each row of docs and template that it contains.

    Containment is the share of the template's distinct shingles that stand in one span of the document at most a
    quarter longer than the template; the best and earliest span is given. Of templates whose spans overlap by more than
    half, the one that fits best is named, the longer one among equals. Null and empty texts contain nothing;
    rows that repeat are scanned each for itself; a null doc_id is kept; other columns don't matter. The templates
    are given with the call, so they go to the tasks in its closure. No shuffle.
    """
    templates = Templates(TEMPLATES if texts is None else texts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates, containment), "doc_id long, license_id string, first_word long, n_words long, containment double")
