"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A template of n bigrams can reach a coefficient t only in a window that shares t / (2 - t) * n of its bigrams and has
between that many and n * (2 - t) / t of its own; templates that a text can't hold by these bounds are pruned before
any window is looked at. For the others every window within the bounds that begins and ends with shared bigrams is compared
(bigrams with repeats), and the one with the largest coefficient counts; of equals the first.

Words are runs of letters and digits of the lower-cased text, so case, punctuation and line breaks don't matter. A text gets
the licence with the largest coefficient of at least ``threshold``; ties go to the longer template, then to the first in
alphabetical order. Null and empty texts have none. Long texts are read whole. Rows that repeat get one result each. An empty table
gives no rows; other columns are left out, whatever their names. Tasks keep nothing between texts; the templates (a fixed list, or the
caller's) are sent to them as sorted bigrams, about 3 MB for the list here.

Whole texts: Apache 2.0, GPL 2 and 3, LGPL 2.1 and 3, MPL 2.0, GFDL 1.3 and CC0 1.0; AGPL and the other CC licences by their notices only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Public licence texts and the notices that stand for them.
TEMPLATES = (
    ("MIT", GRANT + " " + NO_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-2-Clause", BSD + " " + BSD_END),
    ("BSD-3-Clause", BSD + " " + BSD_3 + " " + BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """The whole licences, word for word, from the folder beside this module; read by the driver only."""
    folder = resources.files("corvina.llm") / "licences"
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold = threshold
        self.names = [n for n, _ in templates]
        texts = [words(t) for _, t in templates]
        if any(len(w) < 2 for w in texts):
            raise ValueError("a template has two words or more")
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.base = len(self.number) + 1
        self.grams = [np.array([self.number[a] * self.base + self.number[b] for a, b in zip(t, t[1:], strict=False)]) for t in texts]
        self.counts = [Counter(g.tolist()) for g in self.grams]
        # the bigrams in order, and for each the templates that have it: the size is that of the templates' texts
        pairs = np.unique(np.concatenate([np.stack([g, np.full(len(g), k)], 1) for k, g in enumerate(self.grams)]), axis=0)
        self.gram, self.first = np.unique(pairs[:, 0], return_index=True)
        self.first, self.holder = np.append(self.first, len(pairs)), pairs[:, 1]
        self.fewest = np.array([threshold / (2 - threshold) * len(g) - 1e-9 for g in self.grams])

    def find(self, text: str | None) -> list[tuple[float, int, int, int]]:
        """(coefficient, template, first word, words) for each template that a text holds; the best first."""
        if not text:
            return []
        w = words(text)
        ids = np.fromiter(map(self.number.get, w, repeat(0)), np.int64, len(w))
        code = np.where((ids[1:] > 0) & (ids[:-1] > 0), ids[:-1] * self.base + ids[1:], 0)
        slot = np.searchsorted(self.gram, code)
        slot[slot == len(self.gram)] = 0
        hits = np.flatnonzero(self.gram[slot] == code)
        if not len(hits):
            return []
        found, t = [], self.threshold
        # a row for each hit and template that has its bigram, in order of place
        slot = slot[hits]
        many = self.first[slot + 1] - self.first[slot]
        holder = self.holder[np.repeat(self.first[slot] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        place = np.repeat(hits, many)
        for k in np.flatnonzero(np.bincount(holder, minlength=len(self.grams)) >= self.fewest):
            n, at = len(self.grams[k]), place[holder == k]
            # a hit counts in a window that starts behind the hit that is as many of its bigram back as the template has
            last: dict[int, list[int]] = {}
            back = np.full(len(at), -1)
            for x, c in enumerate(code[at].tolist()):
                seen = last.setdefault(c, [])
                if len(seen) >= self.counts[k][c]:
                    back[x] = seen[-self.counts[k][c]]
                seen.append(x)
            # every start at a hit, with every end at a hit up to the widest window that can reach the threshold
            end = np.searchsorted(at, at + int(n * (2 - t) / t + 1e-9))
            best = None
            for i in np.flatnonzero(end - np.arange(len(at)) >= max(1, t / (2 - t) * n - 1e-9)):
                shared = np.cumsum(back[i : end[i]] < i)
                if shared[-1] < t / (2 - t) * n - 1e-9:
                    continue
                dice = 2 * shared / (n + at[i : end[i]] - at[i] + 1)
                j = int(dice.argmax())
                if best is None or dice[j] > best[0]:
                    best = (float(dice[j]), int(k), int(at[i]), int(at[i + j] - at[i]) + 2)
                    if best[0] >= 1:
                        break
            if best and best[0] >= t - 1e-12:
                found.append(best)
        return sorted(found, key=lambda x: (-x[0], -len(self.grams[x[1]]), self.names[x[1]], x[2]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, license, dice, first_word, n_words, licenses) for each row of docs; licenses: all found, in order of name.
    Templates are the notices and whole texts here unless others are given. No shuffle."""
    templates = TEMPLATES + full_texts() if templates is None else templates
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates, threshold))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        for b in batches:
            rows = []
            for t in b.column(1):
                found = x.find(t.as_py())
                best = (x.names[found[0][1]], *found[0][:1], *found[0][2:]) if found else (None,) * 4
                rows.append((*best, sorted({x.names[f[1]] for f in found})))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], ["doc_id", "license", "dice", "first_word", "n_words", "licenses"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, "doc_id long, license string, dice double, first_word long, n_words long, licenses array<string>")
