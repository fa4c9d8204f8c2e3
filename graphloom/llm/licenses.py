"""License scans: normalised text against licence templates by Dice coefficient over word bigrams (operator 2).

Normalising keeps words: lower-case (A-Z), without leading and trailing signs (so comment marks and line breaks don't
matter), runs of white space dropped. A licence is sought wherever it stands, alone or inside a longer text: every run of
words that begins at a bigram of a template and has up to (2 - t) / t times its words is scored against it by
2 |A & B| / (|A| + |B|) over the distinct bigrams of both. A coefficient of at least t needs |A & B| >= |B| t / (2 - t)
and |A| <= |B| (2 - t) / t, so starts without that many of the template's bigrams in reach are pruned before any run is
scored, and texts without any are never looked at again.

Defined cases: null, empty and one-word texts match nothing, nor does anything without templates; of several templates
the one with the most bigrams in common wins, then the higher coefficient, then the first name; repeated rows and rows
without an id are reported each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore, work

#: Licence notices, headers and texts (fixed values: the licences' own published words).
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_TRIM = np.zeros(256, bool)
_TRIM[0x21:0x30] = _TRIM[0x3A:0x41] = _TRIM[0x5B:0x61] = _TRIM[0x7B:0x7F] = True


def _words(w: textcore.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word without the signs around it; words of signs alone are left out."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):  # up to four signs at either side
        start += _TRIM[w.data[np.minimum(start, len(w.data) - 1)]] & (start < end)
        end -= _TRIM[w.data[np.maximum(end - 1, 0)]] & (end > start)
    keep = end > start
    return textcore.span_hashes(w.data, start[keep], end[keep]), w.doc()[keep]


def _pair(h: np.ndarray) -> np.ndarray:
    return textcore.mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])


class Templates:
    def __init__(self, texts: dict[str, str], least: float):
        self.names, self.least = sorted(texts), least
        rows = []
        for name in self.names:
            h, _ = _words(textcore.Words(pa.array([texts[name]]), lower=True))
            rows.append(_pair(h) if len(h) > 1 else np.zeros(0, np.uint64))
        spread = (2 - least) / least
        self.reach = [int(np.ceil(len(r) * spread)) for r in rows]  # bigrams of the longest run
        rows = [np.unique(r) for r in rows]
        self.size = np.array([len(r) for r in rows], np.int64)
        self.need = np.ceil(self.size / spread - 1e-9).astype(np.int64)
        keys = np.concatenate([*rows, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows)), self.size)
        order = np.argsort(keys, kind="stable")
        self.owner = owner[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.table = np.zeros(1 << 18, bool)
        self.table[self.keys >> np.uint64(46)] = True

    def scan(self, key: np.ndarray, doc: np.ndarray, docs: int) -> list[tuple | None]:
        """For each document the best (bigrams in common, coefficient, template, first bigram of the run, its bigrams), or
        None; key, doc: the bigrams of all documents in order."""
        best: list[tuple | None] = [None] * docs
        hit = np.flatnonzero(self.table[key >> np.uint64(46)])
        if not len(hit) or not len(self.keys):
            return best
        slot = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
        right = self.keys[slot] == key[hit]
        hit, slot = hit[right], slot[right]
        n = self.first[slot + 1] - self.first[slot]
        at = np.repeat(hit, n)
        owner = self.owner[np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.argsort(owner, kind="stable")
        at, owner = at[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(self.names) + 1))
        ends = np.searchsorted(doc, doc, "right")  # where each bigram's document ends
        before = None
        for t in range(len(self.names)):
            mine = at[cuts[t] : cuts[t + 1]]
            if len(mine) < self.need[t]:
                continue
            limit = np.minimum(mine + self.reach[t], ends[mine])
            starts = mine[np.searchsorted(mine, limit) - np.arange(len(mine)) >= self.need[t]]
            if not len(starts):
                continue
            if before is None:  # the bigram's last occurrence before it
                by = np.argsort(key, kind="stable")
                before = np.full(len(key), -1, np.int64)
                same = key[by[1:]] == key[by[:-1]]
                before[by[1:][same]] = by[:-1][same]
            inside = np.zeros(len(key), bool)
            inside[mine] = True
            mine_best: dict[int, tuple] = {}  # the template's best run in each document
            for some in np.array_split(starts, -(-len(starts) * self.reach[t] // (1 << 20))):
                span = some[:, None] + np.arange(self.reach[t])
                ok = span < ends[some][:, None]
                span = np.minimum(span, len(key) - 1)
                new = ok & (before[span] < some[:, None])  # a bigram counts once a run
                both, size = np.cumsum(new & inside[span], axis=1), np.cumsum(new, axis=1)
                dice = np.where(ok, 2 * both / (size + self.size[t]), 0.0)
                last = dice.argmax(axis=1)
                top = dice[np.arange(len(some)), last]
                for k in np.flatnonzero(top >= self.least).tolist():
                    d, end = int(doc[some[k]]), int(last[k])
                    if d not in mine_best or top[k] > mine_best[d][1]:
                        mine_best[d] = (int(both[k, end]), float(top[k]), t, int(some[k]), end + 1)
            for d, found in mine_best.items():
                if best[d] is None or found[:2] > best[d][:2]:
                    best[d] = found
        return best


def scan(documents: DataFrame, *, templates: dict[str, str] | None = None, least: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, shared, first_word, n_words) of every row: the best template, bigrams in common with it, and
    the run of words (of those that aren't signs alone) that holds it; nulls without a match."""
    spark = documents.sparkSession
    work.ship(spark)
    sent = spark.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, least))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        t = sent.value
        for batch in batches:
            for part in textcore.slices(batch, 1):
                best = _scan_part(t, part.column(1))
                cols = [part.column(0), *(pa.array([b[k] for b in best], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "license", "dice", "shared", "first_word", "n_words"])

    return work.map_arrow(docs, run, "doc_id long, license string, dice double, shared long, first_word long, n_words long")


def _scan_part(t: Templates, texts: pa.Array) -> list[tuple]:
    w = textcore.Words(texts, lower=True)
    docs = len(w.off) - 1
    none = (None,) * 5
    if len(w) < 2:
        return [none] * docs
    h, doc = _words(w)
    if len(h) < 2:
        return [none] * docs
    same = doc[1:] == doc[:-1]
    place = np.flatnonzero(same)
    first = np.searchsorted(doc, np.arange(docs))
    out = []
    for d, b in enumerate(t.scan(_pair(h)[same], doc[:-1][same], docs)):
        out.append(none if b is None else (t.names[b[2]], b[1], b[0], int(place[b[3]] - first[d]), b[4] + 1))
    return out


def op2(documents: DataFrame) -> DataFrame:
    return scan(documents).withColumn("dice", F.round("dice", 6))
