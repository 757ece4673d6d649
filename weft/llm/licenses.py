"""Licence notices and texts within documents.

Winnowed fingerprints of the templates' word shingles form an inverted index.  A
document's shingles look themselves up in it; templates with hits are candidates.
Hits that follow each other in both texts are chained, and an alignment of words in a
band around the chain, wider where the chain changes its diagonal, gives the matched
share and the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import ALNUM, LOWER, U, between, buffer, prefix, slices, words

#: Words of a shingle, shingles of a winnowing window, how far an alignment may stray from its chain, and by how much
#: two hits of a chain may differ in their distances (both at most a quarter of the template).
SHINGLE, WINDOW, BAND, JUMP = 3, 2, 8, 64
#: Most bytes of all templates together.
MOST = 4 << 20

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Notices that name a licence, headers of files, and whole texts of short licences (fixed values: the licences' own words).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "Released under CC0 1.0 into the public domain.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": _MIT,
    "mit": f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-conditions": _BSD,
    "bsd-2-clause": f"{_BSD} {_BSD_TWO} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} {_BSD_TWO} {_BSD_NAME} {_BSD_END}",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "lgpl-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the rightmost of equals."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())]) if len(hashes) else np.zeros(0, np.int64)
    grid = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(grid)) + window - 1 - grid.argmin(1))


def align(template: np.ndarray, text: np.ndarray, centre: np.ndarray, band: np.ndarray) -> tuple[int, int, int]:
    """Matched words, first and last + 1 matched word of the text, by the longest common subsequence in a band.

    Cell (i, j) is in the band if |j - centre[i]| <= band[i].
    """
    none = (0, -1, -1)
    above: dict[int, tuple[int, int, int]] = {}
    for word, middle, wide in zip(template.tolist(), centre.tolist(), band.tolist()):
        row: dict[int, tuple[int, int, int]] = {}
        low, high = max(0, middle - wide), min(len(text) - 1, middle + wide)
        # what stood in the row above up to here
        before = max((v for j, v in above.items() if j < low), default=none, key=lambda v: v[0])
        left = before
        for j, own in zip(range(low, high + 1), text[low : high + 1].tolist()):
            up = above.get(j, none)
            up = up if up[0] >= before[0] else before
            best = up if up[0] >= left[0] else left
            if own == word and before[0] + 1 > best[0]:
                best = (before[0] + 1, before[1] if before[0] else j, j + 1)
            row[j] = left = best
            before = up
        if above:  # what the band leaves behind on the right stays reachable
            last = max(above.values(), key=lambda v: v[0])
            if not row or last[0] > max(v[0] for v in row.values()):
                row[max(high, low)] = last
        above = row
    return max(above.values(), default=none, key=lambda v: v[0])


def chains(places: np.ndarray, marks: np.ndarray, size: int) -> list[np.ndarray]:
    """Hits, in the order of ``places`` in the text, chained while ``marks`` in the template of ``size`` words rise alike."""
    jump = min(JUMP, size // 4)
    open_: list[list[int]] = []
    done: list[list[int]] = []
    for k, (p, q) in enumerate(zip(places.tolist(), marks.tolist())):
        for c in [c for c in open_ if p - places[c[-1]] > size + jump]:
            open_.remove(c)
            done.append(c)
        fit = [c for c in open_ if p > places[c[-1]] and q > marks[c[-1]] and abs((p - places[c[-1]]) - (q - marks[c[-1]])) <= jump]
        if fit:
            min(fit, key=lambda c: (abs((p - places[c[-1]]) - (q - marks[c[-1]])), -c[-1])).append(k)
        else:
            open_.append([k])
    return [np.array(c) for c in (*done, *open_)]


def around(places: np.ndarray, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the template where the chain expects it, and how far the band reaches there."""
    rows = np.arange(size)
    shift = places - marks
    at = np.searchsorted(marks, rows, "right") - 1
    before, after = np.maximum(at, 0), np.minimum(at + 1, len(marks) - 1)
    band = min(BAND, size // 4) + np.abs(shift[after] - shift[before])
    return rows + shift[before], band


class Templates:
    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        column = pa.array(list(templates.values()), pa.string())
        if sum(len(t.encode()) for t in templates.values()) > MOST:
            raise ValueError(f"templates have more than {MOST} bytes")
        raw, offsets = buffer(column)
        _, _, first, hashes = words(LOWER[raw], offsets, ALNUM)
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        keys, owner, place = [], [], []
        for k, w in enumerate(self.words):
            own = shingles(w, np.array([0, len(w)]))[1]
            for p in winnow(own, WINDOW).tolist():
                keys.append(own[p])
                owner.append(k)
                place.append(p)
        order = np.argsort(np.array(keys, U), kind="stable")
        self.keys, self.owner, self.place = np.array(keys, U)[order], np.array(owner, np.int64)[order], np.array(place, np.int64)[order]


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every shingle; a text of fewer words has its one whole shingle."""
    total = int(first[-1])
    count = np.diff(first)
    size = np.minimum(SHINGLE, np.repeat(count, count))
    left = np.repeat(first[1:], count) - np.arange(total)
    starts = np.flatnonzero(left >= size) if total else np.zeros(0, np.int64)
    return starts, between(prefix(hashes, 6), starts, starts + size[starts], 6) if total else np.zeros(0, U)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, matches) of each row.

    matches lists (license, coverage, start_word, end_word, start_byte, end_byte) of
    each place where at least ``least`` of a template's words align, in order of
    place; of places that overlap, the one with most matched words stays (of equals
    the better covered, then the earlier).  Null and empty texts match nothing; repeated rows are each scanned.
    """
    index = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), *((n, pa.int64()) for n in ("start_word", "end_word", "start_byte", "end_byte"))]))
        for batch in slices(batches):
            raw, offsets = buffer(batch.column("text"))
            starts, ends, first, hashes = words(LOWER[raw], offsets, ALNUM)
            at, keys = shingles(hashes, first)
            hit = np.zeros(len(keys), dtype=bool)
            if len(known.keys):
                hit = known.keys[np.minimum(np.searchsorted(known.keys, keys), len(known.keys) - 1)] == keys
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            of = np.searchsorted(first, at[hit], "right") - 1
            known_of = [np.arange(a, b) for a, b in zip(np.searchsorted(known.keys, keys[hit], "left").tolist(), np.searchsorted(known.keys, keys[hit], "right").tolist())]
            many = np.array([len(x) for x in known_of], np.int64)
            entry = np.concatenate([np.zeros(0, np.int64), *known_of])
            of, place = np.repeat(of, many), np.repeat(at[hit], many)
            owner, mark = known.owner[entry], known.place[entry]
            order = np.lexsort((mark, place, owner, of))
            of, place, owner, mark = of[order], place[order], owner[order], mark[order]
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(owner) != 0)) + 1
            for group in np.split(np.arange(len(of)), cuts) if len(of) else []:
                i, k = int(of[group[0]]), int(owner[group[0]])
                template, a, b = known.words[k], int(first[i]), int(first[i + 1])
                for chain in chains(place[group] - a, mark[group], len(template)):
                    p, q = place[group][chain] - a, mark[group][chain]
                    centre, band = around(p, q, len(template))
                    low = max(0, int((centre - band).min()))
                    n, x, y = align(template, hashes[a + low : min(b, a + int((centre + band).max()) + 1)], centre - low, band)
                    if n and n / len(template) >= least:
                        x, y = x + low, y + low
                        found[i].append({"license": known.names[k], "coverage": n / len(template), "start_word": x, "end_word": y, "start_byte": int(starts[a + x] - offsets[i]), "end_byte": int(ends[a + y - 1] - offsets[i]), "n": n})
            out = []
            for i, matches in enumerate(found):
                kept: list[dict] = []
                taken = np.zeros(int(first[i + 1] - first[i]) if matches else 0, dtype=bool)
                for m in sorted(matches, key=lambda m: (-m.pop("n"), -m["coverage"], m["start_word"], m["license"])):
                    if not taken[m["start_word"] : m["end_word"]].any():
                        taken[m["start_word"] : m["end_word"]] = True
                        kept.append(m)
                out.append(sorted(kept, key=lambda m: m["start_word"]))
            yield pa.record_batch([batch.column("key"), pa.array(np.diff(first)), pa.array(out, kind)], names=["key", "n_words", "matches"])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words bigint, matches array<struct<license:string,coverage:double,start_word:bigint,end_word:bigint,start_byte:bigint,end_byte:bigint>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
