"""License scans by patience alignment.

Texts and templates are compared as lower-cased words without ASCII punctuation. A
template's rarest words show where in a text a copy may stand; each such place gives a
window around it. Within a window, words that are unique in both sides anchor the
alignment: the longest increasing subsequence of their positions is kept, and the gaps
between kept anchors are aligned in the same way, down to gaps without common unique
words, which are aligned by longest common subsequence. Coverage is the share of the
template's words that are aligned.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.batches import by_bytes, map_texts, utf8

MIN_COVERAGE = 0.8
#: So many different probes must stand where a copy is sought.
NEEDED = 2

_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

# Texts and notices of public licenses, by SPDX identifier, and the notice of none.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ' + _BSD_DISCLAIMER,
    ],
    "BSD-2-Clause": ['Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ' + _BSD_DISCLAIMER],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'],
    "LicenseRef-proprietary": ["All rights reserved."],
}

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPLIT = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_LCS_CELLS = 1 << 14


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_SPLIT).lower().split()


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the first place, whose second places rise."""
    tails, at, back = [], [], [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tails, y)
        tails[pile : pile + 1] = [y]
        at[pile : pile + 1] = [k]
        back[k] = at[pile - 1] if pile else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common_subsequence(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Longest common subsequence; from each occurrence list where the table would be large."""
    if len(a) * len(b) > _LCS_CELLS:
        places: dict[bytes, list[int]] = {}
        for j, w in enumerate(b):
            places.setdefault(w, []).append(j)
        return increasing([(i, j) for i, w in enumerate(a) for j in reversed(places.get(w, ()))])
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places of equal words, rising on both sides (patience, then gaps)."""
    done: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            done.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            done.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        left, right = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {w: k for k, w in enumerate(b[j:j_end], j) if right[w] == 1}
        anchors = increasing([(k, where[w]) for k, w in enumerate(a[i:i_end], i) if left[w] == 1 and w in where])
        if not anchors:
            done += [(i + x, j + y) for x, y in _common_subsequence(a[i:i_end], b[j:j_end])]
            continue
        done += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (i_end, j_end)], strict=True):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(done)


class Templates:
    """Tokenised templates, and the probe words that lead to each.

    A copy may lack some of a template's words, so a template has two probes more than that:
    at least two of them stand in any copy, on nearly one diagonal (place in the text less
    place in the template).
    """

    def __init__(self, templates: dict[str, list[str]]):
        self.items = [(name, k, words_of(t.encode())) for name, texts in sorted(templates.items()) for k, t in enumerate(texts)]
        common = Counter(w for _, _, words in self.items for w in set(words))
        self.probes: dict[bytes, list[tuple[int, int]]] = {}
        for n, (_, _, words) in enumerate(self.items):
            once = [(w, p) for p, w in enumerate(words) if words.count(w) == 1]
            most = len(words) - math.ceil(MIN_COVERAGE * len(words)) + NEEDED
            for w, p in sorted(once, key=lambda x: (common[x[0]], -len(x[0]), x))[:most]:
                self.probes.setdefault(w, []).append((n, p))

    def scan(self, text: bytes | None) -> list[tuple]:
        """(license, template, coverage, start_word, end_word) of every copy in a text, in order.

        Of overlapping copies the one with most aligned words stays; ties go by name.
        """
        words = words_of(text)
        if self.probes.keys().isdisjoint(words):
            return []
        hits: dict[int, dict[int, set[int]]] = {}
        for k, w in enumerate(words):
            for n, p in self.probes.get(w, ()):
                hits.setdefault(n, {}).setdefault(k - p, set()).add(p)
        found = []
        for n, by_diagonal in hits.items():
            name, variant, own = self.items[n]
            for start, end in self._windows(by_diagonal, len(own), len(words)):
                matched = _densest(align(own, words[start:end]), len(own))
                if len(matched) >= MIN_COVERAGE * len(own):
                    found.append((len(matched), name, variant, len(matched) / len(own), start + matched[0][1], start + matched[-1][1] + 1))
        starts: list[int] = []  # of the copies kept, which do not overlap, so only the neighbours can
        kept: list[tuple] = []
        for row in sorted(found, key=lambda r: (-r[0], -r[3], r[1], r[2], r[4])):
            k = bisect_right(starts, row[4])
            if (not k or kept[k - 1][5] <= row[4]) and (k == len(kept) or row[5] <= starts[k]):
                starts.insert(k, row[4])
                kept.insert(k, row)
        return [row[1:] for row in kept]

    @staticmethod
    def _windows(by_diagonal: dict[int, set[int]], size: int, total: int) -> list[tuple[int, int]]:
        """Stretches of the text where enough different probes stand on nearly one diagonal."""
        slack, out, used = size // 4 + 1, [], set()
        places = sorted(by_diagonal)
        for d in sorted(places, key=lambda x: (-len(by_diagonal[x]), x)):
            if d in used:
                continue
            near = places[bisect_left(places, d - slack) : bisect_left(places, d + slack + 1)]
            if len(set().union(*(by_diagonal[x] for x in near))) >= NEEDED:
                used.update(near)
                out.append((max(0, d - slack), min(total, d + size + slack)))
        return out


def _densest(matched: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The aligned words in the stretch of at most 1.5 templates that holds most of them."""
    best, low = [], 0
    for k in range(len(matched)):
        while matched[k][1] - matched[low][1] >= size * 3 // 2 + 1:
            low += 1
        if k + 1 - low > len(best):
            best = matched[low : k + 1]
    return best


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each copy of a template in a text.

    (doc_id, license, template, coverage, start_word, end_word): ``template`` is the place in
    the license's list, words are counted from 0 with the end exclusive. Null and empty texts
    and empty tables give no rows; repeated rows give repeated rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license string, template int, coverage double, start_word bigint, end_word bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in by_bytes(batches, "text"):
            found = [(k, row) for k, text in enumerate(utf8(batch, "text")) for row in known.scan(text)]
            if found:
                ids = batch.column(0).take(pa.array([k for k, _ in found]))
                columns = zip(*(row for _, row in found), strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return map_texts(rows, each, schema)
