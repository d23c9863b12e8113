"""License scans by patience alignment of a text's words with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices and grants of well-known public licenses.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
    "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
ISC_TEXT = (
    ISC_GRANT + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
BSD_THIRD = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
ZLIB_TEXT = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
    "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
    "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered "
    "source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice "
    "may not be removed or altered from any source distribution."
)
UNLICENSE_TEXT = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law."
)
BSL_TEXT = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
    "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
    "so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license "
    "grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and "
    "all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
    "object code generated by a source language processor."
)
APACHE_REST = (
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
GPL_REST = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
    "received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at"
)
GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version."
)
MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at"
)
#: License, words that an alignment has to include, template.
TEMPLATES = (
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "apache", APACHE_NOTICE),
    ("Apache-2.0", "apache", APACHE_NOTICE + APACHE_REST),
    ("BSD", "", BSD_GRANT),
    ("BSD-2-Clause", "", BSD_GRANT + BSD_DISCLAIMER),
    ("BSD-3-Clause", "endorse", BSD_GRANT + BSD_THIRD + BSD_DISCLAIMER),
    ("BSD", "bsd", "Released under the BSD License"),
    ("BSL-1.0", "", BSL_TEXT),
    ("CC-BY-4.0", "cc by 4", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "cc nc 4", "Licensed under CC BY NC 4.0"),
    ("CC-BY-SA-4.0", "cc sa 4", "Licensed under CC BY SA 4.0"),
    ("GPL-2.0", "gnu 2", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "gnu 3", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "gnu 3", GPL_NOTICE),
    ("GPL-3.0", "gnu 3", GPL_NOTICE + GPL_REST),
    ("ISC", "", ISC_GRANT),
    ("ISC", "", ISC_TEXT),
    ("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "mit", "Released under the MIT License"),
    ("MIT", "", MIT_GRANT),
    ("MPL-2.0", "mozilla", MPL_NOTICE),
    ("Unlicense", "", UNLICENSE_TEXT),
    ("Zlib", "", ZLIB_TEXT),
)
#: Share of a template's words that must align.
COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), rising in both.

    Anchors are the words that are unique in both; of these the longest run that rises in both stays. Equal words next
    to an anchor or an end extend it, and the gaps between are aligned the same way, without recursion on the stack.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {template[j]: j for j in range(c, d) if there[template[j]] == 1}
        unique = [(i, place[text[i]]) for i in range(a, b) if here[text[i]] == 1 and text[i] in place]
        tails: list[int] = []
        tops: list[int] = []
        before = [-1] * len(unique)
        for k, (_, j) in enumerate(unique):
            pile = bisect_left(tails, j)
            before[k] = tops[pile - 1] if pile else -1
            tails[pile : pile + 1], tops[pile : pile + 1] = [j], [k]
        k, run = (tops[-1] if tops else -1), []
        while k >= 0:
            run.append(unique[k])
            k = before[k]
        if not run:
            continue
        out += run
        edges = [(a - 1, c - 1), *reversed(run), (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Templates:
    """Templates as words, each with its rarest words: any text that covers enough of it holds one of those."""

    def __init__(self, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.names = [n for n, _, _ in templates]
        self.needed = [set(w.split()) for _, w, _ in templates]
        self.words = [WORD.findall(t.lower()) for _, _, t in templates]
        often = Counter(w for x in self.words for w in set(x))
        self.seeds = []
        for x in self.words:
            spare, seeds = len(x) - int(-(-coverage * len(x) // 1)), []
            for w in sorted(set(x), key=lambda w: (-len(w) * (not w.isdigit()), often[w], w)):
                seeds.append(w)
                spare -= x.count(w)
                if spare < 0:
                    break
            self.seeds.append(frozenset(seeds))
        self.gate = sorted(frozenset().union(*self.seeds))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each place where a template is covered, in order of place.

        Where a rare word of a template stands, the template's stretch of text around it, with a fifth more on both
        sides, is aligned with the template; stretches with too few of its words aren't. So the work is linear in the
        text. Of places that overlap the one with most words aligned stays.
        """
        lower = (text or "").lower()
        if not any(w in lower for w in self.gate):
            return []
        words = WORD.findall(lower)
        places: dict[str, list[int]] = {w: [] for w in self.gate}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        found: set[tuple[int, str, float, int, int]] = set()
        for name, needed, template, seeds in zip(self.names, self.needed, self.words, self.seeds, strict=True):
            n, slack = len(template), len(template) // 5 + 1
            bag = Counter(template)
            starts = {i - j for j, w in enumerate(template) if w in seeds for i in places[w]}
            for start in starts:
                a, b = max(0, start - slack), min(len(words), start + n + slack)
                if b <= a or (Counter(words[a:b]) & bag).total() < self.coverage * n:
                    continue
                pairs = patience(words[a:b], template)
                if len(pairs) >= self.coverage * n and needed <= {template[j] for _, j in pairs}:
                    found.add((len(pairs), name, len(pairs) / n, a + pairs[0][0], a + pairs[-1][0]))
        best, taken = [], bytearray(len(words))
        for _, name, coverage, first, last in sorted(found, key=lambda h: (-h[0], -h[2], h[4] - h[3], h[3], h[1])):
            if not any(taken[first : last + 1]):
                taken[first : last + 1] = b"\1" * (last + 1 - first)
                best.append((name, coverage, first, last))
        return sorted(best, key=lambda h: (h[2], h[0]))


def scan(docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> DataFrame:
    """(row, found): each row of ``docs`` as a struct without its text; found: array of license, coverage, start, stop.

    Words are runs of letters and digits, in lower case; start and stop count words, both included. Whole texts are
    read, of any length; the gate of rare words leaves out no place that covers COVERAGE of a template. A null or empty
    text has an empty array. Repeated rows stay.
    """
    known = Templates(templates)
    kind = "array<struct<license:string,coverage:double,start:long,stop:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            found = [[dict(zip(("license", "coverage", "start", "stop"), h, strict=True)) for h in known.scan(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, shape)], names=["row", "found"])

    rest = F.struct(*[F.col(c) for c in docs.columns if c != text], F.lit(0).alias("_"))
    rows = docs.select(rest.alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, found {kind}")
