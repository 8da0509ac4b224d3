"""License scans by conditional compression, confirmed by exact wording differences.

A mark (as 'licensed' or 'copyright') in a text begins a candidate block: the words around it, as many as the longest template of a length class has on each side. The block is
compressed with zstandard plainly and with each template of the class as raw dictionary, and the templates are ranked by how many bytes they save. Of those of ``LOOSE`` words and more, only the ones come into question that save the block at
least ``LEAST`` of what they save their own text. Down the ranking, the first one whose wording is confirmed is the finding (of those that save the same but for ``SLACK`` bytes, the one with the fewest differences): it is
aligned with the block word by word (the cheapest place of the whole template inside the block). A
template of 20 words or more may differ in a tenth of them, a shorter one in one, one of under four words in none, and none may differ in a name (as 'affero' or 'by-nc') or a word with a digit. So compression finds the
template and the wording confirms it: version 2 is not taken for version 3. That the share loses nothing is measured: every template, altered at random as far as it may be, amid prose and other notices, saves half of its own
and more (see the tests). The words of a block before and behind a finding are searched again as long as they hold a mark and a template is
confirmed, so notices that stand side by side are all found.

Texts without a mark are passed over in Arrow. Equal blocks are resolved once a batch. Rows keep their partition; nothing is shuffled.

Defined results: null, empty and unmarked texts have no findings. Repeated rows have theirs each; null ids pass through; other columns are ignored; an empty table gives
an empty result. Words are compared in lower case without punctuation. Findings of a text do not overlap: longer templates come first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import slices, texts_of

_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_AUTHOR_DISCLAIMS = (
    " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely"
)
#: Notices by license. Several wordings of one license are told apart by what follows the colon.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0:header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License.",
    "MIT:licensed": "Licensed under the MIT License.",
    "MIT:grant": _MIT,
    "MIT:text": _MIT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY,
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0:or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD:grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MPL-2.0:header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC:grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC:text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _AUTHOR_DISCLAIMS,
    "0BSD:text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _AUTHOR_DISCLAIMS,
    "Zlib:grant": _ZLIB,
    "Zlib:text": _ZLIB + ", subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0:text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
    "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
    "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense:text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause:text": _CLAUSES + _DISCLAIMER,
    "BSD-3-Clause:text": _CLAUSES + _NO_ENDORSEMENT + _DISCLAIMER,
} | {
    f"{tag}:tag": f"SPDX-License-Identifier: {tag}"
    for tag in ("Apache-2.0", "MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense")
}
#: Words that tell licenses apart, as do all words with a digit.
NAMES = frozenset("apache mit isc zlib unlicense bsd gnu general lesser library affero mozilla mpl cc by by-sa by-nc by-nc-sa by-nd by-nc-nd".split())
#: What marks a candidate block.
MARK = r"licen[cs]|copyright|redistribut|public\s+domain|permission\s+(?:is|to\s+use)|released\s+under"
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: Words up to which a template is short or of middle length; words under which none and up to which one may differ, and the share of longer ones.
LENGTHS, STRICT, LOOSE, TOLERANCE = (16, 90), 4, 20, 0.1
#: The least share of the bytes that a template saves its own text, for it to come into question; bytes within which savings count as the same.
LEAST, SLACK = 0.35, 10
#: Level of compression, and words of the blocks that are kept in memory.
LEVEL, MEMO_WORDS = 19, 1_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed(template: list[str]) -> int:
    """Differences that a template may have."""
    n = len(template)
    return 0 if n < STRICT else 1 if n < LOOSE else int(TOLERANCE * n)


def align(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(differences, start, end) of the cheapest place of the whole template inside the block; of equal ones the earliest end. Differences are words left out, put in or changed."""
    codes = {w: n for n, w in enumerate(dict.fromkeys(template + block))}
    words = np.array([codes[w] for w in block], np.int64)
    width = len(block) + 1
    at, cost = np.arange(width), np.zeros(width, np.int64)
    begin = np.arange(width)
    for i, w in enumerate(template, 1):
        changed = np.append(i, cost[:-1] + (words != codes[w]))
        from_left = np.append(0, begin[:-1])
        left_out = cost + 1
        better = left_out < changed
        new, start = np.where(better, left_out, changed), np.where(better, begin, from_left)
        new[0], start[0] = i, 0
        # Words put in: new[j] = min over k <= j of new[k] + (j - k).
        low = new - at
        best = np.minimum.accumulate(low)
        source = np.maximum.accumulate(np.where(low == best, at, 0))
        cost, begin = best + at, start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Templates:
    def __init__(self, templates: Mapping[str, str]):
        self.words = {name: words_of(text) for name, text in templates.items()}
        of_length = lambda name: sum(len(self.words[name]) > most for most in LENGTHS)
        self.classes = [names for k in range(len(LENGTHS), -1, -1) if (names := [n for n in self.words if of_length(n) == k])]
        self.reach = [max(len(self.words[n]) for n in names) for names in self.classes]
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, **options)
        self.plain = zstandard.ZstdCompressor(compression_params=parameters)
        self.given = {n: zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, w in self.words.items()}
        self.own = {n: self.saving(" ".join(w).encode(), n) for n, w in self.words.items()}
        self.memo: dict[tuple, tuple | None] = {}
        self.memo_words = 0

    def saving(self, raw: bytes, name: str, size: int | None = None) -> int:
        """Bytes that the template as dictionary saves. size: of the plain compression, if it is known."""
        return (len(self.plain.compress(raw)) if size is None else size) - len(self.given[name].compress(raw))

    def ranked(self, block: list[str], names: list[str]) -> list[tuple[int, str]]:
        """(bytes that the template saves, name) of those that save enough, the most first."""
        raw = " ".join(block).encode()
        size = len(self.plain.compress(raw))
        saved = ((self.saving(raw, n, size), n) for n in names)
        return sorted(((s, n) for s, n in saved if len(self.words[n]) < LOOSE or s >= LEAST * self.own[n]), key=lambda x: (-x[0], x[1]))

    def find(self, block: list[str], k: int) -> tuple | None:
        """(name, start, end, differences, saved) of the block's finding in length class k."""
        key = (k, *block)
        if key not in self.memo:
            if self.memo_words > MEMO_WORDS:
                self.memo.clear()
                self.memo_words = 0
            self.memo[key] = self._find(block, k)
            self.memo_words += len(key)
        return self.memo[key]

    def _find(self, block: list[str], k: int) -> tuple | None:
        best, size = None, 0
        for saved, name in self.ranked(block, self.classes[k]):
            if best and saved < best[5] - SLACK:
                break
            template = self.words[name]
            cost, start, end = align(template, block)
            if cost <= allowed(template) and self._same_names(template, block[start:end]) and (best is None or cost < best[3]):
                size = size or len(self.plain.compress(" ".join(block).encode()))
                best = (name, start, end, cost, saved / size, saved if best is None else best[5])
        return best and best[:5]

    @staticmethod
    def _same_names(template: list[str], found: list[str]) -> bool:
        names = lambda ws: [w for w in ws if w in NAMES or any(c.isdigit() for c in w)]
        return names(template) == names(found)

    def _search(self, words: list[str], marks: np.ndarray, low: int, high: int, limit: int, k: int) -> list[tuple]:
        """Findings of length class k in words[low:high], in their order: the block's finding, and those before it. A part without a mark holds none; what is behind the last finding belongs to
        the blocks of later marks. A finding with differences that the block's end may have cut is searched for again with all words that it could have, as far as the limit."""
        found, spans = [], [(low, high)]
        while spans:
            low, end = spans.pop()
            if np.searchsorted(marks, low) == np.searchsorted(marks, end) or not (hit := self.find(words[low:end], k)):
                continue
            wide = min(limit, low + hit[1] + 2 * self.reach[k])
            if end == high and hit[3] and low + hit[2] == end < wide:
                cost, start, stop = align(self.words[hit[0]], words[low:wide])
                if cost < hit[3] and self._same_names(self.words[hit[0]], words[low + start : low + stop]):
                    hit = (hit[0], start, stop, cost, hit[4])
            found.append((hit[0], low + hit[1], hit[2] - hit[1], hit[3], hit[4]))
            spans.append((low, low + hit[1]))
            if end != high:
                spans.append((low + hit[2], end))
        return sorted(found, key=lambda f: f[1])

    def scan(self, text: str, mark: re.Pattern) -> list[tuple]:
        """(name, first word, words, differences, saved) in the order of the text."""
        lowered = text.lower()
        spans = [m.span() for m in WORD.finditer(lowered)]
        words, starts = [lowered[a:b] for a, b in spans], np.array([a for a, _ in spans], np.int64)
        marks = np.unique(np.searchsorted(starts, [m.start() for m in mark.finditer(lowered)], side="right") - 1)
        found: list[tuple] = []
        taken: list[tuple[int, int]] = []  # in order, and apart
        for k, reach in enumerate(self.reach):
            own: list[tuple[int, int]] = []
            for at in marks.tolist():
                n = bisect_right(taken, at, key=lambda span: span[0])  # those that begin before the mark
                before, after = taken[n - 1 : n], taken[n : n + 1]
                if at < 0 or any(at < b for _, b in before) or (own and at < own[-1][1]):
                    continue
                low = max([0, at - reach, *(b for _, b in own[-1:]), *(b for _, b in before)])
                limit = min([len(words), *(a for a, _ in after)])
                for hit in self._search(words, marks, low, min(limit, at + reach), limit, k):
                    own.append((hit[1], hit[1] + hit[2]))
                    found.append(hit)
            taken = sorted(taken + own)
        return sorted(found, key=lambda f: f[1])


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, mark: str = MARK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, wording (null for the plain one), first_word, n_words, differences, saved: one row per notice found."""
    schema = "license string, wording string, first_word long, n_words long, differences long, saved double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pattern = Templates(templates), re.compile(mark)
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            rows, made = [], []
            for i in np.flatnonzero(pc.match_substring_regex(texts, mark, ignore_case=True).to_numpy(zero_copy_only=False)).tolist():
                for name, *rest in known.scan(texts[i].as_py(), pattern):
                    rows.append(i)
                    made.append((*(name.split(":", 1) + [None])[:2], *rest))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            columns = [pa.array([m[c] for m in made], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *columns], ["id", *(f.split()[0] for f in schema.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
