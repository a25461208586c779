"""License scans: an inverted index of winnowed template fingerprints, then banded alignment of the candidates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# The wording of well-known licenses, file headers and notices; years, names and places are left out.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GNU_HEADER = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/grant": MIT_GRANT,
    "MIT/license": f"{MIT_GRANT}\n{MIT_REST}",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": GNU_HEADER.format(what="program", name="General Public License"),
    "LGPL-3.0/header": GNU_HEADER.format(what="library", name="Lesser General Public License"),
    "AGPL-3.0/header": GNU_HEADER.format(what="program", name="Affero General Public License"),
    "MPL-2.0/header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD/conditions": BSD_CONDITIONS,
    "BSD-2-Clause/license": f"{BSD_CONDITIONS}\n{BSD_TWO}\n{BSD_DISCLAIMER}",
    "BSD-3-Clause/license": f"{BSD_CONDITIONS}\n{BSD_TWO}\n{BSD_THIRD}\n{BSD_DISCLAIMER}",
    "ISC/license": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib/license": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense/license": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0/notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.""",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "Proprietary/notice": "All rights reserved.",
}
WORD = re.compile(rb"[a-z0-9]+")
GRAM, WINNOW = 3, 4
#: Words of a template for each fingerprint that a candidate must share with it.
WORDS_A_HIT = 32
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Weights of an alignment's score and of its matched words beside the place of the first, counted in its band.
SCORE, MATCHED = 1 << 40, 1 << 26


def words_of(raw: bytes) -> list[bytes]:
    return WORD.findall(raw.lower())


@dataclass(frozen=True)
class Match:
    template: str
    matched: int
    coverage: float
    first: int
    last: int  # words, both included


class TemplateIndex:
    """Fingerprints of three-word runs of the templates, and the search that they open."""

    def __init__(self, templates: dict[str, str], least_coverage: float = 0.8):
        self.names = list(templates)
        self.least_coverage = least_coverage
        self.tokens = [words_of(templates[n].encode()) for n in self.names]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in self.tokens for w in t}))}
        self.ids = [np.array([self.vocabulary[w] for w in t], np.int64) for t in self.tokens]
        self.index: dict[int, list[tuple[int, int]]] = {}
        short: set[int] = set()
        for t, ids in enumerate(self.ids):
            grams = self.grams(ids)
            if len(grams) < WINNOW:  # too short for a window of its own: all its fingerprints are kept, here and in texts
                short |= {int(g) for g in grams}
            for at in range(len(grams)) if len(grams) < WINNOW else self.winnow(grams):
                self.index.setdefault(int(grams[at]), []).append((t, int(at)))
        self.short = np.array(sorted(short), np.uint64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each run of ``GRAM`` words; runs with a word no template has get the largest value."""
        if len(ids) < GRAM:
            return np.zeros(0, np.uint64)
        runs = np.lib.stride_tricks.sliding_window_view(ids, GRAM)
        flat = np.zeros(len(runs), np.uint64)
        for k in range(GRAM):
            flat = flat * np.uint64(len(self.vocabulary) + 1) + runs[:, k].astype(np.uint64)
        flat = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        flat ^= flat >> np.uint64(29)
        return np.where((runs < 0).any(axis=1), NONE, flat)

    def least_hits(self, t: int) -> int:
        """Fingerprints that a candidate shares with a template: one for each ``WORDS_A_HIT`` of its words.

        A text that says a template with one word in ten changed keeps about three in four of its runs.
        """
        return max(1, len(self.ids[t]) // WORDS_A_HIT)

    @staticmethod
    def winnow(grams: np.ndarray) -> np.ndarray:
        """Places of each window's smallest fingerprint, the rightmost of equal ones."""
        if len(grams) <= WINNOW:
            return np.array([len(grams) - 1 - int(grams[::-1].argmin())]) if len(grams) else np.zeros(0, int)
        windows = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
        return np.unique(np.arange(len(windows)) + WINNOW - 1 - windows[:, ::-1].argmin(axis=1))

    def scan(self, words: list[bytes]) -> list[Match]:
        """Template matches in a text's words, in order of their first word."""
        known = self.vocabulary.get
        ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        grams = self.grams(ids)
        if not (grams != NONE).any():
            return []
        at = np.union1d(self.winnow(grams), np.flatnonzero(np.isin(grams, self.short)))
        diagonals: dict[int, list[int]] = {}
        for i in at[grams[at] != NONE].tolist():
            for t, j in self.index.get(int(grams[i]), ()):
                diagonals.setdefault(t, []).append(i - j)
        found = []
        for t, starts in diagonals.items():
            if len(starts) < self.least_hits(t):
                continue
            band = max(1, len(self.ids[t]) // 4)
            starts.sort()
            group = [starts[0]]
            for d in [*starts[1:], None]:
                if d is not None and d - group[-1] <= band:
                    group.append(d)
                    continue
                if (m := self.align(t, ids, group[0] - band, group[-1] + band)) is not None:
                    found.append(m)
                group = [d]
        return sorted(set(found), key=lambda m: (m.first, m.last, m.template))

    def align(self, t: int, ids: np.ndarray, low: int, high: int) -> Match | None:
        """The best local alignment of a template on the diagonals from ``low`` to ``high`` (a match 2, else -1).

        A cell is one number: the score, the matched words and the first of them, in this order of weight. Column k of
        row i is word low + i + k; a row is made at once, the step to the right by a running maximum. Of equally good
        alignments the one that starts, then ends, latest counts.
        """
        template = self.ids[t]
        n, width = len(template), high - low + 1
        column = np.arange(width, dtype=np.int64)
        slope = column * SCORE
        # the words of the band, -2 beyond the text's ends
        band = np.full(n + width, -2, np.int64)
        a, b = max(low, 0), min(len(ids), low + n + width)
        if a < b:
            band[a - low : b - low] = ids[a:b]
        above, best, last = np.zeros(width, np.int64), 0, -1
        for i in range(n):
            match = band[i : i + width] == template[i]
            fresh = np.where(above == 0, column + i, 0)
            row = np.where(match, above + (2 * SCORE + MATCHED) + fresh, above - SCORE)
            np.maximum(row[:-1], above[1:] - SCORE, out=row[:-1])
            row = np.maximum.accumulate(row + slope) - slope
            row[row < SCORE] = 0
            if (top := int(row.max())) >= best and top:
                best, last = top, int(np.flatnonzero(row == top)[-1]) + i if top > best else max(last, int(np.flatnonzero(row == top)[-1]) + i)
            above = row
        matched, first = best % SCORE // MATCHED, best % MATCHED
        return Match(self.names[t], matched, matched / n, first + low, last + low) if matched >= self.least_coverage * n else None


def license_texts(folder: str, least_words: int = 50) -> dict[str, str]:
    """Templates from a folder of license texts, one a file, named after it: whole licenses beside the notices here.

    Read by the driver. Files of fewer than ``least_words`` words are left out; of those with the same words the
    last by name counts, which names a version.
    """
    found: dict[str, str] = {}
    seen: set[tuple] = set()
    for path in sorted(Path(folder).iterdir(), reverse=True):
        words = tuple(words_of(path.read_bytes())) if path.is_file() else ()
        if len(words) >= least_words and words not in seen:
            seen.add(words)
            found[f"{path.name}/text"] = path.read_text(errors="replace")
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: ``(<id_col>, template, license, matched_words, coverage, start_char, end_char)``.

    Coverage is the share of the template's words that the alignment matches; matches under ``least_coverage`` (80 %) are
    not reported, so part of a license is found by the shorter templates that it holds, such as its grant or notice.
    Spans are character offsets in the whole text, end excluded. Null, empty and unmatched texts give no rows; a text has as many rows as it has matches, repeated
    rows repeat theirs, a null id stays null. Any run of six template words is a shared fingerprint; a long template needs
    one for each ``WORDS_A_HIT`` words. The templates are a
    parameter of the caller's size; other columns are not read.
    """
    index = TemplateIndex(templates or TEMPLATES, least_coverage)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "template", "license", "matched_words", "coverage", "start_char", "end_char")}
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            raw = (t.as_py() or "").encode()
            matches = index.scan(words_of(raw))
            if not matches:
                continue
            spans = [m.span() for m in WORD.finditer(raw.lower())]
            for m in matches:
                start = len(raw[: spans[m.first][0]].decode())
                end = start + len(raw[spans[m.first][0] : spans[m.last][1]].decode())
                for name, value in zip(out, (i.as_py(), m.template, m.template.split("/")[0], m.matched, m.coverage, start, end), strict=True):
                    out[name].append(value)
        return out

    schema = "id long, template string, license string, matched_words int, coverage double, start_char long, end_char long"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)
