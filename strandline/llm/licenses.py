"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Each line of a text, and the text as a whole, is a unit. A template is compared
with the units that are neither too short nor too long for the threshold:
2 * common / (a + b) >= t needs min(a, b) / max(a, b) >= t / (2 - t).
Runs of words from any word on, across line ends and of the same sizes, are
units too: so a notice within a line, or over several, and a licence's own text
are found.

All templates' bigrams stand in one inverted index, by hash. One pass over a
batch's words looks each pair up in it; only lines, texts and runs with enough
hits of a template for its size are made into sets and compared.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import lean, table
from strandline.llm.hashing import mix, pieces, word_hashes

#: Notices by which texts state their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
#: Headers of files and parts of licences' own texts, compared with runs of words only.
BODIES = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" """),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
        AND CONTRIBUTORS "AS IS" """),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-3.0", """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most
        software and other practical works are designed to take away your freedom to share and change the works. By contrast, the
        GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make
        sure it remains free software for all its users."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions:"""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
        OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution."""),
]
#: How the BSD licences end (fixed value).
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
    COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
    (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
    HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
    ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BODIES += [(n, t.partition("THIS SOFTWARE")[0] + DISCLAIMER) for n, t in BODIES if n.startswith("BSD")]
THRESHOLD = 0.8


def _own_bigrams(text: str) -> list[str]:
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({" ".join(p) for p in zip(w, w[1:])} or set(w))


#: Everything but a-z, 0-9 and line ends is a space, in bytes, after lower case.
_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else 32 for c in range(256))


def _dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b))


class Templates:
    """Templates as sets of word bigrams: ``lines`` (license, bigrams) for lines and whole texts, and for runs with ``bodies``."""

    def __init__(self, lines: list, bodies: list, threshold: float):
        self.lines, self.named, self.threshold, self.ratio = sorted(lines), lines + bodies, threshold, threshold / (2 - threshold)
        pairs = sorted((b, k) for k, (_, own) in enumerate(self.named) for b in own if " " in b)
        h, at = word_hashes([b for b, _ in pairs])
        code = self.code(h)[at[:-1]] if pairs else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.first, self.owner = np.append(first, len(pairs)), np.array([k for _, k in pairs], np.int64)[order]
        self.least, self.most = (np.array([f(len(own)) for _, own in self.named], np.int64) for f in (self.fewest, self.largest))

    @staticmethod
    def code(h: np.ndarray) -> np.ndarray:
        """Of each word with the next one."""
        return mix(h * np.uint64(3) + mix(np.append(h[1:], h[:1])))

    def fewest(self, m: int) -> int:
        """Bigrams that a unit shares at least with a template of ``m``; also the fewest that it has."""
        return max(1, math.ceil(m * self.ratio - 1e-9))

    def largest(self, m: int) -> int:
        return math.floor(m / self.ratio + 1e-9)

    def found(self, texts: list) -> list:
        """(text, unit, license, dice) in ``texts``, which are normalised."""
        h, at = word_hashes(texts)
        if not len(h) or not len(self.codes):
            return []
        g = self.code(h)
        place = np.minimum(np.searchsorted(self.codes, g), len(self.codes) - 1)
        real = self.codes[place] == g
        real[at[1:][at[1:] > 0] - 1] = False  # a text's last word has no next one
        hit = np.flatnonzero(real)
        if not len(hit):
            return []
        # each hit with all templates that own its bigram, by template and place
        n = self.first[place[hit] + 1] - self.first[place[hit]]
        k = self.owner[np.repeat(self.first[place[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        p = np.repeat(hit, n)
        order = np.lexsort((p, k))
        k, p = k[order], p[order]
        t = np.searchsorted(at, p, "right") - 1
        # a run that fits begins at a hit, and holds enough others within the size bound
        to = np.minimum(np.arange(len(p)) + self.least[k] - 1, len(p) - 1)
        ok = (np.arange(len(p)) + self.least[k] - 1 < len(p)) & (k[to] == k) & (t[to] == t) & (p[to] - p < self.most[k])
        starts: dict = {}
        for ti, ki, pi in zip(t[ok].tolist(), k[ok].tolist(), (p - at[t])[ok].tolist(), strict=True):
            starts.setdefault(ti, {}).setdefault(ki, []).append(pi)
        out = []
        for ti in np.unique(t).tolist():
            lines = [x.split() for x in texts[ti].split("\n")]
            units = self.of_units(lines, np.unique(p[t == ti] - at[ti]) if len(lines) > 1 else None)
            out += [(ti, *row) for row in units]
            if ti in starts:
                out += [(ti, *row) for row in self.of_runs(lines, starts[ti])]
        return out

    def best(self, words: list):
        """(license, dice) of the template that fits a line or text best, or None."""
        pairs, best = {f"{a} {b}" for a, b in zip(words, words[1:])}, None
        for name, own in self.lines:
            if pairs and self.fewest(len(own)) <= len(pairs) <= self.largest(len(own)):
                dice = _dice(pairs, own)
                if dice >= self.threshold and (best is None or dice > best[1]):
                    best = name, dice
        return best

    def of_units(self, lines: list, hits: np.ndarray | None) -> list:
        """(unit, license, dice) of a text's lines with hits, and of the whole text if it has several lines."""
        if hits is None:
            tried = [(1, lines[0])]
        else:
            first = np.cumsum([0, *map(len, lines)])
            tried = [(0, [x for line in lines for x in line])]
            tried += [(int(i) + 1, lines[i]) for i in np.unique(np.searchsorted(first, hits, "right") - 1)]
        return [(unit, *found) for unit, words in tried if (found := self.best(words))]

    def of_runs(self, lines: list, starts: dict) -> list:
        """(line, license, dice) of the runs from ``starts`` that fit and of which no line or whole text tells as much."""
        w = [x for line in lines for x in line]
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:])]
        runs = []
        for k, places in starts.items():
            name, own = self.named[k]
            for i in places:
                all_, common, best = set(), set(), (0.0, 0, 0)
                for j in range(i, min(len(pairs), i + int(self.most[k]))):
                    all_.add(pairs[j])
                    if pairs[j] in own:
                        common.add(pairs[j])
                        best = max(best, (2 * len(common) / (len(all_) + len(own)), len(common), -j))
                if best[0] >= self.threshold:
                    runs.append((-best[1], -best[0], name, i, -best[2] + 1))
        first = [0]  # word that each line begins with
        for line in lines:
            first.append(first[-1] + len(line))
        lows, highs, out = [], [], []  # of what is taken, in order
        whole, of_line = self.told(set(pairs)), {}  # bigrams in common with the template that a line fits most of
        for n, dice, name, low, high in sorted(runs):  # words low to high
            i = bisect_left(lows, low)
            if i < len(lows) and lows[i] <= high or i and highs[i - 1] >= low:
                continue
            lows.insert(i, low)
            highs.insert(i, high)
            line = bisect_left(first, low + 1) - 1
            upto = bisect_left(first, high + 1)
            for j in range(line, upto):
                if j not in of_line:
                    of_line[j] = self.told({f"{a} {b}" for a, b in zip(lines[j], lines[j][1:])})
            if max([whole, *(of_line[j] for j in range(line, upto))]) < -n:
                out.append((line + 1, name, -dice))
        return out

    def told(self, pairs: set) -> int:
        """Most bigrams that a line or whole text of such bigrams has in common with a template that it fits; 0 if none."""
        return max((len(pairs & own) for _, own in self.lines if _dice(pairs, own) >= self.threshold), default=0)


def _find(templates: Templates):
    def run(frames):
        for f in frames:
            ids, out = f.doc_id.to_numpy(), []
            for low, high in pieces(f.text.tolist()):
                texts = [t.encode("utf-8", "surrogatepass").translate(_BYTES).decode("ascii") for t in f.text.iloc[low:high]]
                out += [(ids[low + t], *row) for t, *row in templates.found(texts)]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "unit", "license", "dice"])

    return lean(run)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, bodies: list = BODIES) -> DataFrame:
    """doc_id, unit, license, dice for every unit (0: whole text, 1 on: lines) that a template (of two words or more) fits.

    A unit has the template of the largest coefficient, of several the first by
    name. Null, empty and blank texts, and blank lines, fit none; repeated rows
    give repeated rows; a text of one line is one unit, 1. A run of words that a
    template or one of ``bodies`` fits, and of which no unit tells as much, has
    the line in which it begins as its unit; of overlapping runs that with the
    most bigrams in common counts. The templates, a list in the code, go to tasks.
    """
    held = Templates([(n, set(_own_bigrams(t))) for n, t in templates.items()], [(n, set(_own_bigrams(t))) for n, t in bodies], threshold)
    # ids as strings, as pandas would make floats of longs with nulls
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text is not null")
    found = rows.mapInPandas(_find(held), "doc_id string, unit int, license string, dice double")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "unit", "license", F.round("dice", 6).alias("dice"))


def op5_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"('{n}', [{', '.join(repr(b) for b in _own_bigrams(t))}])" for n, t in TEMPLATES.items())
    return rf"""
WITH t(license, tb) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d),
u AS (SELECT doc_id, 0 AS unit, text AS line FROM l WHERE len(ls) > 1
      UNION ALL SELECT doc_id, unnest(range(1, len(ls) + 1)), unnest(ls) FROM l),
w AS (SELECT doc_id, unit, list_filter(regexp_split_to_array(line, '[ \n]+'), lambda x: x <> '') AS w FROM u),
b AS (SELECT doc_id, unit, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS b FROM w),
s AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM b JOIN t ON len(b) >= 0.6 * len(tb) AND len(b) <= len(tb) / 0.6)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, round(dice, 6) AS dice FROM s WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1
"""


QUERIES = {"op5_licenses": op5_licenses}
ORACLES = {"op5_licenses": _sql()}
