"""License scans with a generalised suffix automaton of licence tokens.

The templates' tokens build one suffix automaton.  Each text streams through it,
which gives for every word the length of the longest match that ends there
(matching statistics).  Matches of at least MIN_MATCH words are chained for each
template in the order of both sides; a chain that covers enough of the template
is a covered span and gives the template's label.

Texts: null and empty texts have no words and no labels; rows are never dropped,
equal rows and ids repeat in the result; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

# Phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Characteristic sentences of public licences.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

# Public licences in full, or the notice that they ask for.
TEMPLATES += [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
]

#: Words of a match that can start or extend a chain.
MIN_MATCH = 3
#: Share of a template's words that a chain must cover.
MIN_COVER = 0.6
#: Words that a chain may skip in the text between two matches.
MAX_GAP = 8

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))),
    ]
)

#: Bytes to bytes: A-Z become lower case, what is no word character becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class SuffixAutomaton:
    """Of several token sequences; each state knows every (sequence, end) of its strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, tokens in enumerate(sequences):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((k, i + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, parent: int, token: int) -> int:
        """The state of the parent's longest string and the token, cut off its target if that also holds longer ones."""
        target = self.next[parent][token]
        if self.length[target] == self.length[parent] + 1:
            return target
        clone = self._new(self.length[parent] + 1, target)
        self.link[target] = clone
        while parent >= 0 and self.next[parent].get(token) == target:
            self.next[parent][token] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        state, parent = self._new(self.length[last] + 1), last
        while parent >= 0 and token not in self.next[parent]:
            self.next[parent][token] = state
            parent = self.link[parent]
        self.link[state] = 0 if parent < 0 else self._split(parent, token)
        return state

    def matches(self, tokens, least: int):
        """(end in tokens, length, state) of each match that the next token doesn't extend."""
        state = length = 0
        for i, token in enumerate(tokens):
            grown = state
            while grown and token not in self.next[grown]:
                grown = self.link[grown]
            extended = grown == state and token in self.next[state]
            if not extended and length >= least:
                yield i, length, state
            if token in self.next[grown]:
                length = (length if grown == state else self.length[grown]) + 1
                state = self.next[grown][token]
            else:
                state = length = 0
        if length >= least:
            yield len(tokens), length, state


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE, min_match=MIN_MATCH, min_cover=MIN_COVER, max_gap=MAX_GAP):
        self.base = [(phrase.encode().split(), label) for phrase, label in base.items()]
        self.labels = [label for label, _ in templates]
        words = [text.encode().translate(WORD_BYTES).split() for _, text in templates]
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(x for ws in [*words, *(p for p, _ in self.base)] for x in ws))}
        self.sizes = [len(x) for x in words]
        self.automaton = SuffixAutomaton([[self.vocabulary[w] for w in x] for x in words])
        self.phrases = [([self.vocabulary[w] for w in p], label) for p, label in self.base]
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """Every place of a base phrase."""
        found = []
        for phrase, label in self.phrases:
            if len(ids) >= len(phrase):
                hit = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0])
                for k, token in enumerate(phrase[1:], 1):
                    hit = hit[ids[hit + k] == token]
                found += [(int(i), label) for i in hit]
        return found

    def spans(self, ids: np.ndarray) -> list[dict]:
        """Covered template spans.  Only runs of licence words can hold a match, so only they are streamed."""
        known = ids > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= self.min_match:
                for end, length, state in self.automaton.matches(ids[a:b].tolist(), self.min_match):
                    for k, to in self.automaton.ends[state]:
                        pieces.setdefault(k, []).append((int(a) + end - length, to - length, length))
        out = []
        for k, found in sorted(pieces.items()):
            out += self._chains(k, sorted(found))
        return sorted(out, key=lambda x: (x["start"], x["stop"], x["label"]))

    def _chains(self, k: int, found: list[tuple[int, int, int]]) -> list[dict]:
        """Chains matches of template k: later ones must lie later on both sides; overlap isn't counted twice."""
        best: list[tuple[int, int]] = []
        ends = [i + n for i, _, n in found]
        for x, (i, j, n) in enumerate(found):
            score, back = n, -1
            for y in range(x - 1, -1, -1):
                pi, pj, pn = found[y]
                if i - pi > self.sizes[k] + self.max_gap * 2:
                    break
                over = max(0, pi + pn - i, pj + pn - j)
                if pj < j and over < n and i - ends[y] <= self.max_gap and best[y][0] + n - over > score:
                    score, back = best[y][0] + n - over, y
            best.append((score, back))
        out, used = [], [False] * len(found)
        for x in sorted(range(len(found)), key=lambda x: (-best[x][0], x)):
            if used[x] or best[x][0] < self.min_cover * self.sizes[k]:
                continue
            path, y = [], x
            while y >= 0 and not used[y]:
                path.append(y)
                y = best[y][1]
            if y < 0:
                covered = best[x][0]
                out.append({"label": self.labels[k], "start": found[path[-1]][0], "stop": ends[x], "covered": covered, "share": min(1.0, covered / self.sizes[k])})
            for y in path:
                used[y] = True
        return out

    def scan(self, text: bytes) -> tuple:
        words = text.translate(WORD_BYTES).split()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        places, spans = self.places(ids), self.spans(ids)
        starts = [i for i, _ in places]
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(s["label"] for s in spans)})
        score = 1.0 if base else max([0.0, *(s["share"] for s in spans)])
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, spans


@lru_cache(4)
def _scanner(options: tuple) -> Scanner:
    return Scanner(**dict(options))


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): words, base phrases, labels and covered spans.

    A null text counts as empty: 0 words, labels ''.  ``score`` is 1 where a base phrase stands,
    else the largest covered share of a template, else 0.
    """
    held = tuple(sorted(options.items()))

    def run(scanner, ids, texts):
        rows = [scanner.scan(t) for t in texts]
        names = [f.name for f in SCHEMA][1:]
        return {"doc_id": ids} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_texts(docs, run, SCHEMA, setup=lambda: _scanner(held))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the licence scan that SQL can express too."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
u AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM d),
x AS (SELECT row, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM u WINDOW p AS (PARTITION BY row ORDER BY i)),
h AS (SELECT row, i, CASE WHEN w = 'mit' AND w2 = 'license' THEN 'mit' WHEN w = 'apache' AND w2 = 'license' THEN 'apache' WHEN w = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' END AS label FROM x),
f AS (SELECT row, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h WHERE label IS NOT NULL GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN f USING (row)
"""
