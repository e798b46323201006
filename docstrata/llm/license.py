"""Licence scan with a generalised suffix automaton of licence templates.

One automaton over the words of all templates (and of the base phrases) is built
on the driver from fixed text. A document streams through it word by word; the
state and the length reached are the matching statistics. A base phrase ends
where a state on the suffix-link path of the current one is the phrase's end.
Each template's own maximal matches of MIN_MATCH words or more, those inside a longer
match of another one too, are chained per template, in both texts' order with at most MAX_GAP document words between, and a chain that
covers THRESHOLD of its template is a span with the template's label.

Documents are handled one by one, in whole, without a shuffle.

Defined cases: a null text has no words; a document without licence words has
empty labels, null first and last words and score 0; repeated rows are answered
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.text import chunks, words
from docstrata.session import table

MIN_MATCH = 3
MAX_GAP = 12
THRESHOLD = 0.8

#: The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Full texts of short licences by label.
FULL = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
)


def plain(text: str) -> str:
    return b" ".join(words(text.encode())).decode()


#: Well-known notices by label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
    *((label, plain(text)) for label, text in FULL),
)


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((number, at + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] += ends[state]
        #: (sequence, words up to the end) of every occurrence of a state's strings.
        self.ends = [sorted(set(x)) for x in ends]

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes, ends: list) -> int:
        copy = self._new(self.length[p] + 1, ends)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes, ends: list) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word, ends)
        state = self._new(self.length[last] + 1, ends)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word, ends)
        return state

    def statistics(self, text: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """(word, length, state) wherever the longest match that ends at the word has ``least`` words or more."""
        step, link, length = self.next, self.link, self.length
        out, state, matched = [], 0, 0
        for at, word in enumerate(text):
            to = step[state].get(word)
            if to is None:
                if not state:
                    continue
                while to is None and state:
                    state = link[state]
                    to = step[state].get(word)
                matched = length[state]
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= least:
                out.append((at, matched, state))
        return out


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES, threshold: float = THRESHOLD):
        texts = [t.encode().split() for t, _ in base] + [t.encode().split() for _, t in templates]
        self.texts = texts
        self.labels = [label for _, label in base] + [label for label, _ in templates]
        self.size = [len(t) for t in texts]
        self.n_base = len(base)
        self.least = min(MIN_MATCH, *self.size)
        self.threshold = threshold
        self.automaton = Automaton(texts)
        self._met: dict[int, list[tuple[int, int, int]]] = {}

    def _occurrences(self, state: int) -> list[tuple[int, int, int]]:
        """(sequence, words up to the end, longest) wherever a suffix of the state's strings, of up to ``longest`` words, ends in a sequence."""
        found = self._met.get(state)
        if found is None:
            longest: dict[tuple[int, int], int] = {}
            up = state
            while up > 0 and self.automaton.length[up] >= self.least:
                for place in self.automaton.ends[up]:
                    longest.setdefault(place, self.automaton.length[up])
                up = self.automaton.link[up]
            found = self._met[state] = [(number, end, size) for (number, end), size in longest.items()]
        return found

    def pieces(self, text: list[bytes], stats: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(sequence, start in the text, start in the sequence, words) of each sequence's maximal matches of ``least`` words or more."""
        out = []
        for at, matched, state in stats:
            after = text[at + 1] if at + 1 < len(text) else None
            for number, end, longest in self._occurrences(state):
                if end == self.size[number] or self.texts[number][end] != after:
                    size = min(matched, longest)
                    out.append((number, at - size + 1, end - size, size))
        return out

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]], float]:
        """Base places (start, phrase), template spans (start, end, template, coverage) and the best coverage."""
        stats = self.automaton.statistics(text, self.least)
        if not stats:
            return [], [], 0.0
        places, pieces = [], self.pieces(text, stats)
        for at, matched, state in stats:
            # Ends of shorter strings lie further up the suffix-link path, whose states hold their own ends too.
            up = state
            while up > 0 and self.automaton.length[up] >= self.least:
                for number, end in self.automaton.ends[up]:
                    if number < self.n_base and end == self.size[number] and self.automaton.length[self.automaton.link[up]] < end <= min(matched, self.automaton.length[up]):
                        places.append((at - end + 1, number))
                up = self.automaton.link[up]
        spans, best = [], 0.0
        for number in sorted({p[0] for p in pieces}):
            for start, end, covered in self._chains(sorted(p[1:] for p in pieces if p[0] == number)):
                share = covered / self.size[number]
                best = max(best, share)
                if share >= self.threshold:
                    spans.append((start, end, number, share))
        return sorted(places), sorted(spans), min(1.0, best)

    @staticmethod
    def _chains(pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """Best chain ending at each piece, as (start, end, covered words); chains with a longer continuation are left out."""
        chain: list[tuple[int, int, int, int]] = []  # start, document end, template end, covered
        extended = set()
        longest = max((size for _, _, size in pieces), default=0)
        for start, at, size in pieces:
            best, by = (start, start + size, at + size, size), None
            for j in range(len(chain) - 1, -1, -1):
                first, end, template_end, covered = chain[j]
                # No piece from here back can end near enough.
                if start - pieces[j][0] > MAX_GAP + longest:
                    break
                over = max(0, end - start, template_end - at)
                if 0 <= start - end + over <= MAX_GAP + over and start > pieces[j][0] and at > pieces[j][1] and over < size and covered + size - over > best[3]:
                    best, by = (first, start + size, at + size, covered + size - over), j
            if by is not None:
                extended.add(by)
            chain.append(best)
        for j, (first, end, _, covered) in enumerate(chain):
            if j not in extended:
                yield first, end, covered


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows: list[tuple] = []
            for text in texts:
                ws = words(text)
                places, spans, score = scanner.scan(ws)
                base = sorted({scanner.labels[n] for _, n in places})
                every = sorted({*base, *(scanner.labels[n] for _, _, n, _ in spans)})
                shown = [{"start": s, "end": e, "label": scanner.labels[n], "coverage": c} for s, e, n, c in spans]
                rows.append((len(ws), len(places), places[0][0] if places else None, max(p for p, _ in places) if places else None, ",".join(base), ",".join(every), score, shown))
            columns = [list(x) for x in zip(*rows, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("coverage", pa.float64())]))]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return run


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, word and base counts, labels, score, spans (words, end exclusive) for every document."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(scanner or Scanner()), f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<start:bigint,end:bigint,label:string,coverage:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
