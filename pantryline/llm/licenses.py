"""License texts inside documents, by patience alignment against templates.

A template may lie only where the words of a window, counted, could make up enough of it in some
order. Windows are twice as wide as the template at first and overlap by half; what is found is set
aside, and the rest is searched in windows twice as wide, up to the whole text, so a license may be
spread over any number of words. (A notice, see below, lies within the first two widths.) A window is aligned with the template: common ends are matched,
words that are unique in both are anchors, the longest increasing run of them is kept, and the gaps
between are aligned in the same way. A gap without such a word is aligned by its longest common
subsequence; a gap is never longer than a window. Coverage is the share of the template's words
that are matched. Stray matched words far outside are cut off while coverage allows.

Coverage leaves room for a few changed words, but not for those that tell licenses apart: the
phrases in `names` (a license's name, its version) must stand whole where the alignment puts them. In a
text, words that belong to no phrase may be between a phrase's own; in a notice, a template of less
than NOTICE words, none may, no word of another notice's phrases may be among it, and at least half
of the words from its first to its last must be its own. Licenses that differ by added words (GPL and Lesser GPL) compete: of hits that overlap, the one
with more matched words stays.

Results, per row: `hits` in the order of the text, none overlapping another; empty for a null or empty
text. Rows keep their doc_id, null and repeated ones too. Whole texts are read; other columns play no
part.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from pantryline.llm.common import batches

COVERAGE = 0.8
#: What a foreign word costs where stray matched words are cut off, and the words from which on a template is no notice.
INSERTED, NOTICE = 0.2, 20
WORD = re.compile(r"[^\W_]+")

#: Notices and license texts, as they are commonly published.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version. This library is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

#: The phrases that tell a license from others, each a run of words of its template. Fixed values.
NAMES = {
    "Apache-2.0-notice": ["Apache License", "Version 2.0"],
    "MIT-notice": ["MIT License"],
    "GPL-3.0-notice": ["General Public License", "version 3"],
    "GPL-2.0-notice": ["General Public License", "version 2"],
    "LGPL-3.0-notice": ["Lesser General Public License", "version 3"],
    "LGPL-2.1-notice": ["Lesser General Public License", "version 2.1"],
    "AGPL-3.0-notice": ["Affero General Public License", "version 3"],
    "BSD-2-Clause-notice": ["BSD 2-Clause"],
    "BSD-3-Clause-notice": ["BSD 3-Clause"],
    "CC-BY-NC-4.0-notice": ["CC BY-NC 4.0"],
    "CC-BY-4.0-notice": ["CC BY 4.0"],
    "CC-BY-SA-4.0-notice": ["CC BY-SA 4.0"],
    "CC-BY-ND-4.0-notice": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0-notice": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0-notice": ["CC BY-NC-ND 4.0"],
    "Apache-2.0": ["Apache License", "Version 2.0"],
    "GPL-3.0": ["GNU General Public License", "version 3 of the License"],
    "GPL-2.0": ["GNU General Public License", "version 2 of the License"],
    "LGPL-2.1": ["GNU Lesser General Public License", "version 2.1 of the License"],
    "AGPL-3.0": ["GNU Affero General Public License", "version 3 of the License"],
    "MPL-2.0": ["Mozilla Public License"],
    "BSD-3-Clause": ["Neither the name of"],
}


def increasing(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises strictly in both places; `pairs` ascend in the first.

    Pairs with an equal first place must come in descending order of the second.
    """
    ends: list[int] = []  # the smallest second place that a run of each length ends with
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before.append(at[n - 1] if n else -1)
        ends[n : n + 1], at[n : n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Matched places (in a, in b), ascending in both, by patience."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {b[q]: q for q in range(j, j_end) if in_b[b[q]] == 1}
        anchors = increasing([(p, place[a[p]]) for p in range(i, i_end) if in_a[a[p]] == 1 and a[p] in place])
        if not anchors:
            places = defaultdict(list)
            for q in reversed(range(j, j_end)):
                places[b[q]].append(q)
            out += increasing([(p, q) for p in range(i, i_end) for q in places.get(a[p], ())])
            continue
        out += anchors
        ends = [*anchors, (i_end, j_end)]
        for (p, q), (p_next, q_next) in zip([(i - 1, j - 1), *anchors], ends, strict=True):
            todo.append((p + 1, p_next, q + 1, q_next))
    return sorted(out)


def apart(hits: list[tuple], rank: Callable, place: Callable) -> list[tuple]:
    """Hits by place; of those that overlap the one that ranks first stays."""
    kept: list[tuple] = []
    for hit in sorted(hits, key=rank):
        first, last = place(hit)
        k = bisect_left(kept, first, key=lambda h: place(h)[1])
        if k == len(kept) or last < place(kept[k])[0]:
            kept.insert(k, hit)
    return kept


def tight(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of matched places worth most, each foreign word within it costing INSERTED of a matched one."""
    best, value, begin = (0.0, 0, 0), 0.0, 0
    for k, (p, _) in enumerate(pairs):
        value -= INSERTED * (p - pairs[k - 1][0] - 1) if k else 0
        if value <= 0:
            value, begin = 0.0, k
        value += 1
        if value > best[0] + 1e-9:
            best = (value, begin, k + 1)
    low, high = best[1:]
    return pairs[low:high]


class Scanner:
    """The templates as numbers of words, and the phrases that name them."""

    def __init__(self, templates: dict[str, str], coverage: float, names: dict[str, list[str]]):
        self.coverage = coverage
        self.names = list(templates)
        self.numbers: dict[str, int] = {}
        self.texts = [
            [self.numbers.setdefault(w, len(self.numbers)) for w in WORD.findall(t.lower())] for t in templates.values()
        ]
        self.totals = [Counter(words) for words in self.texts]
        self.phrases: list[list[tuple[list[int], list[int]]]] = []  # per template: words, and where they begin in it
        for name, words in zip(self.names, self.texts, strict=True):
            if len(words) < 3:
                raise ValueError(f"template {name} has less than three words")
            own = []
            for phrase in names.get(name, ()):
                wanted = [self.numbers.get(w) for w in WORD.findall(phrase.lower())]
                at = [q for q in range(len(words)) if words[q : q + len(wanted)] == wanted]
                if not wanted or not at:
                    raise ValueError(f"template {name} has no {phrase!r}")
                own.append((wanted, at))
            self.phrases.append(own)
        self.telling = {w for own in self.phrases for wanted, _ in own for w in wanted}
        #: Words that name a license in some notice.
        self.rivals = {
            w for own, text in zip(self.phrases, self.texts) if len(text) < NOTICE for wanted, _ in own for w in wanted
        }

    def holds(self, t: int, counts: Counter) -> bool:
        """Whether words, given by their counts, could make up enough of a template in some order, names included."""
        total, need = self.totals[t], self.coverage * len(self.texts[t])
        if any(w not in counts for wanted, _ in self.phrases[t] for w in wanted):
            return False
        return sum([min(n, counts[w]) for w, n in total.items() if w in counts]) >= need

    def stands(self, ids: list, wanted: list[int], low: int, high: int, strict: bool) -> bool:
        """Whether a phrase begins and ends within a stretch; if not strict, words of no phrase may be between its own."""
        for begin in range(low, high - len(wanted) + 1):
            k = 0
            for p in range(begin, high) if ids[begin] == wanted[0] else ():
                if ids[p] == wanted[k]:
                    k += 1
                    if k == len(wanted):
                        return True
                elif strict or ids[p] in self.telling:
                    break
        return False

    def named(self, ids: list, t: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether every phrase stands between the matched words around it."""
        strict = len(self.texts[t]) < NOTICE
        for wanted, at in self.phrases[t]:
            for q in at:
                low = max([p + 1 for p, own in pairs if own < q], default=pairs[0][0])
                high = min([p for p, own in pairs if own >= q + len(wanted)], default=pairs[-1][0] + 1)
                if self.stands(ids, wanted, low, high, strict):
                    break
            else:
                return False
        return True

    def sound(self, ids: list, t: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether matched places are enough of a template, with its names, and as a notice dense and of no other name."""
        own = self.texts[t]
        if len(pairs) < self.coverage * len(own) or not self.named(ids, t, pairs):
            return False
        first, last = pairs[0][0], pairs[-1][0]
        foreign = self.rivals.difference(own)
        return len(own) >= NOTICE or (2 * len(pairs) > last - first and foreign.isdisjoint(ids[first : last + 1]))

    def hit(self, ids: list, t: int, begin: int, end: int) -> tuple[int, int, int] | None:
        """(matched, first, last) of the template in a stretch of the text, if there is enough of it."""
        own, best = self.texts[t], None
        for _ in range(2):  # the stretch, then only what surrounds the place found
            pairs = [(begin + i, j) for i, j in align(ids[begin:end], own)]
            pairs = next((p for p in (tight(pairs), pairs) if self.sound(ids, t, p)), None)
            if not pairs:
                break
            best = max(best or pairs, pairs, key=lambda p: (len(p), p[0][0] - p[-1][0]))
            begin = max(begin, pairs[0][0] - 2 * pairs[0][1] - 1)
            end = min(end, pairs[-1][0] + 2 * (len(own) - pairs[-1][1]))
        return (len(best), best[0][0], best[-1][0]) if best else None

    def hits(self, ids: list, t: int) -> list[tuple[int, int, int]]:
        """(matched, first, last) of every place of a template, none overlapping another."""
        own, at = self.texts[t], [p for p, w in enumerate(ids) if w in self.totals[t]]
        need = self.coverage * len(own)
        found: list[tuple[int, int, int]] = []
        free, width = [(0, len(ids))], 2 * len(own)
        while True:
            new = []
            for low, high in free:
                for begin in range(low, max(low + 1, high - width // 2), width // 2):
                    words = at[bisect_left(at, begin) : bisect_left(at, min(high, begin + width))]
                    todo = [(words[0], words[-1] + 1)] if words else []
                    while todo:
                        first, last = todo.pop()
                        if last - first < need or not self.holds(t, Counter(ids[first:last])):
                            continue
                        if hit := self.hit(ids, t, first, last):
                            new.append(hit)
                            todo += [(first, hit[1]), (hit[2] + 1, last)]
            kept = apart(new, lambda h: (-h[0], h[2] - h[1], h[1]), lambda h: h[1:])
            found += kept
            if width >= len(ids) or (len(own) < NOTICE and width > 2 * len(own)):
                return found
            for _, first, last in kept if len(own) >= NOTICE else ():
                k = bisect_left(free, (first + 1,)) - 1
                low, high = free[k]
                free[k : k + 1] = [(low, first), (last + 1, high)]
            width *= 2

    def scan(self, text: str | None) -> list[dict]:
        """Hits that reach the coverage, none overlapping another."""
        if not text:
            return []
        words = list(WORD.finditer(text.lower()))
        ids = [self.numbers.get(w[0]) for w in words]
        counts, found = Counter(ids), []
        for t, own in enumerate(self.texts):
            if self.holds(t, counts):
                found += [(n, n / len(own), t, first, last) for n, first, last in self.hits(ids, t)]
        kept = apart(found, lambda h: (-h[0], -h[1], h[4] - h[3], h[3], h[2]), lambda h: h[3:])
        # Lower case may be longer than the text, so only where it isn't are its places those of the text.
        where = words if len(text.lower()) == len(text) else list(WORD.finditer(text))
        return [
            {
                "template": self.names[t], "coverage": share, "matched": n, "first_word": first, "last_word": last,
                "start": where[first].start() if last < len(where) else None,
                "stop": where[last].end() if last < len(where) else None,
            }
            for n, share, t, first, last in kept
        ]


@functools.lru_cache(4)
def _scanner(templates: tuple, coverage: float, names: tuple) -> Scanner:
    """One scanner per worker process and set of templates."""
    return Scanner(dict(templates), coverage, dict(names))


HIT = "template:string,coverage:double,matched:int,first_word:int,last_word:int,start:int,stop:int"
HIT_TYPE = pa.struct(
    [("template", pa.string()), ("coverage", pa.float64())]
    + [(name, pa.int32()) for name in ("matched", "first_word", "last_word", "start", "stop")]
)


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE,
    names: dict[str, list[str]] = NAMES,
) -> DataFrame:
    """Per row: doc_id, hits (array of template, coverage, matched words, place in words and characters).

    `names` holds phrases of templates that must be there whole; a template may have none.
    A narrow pass over the table, one text at a time.
    """
    wanted = tuple(templates.items())
    phrases = tuple((name, tuple(own)) for name, own in names.items())

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        scanner = _scanner(wanted, coverage, phrases)
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                yield doc_id, scanner.scan(text.as_py())

    return docs.select("doc_id", "text").mapInArrow(
        lambda parts: batches(rows(parts), ["doc_id", "hits"], [pa.int64(), pa.list_(HIT_TYPE)]),
        f"doc_id long, hits array<struct<{HIT}>>",
    )
