"""License scans: coverage of notice templates by patience alignment.

Method: a template marks in braces the words that decide the license (its name, version, the
clause that only it has). All marked runs must stand in the text whole and in order; every
place of the first one is tried. The words around them are aligned: words that occur once in
a gap of the text and once in that of the template are anchors; the longest increasing
subsequence of their places is kept, and the gaps between kept anchors are aligned in the
same way, after equal words at both ends of a gap are matched. Coverage is the share of
template words matched. A template is found where coverage reaches ``LEAST``. A gap of the text
is at most a quarter and two words longer than the template's, in templates of fewer than
``SHORT`` words no longer at all.

A text is searched whole. The places of the first marks are found by hashes for a batch at
once. Other templates may be given: one of fewer than ``SHORT`` words without a mark must stand
whole; for a longer one the longest common subsequence with every stretch counts. Braces mark only.
Templates are fixed values, so the broadcast has a fixed size.

A place inside that of a longer template is not reported (BSD-3-Clause holds the whole text of
BSD-2-Clause). What is not among the templates is not found. Negations are not understood.

Results: one row per document row: ``n_words``; ``license``, ``coverage``, ``start_word``,
``end_word`` of the best template (highest coverage, then the longer template, then the name,
then the first place), null (coverage 0) if none is found; ``licenses``, all names found,
sorted, joined with commas. Null and empty texts have no words and no license. A null id
stays null, repeated rows are each scanned, an empty table gives no rows. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.buffers import byte_class, chained, shared_object, slices, text_bytes, words

LEAST = 0.8
SHORT = 20

_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU %sGeneral Public "
    "License} as published by the Free Software Foundation, either {version %s} of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
    "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. {Redistributions in binary form must reproduce} the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_ADVERTISING = (
    " {All advertising materials mentioning features} or use of this software must display the following acknowledgement: "
    "This product includes software developed by the copyright holder."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to {endorse or promote products} "
    "derived from this software without specific prior written permission."
)

# Public license notices, as (name, text).
NOTICES = (
    ("Apache-2.0", "Licensed under the {Apache License, Version 2.0}."),
    (
        "Apache-2.0",
        'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", _BSD + _BSD_NAMES),
    ("CC-BY-4.0", "This work is licensed under a {Creative Commons Attribution 4.0} International License."),
    ("CC-BY-NC-4.0", "Licensed under {CC BY-NC 4.0}."),
    ("GPL-3.0", "This work is licensed under the {GNU General Public License, version 3}."),
    ("GPL-3.0", _GPL % ("", "3")),
    ("MIT", "Released under the {MIT License}."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), {to deal in the Software} without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice {shall be included} in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}."),
    ("AGPL-3.0", _GPL % ("Affero ", "3")),
    ("BSD-2-Clause", _BSD),
    ("BSD-4-Clause", _BSD + _BSD_ADVERTISING + _BSD_NAMES),
    ("GPL-2.0", "This work is licensed under the {GNU General Public License, version 2}."),
    ("GPL-2.0", _GPL % ("", "2")),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software {for any purpose with or without fee} is hereby "
        "granted, provided that the above copyright notice and this permission notice {appear in all copies}.",
    ),
    ("LGPL-2.1", _GPL % ("Lesser ", "2.1")),
    ("LGPL-3.0", _GPL % ("Lesser ", "3")),
)

# Names in a line like "Licensed under the ...".
SPELLINGS = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU AGPL v3", "AGPL v3", "AGPLv3"),
    ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    ("BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    ("GPL-2.0", "GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPL v2", "GPLv2"),
    ("GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPL v3", "GPLv3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU LGPL v3", "LGPL v3", "LGPLv3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
)
COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def _lines() -> list[tuple[str, str]]:
    """Lines that name a license, from the spellings."""
    found = []
    for name, *spelled in SPELLINGS:
        for words_ in {w for s in spelled for w in (s, s.replace("License", "Licence"))}:
            found += [(name, f"{lead} under the {{{words_}}}.") for lead in ("Licensed", "Released")]
    for code, long in COMMONS.items():
        for version, kind in (("3.0", "Unported"), ("4.0", "International")):
            name = f"CC-{code}-{version}"
            found += [(name, f"{lead} under {{CC {code} {version}}}.") for lead in ("Licensed", "Released")]
            found.append((name, f"This work is licensed under a {{Creative Commons {long} {version}}} {kind} License."))
    return sorted(set(found) - set(NOTICES))


TEMPLATES = (*NOTICES, *_lines())


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits, all beyond ASCII), and word offsets of the texts."""
    *_, owner, hashes = words(data, offsets, byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for index, value in enumerate(values):
        pile = bisect_left(tops, value)
        back[index] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(value)
            at.append(index)
        else:
            tops[pile], at[pile] = value, index
    found, index = [], at[-1] if at else -1
    while index >= 0:
        found.append(index)
        index = back[index]
    return found[::-1]


def aligned(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places ``(text, template)`` in order."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            found.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            found.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        places: dict[int, int] = {}
        for i in range(a, a_end):
            places[text[i]] = -1 if text[i] in places else i
        seen: dict[int, int] = {}
        for j in range(b, b_end):
            seen[template[j]] = -1 if template[j] in seen else j
        anchors = sorted((j, places[w]) for w, j in seen.items() if j >= 0 and places.get(w, -1) >= 0)
        kept = [anchors[i] for i in increasing([i for _, i in anchors])]
        if not kept:
            continue
        found += [(i, j) for j, i in kept]
        edges = [(b - 1, a - 1), *kept, (b_end, a_end)]
        gaps += [(i + 1, i_next, j + 1, j_next) for (j, i), (j_next, i_next) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def common(masks: list[int], size: int) -> tuple[int, int]:
    """Length of the longest common subsequence with ``size`` template words, and how many words of the text it needs.

    ``masks`` has the template places of each word of the text as bits (Hyyro 2004).
    """
    whole = (1 << size) - 1
    left, best, stop = whole, size, 0
    for count, mask in enumerate(masks, 1):
        both = left & mask
        left = (left + both | left - both) & whole
        if (rest := left.bit_count()) < best:
            best, stop = rest, count
    return size - best, stop


class Templates:
    """Word hashes of the templates and the places of their marks."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> None:
        self.names = [name for name, _ in templates]
        self.least = least
        self.words: list[np.ndarray] = []
        self.marks: list[list[tuple[int, int, int]]] = []
        #: By width: templates with a first mark of this hash.
        self.firsts: dict[int, dict[int, list[int]]] = {}
        for template, (_, text) in enumerate(templates):
            pieces = re.split("[{}]", text)
            hashes, bounds = _hashed(*text_bytes(pa.array(pieces, pa.string())))
            marks = [(int(bounds[i]), int(bounds[i + 1])) for i in range(1, len(pieces), 2) if bounds[i] < bounds[i + 1]]
            if not marks and 0 < len(hashes) < SHORT:
                marks = [(0, len(hashes))]
            self.words.append(hashes)
            self.marks.append([(a, b, int(chained(hashes[a:b], b - a)[0])) for a, b in marks])
            if marks:
                a, b, key = self.marks[-1][0]
                self.firsts.setdefault(b - a, {}).setdefault(key, []).append(template)
        self.sizes = np.array([len(w) for w in self.words])
        self.loose = [t for t, m in enumerate(self.marks) if not m and self.sizes[t]]

    def match(self, text: np.ndarray, template: int, place: int) -> tuple[float, int, int] | None:
        """Coverage, first word and end of a template whose first mark is at ``place``, if it is enough."""
        own, marks = self.words[template], self.marks[template]
        size = len(own)
        more = (lambda gap: gap // 4 + 2) if size >= SHORT else (lambda gap: 0)
        ends = place + marks[0][1] - marks[0][0]
        known = list(range(place, ends))
        for (_, last, _), (a, b, key) in zip(marks, marks[1:], strict=False):
            gap = a - last
            reach = text[ends : ends + gap + more(gap) + b - a]
            at = np.flatnonzero(chained(reach, b - a) == np.uint64(key))
            if not len(at):
                return None
            nearest = int(at[np.argmin(np.abs(at - gap))])
            known += [ends + i for i, _ in aligned(reach[:nearest].tolist(), own[last:a].tolist())]
            ends += nearest + b - a
            known += range(ends - (b - a), ends)
        left, right = marks[0][0], size - marks[-1][1]
        first = max(0, place - left - more(left))
        known += [first + i for i, _ in aligned(text[first:place].tolist(), own[:left].tolist())]
        known += [ends + i for i, _ in aligned(text[ends : ends + right + more(right)].tolist(), own[size - right :].tolist())]
        coverage = len(known) / size
        return (coverage, min(known), max(known) + 1) if coverage >= self.least else None

    def stretches(self, text: np.ndarray, template: int) -> Iterator[tuple[float, int, int]]:
        """Places of a long template without marks, that do not overlap.

        A place starts where a stretch of at most a quarter and two words more than the template
        has the longest common subsequence with it, of all starts within half the template.
        A wider stretch has no shorter one, so it rules out many starts at a time.
        """
        own = self.words[template]
        size = len(own)
        wide, step, least = size + size // 4 + 2, max(1, size // 4), self.least * size
        bits: dict[int, int] = {}
        for at, word in enumerate(own.tolist()):
            bits[word] = bits.get(word, 0) | 1 << at
        at = np.flatnonzero(np.isin(text, own))
        masks = [bits[word] for word in text[at].tolist()]
        start = 0
        while start < len(text):
            low, high = np.searchsorted(at, (start, start + wide + step)).tolist()
            if high - low < least or common(masks[low:high], size)[0] < least:
                start += step if low < len(at) else len(text)
                continue
            best = (0, 0, 0)
            end = start + step
            # Only a word of the template can be the first of a place.
            for first in range(low, len(at)):
                if at[first] >= end:
                    break
                last = int(np.searchsorted(at, at[first] + wide))
                if last - first < least:
                    continue
                length, stop = common(masks[first:last], size)
                if length < least:
                    continue
                if not best[0]:
                    end = int(at[first]) + max(1, size // 2) + 1
                best = max(best, (length, int(at[first]), int(at[first + stop - 1]) + 1))
            if best[0]:
                yield best[0] / size, best[1], best[2]
            start = best[2] if best[0] else start + step

    def scan(self, hashes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[float, int, str, int, int]]]:
        """For each text what is found: coverage, template size, name, first word, end."""
        found: list[list[tuple[float, int, str, int, int]]] = [[] for _ in range(len(bounds) - 1)]
        for width, known in self.firsts.items():
            runs = chained(hashes, width)
            for at in np.flatnonzero(np.isin(runs, np.fromiter(known, np.uint64, len(known)))).tolist():
                row = int(np.searchsorted(bounds, at, side="right")) - 1
                if at + width > bounds[row + 1]:
                    continue
                for template in known[int(runs[at])]:
                    one = self.match(hashes[bounds[row] : bounds[row + 1]], template, at - int(bounds[row]))
                    if one:
                        found[row].append((one[0], len(self.words[template]), self.names[template], one[1], one[2]))
        for row in range(len(found) if self.loose else 0):
            for template in self.loose:
                for coverage, first, end in self.stretches(hashes[bounds[row] : bounds[row + 1]], template):
                    found[row].append((coverage, len(self.words[template]), self.names[template], first, end))
        return [outermost(f) for f in found]


def outermost(found: list[tuple[float, int, str, int, int]]) -> list[tuple[float, int, str, int, int]]:
    """Places that are not inside the place of a longer template."""
    kept, around = [], []
    for one in sorted(found, key=lambda x: (x[3], -x[4], -x[1])):
        around = [x for x in around if x[4] > one[3]]
        if not any(x[4] >= one[4] and x[1] > one[1] for x in around):
            kept.append(one)
        around.append(one)
    return kept


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Best and all licenses found in every row of ``docs``; see the module."""
    shared = shared_object(docs.sparkSession, Templates(templates, least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for batch in batches:
            data, all_offsets = text_bytes(batch.column("text"))
            for first, last in slices(all_offsets):
                base = all_offsets[first]
                hashes, bounds = _hashed(data[base : all_offsets[last]], all_offsets[first : last + 1] - base)
                found = known.scan(hashes, bounds)
                best = [min(f, key=lambda x: (-x[0], -x[1], x[2], x[3])) if f else None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.array(np.diff(bounds)),
                        pa.array([b and b[2] for b in best], pa.string()),
                        pa.array([b[0] if b else 0.0 for b in best], pa.float64()),
                        pa.array([b and b[3] for b in best], pa.int64()),
                        pa.array([b and b[4] for b in best], pa.int64()),
                        pa.array([",".join(sorted({x[2] for x in f})) for f in found], pa.string()),
                    ],
                    ["doc_id", "n_words", "license", "coverage", "start_word", "end_word", "licenses"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, license string, coverage double, start_word bigint, end_word bigint, licenses string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
