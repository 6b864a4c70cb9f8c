"""License scans by patience alignment of texts with license templates.

A stretch of a text is aligned with a template by anchoring on words that occur
once in both, taking the longest increasing subsequence of the anchors, and
aligning the gaps between them in the same way. Coverage is the share of the
template's words that are aligned. Stretches to align come from an exact bound: a
window of SLACK times the template's length in which enough of the template's
words occur at all. Where notices overlap, the one that covers most words stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of

COVERAGE = 0.8
#: Words of a window for each word of the template; what lies between aligned words is of the text alone.
SLACK = 1.25
WORD = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")


@dataclass(frozen=True)
class Template:
    """license: its SPDX name; keys: words that must be aligned, since licenses differ in them."""

    license: str
    text: str
    keys: tuple[str, ...]

    @cached_property
    def words(self) -> tuple[str, ...]:
        return tuple(w for w, _, _ in words_of(self.text))

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.words)


# The wording of common license notices and the words that tell them apart.
TEMPLATES: tuple[Template, ...] = (
    Template("MIT", "Released under the MIT License.", ("mit", "license")),
    Template("MIT", "Licensed under the MIT License.", ("mit", "license")),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission", "sublicense"),
    ),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "license", "2.0")),
    Template(
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache", "compliance"),
    ),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "general", "public", "3")),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "general", "public", "3")),
    Template(
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu", "general", "public", "redistribute", "3"),
    ),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", ("bsd", "3-clause")),
    Template("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", ("bsd", "2-clause")),
    Template(
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution", "redistributions", "binary"),
    ),
    Template(
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("permission", "fee"),
    ),
    Template(
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla", "public", "2.0"),
    ),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    Template("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ("cc", "by-nd", "4.0")),
    Template("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("cc", "by-nc-sa", "4.0")),
    Template("CC0-1.0", "Released under CC0 1.0 Universal.", ("cc0", "1.0")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution", "4.0")),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "commons", "attribution-noncommercial", "4.0")),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "attribution-sharealike", "4.0")),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered", "public", "domain")),
    Template("Proprietary", "All rights reserved. No part of this work may be reproduced without prior written permission.", ("rights", "reserved", "reproduced")),
    # of its own name: BSD and other open licenses follow this sentence too
    Template("All-rights-reserved", "All rights reserved.", ("rights", "reserved")),
    Template("All-rights-reserved", "Alle Rechte vorbehalten.", ("rechte", "vorbehalten")),
    Template("All-rights-reserved", "Tous droits réservés.", ("droits", "réservés")),
    Template("All-rights-reserved", "Todos los derechos reservados.", ("derechos", "reservados")),
)


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words of letters and digits, joined by single dots, hyphens and pluses, with their places in the text."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1] = [v]
        ends[k : k + 1] = [i]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: list[str] | tuple[str, ...], b: list[str] | tuple[str, ...]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both, by patience alignment."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        shared = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place]
        last_a, last_b = a0, b0
        for k in rising([j for _, j in shared]):
            i, j = shared[k]
            pairs.append((i, j))
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        if last_a > a0:
            todo.append((last_a, a1, last_b, b1))
    return sorted(pairs)


def notices_of(template: Template, words: list[str], coverage: float) -> Iterator[tuple[int, int, int]]:
    """(first word, last word, aligned words) of each stretch that covers enough of the template, left to right."""
    counts, n = template.counts, len(template.words)
    need = max(1, -(-round(coverage * 1000) * n // 1000))
    width = int(SLACK * n) + 2
    hits = [i for i, w in enumerate(words) if w in counts]
    inside: Counter = Counter()
    bound, right, over = 0, 0, -1
    for left, start in enumerate(hits):
        while right < len(hits) and hits[right] < start + width:
            w = words[hits[right]]
            inside[w] += 1
            bound += inside[w] <= counts[w]
            right += 1
        if bound >= need and start > over:
            stretch = words[start : start + width]
            pairs = align(template.words, stretch)
            found = {template.words[i] for i, _ in pairs}
            # the window may begin with a word of the text: the notice is looked for again from the next hit
            if len(pairs) >= need and found.issuperset(template.keys) and pairs[0][1] == 0:
                yield start, start + pairs[-1][1], len(pairs)
                over = start + pairs[-1][1]
        w = words[start]
        bound -= inside[w] <= counts[w]
        inside[w] -= 1


def scan(text: str | None, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> list[tuple[str, int, float, int, int]]:
    """(license, aligned words, coverage, first, end) of a text's notices, the last two as places of characters; in order of place."""
    low = (text or "").lower()
    likely = [t for t in templates if all(k in low for k in t.keys)]
    if not likely:
        return []
    placed = words_of(text)
    words = [w for w, _, _ in placed]
    found = []
    for t in likely:
        found += [(-n, -n / len(t.words), first, last, t.license) for first, last, n in notices_of(t, words, coverage)]
    kept: list[tuple] = []
    for row in sorted(found):  # most aligned words first, then the better covered, then the earlier
        if all(row[3] < k[2] or row[2] > k[3] for k in kept):
            kept.append(row)
    return sorted(((name, -n, -share, placed[first][1], placed[last][2]) for n, share, first, last, name in kept), key=lambda r: r[3])


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, words (aligned), coverage, first_char, end_char and excerpt of every notice in docs.

    Null and empty texts have none. A text's notices don't overlap; of equal ones
    at one place the first by license name stays. Repeated rows give their
    notices each. Very long texts are scanned whole.
    """
    session_of(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py()
                for name, n, share, first, end in scan(text, templates, coverage):
                    for column, x in zip(out, (doc_id, name, n, share, first, end, text[first:end]), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            names = ["doc_id", "license", "words", "coverage", "first_char", "end_char", "excerpt"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id long, license string, words int, coverage double, first_char long, end_char long, excerpt string")
