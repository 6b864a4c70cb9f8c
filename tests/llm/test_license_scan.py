from __future__ import annotations

import random

import pytest

from skyloom.llm.license_scan import TEMPLATES, Template, align, rising, scan, scan_licenses

from .helpers import documents, frame, prose


def longest_common(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_rising():
    rng = random.Random(1)
    for _ in range(100):
        values = [rng.randrange(30) for _ in range(rng.randrange(12))]
        found = [values[i] for i in rising(values)]
        assert found == sorted(set(found))
        best = [1] * len(values)
        for i in range(len(values)):
            best[i] = 1 + max([best[j] for j in range(i) if values[j] < values[i]], default=0)
        assert len(found) == max(best, default=0)


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefghij") for _ in range(rng.randrange(15))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randrange(15))]
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest_common(a, b)
    once = list("abcdefghijklmnop")
    assert len(align(once, [x for x in once if x not in "cfk"])) == 13


@pytest.mark.parametrize("template", TEMPLATES, ids=lambda t: f"{t.license}-{len(t.words)}")
def test_every_template_is_found_in_prose(template):
    rng = random.Random(len(template.words))
    text = prose(rng, 200) + "\n" + template.text + "\n" + prose(rng, 100)
    found = scan(text)
    assert any(name == template.license and share == 1.0 for name, _, share, _, _ in found)
    assert len(found) == 1


def test_changed_notices():
    template = Template("X", "one two three four five six seven eight nine ten", ("five",))
    assert scan("zero one two three FOUR, five six seven eight nine! more", (template,))[0][1:3] == (9, 0.9)
    assert scan("one two three four and five six seven eight", (template,))[0][1] == 8
    assert scan("one two three four six seven eight nine ten", (template,)) == []  # a key is missing
    assert scan("one two three five six seven", (template,)) == []
    assert len(scan("one two three four five six seven eight nine ten " * 3, (template,))) == 3


def test_licenses_are_told_apart():
    assert [x[0] for x in scan("Licensed under the MIT License.")] == ["MIT"]
    assert [x[0] for x in scan("Licensed under the Apache License, Version 2.0. Released under the MIT License.")] == ["Apache-2.0", "MIT"]
    assert [x[0] for x in scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    assert scan("mit der Zeit under the bridge") == [] and scan(None) == [] and scan("") == []


def test_documents(spark):
    docs = [*documents(), (70, "a\nLicensed under CC BY-NC 4.0.\nb", "en", "s", None), (70, "a\nLicensed under CC BY-NC 4.0.\nb", "en", "s", None), (None, "Released under the MIT License.", "en", "s", None)]
    found = sorted((tuple(r) for r in scan_licenses(frame(spark, docs, extra=True)).collect()), key=repr)
    cc = (70, "CC-BY-NC-4.0", 5, 1.0, 2, 29, "Licensed under CC BY-NC 4.0")
    assert found == sorted([cc, cc, (None, "MIT", 5, 1.0, 0, 30, "Released under the MIT License")], key=repr)
    assert scan_licenses(frame(spark, [])).collect() == []


def test_lines_that_documents_hold():
    """The license lines of the test tables, each alone and inside a text."""
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "All rights reserved.": "All-rights-reserved",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    for line, name in lines.items():
        assert [x[0] for x in scan(line)] == [name]
        found = scan(f"one two\n{line}\nthree four")
        assert [(x[0], x[2], x[3]) for x in found] == [(name, 1.0, 8)]
    assert scan("reserved are all rights") == []
    assert [x[0] for x in scan("All rights reserved. No part of this work may be reproduced without prior written permission.")] == ["Proprietary"]
