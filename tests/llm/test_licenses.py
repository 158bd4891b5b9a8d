import itertools
import random

import pytest

import costlens.llm.licenses as L

READY = [L.Template(n, t, L.MIN_COVERAGE) for n, t in L.TEMPLATES.items()]


def test_increasing_is_the_longest():
    random.seed(0)
    for _ in range(200):
        second = random.sample(range(20), 8)
        pairs = list(enumerate(second))
        got = L.increasing(pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))
        best = max(
            n for n in range(9) if any(list(c) == sorted(c) for c in itertools.combinations(second, n))
        )
        assert len(got) == best


def test_alignment_is_in_order_and_equal():
    random.seed(1)
    for _ in range(200):
        a = [random.choice("abcdefghij") for _ in range(20)]
        b = [random.choice("abcdefghij") for _ in range(15)]
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(L.align(list("xxabcyy"), list("abc"))) == 3


@pytest.mark.parametrize("name", L.TEMPLATES)
def test_planted_notices(name):
    random.seed(2)
    text = L.TEMPLATES[name]
    for place in range(20):
        before = " ".join(random.choices(["the", "of", "license", "under", "and", "foo"], k=place))
        t = f"{before}\n{text.upper() if place % 2 else text}\n{before}"
        assert [n for n, *_ in L.scan(t, READY)] == [name]
        _, a, b, cover = L.scan(t, READY)[0]
        assert cover == 1.0 and L.words(t[a:b]) == L.words(text)


def test_changed_notice_and_coverage():
    w = L.TEMPLATES["GPL-3.0"].split()
    some = " ".join(w[:3] + ["inserted"] + w[4:])
    assert [(n, round(c, 3)) for n, _, _, c in L.scan(some, READY)] == [("GPL-3.0", round(11 / 12, 3))]
    assert L.scan(" ".join(w[:8]), READY) == []
    twice = f"{L.TEMPLATES['MIT']} and {L.TEMPLATES['MIT']}"
    assert [n for n, *_ in L.scan(twice, READY)] == ["MIT", "MIT"]


@pytest.mark.parametrize(
    "text, name",
    [
        ("Released under the BSD License.", "BSD"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This project is licensed under the MIT License", "MIT"),
        ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("Released under the ISC License.", "ISC"),
        ("Licensed under the Eclipse Public License, Version 2.0.", "EPL-2.0"),
        ("Released under the Unlicense.", "Unlicense"),
        ("Licensed under CC0 1.0.", "CC0-1.0"),
        ("Released under the Zope License.", None),
        ("Licensed under CC BY-NC 2.5.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("This work is licensed under the GNU General Public License, version 1.", None),
    ],
)
def test_neighbours_are_told_apart(text, name):
    for t in (text, f"some words before\n{text.upper()}\nand words after"):
        assert [n for n, *_ in L.scan(t, READY)] == ([name] if name else [])


@pytest.mark.parametrize(
    "text",
    [
        "Released under the BSD License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
)
def test_neighbours_are_not_taken_for_these(text):
    own = [t for t in READY if t.name in ("GPL-3.0", "GPL-3.0-header", "CC-BY-NC-4.0", "MIT", "MIT-text", "Apache-2.0")]
    assert L.scan(text, own) == [] and L.scan(f"before {text.upper()} after", own) == []


def test_rows(odd_rows, no_rows, spark):
    got = L.scan_licenses(odd_rows).collect()
    assert len(got) == odd_rows.count() and all((r.n_notices, r.best, r.coverage) == (0, None, 0.0) for r in got)
    one = spark.createDataFrame([(1, "😀 All rights reserved. " + "license " * 5000)], "doc_id long, text string")
    r = L.scan_licenses(one).first()
    assert (r.n_notices, r.best, r.notices[0].start, r.notices[0].end) == (1, "All-rights-reserved", 2, 21)
    assert L.scan_licenses(no_rows).count() == 0
