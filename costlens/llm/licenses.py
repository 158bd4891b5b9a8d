"""Operator 7: license scans by patience alignment.

Words that are unique to both a stretch of text and a template anchor the
alignment; the longest increasing subsequence of the anchors is kept, and the
gaps between them are aligned in the same way, where other words are unique.
Coverage is the share of the template's words that are aligned.

The words of a template in braces name the license and its version.  All of
them must be aligned besides, and those of one brace next to each other, so
that a neighbour (LGPL for GPL, another version) is not taken for it.

Where a template may be at all is settled first, without loss: a stretch with
enough coverage holds at least one of any set of template words that is too
large to be missed whole, so only the surroundings of that set's occurrences
are aligned (the set of those rarest in the text).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Notices and headers of common licenses.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the {GNU General Public License}, version {3}.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General "
        "Public License} as published by the Free Software Foundation, either version {3} of the License, or (at your "
        "option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under {CC BY-NC 4.0}.",
    "MIT": "Released under the {MIT} License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, {subject to the following "
        "conditions}:"
    ),
    "Apache-2.0": "Licensed under the {Apache License}, Version {2.0}.",
    "Apache-2.0-header": (
        'Licensed under the {Apache License}, Version {2.0} (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied."
    ),
    "All-rights-reserved": "All rights reserved.",
}
# The other licenses' short notices, headers and the openings of their texts.
for _name, _words, _version in (
    ("GPL-2.0", "GNU General Public License", "2"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
):
    TEMPLATES[_name] = f"This work is licensed under the {{{_words}}}, version {{{_version}}}."
    TEMPLATES[f"{_name}-header"] = TEMPLATES["GPL-3.0-header"].replace("GNU General Public License", _words).replace(
        "{3}", f"{{{_version}}}"
    )
for _name, _words, _version, _date in (
    ("GPL-2.0", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007"),
):
    TEMPLATES[f"{_name}-title"] = f"{{{_words}}} Version {{{_version}}}, {_date}"
for _name, _words in (("BSD", "BSD"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("ISC", "ISC")):
    TEMPLATES[_name] = f"Released under the {{{_words}}} License."
for _name, _words, _version in (
    ("MPL-1.1", "Mozilla Public License", "1.1"),
    ("MPL-2.0", "Mozilla Public License", "2.0"),
    ("EPL-1.0", "Eclipse Public License", "1.0"),
    ("EPL-2.0", "Eclipse Public License", "2.0"),
):
    TEMPLATES[_name] = f"Licensed under the {{{_words}}}, Version {{{_version}}}."
for _short, _long in (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    TEMPLATES[f"CC-{_short}-4.0"] = f"Licensed under {{CC {_short} 4.0}}."
    TEMPLATES[f"CC-{_short}-3.0"] = f"Licensed under {{CC {_short} 3.0}}."
    TEMPLATES[f"CC-{_short}-4.0-header"] = (
        f"This work is licensed under a {{Creative Commons {_long} 4.0}} International License."
    )
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: {Redistributions of source code must retain the above copyright notice}, this list "
    "of conditions and the following disclaimer. {Redistributions in binary form must reproduce the above copyright "
    "notice}, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
TEMPLATES |= {
    "BSD-2-Clause-text": _BSD_2,
    "BSD-3-Clause-text": (
        f"{_BSD_2} {{Neither the name of}} the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, {provided that the above copyright notice and this permission notice appear in all copies}."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the {Mozilla Public License}, v. {2.0}. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the {Eclipse Public "
        "License} {2.0} which is available at"
    ),
    "CC0-1.0": "Licensed under {CC0 1.0}.",
    "CC0-1.0-text": "{Creative Commons CC0 1.0} Universal",
    "Unlicense": "Released under the {Unlicense}.",
    "Unlicense-text": (
        "This is {free and unencumbered software} released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Apache-2.0-title": "{Apache License} Version {2.0}, January 2004",
    "MPL-2.0-title": "{Mozilla Public License} Version {2.0} 1. Definitions",
    "EPL-2.0-title": "{Eclipse Public License} v {2.0} THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS",
}
MIN_COVERAGE = 0.8
FORM = re.compile("-(?:header|text|title)$")
WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by first place, whose second places grow (patience piles)."""
    tops: list[int] = []
    piles: list[tuple[int, int]] = []  # (index of the pair, pile entry to its left)
    last: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        piles.append((k, last[at - 1] if at else -1))
        if at == len(tops):
            tops.append(b)
            last.append(k)
        else:
            tops[at], last[at] = b, k
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = piles[k][1]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text place, template place) pairs, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # equal ends need no anchor
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if in_template[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(text[a:b], a) if in_text[w] == 1 and w in where]
        anchors = increasing(pairs)
        if not anchors:
            continue
        out += anchors
        for (i, k), (j, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if j - i > 1 and m - k > 1:
                todo.append((i + 1, j, k + 1, m))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, min_coverage: float):
        self.name, self.words = name, words(text)
        self.need = max(1, -int(-min_coverage * len(self.words) // 1))  # words that must be aligned
        self.spare = len(self.words) - self.need
        count = Counter(self.words)
        self.count = count
        # Places of the words in braces, brace by brace.
        self.marked, n = [], 0
        for k, piece in enumerate(re.split("[{}]", text)):
            more = len(words(piece))
            if k % 2:
                self.marked.append(range(n, n + more))
            n += more
        self.names = sorted({self.words[i] for m in self.marked for i in m}, key=lambda w: (-len(w), w))
        # Longest words whose occurrences can't all be missing.
        self.keys, missing = [], 0
        for w in sorted(count, key=lambda w: (-len(w), w)):
            self.keys.append(w)
            missing += count[w]
            if missing > self.spare:
                break

    def windows(self, text: list[str], at: dict[str, list[int]]) -> list[tuple[int, int]]:
        """Stretches of the text that may hold the template: around the rarest words that can't all be missing."""
        missing, places = 0, []
        if self.names:  # none of them may be missing
            places = min((at.get(w, []) for w in self.names), key=len)
        else:
            for w in sorted(self.count, key=lambda w: (len(at.get(w, ())), w)):
                places += at.get(w, ())
                missing += self.count[w]
                if missing > self.spare:
                    break
        reach = len(self.words) + self.spare
        out: list[tuple[int, int]] = []
        for p in sorted(places):
            a, b = max(0, p - reach), min(len(text), p + reach + 1)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def find(self, text: list[str], at: dict[str, list[int]]) -> list[tuple[int, int, float]]:
        """(first word, word after the last, coverage) of each place with enough coverage; the best of overlapping ones."""
        out = []
        for a, b in self.windows(text, at):
            best, i = None, a
            while i < b or best is not None:
                if best is not None and (i >= best[1] or best[2] == 1.0):
                    out.append(best)
                    best, i = None, max(i, best[1])
                    continue
                got = self._from(text, i, b) if text[i] in self.count else None
                if got is not None and (best is None or (-got[2], got[1] - got[0]) < (-best[2], best[1] - best[0])):
                    best = got
                i += 1
        return out

    def _from(self, text: list[str], lo: int, end: int) -> tuple[int, int, float] | None:
        """The alignment of the stretch that begins at `lo`, if it covers enough."""
        part = text[lo : min(end, lo + len(self.words) + self.spare)]
        here = set(part)
        if any(w not in here for w in self.names):
            return None
        if sum((Counter(part) & self.count).values()) < self.need:
            return None
        pairs = align(part, self.words)
        if len(pairs) < self.need or not self._named(pairs):
            return None
        return lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs) / len(self.words)


    def _named(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether the words of each brace are aligned, side by side in the text."""
        place = {j: i for i, j in pairs}
        return all(
            m[0] in place and all(place.get(j) == place[m[0]] + j - m[0] for j in m) for m in self.marked
        )


def scan(text: str, templates: list[Template]) -> list[tuple[str, int, int, float]]:
    """(license, start, end, coverage) of the notices in a whole text, in code points, by place."""
    low = text.lower()
    some = [t for t in templates if all(k in low for k in t.names) and any(k in low for k in t.keys)]
    if not some:
        return []
    wanted = set().union(*(t.count for t in some))
    spans = [m.span() for m in WORD.finditer(low)]
    w = [low[a:b] for a, b in spans]
    at: dict[str, list[int]] = {}
    for i, x in enumerate(w):
        if x in wanted:
            at.setdefault(x, []).append(i)
    found = [
        (t.name, spans[a][0], spans[b - 1][1], cover, round(cover * len(t.words)))
        for t in some for a, b, cover in t.find(w, at)
    ]
    def part_of(f, g) -> bool:
        """Whether `f` goes with `g`: it lies inside, or both are forms of one license that overlap and `g` fits better."""
        if g[1] <= f[1] and f[2] <= g[2]:
            return (g[2] - g[1], g[4]) > (f[2] - f[1], f[4])
        apart = g[1] >= f[2] or f[1] >= g[2] or f[1] <= g[1] and g[2] <= f[2]
        return not apart and FORM.sub("", f[0]) == FORM.sub("", g[0]) and (g[3], g[4]) > (f[3], f[4])

    out = [f[:4] for f in found if not any(part_of(f, g) for g in found)]
    return sorted(out, key=lambda f: (f[1], f[0]))


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """`key`, n_notices, best, coverage, notices of every row of `docs`.

    notices: array of (license, start, end, coverage) in code points, by start.
    best: the license of most coverage, of the first of equal ones; null and
    coverage 0 where there is none, as in null and empty texts.  Repeated rows
    and null keys get a row each; an empty table gives an empty result; other
    columns are not read.
    """
    texts = TEMPLATES if templates is None else templates
    span = T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("coverage", T.DoubleType()),
        ]
    )
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_notices", T.LongType()),
            T.StructField("best", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("notices", T.ArrayType(span)),
        ]
    )
    spans = pa.list_(
        pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Template(n, t, min_coverage) for n, t in texts.items()]
        for batch in batches:
            found = [scan(t.as_py() or "", ready) for t in batch.column(1)]
            best = [min(f, key=lambda x: (-x[3], x[1]), default=None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([b and b[0] for b in best], pa.string()),
                    pa.array([b[3] if b else 0.0 for b in best], pa.float64()),
                    pa.array(
                        [[{"license": n, "start": a, "end": b, "coverage": c} for n, a, b, c in f] for f in found], spans
                    ),
                ],
                schema.names,
            )

    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)
