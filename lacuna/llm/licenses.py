"""Licence scans by Dice coefficients over word bigrams.

Every line, every paragraph (lines up to a blank one) and the whole of a text is
a unit.  A unit is normalised to lower-case words and compared to licence
templates by the Dice coefficient of their bigram multisets,
``2 |A and B| / (|A| + |B|)``.  A coefficient of t needs sizes between
``|A| t / (2 - t)`` and ``|A| (2 - t) / t``, so units outside the reach of all
templates are not split into bigrams, and the others meet only templates in reach.
Notices inside longer units are found by windows of a template's length over the
words of the whole text, on lines that no matching unit covers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

THRESHOLD = 0.8
_SLICE = 512
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")

#: The customary notices of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(tokens: list[str]) -> Counter:
    return Counter(zip(tokens, tokens[1:], strict=False))


class Templates:
    """Bigrams of the templates, sizes in reach and the templates that hold a bigram."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        self.grams = [bigrams(words(text)) for _, text in templates]
        self.sizes = [g.total() for g in self.grams]
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.reach = [(n * low - 1e-9, n * high + 1e-9) for n in self.sizes]
        self.least = min((a for a, _ in self.reach), default=1)
        self.most = max((b for _, b in self.reach), default=0)
        self.known = set().union(*self.grams) if self.grams else set()
        self.holders: dict[tuple, list[int]] = {}
        for k, grams in enumerate(self.grams):
            for g in grams:
                self.holders.setdefault(g, []).append(k)

    def best(self, tokens: list[str]) -> tuple[float, int] | None:
        """(Dice, template) of the best template at the threshold or above; ties to the first."""
        n = len(tokens) - 1
        if n < 1 or not self.least <= n <= self.most:
            return None
        own = Counter(g for g in zip(tokens, tokens[1:], strict=False) if g in self.known)
        if 2 * own.total() < self.threshold * (self.least + n):
            return None
        found = None
        for k, (grams, size) in enumerate(zip(self.grams, self.sizes, strict=True)):
            if self.reach[k][0] <= n <= self.reach[k][1]:
                dice = 2 * sum(min(c, grams[g]) for g, c in own.items() if g in grams) / (n + size)
                if dice >= self.threshold and (found is None or dice > found[0]):
                    found = (dice, k)
        return found


    def windows(self, tokens: list[str]) -> list[tuple[float, int, int, int]]:
        """(Dice, template, first word, last word) of windows of a template's length at the threshold, best first, apart from each other.

        A window starts at a bigram of its template: moving it there loses none.
        """
        at: dict[int, list[int]] = {}
        for i, g in enumerate(zip(tokens, tokens[1:], strict=False)):
            for k in self.holders.get(g, ()):
                at.setdefault(k, []).append(i)
        found = []
        for k, hits in at.items():
            size, end = self.sizes[k], 0
            for start, i in enumerate(hits):
                while end < len(hits) and hits[end] < i + size:
                    end += 1
                n = min(size, len(tokens) - 1 - i)
                if 2 * (end - start) >= self.threshold * (n + size):
                    own = Counter((tokens[j], tokens[j + 1]) for j in hits[start:end])
                    dice = 2 * sum(min(c, self.grams[k][g]) for g, c in own.items()) / (n + size)
                    if dice >= self.threshold:
                        found.append((dice, k, i, hits[end - 1] + 1))
        found.sort(key=lambda x: (-x[0], x[2], x[1]))
        apart, taken = [], set()
        for x in found:
            span = range(x[2], x[3] + 1)
            if taken.isdisjoint(span):
                taken.update(span)
                apart.append(x)
        return apart


def scan_text(text: str | None, templates: Templates) -> list[tuple[str, float, int, int]]:
    """(licence, Dice, first line, last line), lines from 0, of each matching unit, best first, then of each window.

    A unit of the same lines as another is taken once; a paragraph or text of
    one line is that line.
    """
    lines = [words(x) for x in (text or "").split("\n")]
    units = {(i, i): own for i, own in enumerate(lines)}
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i]:
            if start < i:
                units.setdefault((start, i - 1), [w for own in lines[start:i] for w in own])
            start = i + 1
    units.setdefault((0, len(lines) - 1), [w for own in lines for w in own])
    found = [(best, span) for span, own in units.items() if (best := templates.best(own))]
    found.sort(key=lambda x: (-x[0][0], x[1], x[0][1]))
    covered = {i for _, (a, b) in found for i in range(a, b + 1)}
    line_of = [i for i, own in enumerate(lines) for _ in own]
    for dice, k, i, j in templates.windows([w for own in lines for w in own]):
        if covered.isdisjoint(range(line_of[i], line_of[j] + 1)):
            found.append(((dice, k), (line_of[i], line_of[j])))
    return [(templates.names[k], dice, a, b) for (dice, k), (a, b) in found]


MATCHES = "array<struct<license:string,dice:double,first_line:int,last_line:int>>"


def scan(docs: DataFrame, keep: list[str], templates=TEMPLATES, threshold: float = THRESHOLD, matches: str = "matches") -> DataFrame:
    """The columns ``keep`` of each row and the list of its matching units, best first.

    Null and empty texts match nothing, and nothing is left out of long texts;
    equal texts get equal lists; an empty table gives an empty result.  A column
    of ``keep`` named like the result gives way to it.
    """
    keep = [c for c in keep if c.lower() != matches.lower()]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(matches, T._parse_datatype_string(MATCHES))])
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))
    fields = ("license", "dice", "first_line", "last_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Templates(templates, threshold)
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                found = [[dict(zip(fields, m, strict=True)) for m in scan_text(t.as_py(), held)] for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, kind)], [*keep, matches])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
