"""Licence notices in documents, by the Dice coefficient of word bigrams with templates.

Texts and templates are compared as words of letters and digits in lower case (bytes beyond
ASCII count as letters). A document's units are runs of whole sentences and lines; a unit is
compared with a template if the numbers of their bigrams allow a coefficient of ``LEAST`` at
all: with n and m bigrams it is at most 2 min(n, m) / (n + m). Of the units that start at a
place the most similar one counts, and of overlapping finds the one with the higher
coefficient (the longer, then the earlier, then the first template, if equal).

A unit names a licence only if its version numbers and the words that tell variants apart (Lesser,
Affero, NonCommercial and the like) are those of the template; the templates hold the short notices
of all versions and variants. Where no such unit is, notices inside a sentence count as well: runs
that start and end at bigrams of a template of up to ``FEW`` bigrams. Of a template of fewer than
``LOOSE`` they must end at the last one, as a bigram less is a good part of it.

A run is compared by its distinct bigrams, and those are known for all runs from a place at once: a
bigram is new in a run if its last place before lies in front of the run. A longer run without a new
bigram is no better, so notices that repeat cost a run each and not one for every length, and places
from which the same follows have the same best run.

Most words of a text are in no template. Only where bigrams of a template are dense enough to
reach ``LEAST`` are units formed. Every row has its own result; a null or empty text has no
licence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import WordNumbers, mixed, odd_numbers, slices

LEAST = 0.8
FEW, LOOSE = 24, 8
PIECE = 8 << 20

# Notices of public licences, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                   "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                   "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
                "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
                "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                     "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                     "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
                     "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

TEMPLATES += [(name, f"This work is licensed under the GNU {kind} Public License, version {version}.") for name, kind, version in (
    ("GPL-2.0", "General", "2"), ("LGPL-2.0", "Library General", "2"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"),
    ("AGPL-3.0", "Affero General", "3"))]
TEMPLATES += [(name, f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published "
                     f"by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.")
              for name, kind, version in (("LGPL-2.0", "Library", "2"), ("LGPL-2.1", "Lesser", "2.1"))]
TEMPLATES += [("ISC", "Licensed under the ISC License."), ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
              ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
              ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("GPL-2.0", "Distributed under the terms of the GNU GPL version 2."),
              ("GPL-3.0", "Distributed under the terms of the GNU GPL version 3."), ("MIT OR GPL", "Dual licensed under the MIT and GPL licenses."),
              ("MIT OR Apache-2.0", "This package is dual-licensed: MIT License or Apache License 2.0.")]
TEMPLATES += [("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
              ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in "
                          "compliance with the License.")]
TEMPLATES += [notice for version, region in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))
              for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                                  ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
              for notice in ((f"CC-{short}-{version}", f"Licensed under CC {short} {version}."),
                             (f"CC-{short}-{version}", f"This work is licensed under a Creative Commons {long} {version} {region} License."))
              if notice not in TEMPLATES]

# Words that tell variants of a licence apart, by themselves, after another word, or before one; and words before a version.
VARIANTS = {b"lesser": "lesser", b"affero": "affero", b"noncommercial": "nc", b"sharealike": "sa", b"noderivatives": "nd", b"noderivs": "nd"}
PAIRS = {(b"non", b"commercial"): "nc", (b"share", b"alike"): "sa", (b"no", b"derivatives"): "nd", (b"no", b"derivs"): "nd", (b"no", b"derivative"): "nd",
         (b"library", b"general"): "library"} | {(a, b): b.decode() for a in (b"by", b"nc") for b in (b"nc", b"sa", b"nd")}
LEADS = frozenset(b"version v attribution by nc sa nd noncommercial sharealike noderivatives noderivs commercial alike derivatives derivs works mpl gpl lgpl agpl".split())
VERSION = re.compile(rb"(?:[al]?gpl)?v(\d)")

#: ASCII letters and digits in lower case and bytes beyond ASCII as they are; all else is a space.
PLAIN = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
UNIT = re.compile(rb"[\r\n]+|(?<=[.!?;:])[ \t]+")


def bigrams(words: list[bytes], numbers: WordNumbers) -> np.ndarray:
    w = numbers.of(words)
    a, b = (np.uint64(int(x)) for x in odd_numbers(2, 51))
    return mixed(w[:-1] * a + w[1:] * b)


def marks(words: list[bytes]) -> list[tuple[int, str]]:
    """(place, mark): versions and variants that the words name."""
    out = []
    for i, word in enumerate(words):
        before, after = words[i - 1] if i else b"", words[i + 1] if i + 1 < len(words) else b""
        minor = len(after) == 1 and after.isdigit()
        found = VERSION.fullmatch(word)
        if found or (len(word) == 1 and word.isdigit() and (before in LEADS or (before == b"license" and minor))):
            out.append((i, (found[1] if found else word).decode() + (f".{after.decode()}" if minor and after != b"0" else "")))
        elif word in VARIANTS:
            out.append((i, VARIANTS[word]))
        elif (word, after) in PAIRS:
            out.append((i + 1, PAIRS[word, after]))
    return out


def _bounds(m: int) -> tuple[int, int]:
    """Least and greatest number of bigrams that can reach ``LEAST`` with m."""
    return int(np.ceil(m * LEAST / (2 - LEAST) - 1e-9)), int(np.floor(m * (2 - LEAST) / LEAST + 1e-9))


def prepared(templates: list[tuple[str, str]]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per template (name, sorted distinct bigrams, its last bigram, its marks); a table of what bigrams there are at all; all bigrams, and
    which templates hold them; and how many a text must share with each template."""
    numbers = WordNumbers()
    sets = []
    for name, text in templates:
        words = text.encode().translate(PLAIN).split()
        grams = bigrams(words, numbers)
        sets.append((name, np.unique(grams), grams[-1:], {mark for _, mark in marks(words)}))
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x[1] for x in sets]]))
    known = np.zeros(1 << 20, bool)
    known[(every >> np.uint64(44)).astype(np.int64)] = True
    holds = np.array([np.isin(every, x[1]) for x in sets]).reshape(len(sets), len(every)).T
    needed = np.array([LEAST * (_bounds(len(g))[0] + len(g)) / 2 - 1e-9 if len(g) else np.inf for g in (x[1] for x in sets)])
    return sets, known, every, holds, needed


def finds(raw: bytes, templates: tuple, numbers: WordNumbers, inside: bool = False) -> list[tuple[str, float, int, int]]:
    """(licence, coefficient, first word, word after the last) of a text, without overlaps; ``inside``: inside sentences too."""
    sets, known, every, holds, needed = templates
    words = raw.translate(PLAIN).split()
    if len(words) < 2 or not len(every):
        return []
    grams = bigrams(words, numbers)
    hits = grams[known[(grams >> np.uint64(44)).astype(np.int64)]]
    if len(hits) < needed.min():
        return []
    at = np.minimum(np.searchsorted(every, hits), len(every) - 1)
    likely = np.flatnonzero(holds[at[every[at] == hits]].sum(axis=0) >= needed)
    if not len(likely):
        return []
    ends = np.cumsum([len(u.translate(PLAIN).split()) for u in UNIT.split(raw)])
    ends = np.unique(ends[ends > 0])
    starts = np.append(0, ends[:-1])
    before = _last_places(grams)
    gap = np.where(before < 0, len(grams), np.arange(len(grams)) - before)
    marked = None
    most = max(_bounds(len(sets[t][1]))[1] for t in likely.tolist()) + 1
    new_from: dict[int, np.ndarray] = {}

    def told_marks() -> list[tuple[int, str]]:
        nonlocal marked
        if marked is None:
            marked = marks(words)
        return marked

    def best_of(t: int, s: int, stops: np.ndarray, low: int, high: int, hit: np.ndarray) -> tuple[float, int]:
        """The highest coefficient of a run from a place that has the marks of the template, and where it ends, the first if equal."""
        if s not in new_from:
            if len(new_from) > 64:
                new_from.clear()
            new_from[s] = _new_places(before, s, most)
        new = new_from[s][:high + 1]
        m, own_marks = len(sets[t][1]), sets[t][3]
        # ends at which a run has a new bigram, with low to high of them
        at = np.searchsorted(stops, new + 2)
        ends_at = np.unique(stops[at[at < len(stops)]])
        n = np.searchsorted(new, ends_at - 1)
        fits = (n >= low) & (n <= high)
        ends_at, n = ends_at[fits], n[fits]
        dice = 2 * np.append(0, np.cumsum(hit[new]))[n] / (n + m)
        first = bisect_left(told_marks(), (s,))
        for i in np.lexsort((ends_at, -dice)):
            if dice[i] < LEAST:
                break
            if {mark for _, mark in marked[first:bisect_left(marked, (int(ends_at[i]),))]} == own_marks:
                return float(dice[i]), int(ends_at[i])
        return 0.0, 0

    contents: dict[tuple, int] = {}
    content_at: dict[int, int] = {}
    known_best: dict[tuple[int, int], tuple[float, int]] = {}

    def content_of(s: int) -> int:
        """A number for what the runs of whole units from a place are made of, the same where a notice repeats."""
        if s not in content_at:
            new = _new_places(before, s, most)
            at = np.searchsorted(ends, new + 2)
            stops = ends[at[at < len(ends)]]
            until = int(stops[-1]) if len(stops) else s
            told = tuple((place - s, mark) for place, mark in told_marks()[bisect_left(told_marks(), (s,)):bisect_left(told_marks(), (until,))])
            content_at[s] = contents.setdefault(((new - s).tobytes(), grams[new].tobytes(), (stops - s).tobytes(), told), len(contents))
        return content_at[s]

    found, partly, prepared_hits = [], [], []
    for t in likely.tolist():
        template = sets[t][1]
        m = len(template)
        low, high = _bounds(m)
        at = np.minimum(np.searchsorted(template, grams), m - 1)
        hit = template[at] == grams
        shared = np.concatenate([[0], np.cumsum(hit)])
        # of the next words, those that neither are the template's nor may come again are too many for a run from there
        again = np.concatenate([[0], np.cumsum(gap < high)])
        enough = shared + again
        prepared_hits.append((t, m, low, high, hit, enough))
        for s in starts[enough[np.minimum(starts + high, len(grams))] - enough[np.minimum(starts, len(grams))] >= needed[t]].tolist():
            content = content_of(s)
            if (t, content) not in known_best:
                dice, e = best_of(t, s, ends, low, high, hit)
                known_best[t, content] = (dice, e - s)
            dice, length = known_best[t, content]
            if dice >= LEAST:
                found.append((-dice, -length, s, t, s + length))
    out: list[tuple[str, float, int, int]] = []
    taken = np.zeros(len(words) + 1, bool)

    def keep(these: list) -> None:
        for minus, _, s, t, e in sorted(these):
            if not taken[s:e].any():
                taken[s:e] = True
                out.append((sets[t][0], -minus, s, e))

    keep(found)
    for t, m, low, high, hit, enough in prepared_hits if inside else ():
        if m <= FEW:
            places = np.flatnonzero(hit & ~taken[:len(hit)])
            last = (np.flatnonzero(hit) if m >= LOOSE else np.flatnonzero(grams == sets[t][2])) + 2
            for s in places[enough[np.minimum(places + high, len(grams))] - enough[places] >= needed[t]].tolist():
                dice, e = best_of(t, s, last, low, high, hit)
                if dice >= LEAST:
                    partly.append((-dice, s - e, s, t, e))
    keep(partly)
    return sorted(out, key=lambda x: x[2])


def _last_places(grams: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same bigram, or -1."""
    order = np.argsort(grams, kind="stable")
    out = np.full(len(grams), -1, np.int64)
    same = grams[order][1:] == grams[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def _new_places(before: np.ndarray, s: int, most: int) -> np.ndarray:
    """The first places from s on, ``most`` of them, whose bigram is not between s and them; read in pieces that double."""
    out, count, at, size = [], 0, s, 4 * most
    while at < len(before) and count < most:
        found = np.flatnonzero(before[at:at + size] < s) + at
        out.append(found)
        count, at, size = count + len(found), at + size, 2 * size
    return np.concatenate([np.zeros(0, np.int64), *out])[:most]


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(id, found): every row with the licences found in it, as (licence, dice, first word, end word) in text order."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("raw"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        made = prepared(templates)
        kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for piece in slices(batches, "raw", PIECE):
            out = [[dict(zip(("licence", "dice", "start", "end"), f)) for f in finds(raw or b"", made, numbers, inside=True)]
                   for raw in piece.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(out, kind)], ["id", "found"])

    id_type = dict(docs.dtypes)[id_col]
    return source.mapInArrow(scan, f"id {id_type}, found array<struct<licence: string, dice: double, start: bigint, end: bigint>>")
