"""License scan: passages whose word bigrams match a licence template by the Dice coefficient.

Texts are normalised to words of letters and digits in lower case. A passage matches a template if 2 |A & B| / (|A| + |B|)
of their sets of word bigrams is THRESHOLD or more. That bounds the sizes: with d the threshold, a passage has between
d / (2 - d) and (2 - d) / d times the template's bigrams, and shares at least d / (2 - d) of them; templates of which a
text holds fewer are never compared. Passages begin and end with bigrams of the template, since others only lower the
coefficient. Of overlapping passages for one template the best is kept, ties by the first and then the shorter.

Null or empty text: no match. Repeated rows each get their own result. Texts are taken whole; a candidate's work is its
bigrams times the bounded number of different bigrams of a passage, however often they are repeated.
"""

from __future__ import annotations

import heapq
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fleetwatt.llm.text import LOWER, mix, pieces, span_hash, sums, words

THRESHOLD = 0.8

#: Bytes that part words: all but letters, digits and the bytes of characters beyond ASCII.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False

#: Notices and texts of common licences, without names and years.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

MATCHES = "array<struct<license:string,dice:double,begin:bigint,end:bigint>>"


def bigrams(data: np.ndarray, at: np.ndarray):
    """(hash, text, begin, end) of each pair of words that follow each other in a text."""
    low = LOWER[data]
    b, e, doc = words(low, at, APART)
    h = span_hash(sums(low), b, e)
    if len(h) < 2:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    pair = doc[1:] == doc[:-1]
    code = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return code[pair], doc[:-1][pair], b[:-1][pair], e[1:][pair]


def template_sets(templates: dict[str, str]) -> dict[str, np.ndarray]:
    out = {}
    for name in sorted(templates):
        raw = np.frombuffer(templates[name].encode(), np.uint8)
        out[name] = np.unique(bigrams(raw, np.array([0, len(raw)]))[0])
    return {k: v for k, v in out.items() if len(v)}


def best_ends(code: list[int], ours: list[bool], size: int, threshold: float, lo: int, hi: int) -> Iterator[tuple[int, float, int]]:
    """(first, dice, last) of the best passage within [lo, hi) from each bigram of the template, from the last one back; last is -1 if none reaches the threshold.

    `recent` holds the nearest different bigrams from a place on, nearest first, as many as a passage can have, so repeated
    bigrams cost nothing. A passage ends where it gains a bigram of the template: any other end has a lower coefficient, or
    the same one and is longer. It ends early once no passage from further left can reach `hi`, which changes none of them.
    """
    most = int((2 - threshold) / threshold * size + 1e-9)
    recent: list[int] = []
    where: dict[int, tuple[int, bool]] = {}
    for a in range(hi - 1, lo - 1, -1):
        x = code[a]
        if x in where:
            recent.remove(x)
        elif len(recent) == most:
            del where[recent.pop()]
        recent.insert(0, x)
        where[x] = a, ours[a]
        if ours[a]:
            best, last, good = threshold, -1, 0
            for n, y in enumerate(recent, 1):
                at, mine = where[y]
                if mine:
                    good += 1
                    dice = 2 * good / (n + size)
                    if dice > best or (last < 0 and dice >= best):
                        best, last = dice, at
            yield a, best, last
        if hi < len(code) and len(recent) == most:
            return


def best_passages(code: np.ndarray, wanted: np.ndarray, threshold: float) -> list[tuple[float, int, int]]:
    """(dice, first, last) bigram indexes of the best passages of a text that don't overlap."""
    ours = np.isin(code, wanted).tolist()
    code = code.tolist()
    best = {a: (dice, b) for a, dice, b in best_ends(code, ours, len(wanted), threshold, 0, len(code)) if b >= 0}
    heap = [(-dice, a, b) for a, (dice, b) in best.items()]
    heapq.heapify(heap)
    kept: list[tuple[float, int, int]] = []
    firsts: list[int] = []
    lasts: list[int] = []
    while heap:
        dice, a, b = heapq.heappop(heap)
        if best.get(a) != (-dice, b):
            continue
        i = bisect(firsts, a)
        before = lasts[i - 1] if i else -1
        if before >= a:
            continue
        kept.append((-dice, a, b))
        firsts.insert(i, a)
        lasts.insert(i, b)
        # passages from the left that reached into this one: the best that end before it
        for x, d, y in best_ends(code, ours, len(wanted), threshold, before + 1, a):
            if x in best and best[x] != (d, y):
                best[x] = d, y
                if y >= 0:
                    heapq.heappush(heap, (-d, x, y))
    return kept


def license_column(spark: SparkSession, text: str | Column, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<license, dice, begin, end>> of a text column, by begin, end (code points) and license."""
    sets = template_sets(templates)
    names = list(sets)
    codes = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]))
    owner = np.zeros((len(names), len(codes)), bool)
    for i, name in enumerate(names):
        owner[i, np.searchsorted(codes, sets[name])] = True
    shared = spark.sparkContext.broadcast((names, sets, codes, owner, threshold))

    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, sets, codes, owner, threshold = shared.value
        need = np.array([threshold / (2 - threshold) * len(sets[n]) - 1e-9 for n in names])
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))
        for texts in it:
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for i, j, data, at in pieces(texts):
                code, doc, b, e = bigrams(data, at)
                if not len(code) or not len(codes):
                    continue
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = np.flatnonzero(codes[place] == code)
                pairs = np.unique(doc[hit] * len(codes) + place[hit])
                of, which = pairs // len(codes), pairs % len(codes)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                for k in np.unique(of):
                    points = None
                    shared_with = owner[:, which[of == k]].sum(1)
                    for m in np.flatnonzero(shared_with >= need):
                        mine = slice(edge[k], edge[k + 1])
                        for dice, x, y in best_passages(code[mine], sets[names[m]], threshold):
                            if points is None:
                                points = np.concatenate([[0], np.cumsum((data[at[k] : at[k + 1]] & 0xC0) != 0x80)])
                            out[i + k].append({"license": names[m], "dice": dice, "begin": int(points[b[mine][x] - at[k]]), "end": int(points[e[mine][y] - at[k]])})
            for row in out:
                row.sort(key=lambda r: (r["begin"], r["end"], r["license"]))
            yield pa.array(out, kind)

    scan.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, MATCHES)(text)
