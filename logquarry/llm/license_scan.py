"""License scan by patience alignment (operator 1).

Text and template are compared word by word: words that stand once in both are anchors,
the longest run of anchors in the same order is kept, and the gaps between them are
aligned in the same way, where other words are now unique. Equal words at both ends of a
gap are taken first. Coverage is the number of aligned words over the template's words and
the words of the text that stand between aligned ones without being aligned.

A text is aligned window by window. A match of coverage c spans at most len(template) / c
words, so windows of that length hold every match whole. Windows without enough telling words
(not among the most common ones), or with too few of a template's words to reach the
coverage, are not aligned; both bounds are exact. So a notice that stands twice is found
twice, also without a word between, and one that other words interrupt is found whole.

Words are ASCII letters and digits in lower case, and non-ASCII characters. Nulls: a null
text, or one without words, has no licence. Of templates with equal coverage the longer
one wins, then the one named first. Rows are scanned one by one.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import map_texts, query, table
from logquarry.llm.words import NOT_ALNUM, words

LEAST_COVERAGE = 0.8

# Notices as their licences word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."),
    "BSD notice": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "Released under CC0 1.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International "
        "License."),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "AGPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Affero General Public License for more details."),
    "LGPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Words of templates that any English text has.
COMMON = ("a above all an and any are as at be but by can code do either even following for form free if in is it "
          "later list more must not of on one or other option see terms that the this to under use was will with "
          "without work you").split()


def codes_of(text: str) -> np.ndarray:
    found = list(words(pa.array([text]), NOT_ALNUM, lower=True))
    return found[0].code if found else np.zeros(0, np.uint64)


class Template:
    def __init__(self, name: str, text: str, common: set[int]):
        self.name, self.codes = name, codes_of(text).tolist()
        self.count = Counter(self.codes)
        self.telling = set(self.codes) - common


def templates(texts: dict[str, str]) -> list[Template]:
    """Those with a word; one of common words only is told by all its words."""
    common = set(codes_of(" ".join(COMMON)).tolist())
    found = [Template(n, t, common) for n, t in sorted(texts.items())]
    for t in found:
        t.telling = t.telling or set(t.codes)
    return [t for t in found if t.codes]


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run (patience piles)."""
    tops, top_place, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            top_place.append(i)
        else:
            tops[pile], top_place[pile] = v, i
        before[i] = top_place[pile - 1] if pile else -1
    out, i = [], top_place[-1] if top_place else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text, template) places, ascending in both."""
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {template[j]: j for j in range(c, d) if there[template[j]] == 1}
        anchors = [(i, place[text[i]]) for i in range(a, b) if here[text[i]] == 1 and text[i] in place]
        chain = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        pairs += chain
        if chain:
            edges = [(a - 1, c - 1), *chain, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


def starts(hits: np.ndarray, t: Template, size: int, width: int, needed: int) -> list[tuple[int, int]]:
    """Ranges of the first words of windows that hold enough of the template's telling words."""
    common = len(t.codes) - sum(n for c, n in t.count.items() if c in t.telling)
    least = max(1, needed - common)
    if len(hits) < least:
        return []
    first, last = hits[:len(hits) - least + 1], hits[least - 1:]
    near = last - first < width
    out: list[list[int]] = []
    for a, b in zip(np.maximum(last[near] - width + 1, 0).tolist(), (first[near] + 1).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def tightest(pairs: list[tuple[int, int]], length: int) -> tuple[float, int, int, int]:
    """(coverage, first word, last word + 1, aligned) of the run of pairs with the best
    coverage. Found by steps that each take the run that gains most over the ratio at hand;
    when none gains, the ratio is the best of all runs."""
    def share(i: int, j: int) -> float:
        return (j - i + 1) / (length + pairs[j][0] - pairs[i][0] - (j - i))
    first, last = 0, len(pairs) - 1
    while True:
        best = share(first, last)
        low, low_at, top = math.inf, 0, (-math.inf, 0, 0)
        for k, (p, _) in enumerate(pairs):
            x = k + best * (k - p)
            if x < low:
                low, low_at = x, k
            top = max(top, (x - low, -low_at, -k))
        if share(-top[1], -top[2]) <= best:
            return best, pairs[first][0], pairs[last][0] + 1, last - first + 1
        first, last = -top[1], -top[2]


def scan_text(text: list[int], hits: list[int], known: list[Template], least: float) -> list[tuple]:
    """(coverage, name, first word, last word + 1, aligned) of all notices in a text, best
    first; where notices overlap the best of them."""
    found = set()
    for t in known:
        length = len(t.codes)
        width, needed = int(length / least + 1e-9), math.ceil(least * length - 1e-9)
        mine = np.array([p for p in hits if text[p] in t.telling], dtype=np.int64)
        whole = 0               # end of the last match of full coverage: none inside it is better
        for a, b in starts(mine, t, len(text), width, needed):
            held = Counter(c for c in text[a:a + width] if c in t.count)
            possible = sum(min(n, t.count[c]) for c, n in held.items())
            for s in range(a, b):
                c = text[s]
                if s >= whole and possible >= needed and c in t.count:
                    pairs = align(text[s:s + width], t.codes)
                    if len(pairs) >= needed:
                        coverage, first, end, n = tightest(pairs, length)
                        if coverage >= least:
                            found.add((coverage, t.name, s + first, s + end, n))
                        if coverage == 1.0:
                            whole = s + end
                if c in t.count:                # leaves the window
                    possible -= held[c] <= t.count[c]
                    held[c] -= 1
                e = text[s + width] if s + width < len(text) else None
                if e in t.count:                # enters it
                    held[e] += 1
                    possible += held[e] <= t.count[e]
    size = {t.name: len(t.codes) for t in known}
    apart: list[tuple] = []
    taken: list[tuple[int, int]] = []           # spans of the matches that stay, ascending
    for f in sorted(found, key=lambda f: (-f[0], -size[f[1]], f[1], f[2], f[3])):
        k = bisect_left(taken, (f[2], f[2]))
        if (not k or taken[k - 1][1] <= f[2]) and (k == len(taken) or taken[k][0] >= f[3]):
            taken.insert(k, (f[2], f[3]))
            apart.append(f)
    return apart


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, matches (array of coverage, license, start, end, aligned; best first) per row."""
    known = templates(texts)
    telling = np.array(sorted(set().union(*[t.telling for t in known])) if known else [], dtype=np.uint64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    match = pa.struct([("coverage", pa.float64()), ("license", pa.string()), ("start", pa.int64()),
                       ("end", pa.int64()), ("aligned", pa.int64())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for w in words(batch.column(1), NOT_ALNUM, lower=True):
            spot = np.flatnonzero(np.isin(w.code, telling))
            for r in np.unique(w.row[spot]).tolist():
                low, high = int(w.bounds[r]), int(w.bounds[r + 1])
                hits = (spot[np.searchsorted(spot, low):np.searchsorted(spot, high)] - low).tolist()
                rows[w.first + r] = [dict(zip(("coverage", "license", "start", "end", "aligned"), f, strict=True))
                                     for f in scan_text(w.code[low:high].tolist(), hits, known, least)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(match))], names=["doc_id", "matches"])
    return map_texts(docs, ["doc_id", "text"], run, f"doc_id {kind}, matches array<struct<coverage:double,"
                     "license:string,start:long,end:long,aligned:long>>")


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best licence notice of every document, where it stands, and how many there are."""
    best = F.get("matches", F.lit(0))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", best["license"].alias("license"), best["coverage"].alias("coverage"),
        best["start"].alias("first_word"), best["end"].alias("end_word"),
        F.size(F.array_distinct("matches.license")).cast("long").alias("n_licenses"),
        F.size("matches").cast("long").alias("n_matches"))
