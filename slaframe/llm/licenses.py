"""License scans by patience alignment.

Texts and templates are sequences of lower-cased alphanumeric words. A
document that holds enough of a template's distinct words is looked at near
the template's rarest word in it: around each cluster of its occurrences a
window is aligned with the template; where the window holds a seed more often
than the template does, so are the windows of each occurrence, between its
neighbours and by its place in the template. The alignment anchors on words that are
unique in both, keeps the longest increasing subsequence of anchors, and goes
on inside the gaps; equal words at the ends of a gap match as they stand.
Coverage is the share of the template's words that are aligned.

A narrow map over whole texts; templates are a bounded parameter.

Defined cases: null and empty texts have no matches; a template that occurs
several times is reported once, where coverage is best (at ties the shortest
span, then the first);
a match inside
the span of one that aligns more words is left out; null ids and repeated rows
are scanned each. Columns other than id and text
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

COVERAGE = 0.8
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:")
_MIT_REST = (" The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
             "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
             "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
             "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
             "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
             "OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. ")
_BSD_NAME = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission. ")
_BSD_REST = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
             "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
             "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
             "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
             "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
             "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
             "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
             "DAMAGE.")
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives",
      "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
      "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
#: Customary license notices, headers and short license texts.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-permission": _MIT,
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    **{f"cc-{k}-4.0": f"Licensed under CC {k.upper()} 4.0." for k in CC},
    **{f"cc-{k}-4.0-notice": f"This work is licensed under a Creative Commons {name} 4.0 International License."
       for k, name in CC.items()},
    "mit-text": _MIT + _MIT_REST,
    "bsd-2-clause": _BSD + _BSD_REST,
    "bsd-3-clause": _BSD + _BSD_NAME + _BSD_REST,
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                         "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                         "specific language governing permissions and limitations under the License.",
    **{f"gpl-{v}.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                            "General Public License as published by the Free Software Foundation, either version "
                            f"{v} of the License, or (at your option) any later version. This program is distributed in the "
                            "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
                            "more details." for v in (2, 3)},
}
_WORD = re.compile(r"[^\W_]+")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (i, j), sorted by i, whose j increase."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        tails[p:p + 1], at[p:p + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        once_a, once_b = Counter(a[i:i2]), Counter(b[j:j2])
        where = {w: k for k, w in enumerate(b[j:j2], j) if once_b[w] == 1}
        anchors = _rising([(k, where[w]) for k, w in enumerate(a[i:i2], i) if once_a[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        for (x, y), (x2, y2) in zip([(i - 1, j - 1), *anchors], [*anchors, (i2, j2)]):
            todo.append((x + 1, x2, y + 1, y2))
    return sorted(out)


def scan(words: list[str], template: list[str], least: float = COVERAGE) -> tuple[float, int, int] | None:
    """Best coverage of the template in a text, and the words it spans."""
    need = set(template)
    places: dict[str, list[int]] = {w: [] for w in need}
    for k, w in enumerate(words):
        if w in places:
            places[w].append(k)
    here = {w: p for w, p in places.items() if p}
    missing = sum(n for w, n in Counter(template).items() if w not in here)
    if not here or len(template) - missing < least * len(template):
        return None
    # Words that a match may miss can be absent at any place: look near the
    # rarest words until one more cannot be missed.
    slack = int((1 - least) * len(template) + 1e-9) - missing
    seeds = sorted(here, key=lambda w: (len(here[w]), w))[:max(1, slack + 1)]
    reach = 2 * len(template)
    spare = int((1 - least) * len(template)) + 1
    found: list[tuple[float, int, int]] = []
    offsets: dict[str, list[int]] = {w: [] for w in seeds}
    for k, w in enumerate(template):
        if w in offsets:
            offsets[w].append(k)
    spots = sorted({k for w in seeds for k in here[w]})
    lo = 0
    while lo < len(spots):
        hi = lo
        while hi + 1 < len(spots) and spots[hi + 1] - spots[hi] <= len(template) // 2 and spots[hi + 1] - spots[lo] <= reach:
            hi += 1
        begin, end = max(0, spots[lo] - reach), min(len(words), spots[hi] + reach + 1)
        windows = {(begin, end)}
        for w in seeds:  # repeats hide anchors: also look at each copy
            near = here[w][bisect_left(here[w], begin):bisect_left(here[w], end)]
            if len(near) <= len(offsets[w]):
                continue
            for n, k in enumerate(near):
                if spots[lo] <= k <= spots[hi]:
                    windows.add((near[n - 1] + 1 if n else begin, near[n + 1] if n + 1 < len(near) else end))
                    for at in (k - o for o in offsets[w]):
                        for room in (0, spare):
                            windows.add((max(begin, at - room), min(end, at + len(template) + room)))
        for x, y in windows:
            got = align(words[x:y], template)
            cover = len(got) / len(template)
            if got and cover >= least:
                found.append((cover, x + got[0][0], x + got[-1][0] + 1))
        lo = hi + 1
    return min(found, key=lambda f: (-f[0], f[2] - f[1], f[1]), default=None)


def outermost(hits: list[dict], size: dict[str, int]) -> list[dict]:
    """Without the hits inside the span of one that aligns more words, or as
    many at a better coverage: a notice is not also a lesser one it contains."""
    def rank(h: dict) -> tuple[int, float]:
        return round(h["coverage"] * size[h["template"]]), h["coverage"]

    return [h for h in hits if not any(
        o["start"] <= h["start"] and h["end"] <= o["end"] and rank(o) > rank(h) for o in hits)]


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_words, matches array<struct<template, coverage, start, end>>
    (words), and the best covered template of each document."""
    known = [(name, word_list(t), set(word_list(t))) for name, t in sorted(templates.items())]
    size = {name: len(t) for name, t, _ in known}
    kind = docs.schema[id_col].dataType.simpleString()
    row = "struct<template: string, coverage: double, start: long, end: long>"
    item = pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found, best = [], [], []
            for text in b.column(1).to_pylist():
                words = word_list(text or "")
                have = set(words)
                hits = []
                for name, t, need in known:
                    if t and sum(w in have for w in need) >= least * len(t) - (len(t) - len(need)):
                        got = scan(words, t, least)
                        if got:
                            hits.append({"template": name, "coverage": got[0], "start": got[1], "end": got[2]})
                hits = outermost(hits, size)
                sizes.append(len(words))
                found.append(hits)
                top = max(hits, key=lambda h: (h["coverage"], size[h["template"]]), default=None)
                best.append(top["template"] if top else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(item)),
                                              pa.array(best, pa.string())], names=["doc_id", "n_words", "matches", "license"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"doc_id {kind}, n_words long, matches array<{row}>, license string")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
