"""License scans by patience alignment.

A template is aligned with a stretch of text by anchors: words that occur once in the
text's stretch and once in the template's. The longest increasing subsequence of the
anchors is kept, and the gaps between them, where more words become unique, are aligned
in the same way. A stretch's score is the share of template and text words that the
alignment covers (twice the matched words by both lengths).

Words that tell one licence from its relatives must be among the matched ones: a
notice's words with digits (versions), and those named as required. Tags of the form
``SPDX-License-Identifier: ...`` are read as they are.

No alignment covers more words than the two texts have in common, so a stretch whose
common words fall short is left out without any loss; nearly all texts are decided by
one count of template words. Templates are a table of notices and short licences; longer
ones, and other lists, come from a table that the caller reads (``read_templates``)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import require_columns
from . import words as W

COVERAGE, SCORE = 0.8, 0.85
NOTICE = 60   # words of a template whose numbers are versions
SLACK = 8     # words that a stretch may hold beyond five quarters of the template

MAX_TEMPLATE_WORDS = 5_000_000   # words of all templates that a worker holds
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_TERM = rf"\(*[ \t]*{_ID}(?:[ \t]*\))*"
_TAG = re.compile(rf"(?i:SPDX-License-Identifier:)[ \t]*({_TERM}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_TERM})*)")

# The texts of short public licences, their notices and grants, and the ids they are known by.
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.")
_BSD_THIRD = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission.")
_AS_IS = (" This software is provided by the copyright holders and contributors \"as is\" and any express or implied "
          "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a "
          "particular purpose are disclaimed.")
_GNU_GRANT = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
              "published by the Free Software Foundation")


def _full(version: str) -> str:
    return version if "." in version else version + ".0"


#: (licence, text, required words beside those with digits)
TEMPLATES = (
    ("MIT", "Released under the MIT License.", ("mit",)),
    ("MIT", "Licensed under the MIT License.", ("mit",)),
    ("MIT", _MIT, ()),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", ("apache",)),
    *((f"Apache-{v}", f"Licensed under the Apache License, Version {v}.", ("apache",)) for v in ("2.0", "1.1", "1.0")),
    # the GNU licences: a notice, the grant with "or any later version", and the grant of one version only
    *((f"{short}-{_full(v)}", f"{lead} under the GNU {long}, version {v}.", need)
      for lead in ("This work is licensed", "Licensed") for short, long, need, versions in (
          ("GPL", "General Public License", ("general",), ("1", "2", "3")),
          ("LGPL", "Lesser General Public License", ("lesser",), ("2.1", "3")),
          ("AGPL", "Affero General Public License", ("affero",), ("3",))) for v in versions),
    *((f"{short}-{_full(v)}{tail}", _GNU_GRANT.format(long) + how.format(v), need)
      for short, long, need, versions in (
          ("GPL", "General Public License", ("general",), ("2", "3")),
          ("LGPL", "Lesser General Public License", ("lesser",), ("2.1", "3")),
          ("AGPL", "Affero General Public License", ("affero",), ("3",))) for v in versions
      for tail, how in (("", ", either version {} of the License, or (at your option) any later version."),
                        ("-only", ", version {} of the License, and no later version."))),
    ("BSD-2-Clause", _BSD + _AS_IS, ()),
    ("BSD-2-Clause", _BSD, ()),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _AS_IS, ("neither", "endorse")),
    ("BSD-3-Clause", _BSD + _BSD_THIRD, ("neither", "endorse")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met", ()),
    ("BSD", "Licensed under the BSD License.", ("bsd",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ()),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
             "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
             "must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source "
             "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
             "3. This notice may not be removed or altered from any source distribution.", ("misrepresented",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
    ("CC0-1.0", "Licensed under CC0 1.0.", ("cc0",)),
    *((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.", tuple(kind.lower().split("-")))
      for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    *((f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {name} {v} {scope} License.",
       tuple(name.lower().replace("-", " ").split()))
      for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                         ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                         ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for v, scope in (("3.0", "Unported"), ("4.0", "International"))),
    ("all-rights-reserved", "All rights reserved.", ()),
)


def read_templates(table: DataFrame) -> list[tuple]:
    """Templates from a table (license, text, and optionally required array<string>), as of whole
    licence texts under a path. Null and wordless texts are left out."""
    require_columns(table, ["license", "text"], "license templates")
    need = F.coalesce("required", F.array().cast("array<string>")) if "required" in table.columns else F.array().cast("array<string>")
    rows = table.select("license", "text", need.alias("required")).where("license is not null and text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 6 * MAX_TEMPLATE_WORDS:
        raise ValueError(f"{size} characters of templates: more than workers hold")
    return [tuple(r) for r in rows.orderBy("license", "text").collect()]


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k:
            back[i] = at[k - 1]
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Ascending (text position, template position) pairs of equal words."""
    pairs = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if left[w] == 1}
        anchors = [(where[w], j) for j, w in enumerate(template[c:d], c) if right[w] == 1 and w in where]
        anchors = [anchors[i] for i in increasing([p for p, _ in anchors])]
        if not anchors:
            continue
        pairs += anchors
        edge = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edge[:-1], edge[1:])]
    return sorted(pairs)


def densest(pairs: list[tuple[int, int]], size: int) -> tuple[float, int, int, int]:
    """(score, matched, start, end) of the run of matches with the best score; of equal
    ones the first, then the shortest. The ratio 2 matched / (size + span) is raised by
    solving for the run that most exceeds the ratio found so far, a linear scan in
    integers; it settles after a few."""
    if not pairs:
        return (0.0, 0, 0, 0)
    p = np.array([x for x, _ in pairs], np.int64)
    k = np.arange(len(p))
    top, below = 2, size + 1   # a single match
    while True:
        # the gain of a run i..j is u[j] - v[i] - top * size, in units of 1 / below
        u, v = 2 * below * (k + 1) - top * (p + 1), 2 * below * k - top * p
        low = np.minimum.accumulate(v)
        gain = u - low - top * size
        if gain.max() <= 0:
            break
        j = int(gain.argmax())
        i = int(np.flatnonzero(v[:j + 1] == low[j])[0])
        top, below = 2 * (j - i + 1), size + int(p[j] - p[i]) + 1
    # the runs that reach the best ratio: the first start of any, then the first end
    best = np.maximum.accumulate(u[::-1])[::-1]
    i = int(np.flatnonzero(best - v - top * size == 0)[0])
    j = i + int(np.flatnonzero(u[i:] - v[i] - top * size == 0)[0])
    return (top / below, j - i + 1, int(p[i]), int(p[j]) + 1)


def scan_words(h: np.ndarray, which: list[int], templates) -> list[tuple[str, float, int, int]]:
    """(license, score, first word, end word) of all notices in a text's word hashes;
    of overlapping ones that with the most evidence (score times template words) stays."""
    found = []
    for t in which:
        name, words, need = templates[t]
        m = len(words)
        step, width = max(1, m // 4), m + m // 4 + SLACK
        starts = np.arange(0, max(1, len(h) - width + step), step)
        # common words of every stretch, as a multiset: an upper bound of the matches
        common = np.zeros(len(starts), np.int64)
        ends = np.minimum(starts + width, len(h))
        for w, n in Counter(words).items():
            seen = np.append(0, np.cumsum(h == np.uint64(w)))
            common += np.minimum(seen[ends] - seen[starts], n)
        for s in starts[common >= COVERAGE * m].tolist():
            pairs = align(h[s:s + width].tolist(), words)
            score, matched, a, b = densest(pairs, m)
            if score >= SCORE and matched >= COVERAGE * m and need <= {words[q] for p, q in pairs if a <= p < b}:
                found.append((name, score, s + a, s + b, m))
    out: list[tuple[str, float, int, int]] = []
    for name, score, a, b, _ in sorted(set(found), key=lambda f: (-f[1] * f[4], -f[1], f[2], f[0])):
        if all(b <= x or a >= y for _, _, x, y in out):
            out.append((name, score, a, b))
    return sorted(out, key=lambda f: f[2])


def _prepared(templates) -> list[tuple[str, list[int], set[int]]]:
    """(licence, word hashes, hashes of the words that must be matched) of each template."""
    def hashes(texts):
        row, start, length, h = W.split_words(*W.utf8(pa.array(texts, pa.string())), "alnum")
        return [h[row == i].tolist() for i in range(len(texts))]

    out = []
    texts = [t[1] for t in templates]
    for t, words in zip(templates, hashes(texts) if texts else []):
        numbers = [x for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+", t[1].translate(_LOWER)) if any(c in "0123456789" for c in x)]
        # in a notice a number is a version; that of a numbered list tells nothing
        numbers = [x for x in numbers if len(words) <= NOTICE and not re.search(rf"(?:^|[.:;] ){x}\. [A-Z]", t[1])]
        need = hashes([" ".join([*numbers, *(t[2] if len(t) > 2 else ())])])[0]
        out.append((t[0], words, set(need)))
    return out


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def tags(text: str) -> list[tuple[str, int, int]]:
    """(licence, first word, end word) of the SPDX tags of a text: every id of the tag's
    expression, without operators and exceptions."""
    out = []
    for m in _TAG.finditer(text):
        words = re.findall(_ID, m[1])
        ids = [w for k, w in enumerate(words) if w not in ("AND", "OR", "WITH")
               and not (k and words[k - 1] == "WITH")]
        first = len(_ALNUM.findall(text[:m.start()].translate(_LOWER)))
        end = first + len(_ALNUM.findall(m[0].translate(_LOWER)))
        out += [(i, first, end) for i in ids]
    return out


_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, licenses (ids in order of place), scores, span_starts
    and span_ends (word numbers). Null and empty texts, and texts without a notice, have
    empty lists; rows are independent, repeated ones too. An SPDX tag has score 1 and gives every id of its
    expression at the same place. Words are runs of [0-9a-z] and non-ASCII after lower-casing A-Z."""
    require_columns(docs, [id_col, text_col], "license scan")
    ready = [t for t in _prepared(templates) if t[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.unique(np.array([w for _, ws, _ in ready for w in ws], np.uint64))
        need = np.zeros((len(ready), len(vocabulary)), np.int64)
        for i, (_, ws, _) in enumerate(ready):
            np.add.at(need[i], np.searchsorted(vocabulary, np.array(ws, np.uint64)), 1)
        size = need.sum(axis=1)
        for b in W.chunks(batches, "text"):
            n = b.num_rows
            row, _, _, h = W.split_words(*W.utf8(b.column("text")), "alnum")
            count = np.zeros((n, len(vocabulary)), np.int64)
            if len(vocabulary) and len(h):
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[at] == h
                np.add.at(count, (row[hit], at[hit]), 1)
            where = W.ptr(row, n)
            results: list[list] = [[] for _ in range(n)]
            enough = np.stack([np.minimum(count, need[i]).sum(axis=1) >= COVERAGE * size[i]
                               for i in range(len(ready))], axis=1) if ready else np.zeros((n, 0), bool)
            for d in np.flatnonzero(enough.any(axis=1)).tolist():
                results[d] = scan_words(h[where[d]:where[d + 1]], np.flatnonzero(enough[d]).tolist(), ready)
            tagged = pc.fill_null(pc.match_substring(b.column("text"), "spdx-license-identifier:", ignore_case=True), False)
            for d in np.flatnonzero(tagged.to_numpy(zero_copy_only=False)).tolist():
                found = tags(b.column("text")[d].as_py())
                results[d] = sorted([(i, 1.0, x, y) for i, x, y in found]
                                    + [r for r in results[d] if all(r[3] <= x or r[2] >= y for _, x, y in found)],
                                    key=lambda r: (r[2], r[0]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([[x[0] for x in r] for r in results], pa.list_(pa.string())),
                 pa.array([[x[1] for x in r] for r in results], pa.list_(pa.float64())),
                 pa.array([[x[2] for x in r] for r in results], pa.list_(pa.int64())),
                 pa.array([[x[3] for x in r] for r in results], pa.list_(pa.int64()))],
                names=["doc_id", "licenses", "scores", "span_starts", "span_ends"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, licenses array<string>, scores array<double>, "
                               "span_starts array<long>, span_ends array<long>")
