"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A unit of text is any run of its words. Its bigrams and a template's, as multisets, agree to 2 * common / (sizes added). A unit can reach
the threshold t only if its size is between t / (2 - t) and (2 - t) / t of the template's, and then it has at least t / (2 - t) of the
template's bigrams: so a text that lacks each of any larger share of them is passed over at once. The version in a licence's name, where
its template states it, and what tells the GNU licences apart must stand in the unit word for word.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from importlib.resources import files

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, text_array

THRESHOLD = 0.8

# Published licence texts and notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.") for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Full texts.
TEMPLATES += [(x.name.removesuffix(".txt"), x.read_text(encoding="utf-8")) for x in sorted((files(__package__) / "licenses").iterdir(), key=lambda x: x.name)]
#: Templates of more bigrams are told by words.
LONG = 400

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams_of(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    size = a.total() + b.total()
    return 2 * (a & b).total() / size if size else 0.0


@dataclass
class Template:
    name: str
    text: str
    threshold: float
    bigrams: Counter = field(init=False)

    def __post_init__(self):
        words = words_of(self.text)
        self.bigrams = Counter(bigrams_of(words))
        self.phrases = [x for x in (version_of(self.name, words), GNU.get(self.name.split("-")[0], [])) if x]
        self.size = self.bigrams.total()
        if not self.size:
            raise ValueError("a template needs two words")
        share = self.threshold / (2 - self.threshold)
        self.least, self.most = share * self.size - 1e-9, self.size / share + 1e-9

    def telling_words(self) -> list[str]:
        """Words of which every text that reaches the threshold has one: those whose bigrams are more than may be missing, long ones first."""
        missing, out, left = self.size - self.least, [], Counter(self.bigrams)
        for word in sorted({w for b in left for w in b}, key=lambda w: (-len(w), w)):
            out.append(word)
            for bigram in [b for b in left if word in b]:
                missing -= left.pop(bigram)
            if missing < 0:
                break
        return out

    def telling(self) -> list[tuple[str, str]]:
        """Bigrams of which every text that reaches the threshold has one: the longest, up to more than the share that may be missing."""
        missing, out = self.size - self.least, []
        for bigram, n in sorted(self.bigrams.items(), key=lambda x: (-len(x[0][0]) - len(x[0][1]), x[0])):
            out.append(bigram)
            missing -= n
            if missing < 0:
                break
        return out


#: What tells the notices of these licences apart besides their versions.
GNU = {"GPL": ["gnu", "general"], "LGPL": ["gnu", "lesser"], "AGPL": ["gnu", "affero"]}
_CLAUSES = {"by", "nc", "nd", "sa", "attribution", "noncommercial", "noderivatives", "sharealike"}


def version_of(name: str, words: list[str]) -> list[str]:
    """The words that state the version at the end of a licence's name, with the word before, or all clauses before; none if the template doesn't state it."""
    if number := re.search(r"-(\d+)\.(\d+)$", name):
        for digits in (list(number.groups()), [number[1]] if number[2] == "0" else []):
            for at in range(1, len(words)):
                if digits and words[at : at + len(digits)] == digits and not words[at - 1].isdigit():
                    first = at - 1
                    while first and words[first] in _CLAUSES and words[first - 1] in _CLAUSES:
                        first -= 1
                    return words[first : at + len(digits)]
    return []


def best_units(text: str, templates: list[Template]) -> list[tuple[str, float, int, int]]:
    """For each template that some unit reaches: name, coefficient, first and last line (from 0) of its best unit; of equal ones the first, then the shortest."""
    lines, words = [], []
    for i, line in enumerate(text.split("\n")):
        own = words_of(line)
        words += own
        lines += [i] * len(own)
    codes: dict[tuple[str, str], int] = {}
    ids = np.fromiter((codes.setdefault(b, len(codes)) for b in bigrams_of(words)), dtype=np.int64, count=max(0, len(words) - 1))
    n = len(ids)
    if not n:
        return []
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, dtype=np.int64)  # of each bigram among its equals
    rank[order] = np.arange(n) - np.searchsorted(ids[order], ids[order])
    listed = list(codes)
    places: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(word, []).append(i)
    out = []
    for t in templates:
        cap = np.fromiter((t.bigrams.get(b, 0) for b in listed), dtype=np.int64, count=len(listed))
        hit = cap[ids] > 0
        if hit.sum() < t.least:
            continue
        stated = [np.array([i for i in places.get(p[0], []) if words[i : i + len(p)] == p], dtype=np.int64) for p in t.phrases]
        if not all(map(len, stated)):
            continue
        most = int(t.most)
        before = np.concatenate([[0], np.cumsum(hit)])
        reach = before[np.minimum(np.arange(n) + most, n)] - before[:-1]
        first_rank = np.zeros(len(listed), dtype=np.int64)  # how often each bigram stands before the start
        best: tuple[float, int, int] | None = None
        at = 0
        for start in np.flatnonzero(hit & (reach >= t.least)):  # a unit that starts or ends elsewhere is worse than without that bigram
            np.add.at(first_rank, ids[at:start], 1)
            at = start
            own = slice(start, min(n, start + most))
            counted = rank[own] - first_rank[ids[own]] < cap[ids[own]]
            score = 2 * np.cumsum(counted) / (np.arange(1, len(counted) + 1) + t.size)
            for p, found in zip(t.phrases, stated, strict=True):
                here = np.searchsorted(found, start)
                score[: max(0, found[here] + len(p) - 2 - start) if here < len(found) else None] = 0
            top = int(np.argmax(score >= score.max() - 1e-12))
            if score[top] >= t.threshold - 1e-9 and (best is None or score[top] > best[0] + 1e-12):
                best = (float(score[top]), lines[start], lines[start + top + 1])
        if best:
            out.append((t.name, *best))
    return out


FOUND = "doc_id bigint, license string, score double, first_line int, last_line int"


def scan_licenses(documents: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, score, first_line, last_line): for each document (doc_id, text) and licence the lines of the unit of words that is
    closest to one of its templates, where it reaches the threshold; of equal ones the first. A text that holds another licence's
    words (BSD-3-Clause those of BSD-2-Clause) has a row for each.

    Lines end at \\n and count from 0; case, punctuation and white space don't matter. Null and empty texts, and texts without such a
    unit, give no row; rows that repeat are scanned each; other columns are ignored.
    """
    known = [Template(name, text, threshold) for name, text in (TEMPLATES if templates is None else templates)]
    telling = sorted({x for t in known for x in (t.telling_words() if t.size > LONG else [f"{a}[^\\pL\\pN]+{b}" for a, b in t.telling()])})
    pattern = r"(?:^|[^\pL\pN])(?:" + "|".join(telling) + r")(?:[^\pL\pN]|$)"

    def run(batches):
        for b in slices(batches):
            texts = text_array(b.column("text"))
            near = np.flatnonzero(np.asarray(pc.match_substring_regex(pc.utf8_lower(texts), pattern))) if known else []
            rows = []
            for i in near:
                best: dict[str, tuple[float, int, int]] = {}
                for name, score, first, last in best_units(texts[i].as_py(), known):
                    if name not in best or (-score, first, last) < (-best[name][0], *best[name][1:]):
                        best[name] = (score, first, last)
                doc = b.column("doc_id")[i].as_py()
                rows += [(doc, name, *found) for name, found in sorted(best.items())]
            if rows:
                types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "license", "score", "first_line", "last_line"])

    return documents.select("doc_id", "text").mapInArrow(run, FOUND)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
