"""License scans: passages of a text against licence templates by the Dice coefficient over word bigrams.

A text's lines are cut into sentences and normalised. A template is compared with every stretch of sentences, or of whole
lines if it has few bigrams, that begins with one that has a bigram of it and whose number of words lies within the bounds that a Dice coefficient of at least the threshold leaves.
Templates of which the whole text has too few bigrams are passed over, and a stretch with too many others is given up.
"""

from __future__ import annotations

import re
from collections import Counter
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import doc_id, keyed, lean

THRESHOLD = 0.9
MAX_TEMPLATES = 2000  # templates travel to every task; more are refused

# Public licence notices and grants, as their licences give them for use in files.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-short": "Licensed under the MIT License.",
    "mit-released": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "lgpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "agpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
}
# and whole licences, a file each
TEMPLATES |= {x.name.removesuffix(".txt") + "-text": x.read_text("utf-8") for x in resources.files("lociframe.llm").joinpath("licenses").iterdir() if x.name.endswith(".txt")}

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def normalised(line: str) -> list[str]:
    """Lower-case words without punctuation and comment marks; British spelling of licence made American."""
    return ["license" + w[7:] if w.startswith("licence") else w for w in WORD.findall(line.lower())]


SENTENCE = re.compile(r"(?<=[.;:!?])\s+")
INSIDE = 12  # bigrams from which a template is looked for inside lines too, from sentence to sentence


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold, self.templates, self.by_bigram = threshold, [], {}
        for name, text in sorted(templates.items()):
            grams = bigrams(normalised(text))
            n = sum(grams.values())
            if not n:
                continue
            # 2 min(m, n) / (m + n) >= t leaves m between these
            self.templates.append((name, grams, n, n * threshold / (2 - threshold), n * (2 - threshold) / threshold))
            for g in grams:
                self.by_bigram.setdefault(g, []).append(len(self.templates) - 1)
        self.starts = {w for g in self.by_bigram for w in g}

    def possible(self, words: list[str]) -> set[int]:
        """Templates of which a text of these words has enough bigrams."""
        shared: Counter = Counter()
        for g, m in bigrams(words).items():
            for t in self.by_bigram.get(g, ()):
                shared[t] += min(m, self.templates[t][1][g])
        return {t for t, m in shared.items() if 2 * m >= self.threshold * (self.templates[t][2] + self.templates[t][3]) - 1e-6}

    def __call__(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first line, line after the last), without overlaps: the best first, then the longest."""
        # units: the sentences of lines that have a word; the number of the line, and whether a line begins and ends with it
        units = [(no, w, k == 0, k == len(own) - 1) for no, line in enumerate(text.split("\n")) if (own := [w for part in SENTENCE.split(line) if (w := normalised(part))]) for k, w in enumerate(own)]
        possible = self.possible([w for _, own, _, _ in units for w in own])
        if not possible:
            return []
        found, grams = [], [list(zip(w, w[1:], strict=False)) for _, w, _, _ in units]
        for i, own in enumerate(grams):
            for t in sorted({t for g in own for t in self.by_bigram.get(g, ())} & possible):
                name, want, n, least, most = self.templates[t]
                if n < INSIDE and not units[i][2]:
                    continue
                have, m, same, j, last = Counter(), 0, 0, i, None
                others = n * (2 - 2 * self.threshold) / self.threshold + 1e-6  # with more, all of the template is not enough
                while j < len(units):
                    step = list(grams[j])
                    if last is not None:
                        step.append((last, units[j][1][0]))
                    m += len(step)
                    if m > most:
                        break
                    for g in step:
                        have[g] += 1
                        same += have[g] <= want[g]
                    if m - same > others:
                        break
                    last = units[j][1][-1]
                    j += 1
                    if m >= least and (n >= INSIDE or units[j - 1][3]) and 2 * same >= self.threshold * (m + n) - 1e-9:
                        found.append((2 * same / (m + n), m, name, i, j))
        out, taken = [], set()
        for d, _, name, i, j in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            if not taken & set(range(i, j)):
                taken |= set(range(i, j))
                out.append((name, round(d, 6), units[i][0], units[j - 1][0] + 1))
        return sorted(out, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of documents: doc_id, n_matches, licenses (distinct names, sorted), best_license, best_dice, matches
    (license, dice, first_line, end_line).

    Null and empty texts, and texts with no passage at the threshold, have no matches: an empty list, null best. Of
    overlapping passages the one with the highest coefficient stands; ties go to the longer, then to the first name, then
    to the earlier line. Rows that share a doc_id are scanned each; a null doc_id stays null. Other columns are ignored.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")

    def run(batches):
        scan = Scanner(templates, threshold)
        for batch in batches:
            rows = [scan(t) for t in batch.column("text").to_pylist()]
            best = [max(r, key=lambda x: (x[1], -x[2])) if r else (None, None) for r in rows]
            matches = [[dict(zip(("license", "dice", "first_line", "end_line"), x, strict=True)) for x in r] for r in rows]
            kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int64()), ("end_line", pa.int64())]))
            yield pa.record_batch([batch.column("k"), pa.array(map(len, rows), pa.int64()), pa.array([sorted({x[0] for x in r}) for r in rows], pa.list_(pa.string())), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array(matches, kind)], names=["k", "n_matches", "licenses", "best_license", "best_dice", "matches"])

    out = keyed(docs).mapInArrow(lean(run), "k long, n_matches long, licenses array<string>, best_license string, best_dice double, matches array<struct<license:string,dice:double,first_line:long,end_line:long>>")
    return out.select(doc_id(), "n_matches", "licenses", "best_license", "best_dice", "matches")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"), "best_license", "best_dice")
