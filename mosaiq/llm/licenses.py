"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

A text is normalised to lower-case words of letters and digits. For each template the passages that begin at
one of its bigrams are compared with it; passages of the whole text are looked at, so a notice is found on a
line of its own and inside prose alike, and a text that is a licence is found whole. Size bounds prune templates
before any comparison: Dice >= t needs t/(2-t) of the template's bigrams in the text.

A null text is empty and matches nothing. A template of one word has no bigram and matches nothing. Passages of a template
do not overlap. Ties take the earliest passage, then the shortest. Repeated rows are kept, an empty table gives no rows, and only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.textutil import documents, map_batches, small_batches, texts

THRESHOLD = 0.8
WORD = re.compile(r"[a-z0-9]+")

#: Public licence notices and short licence texts; ``license_texts`` holds the long ones.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause-notice": "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file.",
}


def full_texts() -> dict[str, str]:
    """``<name>-full``: whole licence texts, kept as files beside this module."""
    return {f"{p.stem}-full": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def normalised(text: str) -> list[str]:
    return WORD.findall(text.lower())


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class LicenseScanner:
    def __init__(self, templates: dict[str, str] | None = None, threshold: float = THRESHOLD):
        self.threshold, self.templates, self.owners = threshold, {}, defaultdict(list)
        sizes = {}
        for name, text in (TEMPLATES | full_texts() if templates is None else templates).items():
            words = normalised(text)
            if grams := set(zip(words, words[1:])):
                self.templates[name] = grams
                sizes[name] = len(words) - 1
                for g in grams:
                    self.owners[g].append(name)
        self.least = {name: threshold * len(g) / (2 - threshold) for name, g in self.templates.items()}
        self.most = {name: int(n * (2 - threshold) / threshold) for name, n in sizes.items()}  # of bigrams with repeats
        self.vocabulary = {w for g in self.owners for w in g}

    def _best(self, words: list[str], name: str, at: list[int]) -> tuple[int, int, float] | None:
        grams, most, best = self.templates[name], self.most[name], None
        counts, last = defaultdict(int), 0  # how often the template's bigrams are in reach of the start
        for i, start in enumerate(at):
            if i:
                g = (words[at[i - 1]], words[at[i - 1] + 1])
                counts[g] -= 1
                if not counts[g]:
                    del counts[g]
            while last < len(at) and at[last] < start + most:  # beyond it a passage is too long
                counts[words[at[last]], words[at[last] + 1]] += 1
                last += 1
            n = len(counts)
            if n < self.least[name] or (best and 2 * n / (n + len(grams)) <= best[2]):
                continue
            inside, shared, end = set(), 0, start
            for stop in at[i:last]:
                for k in range(end, stop + 1):
                    g = (words[k], words[k + 1])
                    if g not in inside:
                        inside.add(g)
                        shared += g in grams
                end = stop + 1
                score = 2 * shared / (len(inside) + len(grams))
                if score >= self.threshold and (best is None or score > best[2]):
                    best = (start, stop + 2, score)
            if best and best[2] == 1:
                break
        return best

    def _passages(self, words: list[str], name: str, at: list[int]) -> list[tuple[int, int, float]]:
        out, cuts = [], [0, *[k for k in range(1, len(at)) if at[k] - at[k - 1] >= self.most[name]], len(at)]
        parts = list(zip(cuts, cuts[1:]))
        while parts:
            lo, hi = parts.pop()
            if hi - lo >= self.least[name] and (best := self._best(words, name, at[lo:hi])):
                out.append(best)
                parts += [(lo, bisect_left(at, best[0] - 1, lo, hi)), (bisect_left(at, best[1], lo, hi), hi)]
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, Dice) of the passages of each template that reach the threshold: the best, then the best before and after it, and so on."""
        words = normalised(text)
        hits, owners, vocabulary = defaultdict(list), self.owners, self.vocabulary
        if len(vocabulary.intersection(words)) < 2:
            return []
        for k, g in enumerate(zip(words, words[1:])):
            if g in owners:
                for name in owners[g]:
                    hits[name].append(k)
        out = []
        for name, at in hits.items():
            if len(at) < self.least[name] or len(words) - 1 < self.least[name]:
                continue
            out += [(name, *x) for x in self._passages(words, name, at)]
        return sorted(out, key=lambda x: (x[1], x[0]))


def nearest(found: list[tuple[str, int, int, float]], threshold: float) -> list[tuple[str, int, int, float]]:
    """Passages without those that lie in the same place (Dice of the words ``threshold`` or more) as a better one of another template."""

    def same(x: tuple, y: tuple) -> bool:
        return 2 * (min(x[2], y[2]) - max(x[1], y[1])) >= threshold * (x[2] - x[1] + y[2] - y[1])

    return [x for x in found if not any(y[3] > x[3] and same(x, y) for y in found)]


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_licenses, licenses, best_dice, spans`` of every row: the licences once each; spans are name:first word:end word of the normalised words."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scanners: list[LicenseScanner] = []
    templates = TEMPLATES | full_texts() if templates is None else templates

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scanners:
            scanners.append(LicenseScanner(templates, threshold))
        found = [nearest(scanners[0].scan(x), threshold) for x in texts(batch.column(1))]
        cols = [
            pa.array([len({x[0] for x in f}) for f in found], pa.int64()),
            pa.array([",".join(sorted({x[0] for x in f})) for f in found], pa.string()),
            pa.array([max((x[3] for x in f), default=0.0) for f in found], pa.float64()),
            pa.array([",".join(f"{n}:{a}:{b}" for n, a, b, _ in f) for f in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_licenses", "licenses", "best_dice", "spans"])

    return map_batches(source, find, f"id {source.schema['id'].dataType.simpleString()}, n_licenses bigint, licenses string, best_dice double, spans string")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
