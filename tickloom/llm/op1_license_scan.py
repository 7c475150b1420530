"""License scan: MinHash bands over overlapping windows retrieve license templates, exact containment confirms.

A text is a sequence of 5-word shingles.  Templates are grouped by length; a group whose longest
template has n shingles is looked for in windows of 3 n shingles that start every n / 2, so an
occurrence lies in one window even with insertions of up to 1.5 n shingles in all.  Each MinHash
value is a band of one row, BANDS bands: with at least CONTAINMENT of a template in a window their
similarity is at least 0.17 (0.8 / 1.5 over 3 + 0.2 / 1.5), and all bands miss with probability
(1 - 0.17) ** 80 < 1e-6.  A retrieved template is confirmed if the window has CONTAINMENT of its
shingles exactly.  Windows without a shingle of any template can't match a band and are passed over.

Defined cases: null and empty texts have no match; a template is reported once a text however
often it occurs, with its number of matching windows; rows are judged one by one, so repeated rows
and null ids give a row each; a template of fewer words than a shingle has is an error; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.tables import table
from tickloom.llm.textarrays import SpanHasher, Words, lower_table, separator_table, shingle_hashes, slices, text_buffer

SHINGLE, BANDS, CONTAINMENT = 5, 80, 0.8
#: Templates of one group differ in length by this factor at most.
SPREAD = 1.5

# fixed values: public license notices
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "BSD-3-Clause-third": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "CC0-notice": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.lower, self.sep, self.hasher = lower_table(), separator_table("alnum"), SpanHasher()
        rng = np.random.Generator(np.random.PCG64(17))
        self.a = rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
        self.names = list(templates)
        text = pa.array(list(templates.values()), pa.string())
        self.sets = [np.unique(h) for h in self.rows(text)]
        if short := [n for n, own in zip(self.names, self.sets, strict=True) if not len(own)]:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.low = np.array([self.minhash(s) for s in self.sets])
        self.groups: list[tuple[int, list[int]]] = []
        for i in sorted(range(len(self.sets)), key=lambda i: -len(self.sets[i])):
            if self.groups and len(self.sets[i]) * SPREAD >= self.groups[-1][0]:
                self.groups[-1][1].append(i)
            elif len(self.sets[i]):
                self.groups.append((len(self.sets[i]), [i]))

    def minhash(self, h: np.ndarray) -> np.ndarray:
        return (h[:, None] * self.a + self.b).min(axis=0)

    def rows(self, column):
        """Shingle hashes of each row in order, and none for rows of fewer words than a shingle has."""
        data, offsets = text_buffer(column)
        for a, b in slices(offsets):
            part, off = self.lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            words = Words(part, off, self.sep)
            hashes = self.hasher(part, words.starts, words.ends)
            for r in range(b - a):
                h = hashes[words.bounds[r] : words.bounds[r + 1]]
                yield shingle_hashes(h, SHINGLE) if len(h) >= SHINGLE else h[:0]

    def scan(self, h: np.ndarray) -> dict[str, int]:
        """Template to its number of matching windows."""
        found: dict[str, int] = {}
        if not len(self.known) or not len(h):
            return found
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == h)
        if not len(hits):
            return found
        for n, members in self.groups:
            step = max(1, n // 2)
            # the windows that start every step and have one of the hits
            first, last = np.maximum(0, -((3 * n - 1 - hits) // step)), hits // step
            for s in np.unique(np.concatenate([np.arange(i, j + 1) for i, j in zip(first, last, strict=True)])) * step:
                window = np.unique(h[s : s + 3 * n])
                low = self.minhash(window)
                for i in members:
                    if (self.low[i] == low).any() and len(np.intersect1d(window, self.sets[i], assume_unique=True)) >= CONTAINMENT * len(self.sets[i]):
                        found[self.names[i]] = found.get(self.names[i], 0) + 1
        return found


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses array<struct<name, windows>>) of each row, by name.  No shuffle."""
    templates = TEMPLATES if templates is None else templates
    Scanner(templates)  # a template that can't be looked for is an error here, not in a task
    kind = pa.list_(pa.struct([("name", pa.string()), ("windows", pa.int32())]))

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            found = [[{"name": k, "windows": v} for k, v in sorted(scanner.scan(h).items())] for h in scanner.rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [id_col, "licenses"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` long, licenses array<struct<name:string,windows:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda s: s["name"]), ",").alias("licenses"))


QUERIES = {"op1_license_scan": query}
ORACLE_SQL: dict[str, str] = {}
