"""Licence scan: Dice coefficient over word bigrams between text segments and licence templates.

A segment is a line or a paragraph (a run of lines that hold words). Words are
compared without case and surrounding punctuation. A template with b bigrams
can reach a coefficient t only against segments of t/(2-t)*b to (2-t)/t*b
bigrams, so sizes prune templates before anything is counted, and only
segments that share a bigram with a template are looked at. Bigrams count as
often as they occur.

With `anywhere`, as in the registered query, notices are looked for among all
runs of words instead, over lines and paragraphs. A best run starts and ends on
a bigram of the template, so only runs between two of those are scored; of runs
that overlap, the one with the greatest coefficient counts for a template.

Templates come from notices and titles by rule (library) or from a table of
licence texts (read_templates).

Defined results: null or empty text has no matches; a one-word segment has no
bigram and matches nothing; ties go to the template listed first, then to the
earlier segment; repeated rows give equal results; extra columns pass through.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import textkit as tk
from millrace.llm.decontaminate import _fold, canonical

U64 = np.uint64
DICE = 0.85

#: Notices of public licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
)

#: Identifiers and titles of public licences.
TITLES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License Version 1.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License Version 2.0"),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "The Unlicense"),
)


def library(titles=TITLES, notices=TEMPLATES) -> tuple[tuple[str, str], ...]:
    """Templates by rule: the notices, then each title by itself, as an identifier line, and as what a work is under."""
    forms = ("{title}", "SPDX-License-Identifier: {name}", "licensed under the {title}")
    return notices + tuple((name, form.format(name=name, title=title)) for name, title in titles for form in forms)


def read_templates(table: DataFrame, most: int = 10_000) -> tuple[tuple[str, str], ...]:
    """Templates from a table (license, text), whole licence texts among them; more than `most` rows are an error, as every task holds them."""
    rows = table.select("license", "text").filter("license IS NOT NULL AND text IS NOT NULL").orderBy("license", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} licence templates")
    return tuple((r[0], r[1]) for r in rows)


class Templates:
    """Bigram multisets of the templates, merged into one sorted array."""

    def __init__(self, templates):
        self.names = [name for name, _ in templates]
        offsets, data = tk.column_bytes(pa.array([text for _, text in templates], pa.string()))
        _, literal, _, first = canonical(offsets, data)
        grams, owner = _bigrams(literal, np.repeat(np.arange(len(templates)), np.diff(first)))
        self.size = np.bincount(owner, minlength=len(templates))
        pairs, self.count = np.unique(np.stack([grams, owner.astype(U64)], 1), axis=0, return_counts=True)
        self.gram, self.owner = pairs[:, 0], pairs[:, 1].astype(np.int64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.gram >> U64(48)).astype(np.int64)] = True


def _bigrams(literal: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(literal) < 2:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = segment[1:] == segment[:-1]
    grams = tk.mix(literal[:-1] * U64(0xD6E8FEB86659FD93) + literal[1:])
    return grams[inside], segment[:-1][inside]


def _segments(offsets: np.ndarray, data: np.ndarray, breaks: np.ndarray):
    """Literals of words with the segment each lies in, under segment ends at `breaks` and at text ends."""
    cuts = np.unique(np.concatenate([offsets, breaks]))
    _, literal, _, first = canonical(cuts, data)
    return literal, np.repeat(np.arange(len(cuts) - 1), np.diff(first)), cuts


def scan_block(t: Templates, offsets: np.ndarray, data: np.ndarray, dice: float) -> list[tuple[int, int, int, int, float]]:
    """(text, template, start byte, end byte, coefficient) of every segment that reaches dice."""
    newline = np.flatnonzero(data == 10)
    blank = newline[:-1][_blank_between(data, newline)] + 1 if len(newline) > 1 else np.zeros(0, np.int64)
    out: dict[tuple[int, int, int], tuple] = {}
    for breaks in (newline + 1, blank):
        literal, segment, cuts = _segments(offsets, data, breaks)
        grams, owner = _bigrams(literal, segment)
        size = np.bincount(owner, minlength=len(cuts) - 1)
        near = np.flatnonzero(t.seen[(grams >> U64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(t.gram, grams[near], "left"), np.searchsorted(t.gram, grams[near], "right")
        n = hi - lo
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        seg, tpl = np.repeat(owner[near], n), t.owner[row]
        ok = (size[seg] * (2 - dice) >= dice * t.size[tpl]) & (dice * size[seg] <= (2 - dice) * t.size[tpl])
        if not ok.any():
            continue
        triples, count = np.unique(np.stack([seg[ok], tpl[ok], row[ok]], 1), axis=0, return_counts=True)
        shared = np.minimum(count, t.count[triples[:, 2]])
        pair, at = np.unique(triples[:, :2], axis=0, return_inverse=True)
        total = np.bincount(at.ravel(), shared)
        score = 2 * total / (size[pair[:, 0]] + t.size[pair[:, 1]])
        for (s, k), v in zip(pair[score >= dice], score[score >= dice]):
            text = int(np.searchsorted(offsets, cuts[s], "right")) - 1
            out[text, int(k), int(cuts[s])] = (text, int(k), int(cuts[s] - offsets[text]), int(cuts[s + 1] - offsets[text]), float(v))
    return sorted(out.values())


def scan_windows(t: Templates, offsets: np.ndarray, data: np.ndarray, dice: float) -> list[tuple[int, int, int, int, float]]:
    """(text, template, start byte, end byte, coefficient) of the runs of words anywhere that reach dice, the best of those that overlap."""
    begin, end, first = tk.core_words(offsets, data)
    literal = tk.span_hash(tk.prefix_hash(_fold(data)), begin, end)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(literal) < 2:
        return []
    grams = tk.mix(literal[:-1] * U64(0xD6E8FEB86659FD93) + literal[1:])
    near = np.flatnonzero(t.seen[(grams >> U64(48)).astype(np.int64)] & (text[1:] == text[:-1]))
    lo, hi = np.searchsorted(t.gram, grams[near], "left"), np.searchsorted(t.gram, grams[near], "right")
    n = hi - lo
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    word, tpl = np.repeat(near, n), t.owner[row]
    out = []
    for k in np.unique(tpl):
        mine = tpl == k
        at, gram, size = word[mine], row[mine], int(t.size[k])
        need, longest = -int((1e-9 - dice * size / (2 - dice)) // 1), int((2 - dice) * size / dice + 1e-9)
        if need > len(at):
            continue
        # only where enough shared bigrams lie close together
        head = np.flatnonzero((at[need - 1 :] - at[: len(at) - need + 1] < longest) & (text[at[need - 1 :]] == text[at[: len(at) - need + 1]]))
        found = []
        for i in head.tolist():
            seen, shared = {}, 0
            for j in range(i, min(len(at), i + longest)):
                length = int(at[j] - at[i]) + 1
                if length > longest or text[at[j]] != text[at[i]]:
                    break
                g = int(gram[j])
                seen[g] = seen.get(g, 0) + 1
                shared += seen[g] <= t.count[g]
                if 2 * shared >= dice * (length + size):
                    found.append((-2 * shared / (length + size), int(at[i]), int(at[j]) + 1))
        taken: list[tuple[int, int]] = []
        for score, a, b in sorted(found):
            at_place = bisect.bisect(taken, (a, b))
            if (at_place == 0 or taken[at_place - 1][1] < a) and (at_place == len(taken) or taken[at_place][0] > b):
                taken.insert(at_place, (a, b))
                i = int(text[a])
                out.append((i, int(k), int(begin[a] - offsets[i]), int(end[b] - offsets[i]), -score))
    return sorted(out)


def _blank_between(data: np.ndarray, newline: np.ndarray) -> np.ndarray:
    """Whether a newline is followed by another with blanks only between."""
    ink = np.concatenate([[0], np.cumsum(~tk.IS_SPACE[data])])
    return ink[newline[1:]] == ink[newline[:-1]]


def scan(docs: DataFrame, templates=TEMPLATES, dice: float = DICE, text_col: str = "text", anywhere: bool = False) -> DataFrame:
    """docs with license_matches added: array of (license, template, start, end, dice), by place, of lines and paragraphs or of runs of words anywhere; a column of docs with this name is replaced."""
    docs = docs.drop("license_matches")
    kind = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("dice", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("dice", pa.float64())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("license_matches", kind)])
    at = docs.columns.index(text_col)

    def run(batches):
        t = Templates(templates)
        for b in batches:
            found = [[] for _ in range(b.num_rows)]
            for lo, _, offsets, data in tk.blocks(b.column(at)):
                for text, k, start, end, v in (scan_windows if anywhere else scan_block)(t, offsets, data, dice):
                    found[lo + text].append({"license": t.names[k], "template": k, "start": start, "end": end, "dice": v})
            for x in found:
                x.sort(key=lambda m: (m["start"], m["template"]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, arrow)], names=[*b.schema.names, "license_matches"])

    return docs.mapInArrow(tk.tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = F.col("license_matches")
    best = F.get(F.array_sort(F.transform(m, lambda x: F.struct((-x["dice"]).alias("d"), x["template"].alias("t"), x["start"].alias("s"), x["license"].alias("l")))), F.lit(0))
    return scan(docs, library(), anywhere=True).select(
        "doc_id",
        F.size(m).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"]))), ",").alias("licenses"),
        best["l"].alias("best_license"),
        F.round(-best["d"], 6).alias("best_dice"),
    )
