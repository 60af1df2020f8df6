"""License scans by Dice coefficient over word bigrams (operator 9).

Notices are looked for as windows of consecutive words anywhere in a text,
over line ends or within a line.  A window of n bigrams can reach a Dice
coefficient of t with a template of b only if t / (2 - t) <= n / b <= (2 - t) / t
and if enough of its bigrams are the template's; on Arrow's flat buffers all
places without that many such bigrams close together are pruned, template by
template.  At what is left, windows grow bigram by bigram from each start with
running counts, and the best ones that do not overlap are kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softcluster.llm import words as W

#: Notices and grants of common licenses, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bigrams(text: str) -> np.ndarray:
    """Hashes of a text's word bigrams."""
    _, _, data, offsets = next(W.chunks(pa.array([text])))
    data = W.LOWER[data]
    starts, ends, _ = W.spans(data, offsets, W.ALNUM)
    return W.shingles(W.checked_hashes(data, starts, ends), 2)


class Template:
    """A notice's bigram counts, and what a window needs to reach the threshold."""

    def __init__(self, name: str, text: str, threshold: float):
        self.name, self.counts = name, Counter(bigrams(text).tolist())
        self.size, self.threshold = self.counts.total(), threshold
        if not self.size:
            raise ValueError(f"a template has two words at least: {text!r}")
        self.known = np.sort(np.array(list(self.counts), np.uint64))
        self.most = int(np.floor(self.size * (2 - threshold) / threshold + 1e-9))
        least = int(np.ceil(self.size * threshold / (2 - threshold) - 1e-9))
        self.shared = max(1, int(np.ceil(threshold * (least + self.size) / 2 - 1e-9)))

    def windows(self, grams: np.ndarray, place: np.ndarray):
        """(first place, bigrams, Dice, shared) of the windows that begin and end
        with a bigram of the template and reach the threshold; ``place`` rises."""
        mine = _in(grams, self.known)
        grams, place = grams[mine], place[mine]
        ahead = place[self.shared - 1:] - place[:max(0, len(place) - self.shared + 1)]
        grams, at = grams.tolist(), place.tolist()
        for i in np.flatnonzero(ahead < self.most).tolist():
            seen, shared = Counter(), 0
            for j in range(i, len(at)):
                n = at[j] - at[i] + 1
                if n > self.most:
                    break
                seen[grams[j]] += 1
                shared += seen[grams[j]] <= self.counts[grams[j]]
                if 2 * shared >= self.threshold * (n + self.size) - 1e-9:
                    yield at[i], n, 2 * shared / (n + self.size), shared


def _best(windows: dict) -> list[tuple[int, int, float, str]]:
    """(first word, bigrams, Dice, license) of the windows kept, by place.

    The largest coefficient first, then the most shared bigrams, the first
    place and the shortest; one that has a word of a kept one is left out.
    ``windows``: (first word, bigrams) -> [(Dice, shared, license)].
    """
    order = []
    for (a, n), found in windows.items():
        dice = max(x[0] for x in found)
        tied = [x for x in found if x[0] == dice]
        order.append((-dice, -max(x[1] for x in tied), a, n, "|".join(sorted({x[2] for x in tied}))))
    kept: list = []
    for dice, _, a, n, name in sorted(order):
        i = bisect_left(kept, (a,))
        if (i == 0 or kept[i - 1][0] + kept[i - 1][1] < a) and (i == len(kept) or kept[i][0] > a + n):
            insort(kept, (a, n, -dice, name))
    return kept


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per notice found: doc_id, first_word, n_words, first_line,
    n_lines (words and lines from 0, lines as \\n ends them), license, dice.

    A notice is a window that reaches the threshold with a template, the best
    of those that overlap.  Its license is that of the template of the largest
    coefficient; where templates of several licenses tie, as for a notice
    without its version, all of them, joined by |.  Bigrams are counted with
    repeats; words are lower-case runs of letters, digits and anything beyond
    ASCII.  Null and blank texts have no notices; repeated rows each give
    their rows; further columns of docs are ignored.
    """
    wanted = [Template(name, text, threshold) for name, text in templates]
    vocabulary = np.unique(np.concatenate([t.known for t in wanted]))
    gap = max(t.most for t in wanted) + 2  # between rows, so that no window spans two
    doc_type = docs.select("doc_id").schema["doc_id"]
    schema = T.StructType([doc_type, *T.DataType.fromDDL(
        "first_word long, n_words long, first_line long, n_lines long, license string, dice double").fields])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(1)):
                data = W.LOWER[data]
                starts, ends, first = W.spans(data, offsets, W.ALNUM)
                rows = np.repeat(np.arange(hi - lo), np.diff(first))
                grams = W.shingles(W.checked_hashes(data, starts, ends), 2)
                at = np.flatnonzero(_in(grams, vocabulary) & (rows[1:] == rows[:-1])) if len(grams) else np.zeros(0, int)
                grams, place = grams[at], at + gap * rows[at]
                found = defaultdict(list)
                for t in wanted:
                    for a, n, dice, shared in t.windows(grams, place):
                        found[a, n].append((dice, shared, t.name))
                if not found:
                    continue
                kept = _best(found)
                a, n = (np.array(x) for x in list(zip(*kept))[:2])
                own = rows[at[np.searchsorted(place, a)]]
                a = a - gap * own
                line = np.cumsum(np.concatenate([[0], data == 10]))
                top, end = line[starts[a]], line[starts[a + n]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + own)), pa.array(a - first[own]), pa.array(n + 1),
                     pa.array(top - line[offsets[own]]), pa.array(end - top + 1), pa.array([x[3] for x in kept]),
                     pa.array([x[2] for x in kept], pa.float64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def summary(found: DataFrame) -> DataFrame:
    """license, n_docs, n_notices of scan()'s rows."""
    return found.groupBy("license").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_notices"))
