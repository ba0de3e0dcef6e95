"""License scan: winnowed fingerprints in an inverted index pick candidates, banded alignment reports coverage and spans.

Words are lower-cased and freed of the marks around them.  The fingerprints of a text are the hashes of its K-word runs
that are smallest in some window of WINDOW runs, so any K + WINDOW - 1 words shared with a template share a fingerprint;
templates are all indexed by every run, so a notice shorter than that is found as well.  A hit names a template and a
diagonal; a local alignment in a band around it confirms the match.  Its words are then taken, and the hits that are left,
near the same diagonal or not, are aligned among the other words, so that occurrences close to each other are all found.

Defined cases: a null or empty text has no matches and gives no rows; each occurrence in a long text is reported; repeated
rows give equal rows; the template list has a fixed size, so it travels with the tasks.
"""
from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealsight.llm.common import map_batches, texts

# Public notices, in the words of their licences.
TEMPLATES = {
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit": "Released under the MIT License.",
    "apache-2.0-full": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-full": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "bsd-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
K, WINDOW, BAND = 3, 3, 8
MARKS = b".,;:!?\"'()[]{}<>*#/-_"
MATCH, MISMATCH, GAP = 2, -2, -1
TAKEN = -2  # a word of the text that an alignment may not cross
CACHE = 200_000


def normal(word: bytes) -> bytes:
    return word.strip(MARKS).lower()


def run_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of each K-word run; runs with an unknown word (-1) get the largest value."""
    n = len(ids) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(K):
        part = ids[k:n + k]
        bad |= part < 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h[bad] = np.iinfo(np.uint64).max
    return h


def winnow(h: np.ndarray) -> np.ndarray:
    """Places whose hash is the smallest of some window; runs with unknown words are never taken."""
    if not len(h):
        return np.zeros(0, np.int64)
    w = min(WINDOW, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(np.arange(len(views)) + w - 1 - views[:, ::-1].argmin(1))
    return at[h[at] != np.iinfo(np.uint64).max]


@dataclass(frozen=True)
class Index:
    """Vocabulary of the templates, their words, and the inverted index: run hash -> (template, place)."""

    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    names: list[str]
    places: dict[int, list[tuple[int, int]]]

    @staticmethod
    def build(templates: dict[str, str]) -> Index:
        vocabulary: dict[bytes, int] = {}
        words, places = [], defaultdict(list)
        for t, text in enumerate(templates.values()):
            ids = np.array([vocabulary.setdefault(x, len(vocabulary)) for w in text.encode().split() if (x := normal(w))], np.int64)
            words.append(ids)
            for at, h in enumerate(run_hashes(ids).tolist()):
                places[h].append((t, at))
        return Index(vocabulary, words, list(templates), dict(places))


def align(doc: np.ndarray, template: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Best local alignment in the band that crosses no taken word: (matched words, first and last+1 word of the text)."""
    width = 2 * BAND + 1
    score = np.zeros(width, np.int64)
    matched, begin = np.zeros(width, np.int64), np.zeros(width, np.int64)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template.tolist()):
        js = i + diagonal - BAND + np.arange(width)
        inside = (js >= 0) & (js < len(doc))
        inside[inside] = doc[js[inside]] != TAKEN
        same = np.zeros(width, bool)
        same[inside] = doc[js[inside]] == word
        # word against word keeps the diagonal; a skipped template word comes from the next diagonal of the row above
        new = score + np.where(same, MATCH, MISMATCH)
        m, b = matched + same, np.where(score > 0, begin, js)
        up = np.r_[score[1:] + GAP, -1]
        take = up > new
        new, m, b = np.where(take, up, new), np.where(take, np.r_[matched[1:], 0], m), np.where(take, np.r_[begin[1:], 0], b)
        new[~inside] = 0
        for k in range(1, width):  # a skipped word of the text stays in the row
            if inside[k] and new[k - 1] + GAP > new[k]:
                new[k], m[k], b[k] = new[k - 1] + GAP, m[k - 1], b[k - 1]
        score = np.maximum(new, 0)
        matched, begin = np.where(score > 0, m, 0), b
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(matched[k]), int(begin[k]), int(js[k]) + 1)
    return best[1:]


def matches(ids: np.ndarray, index: Index, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last+1 word), the best of overlapping ones, in text order."""
    h = run_hashes(ids)
    diagonals: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for at in winnow(h).tolist():
        for t, place in index.places.get(int(h[at]), ()):
            diagonals[t][at - place].append(at)
    found = []
    for t, ds in diagonals.items():
        left = ids.copy()
        for d, hits in sorted(ds.items()):
            while any((left[at:at + K] != TAKEN).all() for at in hits):
                n, s, e = align(left, index.words[t], d)
                if n < coverage * len(index.words[t]):
                    break
                found.append((t, n, s, e))
                left[s:e] = TAKEN
    found.sort(key=lambda x: (-x[1], -x[1] / len(index.words[x[0]]), x[2], x[0]))
    kept: list[tuple[int, int, int, int]] = []
    taken = np.zeros(len(ids) + 1, bool)  # words already in a match
    for f in found:
        if not taken[f[2]:f[3]].any():
            taken[f[2]:f[3]] = True
            kept.append(f)
    return sorted(kept, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.7) -> DataFrame:
    """One row per match: license, matched words, coverage of the template, span in code points."""
    index = Index.build(templates or TEMPLATES)
    names = ["doc_id", "license", "matched", "template_words", "coverage", "start", "end"]

    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        known: dict[bytes, int] = {}
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), texts(b)):
            words = text.split()
            if len(known) > CACHE:
                known.clear()
            for w in set(words).difference(known):
                known[w] = index.vocabulary.get(normal(w), -1)
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            if (ids >= 0).sum() < K:
                continue
            hits = matches(ids, index, coverage)
            if hits:
                at, places = 0, []
                for w in words:
                    at = text.index(w, at)
                    places.append((at, at + len(w)))
                    at += len(w)
                # code points before each byte: all but continuation bytes count
                before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            for t, n, s, e in hits:
                size = len(index.words[t])
                start, end = int(before[places[s][0]]), int(before[places[e - 1][1]])
                rows.append((doc, index.names[t], n, size, n / size, start, end))
        if rows:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), batch,
                       "doc_id long, license string, matched long, template_words long, coverage double, start long, end long")
