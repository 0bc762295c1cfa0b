"""License scan: MinHash over overlapping windows retrieves templates, exact containment verifies them.

A template of n shingles is sought in windows of 2 L shingles that advance by L, the power of two from n up, so
an occurrence lies whole in some window and has a Jaccard similarity of about n / 2 L, over a quarter, with it.
Each of BANDS minima of a window is a band of its own: a window that holds four fifths of a template misses it
in all bands with a probability of some 1e-4 or less. Of the windows found, exactly the shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, mix, shingles

WORDS, BANDS, CONTAINED = 5, 48, 0.8
#: Words scanned at a time.
CHUNK = 400_000

#: Phrases by which licenses are granted or named, with the license's common short name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All rights reserved", "All rights reserved."),
)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        words = Words()
        self.words = words
        self.factors = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(7919)) | np.uint64(1)
        self.templates = []  # name, k, L, sorted distinct shingles
        for name, text in templates:
            w = words(text)
            k = min(WORDS, len(w))
            s = np.unique(shingles(w, k))
            self.templates.append((name, k, 1 << max(0, (len(s) - 1).bit_length()), s))
        with np.errstate(over="ignore"):
            self.minima = [(s[:, None] * self.factors).min(axis=0) for _, _, _, s in self.templates]

    def candidates(self, stream: np.ndarray, k: int) -> dict[int, np.ndarray]:
        """Of each template of k-word shingles, the first shingle of every window that shares a band with it."""
        own = [i for i, t in enumerate(self.templates) if t[1] == k]
        found: dict[int, list[np.ndarray]] = {i: [] for i in own}
        sizes = sorted({self.templates[i][2] for i in own})
        for j, factor in enumerate(self.factors):
            with np.errstate(over="ignore"):
                low = stream * factor
            size = 1
            for to in sizes:
                while size < to:  # minima of blocks twice as long
                    if len(low) % 2:
                        low = np.append(low, np.uint64(2**64 - 1))
                    low = np.minimum(low[::2], low[1::2])
                    size *= 2
                window = np.minimum(low, np.append(low[1:], np.uint64(2**64 - 1)))
                for i in own:
                    if self.templates[i][2] == to:
                        found[i].append(np.flatnonzero(window == self.minima[i][j]))
        return {i: np.unique(np.concatenate(x)) * self.templates[i][2] for i, x in found.items()}

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """(license, first word, words, containment) of each match in each text, in the order of the text."""
        parts = [self.words(t or "") for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        joined = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        found: list[list[tuple]] = [[] for _ in texts]
        for k in sorted({t[1] for t in self.templates}):
            if len(joined) < k:
                continue
            stream = shingles(joined, k)
            for i, windows in self.candidates(stream, k).items():
                name, _, size, own = self.templates[i]
                for at in windows.tolist():
                    to = min(at + 2 * size, len(stream))
                    doc = int(np.searchsorted(starts, at, side="right")) - 1
                    while doc < len(texts) and starts[doc] < to:  # the part of the window in each text
                        lo, hi = max(at, int(starts[doc])), min(to, int(starts[doc + 1]) - k + 1)
                        if lo < hi:
                            hit = np.flatnonzero(np.isin(stream[lo:hi], own))
                            share = len(np.unique(stream[lo + hit])) / len(own)
                            if share >= CONTAINED:
                                first = lo + int(hit[0]) - int(starts[doc])
                                found[doc].append((first, int(hit[-1] - hit[0]) + k, name, share))
                        doc += 1
        return [self._distinct(f) for f in found]

    @staticmethod
    def _distinct(found: list[tuple]) -> list[tuple[str, int, int, float]]:
        """Matches that overlap are one: the longest of the best."""
        kept: list[tuple] = []
        for first, n, name, share in sorted(set(found), key=lambda m: (-m[1] * m[3], m[0], m[2])):
            if all(first >= a + b or a >= first + n for a, b, _, _ in kept):
                kept.append((first, n, name, share))
        return [(name, first, n, share) for first, n, name, share in sorted(kept)]


OUT = "doc_id long, n_matches long, licenses array<string>, matches array<struct<license: string, start_word: int, n_words: int, containment: double>>"
_STRUCT = pa.list_(pa.struct([("license", pa.string()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())]))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_matches, licenses (distinct, sorted), matches.

    A template shorter than WORDS words is one shingle of all its words. Words are runs of letters and digits in
    lower case, so line breaks and punctuation do not matter. Null and empty texts have no matches; of
    overlapping matches the longest stays. Templates are a parameter of a few dozen phrases, sent with the tasks.
    Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= 6 * CHUNK):
                    size += len(texts[to] or "")
                    to += 1
                found = scanner.scan(texts[at:to])
                rows = [[dict(zip(("license", "start_word", "n_words", "containment"), m)) for m in f] for f in found]
                cols = [pa.array(ids[at:to], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([sorted({m[0] for m in f}) for f in found], pa.list_(pa.string())), pa.array(rows, _STRUCT)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_matches", "licenses", "matches"])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)
