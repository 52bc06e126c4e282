"""License scans (operator 8): license texts inside documents, by MinHash bands over overlapping windows.

Templates of one size class share a window length, the longest of theirs in words; windows start every quarter of it.  A
window's MinHash under each of ``BANDS`` hash functions is one band.  If three quarters of a template's shingles
are in the text, some window holds at least three quarters of those and its Jaccard similarity to the template
is at least J = 0.5625 / 2.44 (windows are at most a class's factor of two longer), so a template is missed with
probability (1 - J) ** BANDS, under one in 10^5.  Retrieved templates are then verified by exact containment in the
window's surroundings.  Only windows that hold a shingle of a template can agree with one in a band, so no others
are hashed.

Edge cases: null and empty texts match nothing; a text shorter than a window is one window; overlapping finds of one
template in a text are one match, the best, and all others are matches of their own; repeated rows match alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mixed
from .words import Words, batches_of

BANDS = 44
SHINGLE = 5
CONTAINED = 0.75
# Common notices by which works name their license.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
MATCHES = "array<struct<template:string,first_word:int,last_word:int,containment:double>>"
_SEEDS = np.random.default_rng(11).integers(1, 1 << 62, BANDS).astype(np.uint64) | np.uint64(1)


def shingles(words: Words) -> np.ndarray:
    """Hash of the SHINGLE words from each word on, or of all words of a shorter text; 0 where there is none."""
    out = np.zeros(len(words.end), np.uint64)
    full = words.hashes(SHINGLE)
    out[: len(full)] = full
    place = np.arange(len(out)) - np.repeat(words.first, words.size)
    size = np.repeat(words.size, words.size)
    out[place + SHINGLE > size] = 0
    for n in {int(x) for x in words.size if 0 < x < SHINGLE}:
        short = words.hashes(n)
        at = words.first[words.size == n]
        out[at] = short[at]
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    return np.array([mixed(hashes * s).min() for s in _SEEDS], np.uint64)


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words = Words.of(list(templates.values()), lower=True)
        all_ = shingles(words)
        parts = [all_[f : f + n] for f, n in zip(words.first, words.size, strict=True)]
        self.sets = [np.unique(p[p > 0]) for p in parts]
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.signatures = [signature(s) if len(s) else None for s in self.sets]
        classes: dict[int, list[int]] = {}
        for k, n in enumerate(words.size.tolist()):
            if n:
                classes.setdefault(int(np.log2(n)), []).append(k)
        self.classes = [(max(int(words.size[k]) for k in ks), ks) for ks in classes.values()]

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        words = Words.of(texts, lower=True)
        h = shingles(words)
        hot = np.flatnonzero(np.isin(h, self.known))
        owner = np.searchsorted(words.first, hot, "right") - 1
        # texts without words share their first place with the next text
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        for doc in np.unique(owner):
            first, size = int(words.first[doc]), int(words.size[doc])
            own, places = h[first : first + size], hot[owner == doc] - first
            out[doc] = self._document(own, places)
        return out

    def _document(self, own: np.ndarray, places: np.ndarray) -> list[tuple[str, int, int, float]]:
        found: dict[int, set[tuple[float, int, int]]] = {}
        for length, members in self.classes:
            step = max(1, length // 4)
            reach = max(1, length - SHINGLE + 1)  # shingles of a window
            last = max(0, -(-(len(own) - reach) // step))
            low, high = np.maximum(0, -(-(places - reach + 1) // step)), np.minimum(last, places // step)
            for w in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)] or [np.zeros(0, np.int64)])):
                begin = int(w) * step
                inside = own[begin : begin + reach]
                inside = inside[inside > 0]
                if not len(inside):
                    continue
                bands = signature(inside)
                for k in members:
                    if (bands == self.signatures[k]).any():
                        a, b = max(0, begin - step), min(len(own), begin + reach + step)
                        hits = a + np.flatnonzero(np.isin(own[a:b], self.sets[k]))
                        for share, first, final in copies(hits.tolist(), own[hits].tolist(), len(self.sets[k])):
                            found.setdefault(k, set()).add((share, first, min(len(own), final + SHINGLE)))
        return sorted((self.names[k], a, b, share) for k, finds in found.items() for share, a, b in apart(finds))


def copies(places: list[int], hashes: list[int], whole: int) -> list[tuple[float, int, int]]:
    """Share, first and last place of each stretch that holds CONTAINED of a template's ``whole`` shingles; the shortest that holds most comes first."""
    distinct = len(set(hashes))
    if not distinct or distinct / whole < CONTAINED:
        return []
    held: dict[int, int] = {}
    best, i = (places[-1] - places[0] + 1, 0, len(places) - 1), 0
    for j, x in enumerate(hashes):
        held[x] = held.get(x, 0) + 1
        while held[hashes[i]] > 1:
            held[hashes[i]] -= 1
            i += 1
        if len(held) == distinct:
            best = min(best, (places[j] - places[i], i, j))
    _, i, j = best
    return [(distinct / whole, places[i], places[j]), *copies(places[:i], hashes[:i], whole), *copies(places[j + 1 :], hashes[j + 1 :], whole)]


def apart(finds: set[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The best of overlapping finds, and all that overlap none of these."""
    kept: list[tuple[float, int, int]] = []
    for share, a, b in sorted(finds, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        at = bisect.bisect_left(kept, a, key=lambda x: x[1])
        if (at == 0 or kept[at - 1][2] <= a) and (at == len(kept) or kept[at][1] >= b):
            kept.insert(at, (share, a, b))
    return kept


def matches(text: Column, templates: dict[str, str] | None = None) -> Column:
    """Each occurrence of a template in a text, by name: first and last word (exclusive), and the share of the template's shingles there."""
    given = TEMPLATES if templates is None else templates

    @F.pandas_udf(MATCHES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(given)
        for batch in batches:
            texts, out = batch.tolist(), []
            for at, to in batches_of(texts):
                out += [[dict(zip(("template", "first_word", "last_word", "containment"), m, strict=True)) for m in row] for row in scanner.scan(texts[at:to])]
            yield pd.Series(out, dtype=object)

    return find(F.coalesce(text, F.lit("")))


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """``docs`` with the matches of each text as ``out_col``."""
    return docs.withColumn(out_col, matches(F.col(text_col), templates))
