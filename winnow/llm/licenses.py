"""License scan: winnowed template fingerprints find candidates, banded alignment measures them."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.text import NOT_WORD, Chunk, chunks, word_hashes, words

#: words per fingerprint, winnowing window, half width of the alignment band (a quarter of a short template), least coverage reported
GRAM, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.8

#: Wording of public licences and notices.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MIT-notice": "Released under the MIT License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at"
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}


class Index(NamedTuple):
    """Inverted index of the templates: for each length of gram, the sorted codes of fingerprints and their postings."""

    names: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    words: list[np.ndarray]  # vocabulary positions of each template's words, from 1
    tables: list[tuple[int, np.ndarray, list[list[tuple[int, int]]]]]  # words of a gram, codes, (template, position) of each code


def winnowed(codes: np.ndarray, window: int) -> list[int]:
    """Positions of the rightmost least code of every window (of the whole, if shorter)."""
    n = len(codes)
    if n <= window:
        return [n - 1 - int(np.argmin(codes[::-1]))] if n else []
    return sorted({i + window - 1 - int(np.argmin(codes[i : i + window][::-1])) for i in range(n - window + 1)})


def build_index(templates: dict[str, str], gram: int = GRAM, window: int = WINDOW, coverage: float = COVERAGE) -> Index:
    """Templates of fewer than ``gram`` words can't be fingerprinted and are refused.

    A template too short for two winnowing windows has all its grams as fingerprints, and they are as short as the
    longest run of words that is sure to be left when as many words are replaced as ``coverage`` allows.
    """
    names = sorted(templates)
    hashes = []
    for name in names:
        data = np.frombuffer(templates[name].encode(), np.uint8)
        chunk = Chunk(None, data, np.array([0, len(data)]))
        hashes.append(word_hashes(chunk, words(chunk, NOT_WORD)))
        if len(hashes[-1]) < gram:
            raise ValueError(f"template {name} has fewer than {gram} words")
    vocabulary = np.unique(np.concatenate(hashes))
    ids = [np.searchsorted(vocabulary, h) + 1 for h in hashes]
    postings = defaultdict(lambda: defaultdict(list))
    for t, w in enumerate(ids):
        size, every = gram, len(w) - gram + 1 < 2 * window
        if every:
            kept = ceil(coverage * len(w) - 1e-9)
            size = max(1, min(gram, -(-kept // (len(w) - kept + 1))))
        codes = gram_codes(w, size, len(vocabulary))
        for p in range(len(codes)) if every else winnowed(scatter(codes), window):
            postings[size][int(codes[p])].append((t, p))
    return Index(names, vocabulary, ids, [(size, np.array(sorted(of)), [of[c] for c in sorted(of)]) for size, of in sorted(postings.items())])


def gram_codes(ids: np.ndarray, gram: int, size: int) -> np.ndarray:
    """One number for each run of ``gram`` words; 0 if one of them is in no template."""
    n = max(len(ids) - gram + 1, 0)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(gram):
        part = ids[j : j + n]
        code = code * (size + 1) + part
        known &= part > 0
    return np.where(known, code, 0)


def scatter(codes: np.ndarray) -> np.ndarray:
    """Order of the winnowing: a fixed shuffle of the codes."""
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)


def banded(template: np.ndarray, doc: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence of words with |j - i - shift| <= band.

    Gives the number of matched words and the first and last matched word of ``doc``; of equal
    alignments the shortest one.
    """
    width = 2 * band + 1
    best = [(0, 0, 0, 0)] * width  # matched, first - last, first, last
    for i, word in enumerate(template):
        row: list[tuple[int, int, int, int]] = []
        for c in range(width):
            j = i + shift + c - band
            options = [best[c + 1]] if c + 1 < width else []
            if c:
                options.append(row[-1])
            if 0 <= j < len(doc) and doc[j] == word:
                m, _, first, _ = best[c]
                first = first if m else j
                options.append((m + 1, first - j, first, j))
            else:
                options.append(best[c])
            row.append(max(options))
        best = row
    matched, _, first, last = max(best)
    return matched, first, last


def matches(ids: np.ndarray, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word) of every stretch of one document, not overlapping per template.

    Every shift that a seed suggests is aligned once per stretch; only a stretch matched in full stands for the shifts near it.
    """
    seeds = defaultdict(list)
    for gram, known, postings in index.tables:
        codes = gram_codes(ids, gram, len(index.vocabulary))
        at = np.flatnonzero(codes)
        place = np.searchsorted(known, codes[at])
        place[place == len(known)] = 0
        hit = known[place] == codes[at]
        for p, k in zip(at[hit], place[hit]):
            for t, q in postings[k]:
                seeds[t].append((int(p), int(p) - q))
    out = []
    for t, found in seeds.items():
        template = index.words[t]
        slip = min(band, max(1, len(template) // 4))  # copies of a short notice may stand close together
        whole = (-len(template), 0)  # shift, end of the last stretch that was matched in full
        tried = set()
        spans = []
        for p, shift in sorted(found):
            if shift in tried or p < whole[1] and abs(shift - whole[0]) <= slip:
                continue
            tried.add(shift)
            low = max(0, shift - slip)
            window = ids[low : shift + len(template) + slip + 1]
            matched, first, last = banded(template, window, shift - low, slip)
            if matched >= coverage * len(template):
                spans.append((t, matched, low + first, low + last))
            if matched == len(template):
                whole = (shift, low + last + 1)
        ends: list[tuple[int, int]] = []  # last and first word of the spans taken, in order
        for m in sorted(set(spans), key=lambda m: (-m[1], m[2])):
            i = bisect_left(ends, (m[2], 0))
            if i == len(ends) or ends[i][1] > m[3]:
                ends.insert(i, (m[3], m[2]))
                out.append(m)
    return sorted(out, key=lambda m: (m[2], m[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", keep: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """One row per licence stretch of every whole text: ``keep``, ``template``, ``matched``,
    ``coverage`` (matched words over the template's) and the span ``start``, ``end`` in characters.

    Words are runs of letters and digits, ASCII letters in lower case. Null and empty texts give
    no row. Templates are a bounded parameter, so their index travels with the tasks.
    """
    index = docs.sparkSession.sparkContext.broadcast(build_index(templates, coverage=coverage))
    source = docs.select(F.col(keep).alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for chunk in chunks(batches, "_text"):
            w = words(chunk, NOT_WORD)
            h = word_hashes(chunk, w)
            ids = np.searchsorted(ix.vocabulary, h)
            ids[ids == len(ix.vocabulary)] = 0
            ids = np.where(ix.vocabulary[ids] == h, ids + 1, 0) if len(h) else ids
            heads = np.zeros(len(chunk.data) + 1, np.int64)
            np.cumsum((chunk.data & 0xC0) != 0x80, out=heads[1:])
            rows = []
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            some = known[w.first[1:]] - known[w.first[:-1]] >= min(size for size, *_ in ix.tables)
            for i in np.flatnonzero(some):
                lo, hi = w.first[i], w.first[i + 1]
                base = heads[chunk.offsets[i]]
                for t, m, first, last in matches(ids[lo:hi], ix, coverage=coverage):
                    rows.append((int(i), ix.names[t], m, m / len(ix.words[t]), int(heads[w.start[lo + first]] - base), int(heads[w.end[lo + last]] - base)))
            if rows:
                i, name, m, share, start, end = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [chunk.rows.column("_id").take(pa.array(i)), pa.array(name), pa.array(m, pa.int32()), pa.array(share), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    [keep, "template", "matched", "coverage", "start", "end"],
                )

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{keep}` {kind}, template string, matched int, coverage double, start long, end long")
