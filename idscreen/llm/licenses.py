"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Template texts are cut into words; rolling hashes of a few words are winnowed (Schleimer, Wilkerson and Aiken 2003) and
kept in an inverted index from fingerprint to templates and places. A document's rolling hashes are winnowed alike and
looked up; hits on nearby diagonals are a candidate. A candidate is aligned word by word inside a band around its
diagonals: the longest common subsequence there gives the matched words, its ends give the span.

Cases: a null text has no words and no matches; a text may hold several templates, and one template several times;
ids may be null or repeated; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idscreen.llm.shared import Rolling, WordHashes, binary_values

GRAM_WORDS = 3
WINNOW = 2
BAND = 8
MIN_COVERAGE = 0.75
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:[.-][0-9a-z\x80-\xff]+)*")

# Short public notices by which texts name their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
    " except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    " and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the"
    " GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(text: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """Lower-cased words with the places in the text where they begin and end."""
    words, begins, ends = [], [], []
    for m in _WORD.finditer(text.lower()):
        words.append(m.group())
        begins.append(m.start())
        ends.append(m.end())
    return words, begins, ends


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the chosen fingerprints: in every run of `window` hashes the smallest, the last of equal ones."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(runs)) + window - 1 - runs.argmin(axis=1))


@dataclass(frozen=True)
class Match:
    template: str
    matched: int
    length: int
    first: int
    last: int

    @property
    def coverage(self) -> float:
        return self.matched / self.length


class TemplateIndex:
    """Inverted index of the templates' fingerprints; as large as the caller's short list of templates."""

    def __init__(self, templates: Mapping[str, str], gram: int = GRAM_WORDS, window: int = WINNOW) -> None:
        self._hashes, self._rolling, self._gram, self._window = WordHashes(), Rolling(), gram, window
        self._names = list(templates)
        self._words: list[np.ndarray] = []
        self._places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, text in enumerate(templates.values()):
            h = self._hashes.of(words_of(text.encode())[0])
            self._words.append(h)
            grams = self._grams(h)
            for at in winnowed(grams, window):
                self._places[int(grams[at])].append((k, int(at)))
        self._known = np.array(sorted(self._places), np.uint64)

    def _grams(self, h: np.ndarray) -> np.ndarray:
        return self._rolling.windows(h, min(self._gram, max(1, len(h))))

    def matches(self, words: list[bytes], min_coverage: float, band: int) -> list[Match]:
        """All spans of a text that hold at least `min_coverage` of a template's words in order."""
        h = self._hashes.of(words)
        grams = self._grams(h)
        chosen = winnowed(grams, self._window)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in chosen[np.isin(grams[chosen], self._known)]:
            for template, place in self._places[int(grams[at])]:
                hits[template].append((int(at) - place, int(at)))
        found = []
        for template, places in hits.items():
            own = self._words[template]
            # hits whose diagonals lie within the band, one after the other, are one candidate
            places.sort()
            start, wide = 0, min(band, len(own) // 2)  # so that the next copy of a short template is a candidate of its own
            for k in range(1, len(places) + 1):
                if k < len(places) and places[k][0] - places[k - 1][0] <= wide:
                    continue
                low, high = places[start][0] - wide, places[k - 1][0] + wide
                start = k
                match = self._aligned(template, own, h, low, high)
                if match and match.coverage >= min_coverage:
                    found.append(match)
        return sorted(set(found), key=lambda m: (m.first, m.last, m.template))

    def _aligned(self, template: int, own: np.ndarray, text: np.ndarray, low: int, high: int) -> Match | None:
        """Longest common subsequence of a template and a text whose diagonals (text place - template place) are banded.

        A row holds, per diagonal, the best count with the first and last matched text place; shorter spans win ties.
        """
        width = high - low + 1
        nothing = (0, 0, 0, 0)  # matched, minus span, first, last
        row = [nothing] * width
        for i, word in enumerate(own):
            new = [nothing] * width
            for d in range(width):
                j = i + low + d
                # a template word left out: one diagonal up; a text word left out: the neighbour just computed
                best = row[d + 1] if d + 1 < width else nothing
                if d and new[d - 1] > best:
                    best = new[d - 1]
                if 0 <= j < len(text) and text[j] == word:
                    n, _, first, _ = row[d]
                    first = first if n else j
                    step = (n + 1, first - j, first, j)
                    best = max(best, step)
                new[d] = max(best, row[d]) if not (0 <= j < len(text)) else best
            row = new
        n, _, first, last = max(row)
        return Match(self._names[template], n, len(own), first, last) if n else None


def license_spans(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text: str = "text",
    min_coverage: float = MIN_COVERAGE,
    band: int = BAND,
) -> DataFrame:
    """(doc_id, license, coverage, matched_words, template_words, begin, end), one row per span; places count bytes of the
    text in UTF-8. Spans are found in the task that reads the text: no shuffle."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType
    names = ["doc_id", "license", "coverage", "matched_words", "template_words", "begin", "end"]
    templates = dict(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        for batch in batches:
            at, rows = [], []
            for k, raw in enumerate(binary_values(batch.column(1))):
                words, begins, ends = words_of(raw)
                for m in index.matches(words, min_coverage, band):
                    at.append(k)
                    rows.append((m.template, m.coverage, m.matched, m.length, begins[m.first], ends[m.last]))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=names
            )

    return narrow.mapInArrow(
        scan,
        f"doc_id {kind.simpleString()}, license string, coverage double, matched_words int, template_words int,"
        " begin bigint, end bigint",
    )
