"""License scans by conditional compression.

Candidate blocks reach from a licensing word by the length of the longest template on both sides, across
lines and blank lines; its line and its paragraph are looked at by themselves too. Each block is compressed
plainly and with every template as a raw zstandard dictionary; templates are ranked by how many bytes
their dictionary saves, and those that save enough are confirmed in that order by exact wording: the words of
the template are aligned with the block's and the differences listed. Years, names and other text in the
holes that a template leaves open are no differences. A template is confirmed without any, or, if it is
long, with one for every ``WORDS_A_CHANGE`` of its words, none of them at a word that tells licenses apart
(numbers, names, negations). The words of a confirmed template are taken: one of lower rank can't have them.

Whole texts are scanned: blocks that overlap are joined, and a long one is compressed in pieces that
overlap by the longest template, which is counted in words. Null counts as the empty text, which has no blocks. Rows are
independent: ties in saving are broken by the template's place, repeated rows and other columns
need no rule, an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, texts_of

#: The public wordings of common license statements. A star is a hole of up to 12 words.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, * has waived all copyright and related or neighboring rights to *"),
    # The license is named by the word in the hole.
    ("*", "SPDX-License-Identifier: *"),
]
#: Names under which texts are said to be licensed or released.
NAMES = {
    "GPL-3.0": ["GPL v3", "GPLv3", "GPL-3.0", "GNU GPL v3", "GNU General Public License v3.0"],
    "GPL-2.0": ["GPL v2", "GPLv2", "GPL-2.0", "GNU GPL v2", "GNU General Public License v2.0"],
    "LGPL-2.1": ["LGPL v2.1", "LGPLv2.1"],
    "AGPL-3.0": ["AGPL v3", "AGPLv3", "GNU Affero General Public License v3.0"],
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0"],
    "ISC": ["ISC License"],
}
TEMPLATES += [(license, f"{how} under the {name}") for license, names in NAMES.items() for name in names for how in ("Licensed", "Released")]
#: Words at which no difference is allowed, besides those with digits.
TELLING = frozenset("affero apache bsd commons creative free gnu general isc lesser library mit mozilla no noncommercial not or public sharealike without".split())
#: A template may differ at one word for each so many of its own.
WORDS_A_CHANGE = 20
#: Words that may stand in a licensing block.
CUES = re.compile(r"licen[sc]|released under|permission|redistribut|public domain|free software|warranty|mozilla public|waived all|names of its", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
HOLE_WORDS = 12
#: A template wins if its dictionary saves at least this share of what it could: of the block's
#: compressed size or its own, whichever is less.
LEAST_SAVING = 0.2
#: A block is compressed in pieces of about so many times the longest template.
BLOCK_TEMPLATES = 16


@dataclass
class Template:
    license: str
    text: str
    #: The words between the holes.
    parts: tuple[tuple[str, ...], ...]

    @property
    def words(self) -> int:
        return self.own + HOLE_WORDS * (len(self.parts) - 1 + (self.license == "*"))

    @property
    def own(self) -> int:
        return sum(map(len, self.parts))

    @functools.cached_property
    def threes(self) -> frozenset[tuple[str, ...]]:
        return frozenset(p[i : i + 3] for p in self.parts for i in range(len(p) - 2))


Found = tuple[int, int, list[str]]
_HOLE = None


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        import zstandard

        self.templates = [Template(n, t, tuple(tuple(_words(p)) for p in t.split("*") if _words(p))) for n, t in templates]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [
            zstandard.ZstdCompressor(
                level=3,
                write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict(t.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for t in self.templates
        ]
        self.own = [len(self.plain.compress(t.text.encode())) for t in self.templates]
        self.most = max((t.words for t in self.templates), default=0)
        # The ranking of a block depends on its text alone; short blocks recur.
        self.rank = functools.lru_cache(maxsize=4096)(self._rank)

    def blocks(self, places: list[tuple[int, int]], cues: list[int]) -> Iterator[tuple[int, int]]:
        """Ranges of words around licensing words, widened by the longest template; overlapping ones joined."""
        starts = [s for s, _ in places]
        start = end = -1
        for c in cues:
            k = bisect.bisect_right(starts, c)
            a, b = max(0, k - self.most), min(len(places), k + self.most)
            if a <= end:
                end = b
            else:
                if end >= 0:
                    yield start, end
                start, end = a, b
        if end >= 0:
            yield start, end

    def windows(self, text: str, places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """What is compressed: the lines and paragraphs that hold licensing words, and the blocks around them."""
        cues = [m.start() for m in CUES.finditer(text)]
        out = set()
        for mark in ("\n", "\n\n"):
            end = -1
            for c in cues:
                if c < end:
                    continue
                start = text.rfind(mark, 0, c)
                start = 0 if start < 0 else start + len(mark)
                end = text.find(mark, c)
                end = len(text) if end < 0 else end
                out.add((start, end))
        for a, b in self.blocks(places, cues):
            for x in range(a, max(a + 1, b - self.most), BLOCK_TEMPLATES * self.most):
                out.add((places[x][0], places[min(b, x + (BLOCK_TEMPLATES + 1) * self.most) - 1][1]))
        yield from sorted(out)

    def _rank(self, block: str) -> list[tuple[float, int]]:
        """(saving, template) for the templates that save enough, most bytes first; a saving is a share."""
        raw = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(raw))
        told = [(alone - len(c.compress(raw)), -i) for i, c in enumerate(self.given)]
        shares = [(saved / min(alone, self.own[-i]), -i) for saved, i in sorted(told, reverse=True)]
        return [(s, i) for s, i in shares if s >= LEAST_SAVING]

    def confirm(self, words: list[str], template: Template) -> Iterator[Found]:
        """Ranges of words that are the template, and how they differ from it."""
        exact = list(self._exact(words, template))
        for start, end in exact:
            yield start, end, []
        most = template.own // WORDS_A_CHANGE
        if not most:
            return
        # A change breaks three of the template's triples at most; a place of enough whole ones is aligned.
        hits = [i for i in range(len(words) - 2) if tuple(words[i : i + 3]) in template.threes]
        needed, reach = len(template.threes) - 3 * most, template.words + most
        done = -1
        for k, first in enumerate(hits):
            if first < done or bisect.bisect_left(hits, first + reach) - k < needed:
                continue
            a, b = max(0, first - 3 * most - 3), min(len(words), first + reach + most)
            for start, end, changes in align(words[a:b], template, most):
                done = a + end
                if all(a + end <= s or a + start >= e for s, e in exact):
                    yield a + start, a + end, changes

    def _exact(self, words: list[str], template: Template) -> Iterator[tuple[int, int]]:
        """Ranges of words that are the template word by word, holes aside."""
        first = template.parts[0]
        at = 0
        while at + len(first) <= len(words):
            try:
                at = words.index(first[0], at)
            except ValueError:
                return
            if tuple(words[at : at + len(first)]) == first and (end := self._rest(words, at + len(first), template.parts[1:])):
                end += template.license == "*"
                if end <= len(words):
                    yield at, end
                at = end
            else:
                at += 1

    @staticmethod
    def _rest(words: list[str], at: int, parts: tuple[tuple[str, ...], ...]) -> int | None:
        for part in parts:
            for hole in range(HOLE_WORDS + 1):
                if tuple(words[at + hole : at + hole + len(part)]) == part:
                    at += hole + len(part)
                    break
            else:
                return None
        return at

    def scan(self, text: str) -> list[dict]:
        """Confirmed spans in order: start, end, license, template, saving, changes. Where spans of several blocks overlap the longest stays."""
        found: list[dict] = []
        places = [m.span() for m in _WORD.finditer(text)]
        starts, ends = [s for s, _ in places], [e for _, e in places]
        words = [text[s:e].lower() for s, e in places]
        for x, y in self.windows(text, places):
            if not (ranked := self.rank(text[x:y])):
                continue
            a, b = bisect.bisect_left(starts, x), bisect.bisect_right(ends, y)
            own, taken = words[a:b], []
            for saving, i in ranked:
                for s, e, changes in self.confirm(own, self.templates[i]):
                    if any(s < f and e > t for t, f in taken):
                        continue
                    taken.append((s, e))
                    license = self.templates[i].license
                    if license == "*":
                        license = text[starts[a + e - 1] : ends[a + e - 1]]
                    found.append(
                        {"start": starts[a + s], "end": ends[a + e - 1], "license": license, "template": i, "saving": round(saving, 6), "changes": changes}
                    )
        out: list[dict] = []
        for f in sorted(found, key=lambda f: (f["start"] - f["end"], len(f["changes"]), f["start"], f["template"])):
            if all(f["end"] <= g["start"] or f["start"] >= g["end"] for g in out):
                out.append(f)
        return sorted(out, key=lambda f: f["start"])


def align(words: list[str], template: Template, most: int) -> list[Found]:
    """The range of words with the fewest differences from the template, the leftmost of such, if they are ``most`` or fewer.

    Differences are told as ``old>new``, ``old>`` (left out) and ``>new`` (put in). None may touch a telling word.
    """
    tokens: list[str | None] = []
    for part in template.parts:
        tokens += [_HOLE] * bool(tokens) + list(part)
    never = most + 1
    apart = lambda w: w in TELLING or any(c.isdigit() for c in w)
    # cost[j]: of the tokens so far against words that end at j; the start is free.
    cost = [0] * (len(words) + 1)
    steps: list[list[int]] = []
    for token in tokens:
        then, step = [never] * (len(words) + 1), [0] * (len(words) + 1)
        if token is _HOLE:
            for j in range(len(words) + 1):
                back = min(range(min(j, HOLE_WORDS) + 1), key=lambda k, j=j: (cost[j - k], k))
                then[j], step[j] = cost[j - back], 3 + back
        else:
            rigid = apart(token)
            for j in range(len(words) + 1):
                best, how = (cost[j] + (never if rigid else 1)), 1  # the token is left out
                if j:
                    word = words[j - 1]
                    same = cost[j - 1] + (0 if word == token else never if rigid or apart(word) else 1)
                    if same <= best:
                        best, how = same, 0
                    more = then[j - 1] + (never if apart(word) else 1)  # a word is put in
                    if more < best:
                        best, how = more, 2
                then[j], step[j] = min(best, never), how
        cost = then
        steps.append(step)
    end = min(range(len(cost)), key=lambda j: (cost[j], j))
    if cost[end] > most:
        return []
    changes, j, i = [], end, len(tokens)
    while i:
        how = steps[i - 1][j]
        if how >= 3:
            j -= how - 3
        elif how == 2:
            changes.append(f">{words[j - 1]}")
            j -= 1
            continue
        else:
            token = tokens[i - 1]
            if how == 1:
                changes.append(f"{token}>")
            else:
                if words[j - 1] != token:
                    changes.append(f"{token}>{words[j - 1]}")
                j -= 1
        i -= 1
    return [(j, end, changes[::-1])]


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("template", pa.int32()), ("saving", pa.float64()), ("changes", pa.list_(pa.string()))])


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: the license statements of each whole text. One narrow pass, no shuffle."""
    known = TEMPLATES if templates is None else templates
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for part in parts(batches, "text"):
            found = [scanner.scan(t) if CUES.search(t) else [] for t in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, found array<struct<start:int,end:int,license:string,template:int,saving:double,changes:array<string>>>")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted names), spans (license:start:end by start), n_changes (words that differ from the templates)."""
    said = F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"], f["end"]))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    return scanned.select(
        "doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_join(said, ",").alias("spans"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, f: n + F.size(f["changes"])).alias("n_changes"),
    )
