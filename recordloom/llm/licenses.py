"""License scans by matching templates with markup.

A template is a licence's wording with marked regions: ``<<beginOptional>>`` to
``<<endOptional>>`` may be missing, ``<<var;name="...";words=LOW-HIGH>>`` stands
for that many words of any kind. All templates are compiled into one automaton
over words: each state is a word of a template, or a word of any kind. A text is
read once, word by word; a template is accepted where its mandatory wording
stands word for word, with nothing between but what its regions allow. Plain
phrases are templates without regions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import picked, sliced, whole_text


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    markup: str


# The phrases that are looked for in any case.
PHRASES = (
    Template("mit phrase", "mit", "MIT License"),
    Template("apache phrase", "apache", "Apache License"),
    Template("gpl phrase", "gpl", "General Public License"),
)

# Public licence texts and notices, with regions marked.
TEMPLATES = (
    Template("MIT notice", "mit", """
        under <<beginOptional>>the terms of<<endOptional>> the MIT License"""),
    Template("MIT text", "mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy
        of <<var;name="work";words=1-12>> to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE
        IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;name="holders";words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE."""),
    Template("ISC text", "isc", """
        Permission to use, copy, modify, and/or distribute this software for any
        purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND <<var;name="holder";words=1-12>> DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE"""),
    Template("BSD two clauses", "bsd-2-clause", """
        Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following
        disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with
        the distribution."""),
    Template("BSD third clause", "bsd-3-clause", """
        Neither the name of <<var;name="holder";words=1-12>> nor the names of
        <<beginOptional>>its<<endOptional>> contributors may be used to endorse or
        promote products derived from this software without specific prior written
        permission."""),
    Template("Apache 2.0 notice", "apache-2.0", """
        Licensed under the Apache License, Version 2.0"""),
    Template("Apache 2.0 header", "apache-2.0", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        <<var;name="files";words=1-6>> except in compliance with the License. You may
        obtain a copy of the License at <<var;name="address";words=1-12>> Unless
        required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License."""),
    Template("GPL 2 notice", "gpl-2.0", """
        General Public License <<beginOptional>>as published by the Free Software
        Foundation;<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"""),
    Template("GPL 3 notice", "gpl-3.0", """
        General Public License <<beginOptional>>as published by the Free Software
        Foundation,<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"""),
    Template("GPL header", "gpl", """
        <<var;name="program";words=1-6>> is free software<<beginOptional>>: you<<endOptional>>
        can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation"""),
    Template("LGPL notice", "lgpl", """
        GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Library<<endOptional>>
        General Public License <<beginOptional>>as published by the Free Software
        Foundation<<endOptional>> either version 2.1"""),
    Template("MPL 2.0 header", "mpl-2.0", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v.
        2.0. If a copy of the MPL was not distributed with this file, You can obtain one
        at <<var;name="address";words=1-12>>"""),
    Template("CC BY-NC 4.0 notice", "cc-by-nc-4.0", """
        licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0"""),
    Template("CC BY 4.0 notice", "cc-by-4.0", """
        licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0"""),
    Template("CC BY-SA 4.0 notice", "cc-by-sa-4.0", """
        licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        <<beginOptional>>Creative Commons<<endOptional>> CC BY-SA 4.0"""),
    Template("CC0 text", "cc0-1.0", """
        To the extent possible under law, <<var;name="author";words=1-12>>
        <<beginOptional>>has<<endOptional>> <<beginOptional>>have<<endOptional>> waived
        all copyright and related or neighboring rights to"""),
    Template("Unlicense text", "unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is
        free to copy, modify, publish, use, compile, sell, or distribute this software"""),
)

#: Every byte as part of a word, in lower case, or as a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words_of(text: bytes, span: int = 1 << 16) -> Iterator[bytes]:
    """The words of an UTF-8 text in order; at no time more than one span's."""
    spaced = text.translate(WORD_BYTES)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + span)
        end = len(spaced) if end < 0 else end
        yield from spaced[at:end].split()
        at = end


# ── Markup ───────────────────────────────────────────────────────────


@dataclass
class Region:
    """A run of parts: words, and regions. ``low`` and ``high`` are set where the
    region stands for words of any kind."""

    parts: list = field(default_factory=list)
    low: int | None = None
    high: int = 0

    @property
    def replaceable(self) -> bool:
        return self.low is not None


MARK = re.compile(r'<<(beginOptional|endOptional|var;name="[^"<>]*";words=(\d+)-(\d+))>>')


def parse(markup: str) -> Region:
    """The template's parts, without regions at either end: whatever stands there
    is accepted, so they decide nothing."""
    open_regions = [Region()]
    at = 0
    for mark in MARK.finditer(markup):
        open_regions[-1].parts += words_of(markup[at:mark.start()].encode())
        at = mark.end()
        if mark[1] == "beginOptional":
            open_regions.append(Region())
        elif mark[1] == "endOptional":
            if len(open_regions) == 1:
                raise ValueError(f"endOptional without begin: {markup!r}")
            closed = open_regions.pop()
            open_regions[-1].parts.append(closed)
        else:
            low, high = int(mark[2]), int(mark[3])
            if not 0 <= low <= high or high < 1:
                raise ValueError(f"words={low}-{high} in {markup!r}")
            open_regions[-1].parts.append(Region(low=low, high=high))
    if len(open_regions) > 1:
        raise ValueError(f"beginOptional without end: {markup!r}")
    open_regions[-1].parts += words_of(markup[at:].encode())
    parts = open_regions[0].parts
    fixed = [k for k, p in enumerate(parts) if isinstance(p, bytes)]
    if not fixed:
        raise ValueError(f"no mandatory wording: {markup!r}")
    return Region(parts[fixed[0]: fixed[-1] + 1])


def mandatory_words(markup: str) -> int:
    return sum(isinstance(p, bytes) for p in parse(markup).parts)


# ── Automaton ────────────────────────────────────────────────────────

ANY = None


class Automaton:
    """States are the places in the templates; entering one reads a word, the one
    of the place or, in a replaceable region, any."""

    def __init__(self, templates: Iterable[Template]):
        self.templates = tuple(templates)
        self.symbol: list[bytes | None] = []
        self.after: list[set[int]] = []
        self.accepts: dict[int, int] = {}
        self.first: dict[bytes, list[int]] = {}
        for number, template in enumerate(self.templates):
            first, last, _ = self._chain(parse(template.markup).parts)
            for state in first:
                self.first.setdefault(self.symbol[state], []).append(state)
            for state in last:
                self.accepts[state] = number
        # Where a state leads to by a word, and by any word.
        self.by_word: list[dict[bytes, list[int]]] = []
        self.by_any: list[list[int]] = []
        for targets in self.after:
            known: dict[bytes, list[int]] = {}
            for t in sorted(targets):
                if self.symbol[t] is not ANY:
                    known.setdefault(self.symbol[t], []).append(t)
            self.by_word.append(known)
            self.by_any.append([t for t in sorted(targets) if self.symbol[t] is ANY])

    def _place(self, symbol: bytes | None) -> int:
        self.symbol.append(symbol)
        self.after.append(set())
        return len(self.symbol) - 1

    def _chain(self, parts: list) -> tuple[set[int], set[int], bool]:
        """First states, last states, and whether no word at all is enough."""
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for part in parts:
            if isinstance(part, bytes):
                state = self._place(part)
                begin, end, skip = {state}, {state}, False
            elif part.replaceable:
                run = [self._place(ANY) for _ in range(part.high)]
                for a, b in zip(run, run[1:]):
                    self.after[a].add(b)
                begin, end, skip = {run[0]}, set(run[max(part.low, 1) - 1:]), part.low == 0
            else:
                begin, end, _ = self._chain(part.parts)
                skip = True
            for state in last:
                self.after[state] |= begin
            first |= begin if empty else set()
            last = end | last if skip else end
            empty = empty and skip
        return first, last, empty

    def scan(self, words: Iterable[bytes]) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and the passages ``(template, start, end)`` accepted, the
        first for each start. Of runs that meet in a state the one that began first
        goes on, so of passages that overlap in a replaceable region one is given."""
        found: dict[tuple[int, int], int] = {}
        active: dict[int, int] = {}
        first, accepts = self.first, self.accepts
        at = -1
        for at, word in enumerate(words):
            if not active and word not in first:
                continue
            moved: dict[int, int] = {}
            for state, start in active.items():
                for t in self.by_word[state].get(word, ()):
                    moved[t] = min(start, moved.get(t, start))
                for t in self.by_any[state]:
                    moved[t] = min(start, moved.get(t, start))
            for t in first.get(word, ()):
                moved.setdefault(t, at)
            active = moved
            for state, start in active.items():
                if state in accepts:
                    found.setdefault((accepts[state], start), at + 1)
        return at + 1, [(k, start, end) for (k, start), end in found.items()]


# ── Job ──────────────────────────────────────────────────────────────

FOUND = ("doc_id bigint, n_words bigint,"
         " passages array<struct<template: string, label: string, start: bigint, end: bigint>>")


def find_licenses(
    documents: DataFrame, templates: tuple[Template, ...] = PHRASES + TEMPLATES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, passages`` of every whole text.

    A passage is where a template is accepted: its name and label, the number of
    its first word (from 0) and that after its last, by start, then template.
    Words are runs of digits, letters and all characters beyond ASCII; A-Z count
    as lower case. Null and empty texts have no words. A very long text is read in
    spans and needs memory for its bytes and its passages only. Repeated rows and
    rows without id are scanned row by row. An empty table gives no rows. Other
    columns are not looked at. No row leaves its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        for batch in sliced(batches):
            counts, passages = [], []
            for value in batch.column("text"):
                n, found = automaton.scan(words_of(value.as_py()))
                counts.append(n)
                passages.append([
                    {"template": templates[k].name, "label": templates[k].label, "start": start, "end": end}
                    for k, start, end in sorted(found, key=lambda f: (f[1], f[0], f[2]))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(passages, PASSAGES)],
                names=["doc_id", "n_words", "passages"])

    return picked(documents, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text("text").cast("binary").alias("text"),
    ).mapInArrow(run, FOUND)


PASSAGES = pa.list_(pa.struct([
    ("template", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

#: Mandatory words that make a score of one half.
HALF = 4


def summary(found: DataFrame, templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``:
    the places of the plain phrases, the distinct labels, and ``m / (m + 4)`` for
    the most mandatory words ``m`` that one accepted template has."""
    base = F.filter("passages", lambda p: p["template"].isin(*[t.name for t in PHRASES]))
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    weights = F.create_map(*[F.lit(x) for t in templates for x in (t.name, mandatory_words(t.markup))])
    most: Column = F.coalesce(
        F.array_max(F.transform("passages", lambda p: F.element_at(weights, p["template"]))), F.lit(0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        said(base).alias("base_labels"), said(F.col("passages")).alias("labels"),
        (most / (most + HALF)).alias("score"))


def summary_sql(templates: tuple[Template, ...] = PHRASES + TEMPLATES) -> str:
    """The same over ``documents`` as SQL: words as one string with single blanks,
    templates as regular expressions over it, phrases by word number."""

    def pattern(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += " " + part.decode()
            elif part.replaceable:
                out += f"(?: [^ ]+){{{part.low},{part.high}}}"
            else:
                out += f"(?:{pattern(part.parts)})?"
        return out

    tests = ",\n    ".join(
        f"CASE WHEN regexp_matches(t, '{pattern(parse(x.markup).parts)} ')"
        f" THEN {{'label': '{x.label}', 'words': {mandatory_words(x.markup)}}} END" for x in templates)
    places = ",\n    ".join(
        "list_filter(range(1, len(w) + 1), lambda i: "
        + " AND ".join(f"w[i + {k}] = '{word.decode()}'" for k, word in enumerate(parse(x.markup).parts))
        + f") AS at_{x.label}" for x in PHRASES)
    every = ", ".join(f"at_{x.label}" for x in PHRASES)
    bases = ", ".join(f"CASE WHEN len(at_{x.label}) > 0 THEN '{x.label}' END" for x in PHRASES)
    return rf"""WITH spaced AS (
  SELECT doc_id, trim(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS s FROM documents),
worded AS (
  SELECT doc_id, ' ' || s || ' ' AS t, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS w FROM spaced),
placed AS (
  SELECT doc_id, len(w) AS n_words,
    {places},
    list_filter([{tests}], lambda x: x IS NOT NULL) AS hits
  FROM worded),
joined AS (SELECT *, flatten([{every}]) AS at_all FROM placed)
SELECT doc_id, n_words, len(at_all) AS n_base, list_min(at_all) - 1 AS first_word, list_max(at_all) - 1 AS last_word,
  array_to_string(list_sort(list_filter([{bases}], lambda x: x IS NOT NULL)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.label))), ',') AS labels,
  coalesce(list_max(list_transform(hits, lambda x: x.words)) / (list_max(list_transform(hits, lambda x: x.words)) + {HALF}), 0.0)::DOUBLE AS score
FROM joined"""
