"""License scans (4): a generalised suffix automaton of licence tokens.

Words of all templates, numbered, make one suffix automaton. A text's words stream through it and give
matching statistics: at every word, the longest run ending there that some template holds, and the state
that names it. Three things are read off:

- base phrases: a phrase ends at a word if its own state lies on the suffix path of the current state;
- long matches: for each template, runs of `MIN_RUN` words or more (or whole shorter templates) that this
  template does not continue as the text does, whatever longer runs other templates have there;
- spans: long matches of one template whose template places go up are chained over gaps of at most
  `MAX_GAP` words; a chain that covers `MIN_COVER` of the template is a licence span and gives its label.

Only runs of two or more template words are streamed (base phrases and templates have two words at least);
all other words reset the automaton, as they would anyway.

Edge cases: null text is empty: no words, no labels, score 0; a phrase that occurs several times counts every
time, overlapping ones too; texts of any length are streamed whole; repeated rows are scanned one by one; an empty table gives an empty result; other
columns pass through. Added columns: see `scan`; they replace columns of these names; working columns start with `__li_`.
"""

from __future__ import annotations

import re
from collections import deque
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.registry import query, table
from plumbline.llm.shared import replaced
from plumbline.llm.tokens import ALNUM, hash_spans, slices, word_spans

#: Base phrases and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of common licences, as their authors ask users to put them into files: fixed values.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Licensed under the MIT License",
        "released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal Public Domain Dedication"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
}

MIN_RUN = 4
MAX_GAP = 8
MIN_COVER = 0.8


def words_in(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


class Automaton:
    """A generalised suffix automaton of numbered words, with the templates in which each state's words stand."""

    def __init__(self, texts: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        #: (template, end) of each state's occurrences, filled along suffix links.
        self.ends: list[set] = [set()]
        for t, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((t, i + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        """Blumer's online step, for words that may be there already."""
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def walk(self, words: list[int]) -> list[int]:
        state = 0
        for w in words:
            state = self.next[state][w]
        return [state]

    def statistics(self, words: list[int]) -> tuple[list[int], list[int]]:
        """State and length of the longest match that ends at each word."""
        states, lengths, state, length = [], [], 0, 0
        following, link, longest = self.next, self.link, self.length
        for w in words:
            while state and w not in following[state]:
                state = link[state]
                length = longest[state]
            state = following[state].get(w, 0)
            length = length + 1 if state else 0
            states.append(state)
            lengths.append(length)
        return states, lengths


class Scanner:
    """The automaton of base phrases and templates, with what a state tells."""

    def __init__(self, base: dict[str, str], templates: dict[str, list[str]]):
        phrases = [(words_in(p), label) for p, label in base.items()]
        notices = [(words_in(t), label) for label, texts in templates.items() for t in texts]
        vocabulary = sorted({w for ws, _ in phrases + notices for w in ws})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        joined = b" ".join(vocabulary)
        starts, stops, _ = word_spans(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), ALNUM)
        hashes = hash_spans(np.frombuffer(joined, np.uint8), starts, stops)
        turn = np.argsort(hashes)
        self.hashes, self.numbers = hashes[turn], turn + 1
        self.low = np.zeros(1 << 20, bool)
        self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.texts = [[number[w] for w in ws] for ws, _ in phrases + notices]
        self.labels = [label for _, label in phrases + notices]
        self.phrases = len(phrases)
        self.automaton = Automaton(self.texts)
        at = {}
        for i in range(self.phrases):
            state = self.automaton.walk(self.texts[i])[0]
            at.setdefault(state, []).append(i)
        #: Base phrases that end in each state: (phrase, words), along its suffix links.
        self.told: list[list] = []
        for s in range(len(self.automaton.next)):
            found, t = [], s
            while t > 0:
                found += at.get(t, [])
                t = self.automaton.link[t]
            self.told.append([(i, len(self.texts[i])) for i in found])
        #: The least words that a match of each template must have.
        self.least = [min(MIN_RUN, len(ws)) for ws in self.texts]
        self.shortest = min(self.least[self.phrases :], default=MIN_RUN)
        #: Filled as states come: see `held`.
        self.kept: dict[int, list] = {}

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            k = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[k] == hashes[maybe], self.numbers[k], 0)
        return out

    def held(self, state: int) -> list:
        """(template, words, ends) of the longest match of each template that ends where this state's does;
        0 words stand for the whole match. Templates of shorter matches lie on the suffix links."""
        if (out := self.kept.get(state)) is None:
            out, seen, s = [], set(), state
            while s > 0 and (s == state or self.automaton.length[s] >= self.shortest):
                ends: dict[int, list] = {}
                for t, end in self.automaton.ends[s]:
                    if t >= self.phrases and t not in seen:
                        ends.setdefault(t, []).append(end)
                out += [(t, 0 if s == state else self.automaton.length[s], e) for t, e in ends.items()]
                seen |= ends.keys()
                s = self.automaton.link[s]
            self.kept[state] = out
        return out

    def run(self, numbers: list[int], at: int, base: list, matches: list) -> None:
        """Stream a run of template words that begins at word `at`; add base places and long matches."""
        states, lengths = self.automaton.statistics(numbers)
        before: dict[int, tuple] = {}  # template: words and ends of its match that ends at the word before
        for i, (state, length) in enumerate(zip([*states, 0], [*lengths, 0])):
            now = {t: (n or length, ends) for t, n, ends in self.held(state)} if length >= self.shortest else {}
            for t, (n, ends) in before.items():
                if n >= self.least[t] and now.get(t, (0,))[0] <= n:  # the template cannot make it longer to the right
                    matches.extend((t, at + i - n, end - n, n) for end in ends)
            before = now
            for phrase, n in self.told[state]:
                if n <= length:
                    base.append((at + i - n + 1, phrase))

    def spans(self, matches: list) -> list[dict]:
        """Chains of a template's matches, in order and apart both in the text and in the template, over gaps of at
        most MAX_GAP words of text, that cover enough of it."""
        out = []
        by_template: dict[int, list] = {}
        for t, word, place, n in matches:
            by_template.setdefault(t, []).append((word, place, n))
        for t, found in sorted(by_template.items()):
            size = len(self.texts[t])
            for covered, begin, stop in chains(sorted(set(found)), MIN_COVER * size):
                out.append({"label": self.labels[t], "word": begin, "words": stop - begin, "cover": covered / size})
        return out


def best_chain(found: list) -> tuple[int, int, int]:
    """(words covered, first word, end) of the heaviest chain of matches (word, place, n), sorted. The matches that may
    come before one end within MAX_GAP words of text, so only these are looked at; of several heaviest chains the one
    in the middle is taken."""
    weight, begin, active = [], [], deque()
    order = sorted(range(len(found)), key=lambda i: found[i][0] + found[i][2])  # by end in the text
    nxt = 0
    for j, (word, place, n) in enumerate(found):
        while nxt < len(order) and found[order[nxt]][0] + found[order[nxt]][2] <= word:
            active.append(order[nxt])  # ends before this one begins, hence has its weight already
            nxt += 1
        while active and word - found[active[0]][0] - found[active[0]][2] > MAX_GAP:
            active.popleft()
        best = max((i for i in active if found[i][1] + found[i][2] <= place), key=lambda i: (weight[i], begin[i]), default=None)
        weight.append(n + (weight[best] if best is not None else 0))
        begin.append(begin[best] if best is not None else word)
    top = max(weight)
    at = [j for j, w in enumerate(weight) if w == top]
    j = at[len(at) // 2]
    return top, begin[j], found[j][0] + found[j][2]


def chains(found: list, least: float) -> list[tuple[int, int, int]]:
    """The heaviest chain, then those of the words before and after it, as long as they cover enough."""
    out, todo = [], []
    run, end = [], 0
    for m in found:  # no chain goes over a longer gap
        if run and m[0] - end > MAX_GAP:
            todo.append(run)
            run, end = [], 0
        run.append(m)
        end = max(end, m[0] + m[2])
    if run:
        todo.append(run)
    while todo:
        run = todo.pop()
        if sum(n for _, _, n in run) < least:
            continue
        covered, begin, stop = best_chain(run)
        if covered >= least:
            out.append((covered, begin, stop))
            todo += [part for part in ([m for m in run if m[0] + m[2] <= begin], [m for m in run if m[0] >= stop]) if part]
    return sorted(out, key=lambda c: c[1])


SPAN = "struct<label:string,word:bigint,words:bigint,cover:double>"


def scan(docs: DataFrame, text: str = "text", base: dict | None = None, templates: dict | None = None) -> DataFrame:
    """docs with `n_words`, `n_base` (all places of base phrases), `first_word` and `last_word` (their smallest
    and largest start), `base_labels`, `spans` (label, first word, words, covered share of the template),
    `labels` (base and template ones) and `score`: 1 for a whole base phrase, else the best covered share."""
    docs = replaced(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "labels", "score")
    spark, columns = docs.sparkSession, docs.columns
    shared = spark.sparkContext.broadcast((base or BASE, templates or TEMPLATES))
    added = T._parse_datatype_string(f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<{SPAN}>, labels array<string>, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("cover", pa.float64())])), pa.list_(pa.string()), pa.float64()]
        for batch in batches:
            out = [[] for _ in kinds]
            for lo, hi, data, rows in slices(batch.column(text)):
                starts, stops, first = word_spans(data, rows, ALNUM)
                numbers = scanner.word_numbers(hash_spans(data, starts, stops))
                count = np.diff(first)
                # runs of two or more template words, cut at texts' ends
                row = np.repeat(np.arange(hi - lo), count)
                known = numbers > 0
                joined = known[1:] & known[:-1] & (row[1:] == row[:-1]) if len(known) else known
                edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))) if len(known) else np.zeros(0, int)
                places, matches = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                listed = numbers.tolist()
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    r = int(row[a])
                    scanner.run(listed[a : b + 1], a - int(first[r]), places[r], matches[r])
                for r in range(hi - lo):
                    found, spans = places[r], scanner.spans(matches[r]) if matches[r] else []
                    named = sorted({scanner.labels[p] for _, p in found})
                    at = [w for w, _ in found]
                    for column, value in zip(out, (int(count[r]), len(found), min(at, default=None), max(at, default=None), named, spans, sorted({*named, *(s["label"] for s in spans)}), 1.0 if found else max((min(1.0, s["cover"]) for s in spans), default=0.0))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(v, k) for v, k in zip(out, kinds))], [*columns, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


@query("op4_suffix_automaton_licences")
def _(spark, sf):
    found = scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
