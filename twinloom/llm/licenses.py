"""License scans: generalised suffix automaton of licence tokens.

The tokens of all templates and phrases go into one suffix automaton. A text streams through it once: after each
word the automaton holds the longest stretch of template tokens that ends there (matching statistics). The longest
stretch of each single template is the first state along suffix links that it has a place in; those that the next word
doesn't lengthen are the template's hits, whatever longer stretch another template has there.

A template's hits are chained: a hit follows another if it goes on in the text and in the template, by no more than the
template's length in the text. For each hit, of the chains that end there, the one counts that covers most of the template (of equal
ones, that with the shortest gaps). Those that cover COVERED of it are spans, best first, if they share no word with a
span before them; the hits left between spans are chained again, so that every copy has its span. A template with a
span gives its label. Whole phrases are the automaton's accepting states, met along suffix links at every word.

Null and empty texts give counts 0, null places, empty labels and score 0. Rows are scanned on their own: repeated rows
stay rows with equal results. Templates that are equally covered all give their labels. An empty table gives an empty
result. Columns beside key and text don't matter.
"""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C

# Phrases whose every place counts, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening notices and grants of public licences, as their stewards publish them.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
}

#: A match is long from this many tokens (or all tokens of a shorter template); a template counts from this covered share.
LONG_MATCH, COVERED = 4, 0.8

_TABLE = C.word_table("alnum")


def _tokens(text: str) -> list[str]:
    return "".join(chr(c) if (c := _TABLE[b]) else " " for b in text.encode()).split()


class SuffixAutomaton:
    """Of several token sequences: next, link, longest, and per state one place (sequence, end) of its strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.accepts: list[list[int]] = [[]]
        self.places: list[list[tuple[int, int]]] = [[]]
        ends = []
        for k, seq in enumerate(sequences):
            last = 0
            for i, token in enumerate(seq):
                last = self._extend(last, token)
                ends.append((last, k, i))
        for k, seq in enumerate(sequences):
            v = 0
            for token in seq:
                v = self.next[v][token]
            self.accepts[v].append(k)
        for state, k, i in ends:  # every state's end places are those of the prefixes below it in the link tree
            while state > 0:
                self.places[state].append((k, i))
                state = self.link[state]
        chain: list[list[int]] = [[] for _ in self.next]
        for v in sorted(range(1, len(self.next)), key=self.longest.__getitem__):
            chain[v] = chain[self.link[v]] + [(k, len(sequences[k])) for k in self.accepts[v]]
        self.ending = chain

    def _state(self, longest: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.longest.append(longest)
        self.accepts.append([])
        self.places.append([])
        return len(self.next) - 1

    def _clone(self, p: int, q: int, token: int) -> int:
        c = self._state(self.longest[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # another sequence has this already
            return q if self.longest[q] == self.longest[last] + 1 else self._clone(last, q, token)
        new, p = self._state(self.longest[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._clone(p, q, token)
        return new

    def statistics(self, tokens):
        """After each token: the state and the length of the longest match that ends there."""
        nxt, link, longest = self.next, self.link, self.longest
        v = n = 0
        for t in tokens:
            while v and t not in nxt[v]:
                v = link[v]
                n = longest[v]
            if (w := nxt[v].get(t)) is not None:
                v, n = w, n + 1
            yield v, n


def chains(hits: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Of hits (start, place, tokens), sorted: by hit, covered tokens, less the gaps, and first word of its best chain.

    Where two hits overlap, in the text or the template, the second counts without its first tokens.
    """
    best: list[tuple[int, int, int]] = []
    low = 0
    for start, place, n in hits:
        while hits[low][0] + 2 * size < start:  # no hit is longer than the template
            low += 1
        own = (n, 0, start)
        for j in range(low, len(best)):
            s, p, m = hits[j]
            cut = max(s + m - start, p + m - place, 0)
            gap = start + cut - s - m
            if cut < n and gap <= size and s < start and p < place:
                own = max(own, (best[j][0] + n - cut, best[j][1] - gap, best[j][2]))
        best.append(own)
    return best


def spans_of(hits: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, float]]:
    """First word, last word and covered share of a template's spans."""
    found: list[tuple[int, int, float]] = []
    left = sorted(set(hits))
    while left:
        ends = [(-c, -g, first, start + n - 1) for (c, g, first), (start, _, n) in zip(chains(left, size), left, strict=True) if c >= COVERED * size]
        new: list[tuple[int, int]] = []
        for c, _, first, last in sorted(ends):
            at = bisect(new, (first, last))
            if (at == 0 or new[at - 1][1] < first) and (at == len(new) or new[at][0] > last):
                new.insert(at, (first, last))
                found.append((first, last, -c / size))
        if not new:
            break
        starts = [x[0] for x in new]
        free = lambda a, b: (at := bisect(starts, b)) == 0 or new[at - 1][1] < a
        left = [h for h in left if free(h[0], h[0] + h[2] - 1)]
    return sorted(found)


class Scanner:
    """Templates and base phrases in one automaton, and the scan of one text."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.names = [*phrases.values(), *(name for name, texts in templates.items() for _ in texts)]
        texts = [*phrases, *(x for v in templates.values() for x in v)]
        split = [_tokens(x) for x in texts]
        vocabulary = sorted({w for s in split for w in s})
        self.hashes = C.hash_words(vocabulary, _TABLE)
        order = np.argsort(self.hashes)
        self.hashes, ids = self.hashes[order], order
        self.ids, self.n_base = ids.astype(np.int64), len(phrases)
        index = {w: i for i, w in enumerate(vocabulary)}
        self.sequences = [[index[w] for w in s] for s in split]
        self.automaton = a = SuffixAutomaton(self.sequences)
        #: Of each state: by template, the state of its longest stretch that ends there, from LONG_MATCH tokens.
        self.held: list[dict[int, int]] = [{} for _ in a.next]
        for v in sorted(range(1, len(a.next)), key=a.longest.__getitem__):
            if a.longest[v] >= LONG_MATCH:
                self.held[v] = self.held[a.link[v]] | {k: v for k, _ in a.places[v] if k >= self.n_base}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Base phrases as (phrase, start), and templates as (template, first word, last word, covered share)."""
        a, base, long_ = self.automaton, [], {}
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return [], []
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        for run in np.split(known, cuts):
            at, before = int(run[0]), {}
            for i, (v, n) in enumerate(a.statistics(ids[run].tolist())):
                for k, m in a.ending[v]:
                    if m <= n:
                        if k < self.n_base:
                            base.append((k, at + i - m + 1))
                        elif m < LONG_MATCH:
                            long_.setdefault(k, []).append((at + i - m + 1, 0, m))
                now = {k: (u, n if u == v else a.longest[u], i) for k, u in self.held[v].items()} if n >= LONG_MATCH else {}
                for k, x in before.items():
                    if k not in now or now[k][1] <= x[1]:  # the match before was maximal
                        self._long(long_, at, k, *x)
                before = now
            for k, x in before.items():
                self._long(long_, at, k, *x)
        return base, sorted((k, first, last, share) for k, hits in long_.items() for first, last, share in spans_of(hits, len(self.sequences[k])))

    def _long(self, long_: dict, at: int, k: int, v: int, n: int, i: int) -> None:
        long_.setdefault(k, []).extend((at + i - n + 1, end - n + 1, n) for j, end in self.automaton.places[v] if j == k)


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """One row per input row: key, n_words, base (phrase label, word), spans (label, first, last word, covered share)."""

    def make():
        scanner = Scanner(templates, phrases)

        def step(part: pa.RecordBatch):
            _, hashes, per = C.words(C.texts_of(part.column(1).fill_null("")), _TABLE)
            ids = scanner.lookup(hashes)
            base, spans = [], []
            for i in range(len(per) - 1):
                b, s = scanner.scan(ids[per[i] : per[i + 1]])
                base.append([{"label": scanner.names[k], "word": w} for k, w in b])
                spans.append([{"label": scanner.names[k], "first_word": f, "last_word": l, "covered": c} for k, f, l, c in s])
            place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
            span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())]))
            return [part.column(0), pa.array(np.diff(per).astype(np.int64)), pa.array(base, place), pa.array(spans, span)]

        return step

    return C.text_map(df, [key, text], make, f"{key} {C.type_of(df, key)}, n_words long, base array<struct<label:string,word:bigint>>, spans array<struct<label:string,first_word:bigint,last_word:bigint,covered:double>>")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, places, labels and a score: the largest covered share, or 0.5 to 1 by the number of base places."""
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(x)["label"] for x in c)))), ",")
    n = F.size("base").cast("long")
    share = F.coalesce(F.array_max(F.col("spans")["covered"]), F.lit(0.0))
    return found.select(
        key, "n_words", n.alias("n_base"), F.array_min(F.col("base")["word"]).alias("first_word"), F.array_max(F.col("base")["word"]).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "spans").alias("labels"), F.greatest(share, F.when(n > 0, 1.0 - F.pow(F.lit(0.5), n)).otherwise(0.0)).alias("score"),
    )
