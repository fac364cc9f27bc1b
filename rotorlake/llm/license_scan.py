"""Operator 3: licence scans with a generalised suffix automaton over licence templates.

The templates' words become one automaton of all their substrings (a separate branch per template).
Each file's words are streamed through it; after every word the automaton's depth is the matching
statistic, the longest suffix of the file so far that stands in some template.  Along the suffix links stand
the shorter suffixes that other templates hold.  Matches of at least ``MIN_MATCH`` words that the next word ends
are anchors, for every template by itself; anchors of one template that follow each other in file and
template with gaps of at most ``MAX_GAP`` words are chained into spans, and the share of the template
that the best chain covers is the file's score for it.  All chains of enough cover are reported as ``spans``.

Words outside the templates' vocabulary reset the automaton, so runs of vocabulary words shorter than
``MIN_MATCH`` cannot hold an anchor and are skipped without walking them; the result is the same.

Null and empty texts have no words, no labels and score 0; very long ones are scanned whole, in time
proportional to their length.  Repeated rows are scanned one by one; rows of null id like others.  Ties between
templates go to the first by name, between chains to the first in the file.  Extra columns are ignored, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import read
from .textkernels import ALNUM, LOWER, span_hashes, texts

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices as commonly printed above or below a work, and licence texts (fixed values); names end in their kind.
TEMPLATES = {
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom
        the software is furnished to do so subject to the following conditions the above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the software the software is provided as is without
        warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a
        particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim
        damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with
        the software or the use or other dealings in the software""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "apache": "licensed under the apache license version 2 0",
    "apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-text": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable
        law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties
        or conditions of any kind either express or implied see the license for the specific language governing permissions and
        limitations under the license""",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-text": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any later version
        this program is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you
        should have received a copy of the gnu general public license along with this program""",
    "lgpl-notice": """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser
        general public license as published by the free software foundation""",
    "agpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu affero
        general public license as published by the free software foundation""",
    "mpl-notice": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at""",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution this software is provided by the copyright holders and contributors as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose
        are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
        special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
        strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
        advised of the possibility of such damage""",
    "zlib-text": """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use
        this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        altered source versions must be plainly marked as such and must not be misrepresented as being the original software this
        notice may not be removed or altered from any source distribution""",
    "unlicense-text": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial
        or non commercial and by any means""",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by": "licensed under cc by 4 0",
}
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 4, 0.75


def label_of(template: str) -> str:
    """A template's label: its name without its kind."""
    return template.removesuffix("-grant").removesuffix("-notice").removesuffix("-text")


def template_words(text: str) -> list[str]:
    return text.lower().split()


class SuffixAutomaton:
    """All substrings of several word sequences; states carry one place (template, end) of their words."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length, self.places = [{}], [-1], [0], [set()]
        for which, seq in enumerate(sequences):
            last = 0
            for at, word in enumerate(seq):
                last = self._extend(last, word)
                self.places[last].add((which, at))
        # a state's places include those of all states whose suffix link leads to it
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.places[self.link[state]] |= self.places[state]

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, q, word)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _state(self, arcs: dict, length: int) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(depth, state) after each word."""
        out, state, depth = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                depth = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                depth += 1
            out.append((depth, state))
        return out

    def held(self, state: int, depth: int, least: int) -> dict[tuple[int, int], int]:
        """Places (template, end) of suffixes of at least ``least`` words after a word, with their lengths."""
        out: dict[tuple[int, int], int] = {}
        while state and depth >= least:
            for place in self.places[state]:
                out.setdefault(place, depth)
            state = self.link[state]
            depth = self.length[state]
        return out

    def anchors(self, words: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """Matches that the next word ends, as (file start, length, template, template start)."""
        out, before = [], {}
        for i, (depth, state) in enumerate([*self.statistics(words), (0, 0)]):
            now = self.held(state, depth, least) if depth >= least else {}
            out += [(i - n, n, t, end - n + 1) for (t, end), n in sorted(before.items()) if (t, end + 1) not in now]
            before = now
        return out


def chain(anchors: list[tuple[int, int, int, int]], max_gap: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Chains by template: (first word, words spanned, template words covered, first template word).

    Anchors join in order of file place when both gaps are between 0 and ``max_gap``; of several chains
    that an anchor could extend, the one with most words covered wins, then the earliest.  Only chains that
    end within ``max_gap`` words can still be extended and are looked at.
    """
    done: dict[int, list[list[int]]] = {}
    open_: dict[int, list[list[int]]] = {}
    for start, n, t, at in sorted(anchors):
        near = open_[t] = [c for c in open_.get(t, ()) if start - c[1] <= max_gap]
        fits = [c for c in near if start >= c[1] and 0 <= at - c[4] <= max_gap]
        if fits:
            c = max(fits, key=lambda c: (c[2], -c[0]))
            new = [c[0], start + n, c[2] + n, c[3], at + n]
        else:
            new = [start, start + n, n, at, at + n]
        near.append(new)
        done.setdefault(t, []).append(new)
    return {t: [(a, b - a, n, at) for a, b, n, at, _ in c] for t, c in done.items()}


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases=PHRASES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        self.names = sorted(templates)
        words = [template_words(templates[n]) for n in self.names]
        phrase_words = [(template_words(p), label) for p, label in phrases]
        vocabulary = sorted({w for seq in [*words, *(p for p, _ in phrase_words)] for w in seq})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        joined = np.frombuffer("".join(vocabulary).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in vocabulary])
        h = span_hashes(joined, np.append(0, ends[:-1]), ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.sizes = [len(w) for w in words]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in seq] for seq in words])
        self.phrases = [(np.array([self.ids[w] for w in p]), label) for p, label in phrase_words]
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary id of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def spans(self, ids: np.ndarray) -> tuple[dict[int, tuple[float, int, int]], list[dict]]:
        """Per template index the best covered share, first word and words; and all spans of enough cover, one per first word."""
        known = np.concatenate(([False], ids >= 0, [False]))
        flips = np.flatnonzero(known[1:] != known[:-1])
        anchors = []
        for a, b in zip(flips[::2], flips[1::2]):
            if b - a >= min(self.min_match, *self.sizes):
                anchors += [(int(a) + s, n, t, at) for s, n, t, at in self.automaton.anchors(ids[a:b].tolist(), self.min_match)]
        out, found = {}, []
        for t, chains in sorted(chain(anchors, self.max_gap).items()):
            first, n, covered, _ = max(chains, key=lambda c: (c[2], -c[0]))
            out[t] = (covered / self.sizes[t], first, n)
            whole: dict[int, tuple] = {}
            for first, n, covered, _ in chains:
                if covered >= self.min_cover * self.sizes[t]:
                    whole[first] = max(whole.get(first, (0, 0)), (covered, n))
            found += [{"template": self.names[t], "first": a, "words": n, "cover": min(1.0, c / self.sizes[t])} for a, (c, n) in sorted(whole.items())]
        return out, found


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template string, span_first long, span_words long, spans array<struct<template:string,first:long,words:long,cover:double>>"


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id and ``COLUMNS`` for every row of docs(doc_id, text)."""
    scanner = scanner or Scanner()
    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(COLUMNS).fields])
    shape = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("template", pa.string()), ("span_first", pa.int64()), ("span_words", pa.int64()), ("spans", pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("cover", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            for c in texts(b.column("text")):
                data = LOWER[c.data]
                starts, ends, first = c.words(ALNUM, data)
                ids = scanner.word_ids(span_hashes(data, starts, ends))
                bounds = first.tolist()
                places: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in scanner.phrases:
                    n = len(phrase)
                    if len(ids) < n:
                        continue
                    hit = np.ones(len(ids) - n + 1, bool)
                    for j, w in enumerate(phrase):
                        hit &= ids[j : len(ids) - n + 1 + j] == w
                    for at in np.flatnonzero(hit).tolist():
                        k = int(np.searchsorted(first, at, "right")) - 1
                        if at + n <= bounds[k + 1]:
                            places.setdefault(k, []).append((at - bounds[k], label))
                # only texts with a long enough run of vocabulary words can hold an anchor
                run_of = np.convolve(ids >= 0, np.ones(scanner.min_match), "valid") >= scanner.min_match - 0.5 if len(ids) >= scanner.min_match else np.zeros(0, bool)
                walk = set((np.searchsorted(first, np.flatnonzero(run_of), "right") - 1).tolist())
                for k in range(c.n):
                    n = bounds[k + 1] - bounds[k]
                    if k not in walk and k not in places:
                        found.append((n, 0, None, None, "", "", 0.0, None, None, None, []))
                        continue
                    spans, whole = scanner.spans(ids[bounds[k] : bounds[k + 1]]) if k in walk else ({}, [])
                    base = places.get(k, [])
                    base_labels = {label for _, label in base}
                    own = {label_of(scanner.names[t]) for t, (cover, _, _) in spans.items() if cover >= scanner.min_cover}
                    best = max(spans.items(), key=lambda x: (x[1][0], -x[0]), default=None)
                    score = max([best[1][0] if best else 0.0, 1.0 if base else 0.0])
                    found.append((n, len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | own)), min(1.0, score), scanner.names[best[0]] if best else None, best and best[1][1], best and best[1][2], whole))
            columns = list(zip(*found)) if found else [[] for _ in shape]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(v), f.type) for v, f in zip(columns, shape))], names=["doc_id", *shape.names])

    return rows.mapInArrow(run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
