"""License scans: matching statistics of every file against a generalised suffix automaton of licence words.

Long matches are chained into spans of the templates in which they stand. A span counts if it covers at least half of
its template, and of spans that overlap the one that covers most, so a licence is not taken for its neighbour.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import map_rows, text_bytes

#: Phrases whose words, standing consecutively, are a license statement by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: License identifiers of file headers (as words, after "SPDX license identifier"), and names by which notices call
#: licenses. They give labels of their own, not base ones.
IDENTIFIERS = {
    "mit": ("mit",), "apache-2": ("apache 2 0",), "bsd": ("bsd 2 clause", "bsd 3 clause"), "gpl": ("gpl 2 0", "gpl 3 0"), "lgpl": ("lgpl 2 1", "lgpl 3 0"), "agpl": ("agpl 3 0",), "mpl-2": ("mpl 2 0",),
    "isc": ("isc",), "zlib": ("zlib",), "unlicense": ("unlicense",), "cc0": ("cc0 1 0",), "cc-by": ("cc by 4 0",), "cc-by-sa": ("cc by sa 4 0",), "cc-by-nd": ("cc by nd 4 0",), "cc-by-nc": ("cc by nc 4 0",),
    "cc-by-nc-sa": ("cc by nc sa 4 0",), "epl-2": ("epl 2 0",), "bsl-1": ("bsl 1 0",),
}
NAMES = {f"spdx license identifier {name}": label for label, names in IDENTIFIERS.items() for name in names} | {
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2", "eclipse public license": "epl-2", "boost software license": "bsl-1",
}
#: Opening passages of public license texts and notices.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version.""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "cc-by-sa": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
    "cc-by-nd": """This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.""",
    "cc-by-nc-sa": """This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International
        License.""",
    "cc-by-nc-nd": """This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International
        License.""",
    "cc0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
        this work.""",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.
        Licensed under CC BY-NC 4.0.""",
    "all-rights-reserved": """All rights reserved. No part of this publication may be reproduced without prior
        written permission of the copyright holder.""",
}
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LEAST_MATCH = 4
MOST_GAP = 6
LEAST_COVER = 8
LEAST_SHARE = 0.5


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words: runs of digits, a-z and characters beyond ASCII."""
    return WORD.findall(text_bytes(text).lower())


class Automaton:
    """Suffix automaton of several word sequences, kept apart by their numbers. ``places`` of a state are all
    (template, words before its end) where the state's words occur. ``names`` are found like phrases, after whose numbers
    theirs follow."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], names: dict[str, str] | None = None):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest, self.places = [-1], [0], [set()]
        self.phrases = [(words(p), label) for p, label in [*phrases.items(), *(names or {}).items()]]
        self.base = len(phrases)
        self.labels = list(templates)
        self.sizes = [len(words(t)) for t in templates.values()]
        for number, source in enumerate([*(words(t) for t in templates.values()), *(p for p, _ in self.phrases)]):
            last = 0
            for i, w in enumerate(source):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), (number, i + 1))
        self.accepts = [[] for _ in self.next]
        for which, (own, _) in enumerate(self.phrases):
            state = 0
            for w in own:
                state = self.next[state][self.vocabulary[w]]
            self.accepts[state].append((len(own), which))
        by_length = sorted(range(1, len(self.next)), key=self.longest.__getitem__)
        for state in reversed(by_length):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]
        self.places = [sorted(p) for p in self.places]
        for state in by_length:
            self.accepts[state] = self.accepts[state] + self.accepts[self.link[state]]

    def _copy(self, state: int, longest: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.longest.append(longest)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        clone = self._copy(child, self.longest[parent] + 1)
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: int, place: tuple[int, int]) -> int:
        child = self.next[last].get(word)
        if child is not None:
            child = child if self.longest[child] == self.longest[last] + 1 else self._split(last, word, child)
            self.places[child].add(place)
            return child
        self.next.append({})
        self.link.append(0)
        self.longest.append(self.longest[last] + 1)
        self.places.append({place})
        new, parent = len(self.next) - 1, last
        while parent >= 0 and word not in self.next[parent]:
            self.next[parent][word] = new
            parent = self.link[parent]
        if parent >= 0:
            child = self.next[parent][word]
            self.link[new] = child if self.longest[child] == self.longest[parent] + 1 else self._split(parent, word, child)
        return new

    def statistics(self, ids: list[int | None]):
        """(position, state, length) at each word that ends a match: the longest suffix of the words read so far
        that occurs in a template or phrase. Positions with unknown words end every match and are left out."""
        following, link, longest = self.next, self.link, self.longest
        state = length = 0
        for i, w in enumerate(ids):
            if w is None:
                state = length = 0
                continue
            while state and w not in following[state]:
                state = link[state]
                length = longest[state]
            state = following[state].get(w, 0)
            length = length + 1 if state else 0
            yield i, state, length

    def scan(self, ids: list[int | None]) -> tuple[list, list]:
        """Phrase places (start, which), and covered template spans (start, end, template, words covered)."""
        places, runs = [], []
        before = (-9, 0, 0)
        for at in self.statistics(ids):
            i, state, length = at
            for size, which in self.accepts[state]:
                if size <= length:
                    places.append((i - size + 1, which))
            if before[2] >= LEAST_MATCH and length <= before[2]:
                runs.append(before)
            before = at
        if before[2] >= LEAST_MATCH:
            runs.append(before)
        return sorted(places), self._chain(runs)

    def _chain(self, runs: list) -> list:
        """Join right-maximal matches of one template whose places follow one another in text and template; a match is
        tried at all its places in all templates. Of spans that overlap, the one that covers most stays."""
        spans, open_ = [], {}
        for i, state, length in runs:
            a, b = i - length + 1, i + 1
            fits: dict[int, list] = {}
            for number, end in self.places[state]:
                if number < len(self.labels):
                    fits.setdefault(number, []).append(end)
            for number, ends in fits.items():
                was = open_.get(number)
                off = lambda end: abs((a - was[1]) - (end - length - was[4]))  # noqa: E731, B023
                near = [e for e in ends if was and a - was[1] <= MOST_GAP and e >= was[4] and off(e) <= MOST_GAP]
                if near:
                    was[3] += b - max(a, was[1])
                    was[1], was[4] = b, min(near, key=off)
                else:
                    open_[number] = [a, b, number, length, ends[0]]
                    spans.append(open_[number])
        whole = [(a, b, n, c) for a, b, n, c, _ in spans if c >= min(LEAST_COVER, self.sizes[n]) and c >= LEAST_SHARE * self.sizes[n]]
        kept: list[tuple] = []
        for span in sorted(whole, key=lambda x: (-x[3], -x[3] / self.sizes[x[2]], x)):
            if all(span[1] <= k[0] or span[0] >= k[1] for k in kept):
                kept.append(span)
        return sorted(kept)


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict | None = None, templates: dict | None = None, names: dict | None = None
) -> DataFrame:
    """(key, n_words, places array<struct<start,label>>, spans array<struct<start,end,label,covered,share>>) of each
    whole text, in words from 0. ``share`` is the part of the template that the span covers; an identifier or name is a
    span of its own, wholly covered. Null or empty texts have no words; repeated rows are scanned alike; no row is dropped."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    names = NAMES if names is None else names

    def make():
        known = Automaton(phrases, templates, names)
        labels = [label for _, label in known.phrases]
        get = known.vocabulary.get

        def each(keys, texts):
            for k, t in zip(keys, texts, strict=True):
                found = words(t)
                places, spans = known.scan(list(map(get, found)))
                made = [{"start": a, "end": b, "label": known.labels[n], "covered": c, "share": min(1.0, c / known.sizes[n])} for a, b, n, c in spans]
                for a, w in places:
                    if w >= known.base:
                        n = len(known.phrases[w][0])
                        made.append({"start": a, "end": a + n, "label": labels[w], "covered": n, "share": 1.0})
                yield k, len(found), [{"start": a, "label": labels[w]} for a, w in places if w < known.base], sorted(made, key=lambda x: (x["start"], x["end"], x["label"]))

        return each

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_words long, places array<struct<start:long,label:string>>, spans array<struct<start:long,end:long,label:string,covered:long,share:double>>"
    return map_rows(docs.select(key, text), make, schema)


def license_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, labels and a score: 1 for a whole phrase, else the best covered share of a template."""
    starts = F.transform("places", lambda x: x["start"])
    base = F.transform("places", lambda x: x["label"])
    both = F.concat(base, F.transform("spans", lambda x: x["label"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        key, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(both).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
