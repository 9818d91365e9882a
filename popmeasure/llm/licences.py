"""Licence scan: an exact set-similarity join of text blocks with licence templates, and the places of fixed phrases.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lowered. Blocks are windows of words, wherever the lines
break: a template of n words meets a text where n + max(8, n / 4) consecutive words hold at least `threshold` of the
template's distinct words. So a wrapped notice is met, and words scattered over a long line are not. Containment alone
cannot tell licences apart whose notices differ by a word. So a notice also says which words must stand in the window,
one after the other, and which must not: the name and version of the licence, terms that make it another one.

The join is exact and filtered in three ways. Words are ordered by how many documents of the whole corpus hold them,
rarest first (a Spark count of the templates' words over all texts). Prefix: a template with n distinct words that needs
t of them meets a text only if the text holds one of its first n - t + 1 words, so an index of these few words finds the
candidates. Length: the text has at least t distinct words. Position: as the template's words are looked up in order, a
pair is given up as soon as the words left cannot reach t. Windows slide over the texts that are left, from one word of
the template to the next. Templates are given by the caller, `MAX_TEMPLATES` at most.

Phrases are found at every place where their words stand consecutively, across lines, overlapping ones included.

Defined results: null and empty texts have no words, places or labels and score 0. Templates without a word never meet.
The score is the highest containment of any template in any window, 1 where a phrase stands. Repeated documents each keep
their row.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.llm.common import free
from popmeasure.llm.words import plain_words, texts

MAX_TEMPLATES = 10_000

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
class Notice(NamedTuple):
    """A template: label and text, what must stand in a window that meets it, and what must not.

    Each entry lists alternatives with `|`; the words of an alternative stand one after the other.
    """

    label: str
    text: str
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()


_MIT = ("permission is hereby granted free of charge",)
_APACHE = ("apache license version 2|apache license 2|apache licence version 2|apache licence 2",)
_BSD = ("redistribution and use in source and binary forms",)
_MPL = ("mozilla public license|mozilla public licence", "2 0")
_FURTHER_TERMS = ("noncommercial|non commercial|sharealike|share alike|noderivatives|noderivs|no derivatives",)

# Short notices by which works name their licence, and headers of licences, with a label and the words
# that tell it from others. The GNU headers of versions and of their lesser and affero forms share a label.
TEMPLATES = (
    Notice("mit", "Released under the MIT License", ("mit license|mit licence",)),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", _MIT),
    Notice("apache-2", "Licensed under the Apache License, Version 2.0", _APACHE),
    Notice("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",), ("nc sa|nc nd",)),
    Notice(
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution",),
        _FURTHER_TERMS,
    ),
    Notice(
        "gpl-3",
        "This work is licensed under the GNU General Public License, version 3",
        ("gnu general public license|gnu general public licence", "version 3"),
    ),
    Notice("lgpl", "GNU Lesser General Public License (LGPL)", ("lesser general public license|lesser general public licence",)),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", _BSD),
    Notice("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", _MPL),
    Notice("all-rights-reserved", "Copyright. All rights reserved", ("all rights reserved",)),
    Notice(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        (*_MIT, "without restriction"),
    ),
    Notice(
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License.",
        _APACHE,
    ),
    Notice(
        "gnu",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
        ("general public license",),
    ),
    Notice(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
        _BSD,
    ),
    Notice(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        _MPL,
    ),
    Notice(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("permission to use copy modify and or distribute this software",),
    ),
    Notice(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
)


@dataclass(frozen=True)
class TemplateIndex:
    """Templates as words in global order, and for each prefix word the templates it leads to."""

    labels: tuple[str, ...]
    words: tuple[tuple[bytes, ...], ...]
    sets: tuple[frozenset[bytes], ...]
    spans: tuple[int, ...]
    needed: tuple[int, ...]
    required: tuple[tuple[tuple[bytes, ...], ...], ...]
    forbidden: tuple[tuple[tuple[bytes, ...], ...], ...]
    by_word: Mapping[bytes, tuple[int, ...]]

    @classmethod
    def of(cls, templates: Sequence[Notice | tuple[str, str]], frequency: Mapping[bytes, int], threshold: float) -> TemplateIndex:
        labels, words, spans, needed, required, forbidden, by_word = [], [], [], [], [], [], {}
        for template in templates:
            label, text, must, must_not = Notice(*template)
            listed = plain_words(text)
            ordered = sorted(set(listed), key=lambda w: (frequency.get(w, 0), w))
            if not ordered:
                continue
            least = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            for word in ordered[: len(ordered) - least + 1]:
                by_word.setdefault(word, []).append(len(labels))
            labels.append(label)
            words.append(tuple(ordered))
            spans.append(len(listed) + max(8, len(listed) // 4))
            needed.append(least)
            required.append(tuple(tuple(b" ".join(plain_words(p)) for p in entry.split("|")) for entry in must))
            forbidden.append(tuple(tuple(b" ".join(plain_words(p)) for p in entry.split("|")) for entry in must_not))
        sets = tuple(map(frozenset, words))
        index = {w: tuple(t) for w, t in by_word.items()}
        told = tuple(required), tuple(forbidden)
        return cls(tuple(labels), tuple(words), sets, tuple(spans), tuple(needed), *told, index)

    def _told_apart(self, t: int, window: list[bytes]) -> bool:
        """The window holds what the template requires and nothing that it forbids."""
        if not (self.required[t] or self.forbidden[t]):
            return True
        text = b" %b " % b" ".join(window)
        here = lambda entry: any(b" %b " % p in text for p in entry)
        return all(map(here, self.required[t])) and not any(map(here, self.forbidden[t]))

    def met(self, block: set[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of the templates that the block meets."""
        return [(self.labels[t], held / len(self.words[t])) for t, held in self._meeting(block)]

    def _meeting(self, block: set[bytes]) -> list[tuple[int, int]]:
        """(template, words held) of the templates that the block meets."""
        candidates = {t for w in block & self.by_word.keys() for t in self.by_word[w]}
        out = []
        for t in sorted(candidates):
            words, least = self.words[t], self.needed[t]
            if len(block) < least:
                continue
            held = 0
            for place, word in enumerate(words):
                held += word in block
                if held + len(words) - place - 1 < least:
                    break
            else:
                out.append((t, held))
        return out

    def windows(self, words: list[bytes], held: set[bytes]) -> list[tuple[int, str, float]]:
        """(first word, label, containment) of the best window in every run of windows that meet a template.

        `held` is the set of the words.
        """
        out = []
        for t, _ in self._meeting(held):
            own, span, least = self.sets[t], self.spans[t], self.needed[t]
            at = [i for i, w in enumerate(words) if w in own]
            inside: Counter = Counter()
            first, best = 0, (0, 0)
            for i in at:
                inside[words[i]] += 1
                while at[first] <= i - span:
                    gone = words[at[first]]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    first += 1
                if len(inside) < least:
                    if best[1]:
                        out.append((best[0], self.labels[t], best[1] / len(own)))
                    best = (0, 0)
                elif len(inside) > best[1] and self._told_apart(t, words[at[first] : at[first] + span]):
                    best = (at[first], len(inside))
            if best[1]:
                out.append((best[0], self.labels[t], best[1] / len(own)))
        return sorted(out)


def word_frequencies(docs: DataFrame, words: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents of the whole corpus each of the given words occurs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: Counter = Counter()
            for value in texts(frame):
                counts.update(words.intersection(plain_words(value)))
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    slim = docs.select(F.col(text).alias("text"))
    found = slim.mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}  # the templates' words, no others


def phrase_places(words: list[bytes], phrases: Sequence[list[bytes]]) -> list[tuple[int, int]]:
    """(start, number of the phrase) of every place."""
    out = []
    for k, phrase in enumerate(phrases):
        place = -1
        try:
            while phrase:
                place = words.index(phrase[0], place + 1)
                if words[place : place + len(phrase)] == phrase:
                    out.append((place, k))
        except ValueError:
            pass
    return out


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[Notice | tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per document row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    `blocks` lists the windows that met a template: line of the first word, label, containment.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"over {MAX_TEMPLATES} templates")
    vocabulary = {w for template in templates for w in plain_words(template[1])}
    index = TemplateIndex.of(templates, word_frequencies(docs, vocabulary, text), threshold)
    listed = [(plain_words(p), label) for p, label in phrases.items()]
    prefix = frozenset(index.by_word)

    def one(value: str | None) -> tuple:
        words = plain_words(value)
        held = set(words)
        asked = [(p, label) for p, label in listed if held.issuperset(p)]
        places = phrase_places(words, [p for p, _ in asked])
        base = {asked[k][1] for _, k in places}
        blocks = []
        if held & prefix:
            blocks = index.windows(words, held)
        if blocks:
            ends = list(accumulate(len(plain_words(line)) for line in value.split("\n")))
            blocks = [(bisect_right(ends, start), label, share) for start, label, share in blocks]
        starts = [s for s, _ in places]
        return (
            len(words),
            len(places),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(base | {label for _, label, _ in blocks})),
            max([1.0] * bool(places) + [share for _, _, share in blocks], default=0.0),
            [{"line": n, "label": label, "containment": share} for n, label, share in blocks],
        )

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = pd.DataFrame([one(t) for t in texts(frame)], columns=names, index=frame.index)
            for c in ("first_word", "last_word"):
                made[c] = made[c].astype("Int64")
            yield pd.concat([frame[["id"]], made], axis=1)

    slim = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"))
    schema = (
        "id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, blocks array<struct<line:int,label:string,containment:double>>"
    )
    (own,) = free(slim.sparkSession.createDataFrame([], schema), id_column)
    kind = docs.schema[id_column].dataType
    return slim.mapInPandas(run, schema).select(F.col("id").cast(kind).alias(own), *names)
