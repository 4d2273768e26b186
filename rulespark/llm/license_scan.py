"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of all templates. A text's words stream through it, giving the length of the longest
run of template words that ends at each word (matching statistics). Runs of MIN_MATCH words or more are placed in every template
that has them and chained, in text and template order, over gaps of at most MAX_GAP words, into covered template spans. A
template whose span covers at least MIN_COVER of it gives its label; the score is the largest cover. Words are first looked up in
the templates' vocabulary, and only runs of word pairs that the templates have are streamed: nothing else can match.

Base phrases are looked for in the same looked-up words. Defined cases: null and empty texts have no words, no labels and score 0;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import ALNUM, LOWER, blocks, prefix, read, span_hash, spans

MIN_MATCH, MAX_GAP, MIN_COVER = 4, 12, 0.5
# Phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Openings and notices of public licences, by label.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
SPANS = "array<struct<label:string,from_word:int,to_word:int,template_from:int,template_to:int,matched:int>>"


def tokens(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and their hashes."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = spans(ALNUM[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s, e, strict=True)], span_hash(prefix(data), s, e)


@dataclass
class Automaton:
    """A suffix automaton of several sequences; ends: the places (sequence, end) of a state's runs."""

    follow: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _new(self, size: int, follow: dict[int, int], link: int) -> int:
        self.follow.append(follow)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        twin = self._new(self.size[p] + 1, dict(self.follow[q]), self.link[q])
        while p >= 0 and self.follow[p].get(x) == q:
            self.follow[p][x] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def add(self, sequence: list[int], name: int) -> None:
        last = 0
        for end, x in enumerate(sequence, 1):
            q = self.follow[last].get(x)
            if q is not None:  # an earlier sequence has this run
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, q, x)
            else:
                p, last = last, self._new(self.size[last] + 1, {}, 0)
                while p >= 0 and x not in self.follow[p]:
                    self.follow[p][x] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.follow[p][x]
                    self.link[last] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, x)
            self.ends[last].add((name, end))

    def close(self) -> None:
        """Gives every state the places of the states that it is a suffix of."""
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest run that ends here) after each item."""
        v, n = 0, 0
        for x in sequence:
            while v and x not in self.follow[v]:
                v = self.link[v]
                n = self.size[v]
            if x in self.follow[v]:
                v, n = self.follow[v][x], n + 1
            yield v, n


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = {k: tokens(t) for k, t in templates.items()}
        known = {p: tokens(p) for p in phrases}
        self.hashes = np.unique(np.concatenate([h for _, h in [*texts.values(), *known.values()]]))
        self.labels, self.lengths = list(texts), [len(h) for _, h in texts.values()]
        self.automaton = Automaton()
        n = len(self.hashes)
        self.pairs = np.zeros((n + 1, n + 1), bool)
        for i, (_, h) in enumerate(texts.values()):
            ids = np.searchsorted(self.hashes, h)
            self.automaton.add(ids.tolist(), i)
            self.pairs[ids[:-1], ids[1:]] = True
        self.automaton.close()
        self.phrases = [(np.searchsorted(self.hashes, known[p][1]), label) for p, label in phrases.items()]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Numbers in the vocabulary; its size for other words."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, len(self.hashes))

    def base(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(word, label) of each base phrase."""
        out = []
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = ids[:n] == phrase[0]
                for i in range(1, len(phrase)):
                    hit &= ids[i : n + i] == phrase[i]
                out += [(w, label) for w in np.flatnonzero(hit).tolist()]
        return sorted(out)

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word in it, first word in the text, length) of the maximal runs, by place in the text."""
        linked = self.pairs[ids[:-1], ids[1:]]
        s, e, _ = spans(linked, np.array([0, len(linked)]))
        out = []
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            if b - a + 1 < MIN_MATCH:
                continue
            run = ids[a : b + 1].tolist()
            stats = list(self.automaton.statistics(run))
            for i, (v, n) in enumerate(stats):
                if n >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                    out += [(t, end - n, a + i + 1 - n, n) for t, end in sorted(self.automaton.ends[v])]
        return out

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, int, int, int]]:
        """Chains (label, from, to, template from, to, words matched), in order of template and place."""
        out = []
        chains: dict[int, list[int]] = {}
        for t, at, word, n in sorted(self.matches(ids), key=lambda m: (m[0], m[2], m[1])):
            c = chains.get(t)
            if c and at + n > c[3] and word + n > c[1] and word - c[1] <= MAX_GAP and at >= c[2]:
                fresh = min(n, at + n - c[3], word + n - c[1])
                c[1], c[3], c[4] = word + n, at + n, c[4] + fresh
            else:
                if c:
                    out.append((self.labels[t], *c))
                chains[t] = [word, word + n, at, at + n, n]
        out += [(self.labels[t], *c) for t, c in chains.items()]
        return sorted(out)

    def cover(self, span: tuple) -> float:
        return span[5] / self.lengths[self.labels.index(span[0])]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, base, spans, score) for each row; base: places (word, label) of phrases."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(1)):
                low = LOWER[data]
                s, e, wb = spans(ALNUM[low], offs)
                ids = scanner.ids(span_hash(prefix(low), s, e))
                base, found, score = [], [], []
                # Texts without two known words side by side have neither a phrase nor a match.
                known = ids < len(scanner.hashes)
                near = np.concatenate([[0], np.cumsum(known[1:] & known[:-1])]) if len(ids) else np.zeros(1, np.int64)
                for p, q in zip(wb[:-1].tolist(), wb[1:].tolist(), strict=True):
                    mine = ids[p:q]
                    some = q - p > 1 and near[q - 1] > near[p]
                    base.append([{"word": w, "label": label} for w, label in scanner.base(mine)] if some else [])
                    chains = scanner.spans(mine) if some else []
                    found.append([dict(zip(("label", "from_word", "to_word", "template_from", "template_to", "matched"), c, strict=True)) for c in chains if scanner.cover(c) >= MIN_COVER])
                    score.append(max((min(1.0, scanner.cover(c)) for c in chains), default=0.0))
                kind = pa.list_(pa.struct([("label", pa.string()), *((k, pa.int32()) for k in ("from_word", "to_word", "template_from", "template_to", "matched"))]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(wb[1:] - wb[:-1]), pa.array(base, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), pa.array(found, kind), pa.array(score, pa.float64())],
                    names=["doc_id", "n_words", "base", "spans", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, base array<struct<word:long,label:string>>, spans {SPANS}, score double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined("base.label").alias("base_labels"), joined("base.label", "spans.label").alias("labels"), "score",
    )
