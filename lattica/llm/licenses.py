"""License scans: license templates with optional and replaceable regions, matched as token automata.

A template is markup over lower-case words: `[ ... ]` encloses an optional region, `{name:min-max}` stands for
min to max arbitrary words. It is compiled to a nondeterministic automaton over words; a text is accepted where all
mandatory wording occurs exactly and in order. Beside the templates, four base phrases are counted.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are scored each for itself;
texts of any length are scanned whole, in time linear in their words for a given library; extra columns are passed through
by `scan` (those with a result's name are replaced). A template whose regions can all be empty matches nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from lattica.llm.common import append_columns, as_bytes
from lattica.llm.decontam import TO_WORDS

#: Fixed phrases and their labels.
PHRASES = {
    b"gnu general public license": "gpl",
    b"apache license": "apache",
    b"cc by": "cc-by",
    b"mit license": "mit",
}

#: Template markup by label; wording of public license texts and notices.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0 [the license]",
        "apache license version 2 0 [january 2004] [http www apache org licenses]",
    ],
    "gpl-2.0": [
        "gnu general public license [as published by the free software foundation] [either] version 2 [of the license]",
        "[the] gnu gpl v 2",
    ],
    "gpl-3.0": [
        "gnu general public license [as published by the free software foundation] [either] version 3 [of the license]",
        "[the] gnu gpl v 3",
    ],
    "cc-by-4.0": ["[licensed under] [the] [a] cc by 4 0", "creative commons attribution 4 0 [international]"],
    "cc-by-nc-4.0": ["[licensed under] [the] [a] cc by nc 4 0", "creative commons attribution noncommercial 4 0 [international]"],
    "cc-by-sa-4.0": ["[licensed under] [the] [a] cc by sa 4 0", "creative commons attribution sharealike 4 0 [international]"],
    "cc-by-nd-4.0": ["[licensed under] [the] [a] cc by nd 4 0", "creative commons attribution noderivatives 4 0 [international]"],
    "mit": [
        "[released] [licensed] [distributed] under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
        " and this permission notice [including the next paragraph] shall be included in all copies or substantial portions"
        " of the software",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "bsd-2-clause": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met [1] redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with the"
        " distribution",
    ],
    "bsd-3-clause": [
        "[3] neither the name of {holder:1-12} nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission",
    ],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

_TOKEN = re.compile(r"\[|\]|\{(\w+):(\d+)-(\d+)\}|[^\s\[\]{}]+")


class Automaton:
    """One template. States are places between words; `edges[s]` are (word or None for any, next), `skips[s]` need no word."""

    def __init__(self, markup: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        opened, self.mandatory, self.needs = [], 0, set()
        for m in _TOKEN.finditer(markup):
            at = len(self.edges) - 1
            if m.group() == "[":
                opened.append(at)
            elif m.group() == "]":
                self.skips[opened.pop()].append(at)
            elif m.group(1):
                low, high = int(m.group(2)), int(m.group(3))
                for k in range(high):
                    self._grow(None)
                    if k >= low:
                        self.skips[at + k].append(at + high)
            else:
                self._grow(m.group().encode())
                self.mandatory += not opened
                if not opened:
                    self.needs.add(m.group().encode())
        if opened:
            raise ValueError(f"an optional region isn't closed: {markup}")
        self.end = len(self.edges) - 1
        self.first = {w for s in self.closure({0}) for w, _ in self.edges[s]}

    def _grow(self, word: bytes | None) -> None:
        self.edges.append([])
        self.skips.append([])
        self.edges[-2].append((word, len(self.edges) - 1))

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[bytes], start: int) -> int:
        """The end of the longest match that starts at a word, or -1."""
        states, end, i = self.closure({0}), -1, start
        while states:
            if self.end in states:
                end = i
            if i == len(words):
                break
            w = words[i]
            states = self.closure({t for s in states for v, t in self.edges[s] if v is None or v == w})
            i += 1
        return end


FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_base", LongType()),
    StructField("first_word", LongType()),
    StructField("last_word", LongType()),
    StructField("base_labels", StringType()),
    StructField("labels", StringType()),
    StructField("score", DoubleType()),
    StructField("matches", StringType()),
]


class Scanner:
    """All templates of a library, and the base phrases."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.automata = [(label, Automaton(t)) for label, ts in templates.items() for t in ts]
        self.starts: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, a in self.automata:
            for w in a.first:  # None: the template can start with any word
                self.starts.setdefault(w, []).append((label, a))
        self.base = re.compile(rb"(?<![^ ])(?:" + b"|".join(map(re.escape, PHRASES)) + rb")(?![^ ])")

    def scan(self, text: bytes) -> tuple:
        words = text.translate(TO_WORDS).split()
        joined = b" ".join(words)
        places, at, word = [], 0, 0
        for m in self.base.finditer(joined):
            word += joined.count(b" ", at, m.start())
            at = m.start()
            places.append((word, PHRASES[m.group()]))
        base = sorted({label for _, label in places})
        best: dict[str, tuple[int, int, int]] = {}
        # a template can match only where all its mandatory words are in the text
        have, starts = set(words), {}
        for w in self.starts.keys() & (have | {None}):
            if possible := [(label, a) for label, a in self.starts[w] if a.needs <= have]:
                starts[w] = possible
        anywhere = starts.pop(None, [])
        for i, w in enumerate(words) if starts or anywhere else ():
            if anywhere or w in starts:
                for label, a in [*starts.get(w, ()), *anywhere]:
                    end = a.match(words, i)
                    if end > i and a.mandatory > best.get(label, (0, 0, 0))[2]:
                        best[label] = i, end, a.mandatory
        labels = sorted(set(base) | set(best))
        # a template of 3 words of mandatory wording gives 0.75, one of 10 or more over 0.9; a bare phrase 0.5
        score = max([0.5 * bool(base), *(1 - 1 / (1 + n) for _, _, n in best.values())])
        found = ",".join(f"{k}:{a}:{b}" for k, (a, b, _) in sorted(best.items()))
        return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(base), ",".join(labels), score, found


def scan(docs: DataFrame, text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """docs with word count, base phrase places, labels, a score and the template matches (label:first word:end)."""
    at = docs.columns.index(text_col)

    def make():
        scanner = Scanner(templates)

        def work(batch):
            rows = [scanner.scan(t) for t in as_bytes(batch.column(at))]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

        return work

    return append_columns(docs, FIELDS, make)
