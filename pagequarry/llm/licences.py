"""Licence scan: a generalised suffix automaton of licence notices, streamed over the words of each text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import per_row

#: Phrases and the labels they give.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: The wording of public licence notices, by the label that a covered notice gives.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
            "file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Released under CC BY 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software"),
)
#: Words of a match that is long enough to start or go on with a span.
LEAST_MATCH = 6
#: Share of a notice's words that a label needs.
COVERED = 0.5
#: Words of the text that may lie between two chained matches.
GAP = 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


class Automaton:
    """A suffix automaton of several word sequences: every run of words of any of them is a path from the start.

    Each state knows, for each sequence that holds its runs, where the first of them ends.
    """

    def __init__(self, sequences: Iterable[list[bytes]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for number, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                state = last
                while state > 0 and number not in self.ends[state]:
                    self.ends[state][number] = at
                    state = self.link[state]

    def _state(self, length: int, moves: dict[bytes, int], link: int, ends: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, parent: int, word: bytes) -> int:
        """The state of the parent's longest run and the word, made from a longer one where needed."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        twin = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child], dict(self.ends[child]))
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:  # another sequence has this run
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1, {}, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        self.link[new] = self._split(state, word) if state >= 0 else 0
        return new

    def statistics(self, words: list[bytes]) -> Iterable[tuple[int, int, int]]:
        """(place, length, state) of the longest run of the sequences that ends at each place, where it has a word."""
        state, length = 0, 0
        start = self.next[0]
        for at, word in enumerate(words):
            if not state and word not in start:
                continue
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
                yield at, length, state
            else:
                state, length = 0, 0


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> None:
        self.labels = [label for label, _ in notices]
        self.sizes = [len(words_of(text.encode())) for _, text in notices]
        self.machine = Automaton(words_of(text.encode()) for _, text in notices)
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases:
            words = phrase.encode().split()
            self.phrases.setdefault(words[0], []).append((words, label))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(place, label) of every phrase."""
        return [
            (at, label) for at, word in enumerate(words) if word in self.phrases
            for phrase, label in self.phrases[word] if words[at:at + len(phrase)] == phrase
        ]

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first place, last place, covered share) of the chains of long matches, one for each stretch of each notice.

        A match goes into a notice's chain if it follows the chain's end in the notice and, within a gap, in the text.
        """
        longest: list[tuple[int, int, int]] = []
        for at, length, state in self.machine.statistics(words):
            if length < LEAST_MATCH and length < min(self.sizes[n] for n in self.machine.ends[state]):
                continue
            if longest and longest[-1][0] == at - 1 and longest[-1][1] == length - 1:
                longest[-1] = (at, length, state)
            else:
                longest.append((at, length, state))
        chains: dict[int, list[list[int]]] = {}
        for at, length, state in longest:
            for number, end in self.machine.ends[state].items():
                first, begin = at - length + 1, end - length + 1
                own = chains.setdefault(number, [])
                if own and own[-1][3] <= begin and own[-1][1] < first <= own[-1][1] + GAP:
                    own[-1] = [own[-1][0], at, own[-1][2] + length, end + 1]
                else:
                    own.append([first, at, length, end + 1])
        return [
            (self.labels[n], first, last, covered / self.sizes[n]) for n, own in chains.items() for first, last, covered, _ in own
        ]

    def scan(self, text: bytes | None) -> tuple:
        """Words, phrase places, first and last place, base labels, all labels, score, spans."""
        words = words_of(text)
        base = self.places(words)
        spans = self.spans(words)
        base_labels = {label for _, label in base}
        best = max((share for *_, share in spans), default=0.0)
        labels = base_labels | {label for label, _, _, share in spans if share >= COVERED}
        at = [p for p, _ in base]
        return (
            len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)),
            min(1.0, max(best, 0.8 if base else 0.0)), [f"{a}:{i}-{j}" for a, i, j, s in spans if s >= COVERED],
        )


def scan(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row, from its whole text.

    ``score`` is the largest covered share of a notice, and 0.8 at least where a phrase stands. Null and empty
    texts have no words, no labels ('') and score 0.
    """
    kept: list[Scanner] = []

    def compute(columns: list[list]) -> list[list]:
        if not kept:
            kept.append(Scanner())
        return [list(c) for c in zip(*map(kept[0].scan, columns[0]), strict=True)]

    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("body"))
    found = per_row(
        rows, ["body"], "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<string>", compute)
    return found.drop("body").withColumnRenamed("id", key)
