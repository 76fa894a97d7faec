"""License scans: fuzzy search for short notices.

Each notice of n characters may differ by up to ``errors`` edits. Cut into errors + 1
pieces, at least one piece is then in the text unchanged, so an exact search for all
pieces (one Aho-Corasick pass) finds every candidate. An edit breaks at most q of a
notice's q-grams; candidates that lack more are dropped. Around the others, the
``regex`` library's bounded-error matching confirms the notice and reports its span
and its edits.

Texts are compared in a normal form: words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the
text with A-Z lower-cased, joined by single blanks. The base report is exact: places
where a phrase's words stand consecutively.

Documents are handled row by row without a shuffle. Candidates whose starts lie within a
notice's errors share a window, so a window is a notice and three times its errors long, and
time grows with the number of candidates. Defined cases: a null or empty text has no words and score 0; overlapping
matches of one notice keep the one with fewer edits, then the earlier; repeated rows
get the same result each.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alnum_words, binary

#: fixed values: exact phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: fixed values: label and opening words of short notices
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("copyright", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "this software is released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
)
#: one edit for so many characters of a notice
CHARS_PER_ERROR = 12
QGRAM = 4


@dataclass(frozen=True)
class Notice:
    label: str
    text: str

    @property
    def errors(self) -> int:
        return max(1, len(self.text) // CHARS_PER_ERROR)

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): errors + 1 parts, of nearly one size."""
        n, k = len(self.text), self.errors + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    """All notices of a text, by exact pieces and then by bounded-error matching."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES):
        import ahocorasick
        import regex

        self.notices = [Notice(*n) for n in notices]
        of: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in notice.pieces():
                of.setdefault(piece, []).append((i, offset))
        self._pieces = ahocorasick.Automaton()
        for piece, places in of.items():
            self._pieces.add_word(piece, (len(piece), places))
        self._pieces.make_automaton()
        self._grams = [[n.text[k : k + QGRAM] for k in range(len(n.text) - QGRAM + 1)] for n in self.notices]
        self._patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.errors}}}") for n in self.notices]

    def _shares(self, i: int, window: str) -> bool:
        """Whether the window has as many of the notice's q-grams as its edits must leave whole."""
        held = {window[k : k + QGRAM] for k in range(len(window) - QGRAM + 1)}
        grams = self._grams[i]
        return sum(g in held for g in grams) >= len(grams) - QGRAM * self.notices[i].errors

    def find(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, notice length) in the normal form, by start."""
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self._pieces.iter(text):
            for i, offset in places:
                starts.setdefault(i, set()).add(end + 1 - size - offset)
        out = []
        for i, some in starts.items():
            hits, errors = set(), self.notices[i].errors
            first = None
            for at in [*sorted(some), None]:  # starts within the notice's errors share a window
                if first is not None and (at is None or at > first + errors):
                    hits |= self._around(i, text, first - errors, last + len(self.notices[i].text) + errors)
                    first = None
                if at is not None:
                    first, last = (at if first is None else first), at
            out += [(self.notices[i].label, *hit, len(self.notices[i].text)) for hit in apart(hits)]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def _around(self, i: int, text: str, low: int, high: int) -> set[tuple[int, int, int]]:
        """(start, end, edits) of matches in a window: the best one, then those before and after it."""
        out, todo = set(), [(max(low, 0), min(high, len(text)))]
        shortest = len(self.notices[i].text) - self.notices[i].errors
        while todo:
            a, b = todo.pop()
            if b - a >= shortest and self._shares(i, text[a:b]) and (m := self._patterns[i].search(text, a, b)) and m.end() > m.start():
                out.add((m.start(), m.end(), sum(m.fuzzy_counts)))
                todo += [(a, m.start()), (m.end(), b)]
        return out


def apart(hits: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches of one notice that do not overlap: fewer edits first, then the earlier."""
    kept: list[tuple[int, int, int]] = []
    for hit in sorted(hits, key=lambda h: (h[2], h[0], h[1])):
        at = bisect.bisect(kept, hit)
        if (at == 0 or kept[at - 1][1] <= hit[0]) and (at == len(kept) or hit[1] <= kept[at][0]):
            kept.insert(at, hit)
    return kept


_FINDERS: dict = {}


def finder(notices: tuple) -> Finder:
    """One for each Python worker."""
    if notices not in _FINDERS:
        _FINDERS[notices] = Finder(notices)
    return _FINDERS[notices]


def places(words: list[bytes], normal: bytes, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(word number, label) of every place of every phrase."""
    out = []
    padded = b" " + normal + b" "
    for phrase, label in phrases.items():
        mark = b" " + phrase.encode() + b" "
        at, seen, n = padded.find(mark), 0, 0
        while at >= 0:
            n += padded.count(b" ", seen, at)
            seen = at
            out.append((n, label))
            at = padded.find(mark, at + 1)
    return out


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:bigint,last:bigint,edits:int>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = NOTICES, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document: words, exact phrases, labels, score of the nearest notice, and the notices' spans in words."""
    phrases = PHRASES if phrases is None else phrases
    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())]))

    def run(batches):
        find = finder(notices).find
        for batch in batches:
            rows = []
            for text in binary(batch, text_col):
                words = alnum_words(text)
                normal = b" ".join(words)
                base = places(words, normal, phrases)
                spans, score = [], 1.0 if base else 0.0
                normal_text = normal.decode()
                if found := find(normal_text):
                    blanks = np.flatnonzero(np.frombuffer(normal_text.encode("utf-32-le"), "<u4") == 32)
                    for label, a, b, edits, size in found:
                        while b > a + 1 and normal_text[b - 1] == " ":
                            b -= 1
                        ends = np.searchsorted(blanks, (a + (normal_text[a : a + 1] == " "), b - 1)).tolist()
                        spans.append({"label": label, "first": ends[0], "last": ends[1], "edits": edits})
                        score = max(score, 1 - edits / size)
                starts = [n for n, _ in base]
                exact = {label for _, label in base}
                rows.append(
                    (
                        len(words),
                        len(base),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(exact)),
                        ",".join(sorted(exact | {s["label"] for s in spans})),
                        score,
                        spans,
                    )
                )
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names=[id_col, *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")


