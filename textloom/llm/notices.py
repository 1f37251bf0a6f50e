"""Short license notices in whole texts (11): exact phrases, and notices with a bounded number of edits.

A text is brought to a plain form: A-Z lower-cased, words (runs of digits, letters and anything beyond ASCII) with one
space between. Phrases are looked up there word by word. A notice of n characters may differ by up to `n // chars_an_edit`
edits, `most_edits` at most. It is split into two parts more than that, so that two parts at least are left whole wherever it stands, their supposed
starts no further apart than the edits; all parts of all notices are found in one pass of an automaton. Where two parts agree, the `regex`
library's bounded-error matching verifies the notice in the window in which it would lie, from no edit upwards, and gives the span. Windows that were seen
before are not verified again. Of notices that overlap the one with the fewest edits stays, of these
the longest, then the leftmost, then by label, so that one version of a license does not pass as another.

Nothing is shuffled; a text is a chunk of work, linear in its length.

Defined results: null text is empty; an empty text, or one without words, has no labels and score 0; rows that repeat
are each treated; null ids stay null; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import deque
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_strings, map_chunks, text_of

#: Phrases whose every place counts, with their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices as projects write them, in the plain form, with their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("licensed under the gnu affero general public license version 3", "agpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
Match = tuple[str, int, int, int]  # label, start, end, edits

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(text: bytes) -> bytes:
    """The plain form, with a space before and after all words; a lone space where there are none."""
    words = text.translate(_PLAIN).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def places(form: bytes, phrase: str) -> list[int]:
    """The word at which each occurrence of the phrase begins."""
    sought, out, word, done = b" " + phrase.encode() + b" ", [], 0, 0
    at = form.find(sought)
    while at >= 0:
        word += form.count(b" ", done, at)
        out.append(word)
        done, at = at, form.find(sought, at + 1)
    return out


def parts(notice: str, n: int) -> list[tuple[int, str]]:
    """The notice cut into n parts of about the same length, each with its place."""
    ends = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(ends, ends[1:])]


@dataclass(frozen=True)
class Rules:
    phrases: tuple[tuple[str, str], ...] = PHRASES
    notices: tuple[tuple[str, str], ...] = NOTICES
    chars_an_edit: int = 10
    most_edits: int = 4


class Scanner:
    """The rules made ready: one automaton for all parts, one pattern a notice."""

    def __init__(self, rules: Rules, known_windows: int = 50_000):
        self.rules = rules
        self.edits = [min(rules.most_edits, len(text) // rules.chars_an_edit) for text, _ in rules.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for which, ((text, _), k) in enumerate(zip(rules.notices, self.edits, strict=True)):
            for at, part in parts(text, k + 2):
                seeds.setdefault(part, []).append((which, at))
        self.automaton = ahocorasick.Automaton()
        for part, wanted in seeds.items():
            self.automaton.add_word(part, (len(part), wanted))
        if seeds:
            self.automaton.make_automaton()
        self.patterns = [
            [regex.compile(f"(?:{regex.escape(text, literal_spaces=True)}){{e<={e}}}") for e in range(k + 1)]
            for (text, _), k in zip(rules.notices, self.edits, strict=True)
        ]
        self.verify = functools.lru_cache(known_windows)(self._verify)

    def _verify(self, which: int, window: bytes) -> tuple[int, int, int] | None:
        """Start, end and edits of the notice's best match in the window, in bytes."""
        text = window.decode("utf-8", "replace")
        for edits, pattern in enumerate(self.patterns[which]):
            if found := pattern.search(text):
                start, end = found.span()
                while start < end and text[start] == " ":  # a space more at the start
                    start += 1
                return len(text[:start].encode()), len(text[:end].encode()), edits
        return None

    def candidates(self, form: bytes) -> set[tuple[int, int]]:
        """Notice and supposed start, wherever two of its parts stand so that the edits between them can be no more than allowed.
        Bytes stand for characters: parts are ASCII, and an edit moves a place by one character of up to four bytes."""
        if not self.patterns:
            return set()
        out: set[tuple[int, int]] = set()
        waiting: list[deque] = [deque() for _ in self.patterns]
        for end, (size, wanted) in self.automaton.iter(form.decode("latin-1")):
            for which, at in wanted:
                start, reach, queue = end + 1 - size - at, 4 * self.edits[which], waiting[which]
                length = len(self.rules.notices[which][0])
                while queue and queue[0][0] < end - length - reach:
                    queue.popleft()
                if any(other != at and abs(start - there) <= reach for _, there, other in queue):
                    out.add((which, start))
                queue.append((end, start, at))
        return out

    def matches(self, form: bytes) -> list[Match]:
        """Label, start and end in the form and edits of all notices that stay, by start."""
        found = set()
        for which, at in self.candidates(form):
            # an edit moves a place by one character, of up to four bytes
            reach = 4 * self.edits[which]
            a, b = max(0, at - reach), at + len(self.rules.notices[which][0]) + reach
            while a and form[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(form) and form[b] & 0xC0 == 0x80:
                b += 1
            if best := self.verify(which, form[a:b]):
                found.add((best[2], best[0] - best[1], a + best[0], self.rules.notices[which][1], a + best[1]))
        return apart(sorted(found))


def apart(ranked: list[tuple[int, int, int, str, int]]) -> list[Match]:
    """From the best on, those that overlap none taken before. Taken spans lie apart, so the only two that can overlap a new one are its neighbours by start."""
    starts: list[int] = []
    taken: list[Match] = []
    for edits, _, a, label, b in ranked:
        i = bisect.bisect_right(starts, a)
        if (not i or taken[i - 1][2] <= a) and (i == len(taken) or b <= taken[i][1]):
            starts.insert(i, a)
            taken.insert(i, (label, a, b, edits))
    return taken


def spans(text: str, form: bytes, found: list[Match]) -> list[Match]:
    """The matches by code points of the text itself: from the first word touched to the last."""
    if not found:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    out, word, done = [], 0, 0
    for label, a, b, edits in found:
        word += form.count(b" ", done, a)
        done = a
        first = word if form[a : a + 1] == b" " else max(0, word - 1)
        last = word + form.count(b" ", a, b) - 1 - (form[b - 1 : b] == b" ")
        out.append((label, words[min(first, len(words) - 1)][0], words[min(max(first, last), len(words) - 1)][1], edits))
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_row(text: bytes, scanner: Scanner) -> tuple:
    form = plain(text)
    found = [(place, label) for phrase, label in scanner.rules.phrases for place in places(form, phrase)]
    fuzzy = scanner.matches(form)
    longest = {}
    for notice, label in scanner.rules.notices:
        longest[label] = max(longest.get(label, 0), len(notice))
    score = 1.0 if found else max((1 - edits / longest[label] for label, _, _, edits in fuzzy), default=0.0)
    base = sorted({label for _, label in found})
    every = sorted({*base, *(m[0] for m in fuzzy)})
    where = ",".join(f"{k}:{a}:{b}:{e}" for k, a, b, e in spans(text.decode("utf-8"), form, fuzzy)) if fuzzy else ""
    starts = [place for place, _ in found]
    return len(form.split()), len(found), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(every), score, where


def scan_notices(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row per document: words, places of phrases, labels, the best score, and the notices' spans as label:start:end:edits."""

    def make():
        scanner = Scanner(rules)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan_row(text, scanner) for text in byte_strings(batch.column("text"))]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))],
                [x.split()[0] for x in SCHEMA.split(", ")]
            )

        return work

    return map_chunks(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), "text", make, SCHEMA)
