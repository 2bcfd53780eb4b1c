"""Search for short licence notices with typing errors, edits and odd punctuation.

A text is taken as its words (ASCII letters and digits, and all characters beyond ASCII; A-Z
lower-cased) with one space between them, and so is a notice. A notice may differ in ``edits``
characters. It is cut into one piece more than that, so wherever it stands with so many edits, one
piece at least stands unchanged (pigeonholes). One automaton finds all pieces of all notices in one
walk over the text; only around a piece found the ``regex`` library looks for the notice with a
bounded number of errors, between whole words, in a window as long as the notice can be. Time is in
proportion to the text and the pieces found, and windows that repeat are looked at once.

Found are all places where a notice stands unchanged, and besides, for each piece, the place with the
fewest edits around it; of places of one notice that overlap, that with fewer edits, then the first.
So a notice is found in a text exactly if some run of whole words is within ``edits`` of it.

Defined results: a null text is empty; an empty one has no word and no place; score 0. Rows are told
apart by themselves, so repeated rows and ids have results like others, and other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

#: What each byte becomes: bytes that part words become spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Notice(NamedTuple):
    label: str
    phrase: str
    base: bool = False

    @property
    def edits(self) -> int:
        """One in eight characters, four at most; none for notices under eight."""
        return min(4, len(self.phrase) // 8)


#: The notices that are searched for. Those marked base count where they stand unchanged.
NOTICES = (
    Notice("gpl", "gnu general public license", True),
    Notice("apache", "apache license", True),
    Notice("cc-by", "cc by", True),
    Notice("mit", "mit license", True),
    Notice("agpl", "gnu affero general public license"),
    Notice("all-rights-reserved", "all rights reserved"),
    Notice("artistic", "artistic license"),
    Notice("boost", "boost software license"),
    Notice("bsd", "bsd license"),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("cc-by", "creative commons attribution"),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc0", "creative commons zero"),
    Notice("epl", "eclipse public license"),
    Notice("isc", "isc license"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("mpl", "mozilla public license"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
)

SPAN = "label: string, phrase: string, base: boolean, edits: int, substituted: int, inserted: int, deleted: int, first_word: long, last_word: long, start: long, end: long"
FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([(n, {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (x.split(": ") for x in SPAN.split(", "))]))),
])


class Searcher:
    """The automaton over the notices' pieces, and an expression for each notice."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            parts = notice.edits + 1
            cuts = [len(notice.phrase) * i // parts for i in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(notice.phrase[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        patterns = [regex.compile(f"(?b)(?<= )(?:{regex.escape(x.phrase, literal_spaces=True)}){{e<={x.edits}}}(?= )") for x in notices]

        @lru_cache(1 << 14)
        def around(n: int, window: str) -> tuple[int, int, tuple[int, int, int]] | None:
            found = patterns[n].search(window)
            return found and (*found.span(), tuple(found.fuzzy_counts))

        self.around = around

    def search(self, text: str) -> Iterator[tuple[int, int, int, tuple[int, int, int]]]:
        """(notice, start, end, edits by kind) in a text of words with a space before and behind each."""
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - size - offset)
        for n in sorted(starts):
            notice = self.notices[n]
            size, most, exact, near = len(notice.phrase), notice.edits, [], {}
            for at in sorted(starts[n]):
                if at > 0 and text.startswith(notice.phrase, at) and text[at - 1] == " " and text[at + size : at + size + 1] == " ":
                    exact.append((0, at, at + size, (0, 0, 0)))
                elif most:
                    low = max(0, at - most - 1)
                    if found := self.around(n, text[low : max(0, at + size + most + 1)]):
                        a, b, kinds = found
                        near[low + a, low + b] = (sum(kinds), low + a, low + b, kinds)
            yield from ((n, a, b, kinds) for _, a, b, kinds in exact)
            yield from ((n, a, b, kinds) for _, a, b, kinds in _apart(exact, near.values()))


def _apart(exact: list[tuple], near) -> list[tuple]:
    """Of the near places those that meet no exact one nor a better near one, in order."""
    from bisect import bisect_left, insort

    taken, out = sorted((x[1], x[2]) for x in exact), []
    for x in sorted(near):
        i = bisect_left(taken, (x[1], x[2]))
        if (i == 0 or taken[i - 1][1] <= x[1]) and (i == len(taken) or taken[i][0] >= x[2]):
            insort(taken, (x[1], x[2]))
            out.append(x)
    return sorted(out, key=lambda x: x[1:3])


def _spans(searcher: Searcher, raw: bytes) -> tuple[int, list[dict]]:
    words = raw.translate(FOLDED).split()
    text = f" {b' '.join(words).decode()} "
    found = sorted(searcher.search(text), key=lambda x: (x[1], x[0], x[2]))
    if not found:
        return len(words), []
    numbers, at, seen = {}, 0, -1  # of the words that begin at a place; and of the word before a space
    for place in sorted({x for _, a, b, _ in found for x in (a, b)}):
        seen += text.count(" ", at, place)
        numbers[place], at = seen, place
    bounds = [m.span() for m in WORD.finditer(raw.decode())]
    out = []
    for n, a, b, (substituted, inserted, deleted) in found:
        notice, first, last = searcher.notices[n], numbers[a], numbers[b]
        out.append({
            "label": notice.label, "phrase": notice.phrase, "base": notice.base, "edits": substituted + inserted + deleted, "substituted": substituted, "inserted": inserted, "deleted": deleted,
            "first_word": first, "last_word": last, "start": bounds[first][0], "end": bounds[last][1],
        })
    return len(words), out


def found(text: Column, notices: tuple[Notice, ...] = NOTICES) -> Column:
    """struct<n_words, spans>: of each span the notice, its edits, its first and last word (from 0), and its place in the text (characters from 0, end behind it)."""
    held: list[Searcher] = []

    def batch(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Searcher(notices))
        rows = [dict(zip(("n_words", "spans"), _spans(held[0], x))) for x in as_bytes(texts)]
        return pa.array(rows, FOUND)

    return F.arrow_udf(batch, f"struct<n_words: long, spans: array<struct<{SPAN}>>>")(text)


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``keep``, n_words and spans of each row. Needs no shuffle."""
    return docs.select(*keep, found(F.col(text_col), notices).alias("found")).select(*keep, "found.*")


def report(scanned: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id and, of each scanned row: n_words, places and labels of base notices, all labels, and the likeness of the best place (1 - edits / characters)."""
    base = F.filter("spans", lambda x: x["base"] & (x["edits"] == 0))
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    first = F.transform("base", lambda x: x["first_word"])
    like = F.transform("spans", lambda x: 1.0 - x["edits"] / F.length(x["phrase"]))
    return scanned.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        named("base").alias("base_labels"), named("spans").alias("labels"), F.coalesce(F.array_max(like), F.lit(0.0)).alias("score"),
    )
