"""Regular expressions as Python's ``re`` reads them: flags, matches with offsets, stripping."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes, only \n ends a line, Unicode case folding; and the same with case.
FOLD, CASED = "(?iudU)", "(?dU)"
#: White space as Python's ``str`` methods have it: Unicode's and four separators.
SPACE = r"[\s\x1c-\x1f]"
#: The characters of ``SPACE``.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space, a character of a word and a word's bounds as RE2 has them, by which the queries' SQL goes: ASCII's alone. Java's own \b goes by Unicode's.
RE2_SPACES = "\t\n\f\r "
RE2_WORD, RE2_WORD_FOLDED = "[0-9A-Za-z_]", "[0-9A-Za-z_ſ\u212a]"
RE2_BOUND = f"(?:(?<!{RE2_WORD})(?={RE2_WORD})|(?<={RE2_WORD})(?!{RE2_WORD}))"
#: Characters of a block of text; numbers of a run that are summed one by one.
BLOCK, RUN = 1024, 256


def fold(pattern: str) -> str:
    return FOLD + pattern


def cased(pattern: str) -> str:
    return CASED + pattern


def re2(pattern: str) -> str:
    """A pattern without classes of its own that finds what RE2 finds with "(?i)" before it: letters are folded as Unicode has it, but ı and İ aren't i, and ſ and the Kelvin sign count for words' characters but not for their bounds."""
    signs = {"\\b": RE2_BOUND, "\\w": RE2_WORD_FOLDED, "\\s": f"[{RE2_SPACES}]", "s": "[sſ]", "k": "[k\u212a]"}
    body, before, after = pattern, "", ""
    # next to a letter that is ASCII's in any case one look will do
    if m := re.match(r"\\b(?=[a-z]|\((?:[a-z]+\|)*[a-z]+\))", body):
        firsts = {x[:1] for x in re.match(r"\(?([a-z|]+)", body[2:])[1].split("|")}
        if not firsts & {"s", "k"}:
            body, before = body[m.end() :], f"(?=[{''.join(sorted(firsts))}])(?<!{RE2_WORD})"
    if m := re.search(r"[a-jl-rt-z]\)?(\\b)\Z", body):
        body, after = body[: m.start(1)], f"(?!{RE2_WORD})"
    return "(?id)" + before + re.sub(r"\\.|[sk]", lambda m: signs.get(m[0], m[0]), body) + after


def needed(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern holds, lower-cased; "" if none is sure."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            return ""
        if c in "([\\.":
            runs.append(run)
            run = ""
            if c == "(":
                depth = 1
                while depth:
                    i += 1
                    depth += (pattern[i] == "(") - (pattern[i] == ")") if pattern[i - 1] != "\\" else 0
            elif c == "[":
                i = pattern.index("]", i)
            elif c == "\\":
                i += 1
        elif c in "?*":
            runs.append(run[:-1])
            run = ""
        elif c == "+":
            runs.append(run)
            run = ""
        elif c == "{":
            runs.append(run[:-1])
            run, i = "", pattern.index("}", i)
        else:
            run += c
        i += 1
    return max([*runs, run], key=len).lower()


def needed_any(pattern: str) -> list[str]:
    """Plain texts of which every match of a pattern holds one, lower-cased: those of the choices of a group that isn't optional, if they are longer than ``needed``."""
    best, depth, begin = [needed(pattern)], 0, 0
    for i, c in enumerate(pattern):
        if c not in "()" or pattern[i - 1 : i] == "\\":
            continue
        depth += 1 if c == "(" else -1
        if c == "(" and depth == 1:
            begin = i + 3 if pattern.startswith("(?:", i) else i + 1
        elif c == ")" and depth == 0 and pattern[i + 1 : i + 2] not in ("?", "*", "{") and "(" not in pattern[begin:i]:
            choices = [needed(x) for x in pattern[begin:i].split("|")]
            if min(map(len, choices)) > min(map(len, best)):
                best = choices
    return best if not _choice_outside(pattern) else [""]


def _choice_outside(pattern: str) -> bool:
    depth = 0
    for i, c in enumerate(pattern):
        if c in "()|" and pattern[i - 1 : i] != "\\":
            depth += (c == "(") - (c == ")")
            if c == "|" and depth == 0:
                return True
    return False


#: Of a thousand characters of prose, how many are these, about; others are rare.
COMMON = {" ": 180, "e": 100, "t": 75, "a": 65, "o": 62, "n": 57, "i": 57, "s": 53, "r": 50, "h": 50, "l": 33, "d": 33, "u": 23, "c": 22, "m": 20, "f": 18, "w": 17, "g": 16, "p": 15, "y": 14, "b": 13, "v": 8, "k": 6}


def roots(texts: list[str], least: int = 4) -> dict[str, str]:
    """Each text's root: a part of it, of ``least`` characters or more unless the text is shorter, so chosen that few roots serve all texts.

    Looking for a root costs a step for each character, and some fifteen more wherever its first character stands: that is where Spark
    compares. Roots that begin with a rare character are preferred so.
    """
    cost = lambda x: 1 + 15 * COMMON.get(x[:1], 1) / 1000
    parts = {t: {t[i:j] for i in range(len(t)) for j in range(i + least, len(t) + 1)} or {t} for t in texts}
    left, found = set(texts), {}
    while left:
        served = {}
        for t in left:
            for x in parts[t]:
                served[x] = served.get(x, 0) + 1
        root = max(served, key=lambda x: (served[x] / cost(x), len(x), x))
        found |= {t: root for t in left if root in parts[t]}
        left = {t for t in left if root not in parts[t]}
    return found


def folded(body: Column) -> Column:
    """Lower case, with the letters that equal s, k and i when case is ignored as these, character for character: what ``needed`` and ``lowered`` are looked for in."""
    odd = "ſ\u212aİı"
    some = F.contains(body, F.lit(odd[0]))
    for c in odd[1:]:
        some = some | F.contains(body, F.lit(c))
    return F.lower(F.when(some, F.translate(body, odd, "skii")).otherwise(body))


def spaced(body: Column, spaces: str = SPACES) -> Column:
    """A space for each character of ``spaces``, if there is any but the space."""
    return let(body, lambda x: F.when(F.exists(F.array(*map(F.lit, spaces.replace(" ", ""))), lambda c: F.contains(x, c)), F.translate(x, spaces, " " * len(spaces))).otherwise(x))


def lowered(pattern: str) -> str:
    """A pattern that finds in a ``folded`` text what ``fold`` finds in the text: case needn't be ignored then, which takes a fraction of the time."""
    return CASED + "".join(c if pattern[i - 1 : i] == "\\" else c.lower() for i, c in enumerate(pattern))


def count(text: Column, pattern: str) -> Column:
    """Matches of a full Java pattern (see ``fold`` and ``cased``)."""
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often lambdas in ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """The sum of the numbers before each place of an array of longs, in two levels: runs, and within a run."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def of(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
        sums = lambda s: F.transform(s, lambda k: total(F.slice(a, k + 1, RUN)))
        before = lambda t: F.transform(t, lambda _, i: total(F.slice(t, F.lit(1), i)))
        inside = lambda k, b: F.transform(F.slice(a, k + 1, RUN), lambda _, i: b + total(F.slice(a, k + 1, i)))
        return let(starts, lambda s: F.flatten(F.zip_with(s, let(sums(s), before), inside)))

    return let(numbers, of)


def placed(found: Column, pieces: Column) -> Column:
    """array<struct<start, text>> of matches one after another and the pieces of a split at them; ``start`` counts from 0.

    Between the matches lie the pieces, so a match starts where all pieces and matches before it end.
    """

    def of(m: Column, p: Column) -> Column:
        sizes = F.zip_with(m, p, lambda x, y: (F.length(x) + F.length(y)).cast("long"))
        starts = F.zip_with(running(sizes), p, lambda at, y: (at + F.length(y)).cast("int"))
        return F.zip_with(starts, m, lambda at, x: F.struct(at.alias("start"), x.alias("text")))

    first = lambda m, p: F.slice(p, F.lit(1), F.size(m))
    return let(found, lambda m: let(first(m, pieces), lambda p: of(m, p)))


def matches(text: Column, pattern: Column) -> Column:
    """``placed`` of a full Java pattern, which mustn't match the empty string."""
    return placed(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1))


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK characters, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, begin: Column, end: Column) -> Column:
    """Characters ``begin`` to ``end`` of a text given by its blocks: no need to walk the text from its start."""
    first, last = F.floor(begin / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    some = F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > begin, F.substring(some, begin - first * BLOCK + 1, end - begin)).otherwise("")


def excerpt(parts: Column, length: Column, start: Column, size: Column, context: int, stripped: bool) -> Column:
    """The match with ``context`` characters on either side, and "..." where text of this length is cut off."""
    begin = F.greatest(F.lit(0), start - context)
    end = F.least(length, start + size + context)
    body = cut(parts, begin, end)
    body = strip(body) if stripped else body
    return F.concat(F.when(begin > 0, "...").otherwise(""), body, F.when(end < length, "...").otherwise(""))
