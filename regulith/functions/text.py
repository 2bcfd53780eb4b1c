"""Scalar functions of a text: words, sentences, readability, jargon, fees, types.

Words and their bounds are those of Python's ``re``; with ``re2``, those of RE2, by which the queries' SQL goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, rx

WORD = r"(?U)[^\s\x1c-\x1f]+"
RE2_WORD = f"[^{rx.RE2_SPACES}]+"
#: In lower-cased text between spaces, with no other white space: final e's of words; and words of one syllable whose groups of vowels, less
#: one for a final e, are none. Characters stand one by one in classes, which Java looks up in a table then.
MARKS = ".,!?;:"
FINAL_E = f"e[{MARKS}]*+(?= )"
NO_GROUP = f" (?=[{MARKS}]*+[^{MARKS} ])[^aeiouy ]*+(?:[aeiouy]*e[{MARKS}]*+)?(?= )"


def rounded(x: Column, digits: int = 6) -> Column:
    """A double to ``digits`` decimals as C's ``round`` of the shifted number gives it: Spark's own rounds the shortest decimal text, so at ties such as 1327 / 640 the two part."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def word_count(text: Column, re2: bool = False) -> Column:
    return F.regexp_count(text, F.lit(RE2_WORD if re2 else WORD)).cast("long")


def sentence_count(text: Column) -> Column:
    """Runs of sentence marks, 0 if there is none."""
    return rx.count(text, rules.SENTENCE_END).cast("long")


def syllables(word: Column) -> Column:
    """Groups of vowels of a word, less one for a final e, at least one; 0 for marks alone."""
    bare = F.regexp_replace(F.lower(word), r"^[.,!?;:]+|[.,!?;:]+\z", "")
    groups = F.regexp_count(bare, F.lit("[aeiouy]+")) - F.endswith(bare, F.lit("e")).cast("int")
    return F.when(bare == "", 0).otherwise(F.greatest(F.lit(1), groups))


def syllable_count(text: Column, re2: bool = False) -> Column:
    """The sum of all words' ``syllables``, from three searches of the whole text: no word is looked at by itself."""
    times = lambda low, pattern: F.regexp_count(low, F.lit(pattern)).cast("long")
    low = rx.spaced(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), rx.RE2_SPACES) if re2 else rx.spaced(F.lower(text))
    return rx.let(F.concat(F.lit(" "), low, F.lit(" ")), lambda low: times(low, "[aeiouy]+") - times(low, FINAL_E) + times(low, NO_GROUP))


def reading_ease(words: Column, sentences: Column, syllable: Column) -> Column:
    """Flesch reading ease from counts, kept within 0 and 100."""
    s, w = F.greatest(sentences, F.lit(1)), F.greatest(words, F.lit(1))
    score = F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * (syllable / w)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def readability(text: Column, re2: bool = False) -> Column:
    return reading_ease(word_count(text, re2), sentence_count(text), syllable_count(text, re2))


def rating(score: Column) -> Column:
    out = F.lit(rules.LOWEST_RATING)
    for name, least in reversed(rules.RATINGS.items()):
        out = F.when(score >= least, name).otherwise(out)
    return out


def document_type(text: Column) -> Column:
    low, out = F.lower(text), F.lit("unknown")
    for kind, phrases in reversed(rules.DOCUMENT_TYPES.items()):
        found = F.lit(False)
        for phrase in phrases:
            found = found | F.contains(low, F.lit(phrase))
        out = F.when(found, kind).otherwise(out)
    return out


def complexity(text: Column, cross_references: Column | int = 0) -> Column:
    """How hard a section is to understand, 1 at most."""
    refs = cross_references if isinstance(cross_references, Column) else F.lit(cross_references)
    length = word_count(text) / F.greatest(sentence_count(text), F.lit(1))
    terms = (
        (length / 20) * 0.3,
        (refs / 5) * 0.2,
        (rx.count(text, rx.cased(rules.NESTED_CLAUSE)) / 10) * 0.2,
        (rx.count(text, rx.fold(rules.COMPLEX_JARGON)) / 5) * 0.15,
        (rx.count(text, rx.cased(rules.COMPLEX_PASSIVE)) / 10) * 0.15,
    )
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.least(total, F.lit(1.0))


def citation(title: Column, chapter: Column, section: Column, subsection: Column, raw: Column) -> Column:
    """"Title t Ch. c § s (x)" of the parts there are, else the raw text."""
    given = lambda c, form: F.when(c != "", F.format_string(form, c))
    shown = F.concat_ws(" ", given(title, "Title %s"), given(chapter, "Ch. %s"), given(section, "§ %s"), given(subsection, "(%s)"))
    return F.when(shown != "", shown).otherwise(raw)


# Jargon ---------------------------------------------------------------------------------


def jargon_pattern(term: str, re2: bool = False) -> str:
    return (rx.re2 if re2 else rx.fold)(rf"\b{term}\b")


def any_jargon() -> str:
    return r"\b(?:" + "|".join(rules.JARGON) + r")\b"


def without_jargon(text: Column, re2: bool = False) -> Column:
    """All replacements one after another, then single spaces. A term is replaced where the plain text that it needs stands by then."""
    state = lambda x: F.struct(x.alias("out"), rx.folded(x).alias("low"))

    def without(term: str, plain: str) -> Callable[[Column], Column]:
        new = lambda s: rx.let(F.regexp_replace(s["out"], jargon_pattern(term, re2), plain), state)
        return lambda s: F.when(F.contains(s["low"], F.lit(rx.needed(term))), new(s)).otherwise(s)

    out = state(text)
    for term, plain in rules.JARGON.items():
        out = rx.let(out, without(term, plain))
    return F.regexp_replace(out["out"], "  +", " ")


def jargon_terms(text: Column, re2: bool = False) -> Column:
    """array<struct<after, found>>: what takes a term's place, and all its matches, in the order of the terms that there are."""

    def of(low: Column) -> Column:
        terms = []
        for term, plain in rules.JARGON.items():
            found = F.when(F.contains(low, F.lit(rx.needed(term))), F.regexp_extract_all(text, F.lit(jargon_pattern(term, re2)), F.lit(0)))
            terms.append(F.struct(F.lit(plain or "(removed)").alias("after"), found.alias("found")))
        return F.filter(F.array(*terms), lambda t: F.size(t["found"]) > 0)

    return rx.let(rx.folded(text), of)


def jargon_found(text: Column, re2: bool = False) -> Column:
    """Every match of every term, in the order of the terms."""
    return F.flatten(F.transform(jargon_terms(text, re2), lambda t: t["found"]))


def jargon_changes(text: Column, re2: bool = False) -> Column:
    """array<struct<before, after, n>>: the different matches of each term, sorted, what takes their place, and how often each stands there."""

    def of(t: Column) -> Column:
        times = lambda m: F.size(F.filter(t["found"], lambda x: x == m)).cast("long")
        return F.transform(F.array_sort(F.array_distinct(t["found"])), lambda m: F.struct(m.alias("before"), t["after"].alias("after"), times(m).alias("n")))

    return F.flatten(F.transform(jargon_terms(text, re2), of))


def passive_count(text: Column, re2: bool = False) -> Column:
    """Both patterns' matches: "is to be filed" counts twice."""
    total = F.lit(0)
    for pattern in rules.PASSIVE:
        total = total + rx.count(text, (rx.re2 if re2 else rx.fold)(pattern))
    return total.cast("long")


def long_sentences(text: Column, words: int = 30, shown: int = 100, most: int = 5) -> Column:
    """The first sentences of over ``words`` words, cut to ``shown`` characters and three dots."""
    parts = F.filter(F.split(text, rules.SENTENCE_END, -1), lambda s: word_count(s) > words)
    return F.transform(F.slice(parts, 1, most), lambda s: F.concat(F.substring(rx.strip(s), 1, shown), F.lit("...")))


# Provisions -----------------------------------------------------------------------------


def score_counts(text: Column) -> list[Column]:
    """Matches of each pattern that counts for the burden score."""
    return [rx.count(text, rx.fold(pattern)) for pattern in rules.SCORE_WEIGHTS]


def score_of(counts: list[Column]) -> Column:
    score = F.lit(rules.SCORE_START)
    for times, weight in zip(counts, rules.SCORE_WEIGHTS.values()):
        score = score + times * F.lit(weight)
    return F.greatest(F.lit(rules.SCORE_LOW), F.least(F.lit(rules.SCORE_HIGH), score))


def burden_score(text: Column) -> Column:
    return score_of(score_counts(text))


def or_not_specified(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise("Not specified")


def fee_list(text: Column, most: int = 3) -> Column:
    found = F.slice(F.regexp_extract_all(text, F.lit(rx.cased(rules.FEE)), F.lit(1)), 1, most)
    return F.transform(found, lambda f: F.concat(F.lit("$"), f))


def fees(text: Column, most: int = 3) -> Column:
    return or_not_specified(fee_list(text, most))


def timeframe_list(text: Column, most: int = 3) -> Column:
    part = lambda g: F.slice(F.regexp_extract_all(text, F.lit(rx.fold(rules.TIMEFRAME)), F.lit(g)), 1, most)
    return F.zip_with(part(1), part(2), lambda n, unit: F.concat(n, F.lit(" "), unit, F.lit("s")))


def timeframes(text: Column, most: int = 3) -> Column:
    return or_not_specified(timeframe_list(text, most))


def is_digital(text: Column) -> Column:
    return F.rlike(text, F.lit(rx.fold(rules.DIGITAL)))


def availability(found: Column) -> Column:
    return F.when(found, "Available").otherwise("Not mentioned")


def digital(text: Column) -> Column:
    return availability(is_digital(text))


# Severities and types -------------------------------------------------------------------


def severity_rank(name: Column) -> Column:
    """1 to 4 for LOW to CRITICAL, upper-cased first; 2 for anything else."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, s in enumerate(rules.SEVERITIES, 1) for x in (s, i))), F.upper(name)), F.lit(2))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, rules.SEVERITIES)), rank)


def category(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in rules.CATEGORY.items() for x in kv)), kind), F.lit(rules.DEFAULT_CATEGORY))


def typical_rank(kind: Column) -> Column:
    ranks = {k: rules.SEVERITIES.index(v) + 1 for k, v in rules.TYPICAL_SEVERITY.items()}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), kind), F.lit(rules.SEVERITIES.index(rules.DEFAULT_SEVERITY) + 1))


def escalated(rank: Column, excerpt: Column) -> Column:
    """The rank raised by the strongest of the words in the excerpt, CRITICAL at most."""
    low = F.lower(excerpt)
    raised = F.greatest(F.lit(0), *(F.when(F.contains(low, F.lit(w)), n).otherwise(0) for w, n in rules.ESCALATION.items()))
    return F.least(F.lit(len(rules.SEVERITIES)), rank + raised)


def mapped_type(name: Column) -> Column:
    """Type of a free-text name: the first type that contains it or that it contains, then by words in it.

    The empty name is contained in every type, so it is the first.
    """
    low = F.translate(F.lower(name), " -", "__")
    out = F.lit(rules.DEFAULT_TYPE)
    for word, kind in reversed(rules.TYPE_WORDS.items()):
        out = F.when(F.contains(low, F.lit(word)), kind).otherwise(out)
    for kind in reversed(rules.BURDEN_TYPES):
        out = F.when(F.contains(low, F.lit(kind)) | F.contains(F.lit(kind), low), kind).otherwise(out)
    return out
