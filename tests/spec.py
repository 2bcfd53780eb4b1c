"""The same computations in plain Python, written from their descriptions, to compare Spark's results with."""

import re

from regulith.functions import rules

I = re.IGNORECASE


def split_sections(text):
    """(section id, title, text, location)"""
    marks = sorted((m.start(), m.group(1)) for p in rules.SECTION_MARKERS for m in re.finditer(p, text, I))
    if not marks:
        return [("1", None, text.strip(), "1")]
    out = []
    for k, (at, name) in enumerate(marks):
        whole = text[at : marks[k + 1][0] if k + 1 < len(marks) else len(text)].strip()
        line, sep, rest = whole.partition("\n")
        titled = sep and len(line) < 200
        out.append((name, line.strip() if titled else None, rest.strip() if titled else whole, f"§ {name}"))
    return out


def excerpt(text, a, b, around, strip):
    lo, hi = max(0, a - around), min(len(text), b + around)
    body = text[lo:hi].strip() if strip else text[lo:hi]
    return ("..." if lo else "") + body + ("..." if hi < len(text) else "")


def findings(text, combined=True, least=30, most=50):
    """(sec_pos, source, type, severity rank, location, excerpt)"""
    out, asked = [], 0
    rank = lambda t: 1 + rules.SEVERITIES.index(rules.TYPICAL_SEVERITY.get(t, "MEDIUM"))
    for pos, (_, _, body, where) in enumerate(split_sections(text)):
        for group, patterns in rules.STATUTORY.items():
            kind = rules.GROUP_TYPE.get(group, group)
            for p in patterns:
                for m in re.finditer(p, body, I):
                    shown = excerpt(body, *m.span(), 150, True)
                    raised = max([0, *(n for w, n in rules.ESCALATION.items() if w in shown.lower())])
                    out.append((pos, 0, kind, min(4, rank(kind) + raised), where, shown))
        if combined and len(body.split()) > least and asked < most:
            asked += 1
            seen = set()
            for kind, patterns in rules.TAXONOMY.items():
                for p in patterns:
                    for m in re.finditer(p, body, I):
                        if kind not in seen:
                            seen.add(kind)
                            out.append((pos, 1, kind, rank(kind), where, excerpt(body, *m.span(), 100, False)))
    return out


def syllables(word):
    word = word.lower().strip(".,!?;:")
    return max(1, len(re.findall("[aeiouy]+", word)) - word.endswith("e")) if word else 0


def ease(text):
    s, words = len(re.findall("[.!?]+", text)) or 1, text.split()
    w = len(words) or 1
    return max(0, min(100, 206.835 - 1.015 * (w / s) - 84.6 * (sum(map(syllables, words)) / w)))


def plain(text):
    for term, other in rules.JARGON.items():
        text = re.sub(rf"\b{term}\b", other, text, flags=I)
    return re.sub("  +", " ", text)


def score(text):
    return max(1.0, min(10.0, 5.0 + sum(len(re.findall(p, text, I)) * w for p, w in rules.SCORE_WEIGHTS.items())))


def complexity(text, refs=0):
    count = lambda p, f=0: len(re.findall(p, text, f))
    length = len(text.split()) / max(1, count("[.!?]+"))
    return min(1.0, length / 20 * 0.3 + refs / 5 * 0.2 + count(rules.NESTED_CLAUSE) / 10 * 0.2 + count(rules.COMPLEX_JARGON, I) / 5 * 0.15 + count(rules.COMPLEX_PASSIVE) / 10 * 0.15)
