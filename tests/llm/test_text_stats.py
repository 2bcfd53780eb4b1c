import random
import re
from collections import Counter

from regulith.llm import text_stats


def brute(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), len(lines), len(set(words)),
        sum("A" <= c <= "Z" for c in text), sum(c in "!?" for c in text), sum("0" <= c <= "9" for c in text), sum(a == b for a, b in zip(words, words[1:])),
    )


def test_measure_is_as_brute_force():
    rng = random.Random(4)
    for text in ["", " ", "\n\n", "a", "a a a", "a a a a", "x\x0by\x85z\xa0w\x1cv", *("".join(rng.choices(["a ", "bé ", "漢\n", "#", "A!", " \t", "7", "\x0c", "\n"], k=rng.randint(0, 80))) for _ in range(500))]:
        assert text_stats.measure(text.encode()) == brute(text), text


def test_long_text():
    assert text_stats.measure(b"ab cd " * 200_000)[:5] == (400_000, 800_000, 0, 0, 400_000)
