"""Syllables of whole texts, and jargon replaced step by step, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from regulith.functions import rules, rx, text

from . import spec


def test_as_word_by_word(spark):
    rng = random.Random(9)
    pieces = ["e", "a", "y", "b", "T", "the", "E", ".", "!", ";", "'", "-", "é", "İ", "Σ", "5", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "e", "e.", ".e", "...", "e.e", "tree eye brr", "aeee" * 500, "b" * 5000 + "e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string").select("i", text.syllable_count(F.col("t")).alias("n"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()  # no word by itself
    got = {r.i: r.n for r in df.collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(texts))] == [sum(map(spec.syllables, t.split())) for t in texts]


def test_jargon_one_term_after_another(spark):
    rng = random.Random(10)
    pieces = [*rules.JARGON, "shall", "be", "in", "order", "to", "PRIOR", "Whereaſ", "it", "\n", "x", " ", "İ", "is required to be"]
    texts = [rng.choice([" ", "  "]).join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(500)] + ["shall hereby be", "in hereby order to", ""]

    def plain(t):
        for term, new in rules.JARGON.items():
            t = re.sub(rf"\b{term}\b", new, t, flags=re.I)
        return re.sub("  +", " ", t)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string").select("i", text.without_jargon(F.col("t")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(texts))] == list(map(plain, texts))
    assert spark.range(1).select(rx.spaced(F.lit("a b\x1cc d"))).first()[0] == "a b c d"
