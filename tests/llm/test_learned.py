"""The learnt filters, held out: quality ranking, decision lists, languages."""

import random
import zlib

import numpy as np
import pytest

from regulith.llm import bradley_terry, decision_list, language_id, text_stats
from regulith.llm.queries import op2_decision_list, op6_bradley_terry, op7_rank_profiles

from .helpers import rows, save
from .test_text_stats import brute

ODD = [(None, "a b"), (9001, None), (9002, ""), (9003, "\n \t"), (9004, "x" * 300_000), (9005, "word " * 60_000), (9006, "... 123 !!"), (1, "the same id again")]
DOCS = "doc_id long, text string, lang string, source string, score double, kept boolean"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(8), str(tmp_path_factory.mktemp("learned"))
    words = {"en": ["the", "and", "thing", "with", "house", "ring"], "de": ["der", "und", "schön", "nicht", "haus", "zug"], "fr": ["le", "et", "été", "avec", "maison", "eaux"]}
    docs, labels = [], []
    for i in range(600):
        lang = rng.choice(list(words))
        own = [rng.choice(words[lang]) + rng.choice(["", "s", "ing", "en", "e"]) + rng.choice("abcdefgh") for _ in range(rng.randint(55, 160))]
        good = i % 4 != 0
        if not good:
            own = [w + rng.choice(["***", "%%"]) for w in own] if i % 8 else [w for w in own[:9] for _ in range(12)]
        docs.append((i, " ".join(own), None if i % 50 == 3 else lang, "s", 0.0, True))
        labels.append((i, int(good), 0))
    docs += [(i, t, None, None, None, None) for i, t in ODD]
    save(spark, path, "documents", docs, DOCS)
    save(spark, path, "labels", labels + [(None, 1, 0), (3, None, None), (88888, 0, 0)], "doc_id long, quality int, toxic int")
    return path, docs, dict((i, q) for i, q, _ in labels)


def test_quality_ranking(spark, folder):
    path, docs, truth = folder
    got = op6_bradley_terry(spark, path).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d[0] for d in docs), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_pairs_are_differences_and_few_suffice():
    good, bad = np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([[0.0, 1.0]])
    assert bradley_terry.preference_pairs(good, bad, 10, 0).tolist() == [[1.0, 1.0], [3.0, 3.0]]
    model = bradley_terry.fit(np.array([[0.0], [1.0], [5.0], [6.0]]), np.array([0, 0, 1, 1]), ("a",))
    assert (model.raw(np.array([[0.0], [1.0], [5.0], [6.0]])) > model.cut).tolist() == [False, False, True, True]
    assert bradley_terry.fit(np.ones((3, 1)), np.ones(3, int), ("a",)).weight == (0.0,)


def test_decision_list(spark, folder):
    path, docs, truth = folder
    got = {(r.doc_id, r.n_words): r for r in op2_decision_list(spark, path).collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        want = brute(text or "") if len(text or "") < 5000 else text_stats.measure((text or "").encode())
        r = got[i, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    told = [(r.kept, truth[i]) for (i, n), r in got.items() if i in truth and n > 10]
    assert np.mean([k == bool(q) for k, q in told]) > 0.97


def test_rules_are_conditions_that_cover_what_they_say(spark):
    rng = np.random.default_rng(1)
    x = rng.random((900, 2))
    reject = ((x[:, 0] > 0.7) & (x[:, 1] <= 0.5)) | (x[:, 1] > 0.95)
    rules = decision_list.fit(x, reject, ("a", "b"))
    covered = np.zeros(900, bool)
    for rule in rules.rules:
        covered |= rule.covers(x, ("a", "b"))
    assert (covered == reject).mean() > 0.97
    got = spark.createDataFrame(x.tolist(), "a double, b double").select(rules.number().alias("n")).collect()
    assert [r.n is not None for r in got] == covered.tolist()
    assert decision_list.fit(x, np.zeros(900, bool), ("a", "b")).rules == ()


def test_languages(spark, folder):
    path, docs, _ = folder
    got = op7_rank_profiles(spark, path).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in (9001, 9002, 9003, 9006):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    lang = {d[0]: d[2] for d in docs if d[2]}
    held = [r for r in got if r.held_out and r.doc_id in lang and r.doc_id > 10]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_ngram_counts_whole_and_in_blocks(monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choices("abCÉ ß.7\n", k=rng.randint(0, 60)))
        want: dict[str, int] = {}
        for word in "".join(c.lower() if c.isalpha() else " " for c in text).split():
            for n in (1, 2, 3):
                padded = word if n == 1 else f" {word} "
                for i in range(len(padded) - n + 1):
                    want[padded[i : i + n]] = want.get(padded[i : i + n], 0) + 1
        for block in (1 << 20, 5):
            monkeypatch.setattr(language_id, "BLOCK", block)
            keys, times = language_id.counts(text)
            got = {}
            for k, t in zip(keys.tolist(), times.tolist()):
                parts = [k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF]
                got["".join(" " if p == 1 else chr(p) for p in parts if p)] = t
            assert got == want


def test_verdicts_are_what_the_rules_say(spark, folder):
    path, docs, _ = folder
    rules = decision_list.learn(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert rules.rules
    got = {(r.doc_id, r.n_words): r for r in op2_decision_list(spark, path).collect()}
    for i, text, *_ in docs:
        stats = dict(zip(text_stats.NAMES, brute(text or "") if len(text or "") < 5000 else text_stats.measure((text or "").encode())))
        x = {k: stats[a] / stats[b] if stats[b] else 0.0 for k, (a, b) in text_stats.RATIOS.items()} | {"log_words": np.log10(stats["n_words"] + 1)}
        first = next((k for k, rule in enumerate(rules.rules, 1) if all(x[n] > t if sign == ">" else x[n] <= t for n, sign, t in rule.tests)), None)
        r = got[i, stats["n_words"]]
        assert r.rule == first and r.kept == (not r.base_failed and first is None)


def test_the_best_threshold_is_that_of_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(40):
        x, y = rng.integers(0, 6, (30, 3)).astype(float), rng.random(30) < 0.4
        best = -np.inf
        for j in range(3):
            values = np.unique(x[:, j])
            for t in (values[:-1] + values[1:]) / 2:
                for covered in (x[:, j] <= t, x[:, j] > t):
                    p, n = (y & covered).sum(), (~y & covered).sum()
                    if p:
                        best = max(best, p * (np.log2(p / (p + n)) - np.log2(y.sum() / len(y))))
        found = decision_list._best(x, y, 128)
        assert (found is None and best <= 0) or found[0] == pytest.approx(best)


def test_ranking_is_as_by_gradient_descent_over_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) * [1, 5, 0.2]
    y = (x @ [1.0, 0.3, -2] + rng.normal(size=40) > 0).astype(int)
    model = bradley_terry.fit(x, y, ("a", "b", "c"), ridge=0.01)
    z = (x - x.mean(0)) / x.std(0)
    w = np.zeros(3)
    for _ in range(20_000):
        grad = 2 * 0.01 * w
        d = np.array([z[i] - z[j] for i in range(40) if y[i] for j in range(40) if not y[j]])
        grad -= (d / (1 + np.exp(d @ w))[:, None]).mean(0)
        w -= 0.5 * grad
        if np.abs(grad).max() < 1e-9:
            break
    assert np.array(model.weight) * x.std(0) == pytest.approx(w, abs=1e-6)
    raw = sorted(z @ w)
    assert raw[(y == 0).sum() - 1] < model.cut < raw[(y == 0).sum()]


def grams(text):
    out = {}
    for word in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in text or "").split():
        for n in (1, 2, 3):
            padded = word if n == 1 else f"\x01{word}\x01"
            for i in range(len(padded) - n + 1):
                out[padded[i : i + n]] = out.get(padded[i : i + n], 0) + 1
    return out


def key(gram):
    return sum(ord(c) << (21 * (len(gram) - 1 - i)) for i, c in enumerate(gram))


def ranked(times, size):
    return sorted(times, key=lambda g: (-times[g], key(g)))[:size]


def test_languages_are_as_by_brute_force(spark, folder):
    path, docs, _ = folder
    by = {}
    for i, text, lang, *_ in docs:
        if lang and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            total = by.setdefault(lang, {})
            for g, n in grams(text).items():
                total[g] = total.get(g, 0) + n
    profiles = {name: {g: k for k, g in enumerate(ranked(total, 400))} for name, total in by.items()}
    got = [r for r in language_id.identify(spark.read.parquet(f"{path}/documents.parquet")).collect()]
    texts = {(d[0], d[1]) for d in docs}
    assert len(got) == len(texts)
    text = {d[0]: d[1] for d in docs if d[0] not in (1, None)}
    for r in got:
        own = ranked(grams(text[r.doc_id]), 400) if text.get(r.doc_id) else []
        if r.doc_id not in text or not own:
            continue
        far = {name: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)) / (400 * len(own)) for name, p in profiles.items()}
        best = min(far, key=lambda n: (far[n], n))
        assert r.lang_pred == best and r.score == pytest.approx(1 - far[best]) and r.distances == pytest.approx(far)


def test_letters_of_all_planes(spark, tmp_path):
    docs = [(i, f"{w} {w}s", lang, None, None, None) for i in range(40) for w, lang in (("house", "en"), ("haus", "de"))]
    save(spark, tmp_path, "documents", [*docs, (900, "\U00032100", None, None, None, None), (901, "\u0301 1", None, None, None, None)], DOCS)
    got = {r.doc_id: r.lang_pred for r in op7_rank_profiles(spark, str(tmp_path)).collect()}
    assert got[900] == "de" and got[901] == "und"


def test_empty_tables(spark, tmp_path):
    save(spark, tmp_path, "documents", [], DOCS)
    save(spark, tmp_path, "labels", [], "doc_id long, quality int, toxic int")
    for query in (op2_decision_list, op6_bradley_terry, op7_rank_profiles):
        assert query(spark, str(tmp_path)).collect() == []
    save(spark, tmp_path, "documents", [(1, "some text", None, None, None, None)], DOCS)
    assert rows(op6_bradley_terry(spark, str(tmp_path)), "doc_id", "score") == [(1, 0.5)]
    assert rows(op7_rank_profiles(spark, str(tmp_path)), "doc_id", "lang_pred", "score") == [(1, "und", 0.0)]
