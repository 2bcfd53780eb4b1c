import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from regulith.llm import elias_fano, ngram_lm
from regulith.llm.queries import op10_elias_fano_lm

from .helpers import save


def test_sequences():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n, universe = int(rng.integers(0, 200)), int(rng.choice([201, 300, 10**6, 1 << 60]))
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        s = elias_fano.Sequence(elias_fano.build(values, universe))
        assert (s.access(np.arange(n)) == values).all() and (s.all() == values).all()
        x = np.concatenate([values, rng.integers(0, universe, 50, dtype=np.uint64)])
        at, equal = s.successor(x)
        assert (equal == np.isin(x, values)).all()
        assert (at == np.searchsorted(values, x)).all()


def test_packed_numbers_and_files(tmp_path):
    rng = np.random.default_rng(3)
    for width in (0, 1, 7, 24, 33, 63):
        values = rng.integers(0, 1 << width, 500, dtype=np.uint64)
        elias_fano.save(f"file://{tmp_path}/x/{width}", {"a": elias_fano.pack(values, width, 64), "b": np.array([0.5, 2.0])})
        read = elias_fano.load(f"file://{tmp_path}/x/{width}")
        assert (elias_fano.unpack(read["a"], width, np.arange(500)) == values).all() and read["b"].tolist() == [0.5, 2.0]


def documents():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)] + ["É", "Über", "x\x85y"]
    out = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60))).title()) for i in range(150)]
    return [(*d, 1.0) for d in out + [(200, None), (201, ""), (202, " \n\t"), (None, "w1 W2 w1"), (7, out[7][1]), (203, "hot " * 5000), (204, "never seen words")]]


def brute(docs, mu2, mu3=None):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t, _ in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    one, two, three, pairs = Counter(), Counter(), Counter(), Counter()
    for (_, w), h in zip(tokens, held):
        if not h:
            one.update(w)
            two.update(zip([None, *w[:-1]], w))
            three.update(zip([None, *w[:-2]], w[:-1], w[1:]))
            pairs.update(zip([None, *w[:-2]], w[:-1]))
    n, v = sum(one.values()), len(one)
    p1 = lambda x: (one[x] + 1) / (n + v + 1)
    p2 = lambda a, x: (two[a, x] + mu2 * p1(x)) / (one[a] + mu2)
    p3 = lambda a, b, x: (three[a, b, x] + mu3 * p2(b, x)) / (pairs[a, b] + mu3) if mu3 else p2(b, x)
    out = []
    for (i, w), h in zip(tokens, held):
        score = math.log10(p2(None, w[0])) + sum(math.log10(p3(a, b, x)) for a, b, x in zip([None, *w[:-2]], w[:-1], w[1:]))
        out.append((i, h, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"shard_bits": 5, "bits": 16, "unit_tokens": 100}, {"mus": (50.0,), "shard_bits": 1, "unit_tokens": 700}])
def test_as_brute_force(spark, tmp_path, how):
    save(spark, tmp_path, "documents", documents(), "doc_id long, text string, score double")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = ngram_lm.score_documents(df, **how) if how else op10_elias_fano_lm(spark, str(tmp_path))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = brute(documents(), *how.get("mus", (300.0, 30.0)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], abs=(1e-4 if "bits" in how else 1.5e-3) * w[2])


def test_blocks_of_tokens_give_the_same_counts():
    texts = [t.encode() for _, t, _ in documents() if t]
    totals = []
    for most in (1 << 20, 50):
        two, three = Counter(), Counter()
        for distinct, place, ends in ngram_lm.token_blocks(texts, most):
            g = ngram_lm.Grams(distinct, place, ends, 3)
            for a, b, n in zip(distinct[g.before].tolist(), distinct[g.after].tolist(), g.pair_times.tolist()):
                two[a, b] += n
            for c, x, n in zip(g.context.tolist(), distinct[g.last].tolist(), g.triple_times.tolist()):
                three[int(distinct[g.before[c]]), int(distinct[g.after[c]]), x] += n
            assert (distinct[g.after[g.shorter]] == distinct[g.last]).all() and (g.before[g.shorter] == g.after[g.context]).all()
        totals.append((two, three))
    assert totals[0] == totals[1]


def test_nothing_to_learn_from(spark, tmp_path):
    save(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert op10_elias_fano_lm(spark, str(tmp_path)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    save(spark, tmp_path, "documents", [(held, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in op10_elias_fano_lm(spark, str(tmp_path)).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_a_common_pair_makes_no_large_unit(spark):
    rng = random.Random(8)
    texts = [" ".join(x for _ in range(40) for x in ("of", "the", f"w{rng.randrange(4000)}", f"v{rng.randrange(50)}")) for _ in range(250)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    cut, whole = ngram_lm.train(df, unit_tokens=2_000), ngram_lm.train(df, unit_tokens=10**9)
    sizes = [ngram_lm.opened_unit(uri, cut.bits).entries for _, uri in cut.units[1]]
    assert cut.parts.several and max(sizes) <= 3_000 and sum(sizes) == sum(ngram_lm.opened_unit(uri, whole.bits).entries for _, uri in whole.units[1])
    some = [t.encode() for t in [*texts[:5], "of the w1 never seen", ""]]
    a, b = ([np.concatenate(x) for x in zip(*m.score(some))] for m in (cut, whole))
    assert all((x == y).all() for x, y in zip(a[:3], b[:3])) and np.abs(a[3] - b[3]).max() < 0.01 * np.abs(b[3]).max()


def test_select_and_neighbours():
    rng = np.random.default_rng(4)
    words = np.concatenate([rng.integers(0, 1 << 64, 300, dtype=np.uint64) & rng.integers(0, 1 << 64, 300, dtype=np.uint64), np.array([1, 1 << 63, (1 << 64) - 1], np.uint64)])
    for word in words[words > 0]:
        ones = [i for i in range(64) if int(word) >> i & 1]
        assert elias_fano._select_in_word(np.full(len(ones), word), np.arange(len(ones))).tolist() == ones
    # buckets and gaps of many words, far from any hint
    for values in (np.repeat(np.array([5, 6, 900], np.uint64), [300, 1, 700]), np.array([0, 1, 1 << 20, (1 << 20) + 1], np.uint64), np.arange(0, 10**6, 7, dtype=np.uint64)):
        arrays = elias_fano.build(values, (1 << 20) + 2)
        s, at = elias_fano.Sequence(arrays), rng.permutation(len(values) - 1)
        assert {len(arrays[k]) for k in ("one_words",)} == {-(-len(values) // elias_fano.HINT)}
        assert all((x == values[at + i]).all() for i, x in enumerate(s.both(at)))
        x = rng.integers(0, 1 << 20, 2000, dtype=np.uint64)
        assert (s.successor(x)[0] == np.searchsorted(values, x)).all()
