"""The pipeline's near-duplicates against all pairs compared."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from regulith.llm import shingle_join

EXTRA = "doc_id long, text string, lang string"


def brute_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_labels(texts, least=0.8):
    found = [brute_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a == b or len(a & b) >= least * len(a | b) - 1e-9:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def planted(rng):
    words = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choices(words, k=25))
    texts = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(30, 250))
        texts.append(" ".join(base) + (" " + line if i % 3 else ""))
        for share in (0.005, 0.01, 0.02, 0.03, 0.04):
            copy = [rng.choice(words) if rng.random() < share else w for w in base]
            texts.append(" ".join(copy) + (" " + line if i % 3 else ""))
    group = rng.choices(words, k=300)
    texts += [" ".join(group[:k] + [f"n{k}"] + group[k:]) for k in range(0, 300, 3)]
    chain = rng.choices(words, k=400)
    texts += [" ".join(chain[k : k + 120]) for k in range(0, 280, 12)]
    return texts + ["a b c", "A  b c", "a b d", None, "", " \n"]


@pytest.mark.parametrize("how", [{}, {"sampled": 0, "listed": 0}])
def test_components_are_those_of_all_pairs(spark, how):
    texts = planted(random.Random(3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(df, **how).collect()}
    assert [got[i] for i in range(len(texts))] == brute_labels(texts)


def test_stage_drops_copies_at_0_8_to_0_95(spark, tmp_path):
    rng = random.Random(8)
    docs, dropped = [], set()
    for i in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        copy = list(base)
        for at in range(10, 10 + 40 * (1 + i % 4), 40):
            copy[at] = "other"
        a, b = brute_set(" ".join(base)), brute_set(" ".join(copy))
        assert 0.8 <= len(a & b) / len(a | b) < 0.96
        docs += [(i, " ".join(base), "en"), (1000 + i, " ".join(copy), "en")]
        dropped.add(1000 + i)
    left = {r.doc_id for r in pipeline.near_duplicates(spark, spark.createDataFrame(docs, EXTRA), str(tmp_path)).collect()}
    assert left == {d[0] for d in docs} - dropped


def test_sketches_bound_the_similarity_of_sets():
    rng = np.random.default_rng(5)
    for n, m in [(0, 0), (0, 3), (1, 1), (7, 8), (40, 60), (500, 520), (4000, 3300)]:
        both = rng.integers(0, 1 << 64, n, np.uint64)
        for kept in (0.0, 0.3, 0.8, 1.0):
            a = np.unique(both)
            b = np.unique(np.concatenate([both[: int(kept * n)], rng.integers(0, 1 << 64, max(0, m - int(kept * n)), np.uint64)]))
            common = len(np.intersect1d(a, b))
            like = common / max(1, len(a) + len(b) - common)
            bound = shingle_join.most_like(shingle_join.sketch(a), shingle_join.sketch(b))
            assert like <= bound <= 1
            if n >= 500 and kept <= 0.3:
                assert bound < 0.8
    crowded = np.arange(300, dtype=np.uint64)  # all begin alike: a count that a byte doesn't hold bounds nothing
    assert shingle_join.sketch(crowded) == b""
    assert shingle_join.most_like(shingle_join.sketch(crowded), shingle_join.sketch(both)) == 1


def test_a_group_around_one_text_needs_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            copy[at] = f"n{i}x{at}"
        texts.append(" ".join(copy))
    made, keep = [], shingle_join.written
    monkeypatch.setattr(shingle_join, "written", lambda df, path: made.append(path) or keep(df, path))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute_labels(texts)
    pairs = spark.read.parquet(next(p for p in made if p.endswith("/pairs"))).count()
    assert pairs < 5 * len(texts)  # all pairs are 80,200
