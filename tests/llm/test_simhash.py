import random
import re

import numpy as np
import xxhash

from regulith.llm import simhash
from regulith.llm.queries import op9_simhash_trie

from .helpers import rows, save


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(values, budget=3):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    label = np.arange(len(values))
    while True:
        new = np.array([label[x].min() for x in near]) if len(values) else label
        if (new == label).all():
            return label
        label = new


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["a ", "Bé ", "c\n", "É", "d\x0b", "\x85", " "], k=rng.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    long = " ".join(rng.choices(["x", "y", "zz"], k=3000))
    assert simhash.fingerprint(long.encode(), block=64) == simhash.fingerprint(long.encode()) == brute_fingerprint(long)


def test_trie_join_finds_what_links_reach(monkeypatch):
    rng = np.random.default_rng(1)
    for t in range(150):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 1 << 48, max(1, n // 5), dtype=np.uint64)
        values = base[rng.integers(0, len(base), n)]
        for _ in range(int(rng.integers(1, 4))):
            values = values ^ (np.uint64(1) << rng.integers(0, 48, n).astype(np.uint64))
        values = np.unique(values)
        monkeypatch.setattr(simhash, "SMALL", int(rng.choice([1, 4, 64])))
        monkeypatch.setattr(simhash, "MOST_PAIRS", int(rng.choice([8, 1 << 20])))
        assert (simhash.trie_join(values, np.array([[0, len(values)] * 2]), 3, 16) == brute_labels(values)).all(), t


def test_links_across_tasks_and_split_subtrees(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    values = base[rng.integers(0, 40, 900)]
    for _ in range(3):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    # a chain of steps of three bits, and one subtree with most of the entries
    chain = np.array([(1 << (3 * k)) - 1 for k in range(20)], np.uint64)
    values = np.unique(np.concatenate([values, chain, rng.integers(0, 1 << 10, 700, dtype=np.uint64) << np.uint64(20)]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    label = values[brute_labels(values)]
    for subtree in (20_000, 7):
        edges = simhash.links(df, subtree=subtree)
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        groups = {}
        for v, want in zip(values.view(np.int64).tolist(), label.tolist()):
            groups.setdefault(want, set()).add(got.get(v, v))
        assert all(len(x) == 1 for x in groups.values())
        assert len({x for g in groups.values() for x in g}) == len(groups)


def test_query(spark, tmp_path):
    rng = random.Random(9)
    text = [" ".join(rng.choices("abcdefghijkl", k=40)) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(text)] + [(i + 100, t.upper()) for i, t in enumerate(text[:20])] + [(i + 200, t + " q") for i, t in enumerate(text[:30])]
    docs += [(300, None), (301, ""), (302, " \n"), (None, text[3]), (None, "none but this"), (5, text[5]), (400, "z " * 50_000)]
    save(spark, tmp_path, "documents", [(*d, 1, 2) for d in docs], "doc_id long, text string, fp int, component_id int")
    fps = np.array([brute_fingerprint(t) if len(t or "") < 5000 else simhash.fingerprint(t.encode()) for _, t in docs], np.uint64)
    u, inverse = np.unique(fps, return_inverse=True)
    label = brute_labels(u)[inverse]
    least = {k: min((d for (d, _), g in zip(docs, label) if g == k and d is not None), default=None) for k in set(label.tolist())}
    want = sorted(((d, f"{fp:016x}", least[k]) for (d, _), fp, k in zip(docs, fps.tolist(), label.tolist())), key=repr)
    assert rows(op9_simhash_trie(spark, str(tmp_path)), "doc_id", "fingerprint", "component_id") == want


def test_empty_table(spark, tmp_path):
    save(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert op9_simhash_trie(spark, str(tmp_path)).collect() == []
