import random

import numpy as np
from pyspark.sql import functions as F

from regulith.llm import top_inner
from regulith.llm.queries import op3_norm_sorted

from .helpers import oracle, rows, save

COLUMNS = ("query_id", "rank", "vec_id", "score")


def vectors(n=260, dim=8, seed=1):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1, 3]) for _ in range(dim)], 0) for i in range(n)]
    out += [(n + i, [1.0] * dim, 0) for i in range(90)]  # many of one length and direction
    nan, inf = float("nan"), float("inf")
    return out + [(1000, None, 0), (1020, [1.0, None] + [0.0] * (dim - 2), 0), (1040, [nan] * dim, 0), (1060, [inf] + [0.0] * (dim - 1), 0), (None, [9.0] * dim, 0)]


def test_as_in_sql_for_all_sizes_of_blocks(spark, tmp_path):
    save(spark, tmp_path, "embeddings", vectors(), "vec_id long, embedding array<float>, score int")
    want = oracle(tmp_path, top_inner.SQL, COLUMNS, "embeddings")
    assert rows(op3_norm_sorted(spark, str(tmp_path)), *COLUMNS) == want
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(top_inner.top_k(df, F.col("vec_id") % 20 == 0, block=37, queries_a_task=3, sample=10), *COLUMNS) == want


def test_few_vectors(spark, tmp_path):
    for data in ([], [(0, [1.0], 0)], [(0, [1.0], 0), (1, [2.0], 0), (20, [], 0)]):
        save(spark, tmp_path, "embeddings", data, "vec_id long, embedding array<float>, score int")
        got = rows(op3_norm_sorted(spark, str(tmp_path)), *COLUMNS)
        assert got == ([] if len(data) < 3 else [(0, 1, 1, 64 * 128), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)])


def test_pruning_leaves_results_whole():
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    make = lambda n: np.floor((rng.normal(size=(n, 16)) * 0.6 ** np.arange(16)) @ basis * 100).astype(np.int64)
    vectors, queries = make(4000), make(30)
    ids, own = rng.permutation(4000), np.full(30, -1)
    rotation = top_inner.fit_rotation(vectors)
    i, j, score, scored = top_inner.search(queries, own, vectors, ids, np.arange(4000), 5, rotation, run=64)
    assert scored < 0.2 * 4000 * 30
    full = queries @ vectors.T
    for q in range(30):
        order = np.lexsort((ids, -full[q]))[:5]
        assert j[i == q].tolist() == order.tolist() and score[i == q].tolist() == full[q, order].tolist()


def test_huge_components_are_whole_numbers():
    big = np.array([[2.0**30, 3], [2**30, 2], [2**30, 1]])
    i, j, score, _ = top_inner.search(big[:1], np.array([7]), big, np.arange(3), np.arange(3), 2, np.eye(2))
    assert j.tolist() == [0, 1] and score.tolist() == [2**60 + 9, 2**60 + 6]


def test_large_components_and_scores_beyond_64_bits(spark, tmp_path):
    data = [(0, [1e8] + [0.0] * 63, 0), (1, [1.0] + [0.0] * 63, 0), (2, [-1e30] * 64, 0), (20, [3e30] + [1.5] * 63, 0), (40, [0.0] * 64, 0), (3, [3.3e6] * 64, 0)]
    save(spark, tmp_path, "embeddings", data, "vec_id long, embedding array<float>, score int")
    got = {r[:3:2]: r[3] for r in rows(op3_norm_sorted(spark, str(tmp_path)), *COLUMNS)}
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v, _ in data}
    limit = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = {(q, c): limit(sum(a * b for a, b in zip(whole[q], whole[c]))) for q in (0, 20, 40) for c in whole if q != c}
    assert got == want and got[0, 1] == 409600000000 and got[0, 20] == 2**63 - 1
    save(spark, tmp_path, "embeddings", data[:2] + data[4:], "vec_id long, embedding array<float>, score int")
    assert rows(op3_norm_sorted(spark, str(tmp_path)), *COLUMNS) == oracle(tmp_path, top_inner.SQL, COLUMNS, "embeddings")


def test_rows_that_repeat_ids_are_queries_and_candidates_of_their_own(spark, tmp_path):
    rng = random.Random(6)
    data = [(i % 45, [rng.gauss(0, 2) for _ in range(6)], 0) for i in range(150)]
    data += [(20, data[20][1], 0), (20, data[20][1], 0), (7, data[7][1], 0), (40, [1e7] * 6, 0), (40, [1.0] * 3, 0)]
    save(spark, tmp_path, "embeddings", data, "vec_id long, embedding array<float>, score int")
    want = oracle(tmp_path, top_inner.SQL, COLUMNS, "embeddings")
    assert rows(op3_norm_sorted(spark, str(tmp_path)), *COLUMNS) == want
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(top_inner.top_k(df, F.col("vec_id") % 20 == 0, block=10, queries_a_task=4), *COLUMNS) == want


def test_finite_components_of_any_size(spark, tmp_path):
    for kind, sizes in (("float", [3e37, 3.4e38, 5.4e36, 1e-45]), ("double", [1e307, 1.7e308, 3e37, 5e-324])):
        data = [(20 * i, [x, -x, 1.5] + [x] * 5, 0) for i, x in enumerate(sizes)] + [(101 + i, [-x / 3, x / 7, 0.25] + [0.0] * 5, 0) for i, x in enumerate(sizes)]
        data += [(200, [1.0] * 8, 0), (201, [0.0] * 8, 0), (220, [0.0] * 8, 0), (203, [2.5] * 8, 0)]
        save(spark, tmp_path, "embeddings", data, f"vec_id long, embedding array<{kind}>, score int")
        own = np.float32 if kind == "float" else float
        whole = {i: [int(float(own(x))) * 64 if abs(x) > 2**60 else int(np.floor(64 * float(own(x)))) for x in v] for i, v, _ in data}
        limit = lambda x: max(-(2**63), min(2**63 - 1, x))
        want = []
        for q in whole:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q) if q % 20 == 0 else []
            want += [(q, c, limit(-s)) for s, c in scores]
        got = rows(op3_norm_sorted(spark, str(tmp_path)), "query_id", "vec_id", "score")
        assert got == sorted(want, key=repr)
        df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
        few = rows(top_inner.top_k(df, F.col("vec_id") % 20 == 0, k=3, block=3, queries_a_task=2), "query_id", "rank", "score")
        by = {q: sorted((-s for a, _, s in want if a == q))[:3] for q in whole if q % 20 == 0}
        assert few == sorted([(q, i + 1, -s) for q, v in by.items() for i, s in enumerate(v)], key=repr)
