import random

from regulith.llm import mixing
from regulith.llm.queries import op8_systematic_mix

from .helpers import oracle, rows, save

COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def documents(sources, n=600, seed=2):
    rng = random.Random(seed)
    out = [(i, " ".join(["w"] * rng.choice([1, 3, 20, 90, 400])), rng.choice(sources), 1) for i in range(n)]
    return out + [(n, None, sources[0], 1), (n + 1, "\t \n", "blank", 1), (5, "a b", sources[0], 1), (5, "a b", sources[0], 1), (None, "x y z", None, 1)]


def filled(sizes, weights, share=1.5, cap=2):
    """Sharing out step by step: whoever is above stops, the rest share what is over."""
    total, capped = share * sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        aims = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if aims[i] >= cap * sizes[i]}
        if not over:
            return [cap * s if i in capped else aims[i] for i, s in enumerate(sizes)]
        capped |= over


def test_as_in_sql_and_near_targets(spark, tmp_path):
    for k, sources in enumerate((["b", "a", "ä", "c", None], ["one"], [f"s{i}" for i in range(9)])):
        save(spark, tmp_path, "documents", documents(sources, seed=k), "doc_id long, text string, source string, copies int")
        got = rows(op8_systematic_mix(spark, str(tmp_path)), *COLUMNS)
        assert got == oracle(tmp_path, mixing.SQL, COLUMNS, "documents")
        mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).toPandas()
        by = mixed.assign(taken=mixed.copies * mixed["size"]).groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
        by = by.sort_index(na_position="last")
        aims = filled(by["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(by))])
        assert all(abs(a - b) <= 1e-6 * max(1, a) for a, b in zip(aims, by.target))
        assert all(abs(t - a) <= 0.05 * a + 500 for t, a in zip(by.taken, by.target))
        assert mixed.copies.max() <= 2


def test_a_very_long_text_and_null_ids(spark, tmp_path):
    docs = [*documents(["a", "b"]), (900, "long text " * 100_000, "a", 1), *((None, "w " * k, "b", 1) for k in range(30))]
    save(spark, tmp_path, "documents", docs, "doc_id long, text string, source string, copies int")
    assert rows(op8_systematic_mix(spark, str(tmp_path)), *COLUMNS) == oracle(tmp_path, mixing.SQL, COLUMNS, "documents")


def test_empty_table(spark, tmp_path):
    save(spark, tmp_path, "documents", [], "doc_id long, text string, source string")
    assert op8_systematic_mix(spark, str(tmp_path)).collect() == []
