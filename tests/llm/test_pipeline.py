"""Each stage of the pipeline on its own input, and all together."""

from collections import Counter

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from regulith.llm import mixing, stages
from regulith.llm.queries import public_model

from .helpers import rows
from .test_learned import folder  # noqa: F401
from .test_shingle_join import brute_labels

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, row_id int, copies int, kept boolean, key string, p string"


def table(spark, docs):
    return spark.createDataFrame([(*d, len(d[1] or ""), "x", "y", 1, 2, True, "k", "p") for d in docs], EXTRA)


def test_filters_keep_good_documents_with_all_columns(spark, folder):  # noqa: F811
    path, docs, truth = folder
    given = table(spark, [d[:4] for d in docs])
    good = pipeline.quality(spark, given, path)
    assert good.columns == given.columns
    kept = {r.doc_id for r in good.collect()}
    told = [i for i in truth if i is not None and i > 10 and i < 600]
    assert np.mean([(i in kept) == bool(truth[i]) for i in told]) > 0.97
    spoken = pipeline.language(spark, good, path)
    assert spoken.columns == given.columns
    rows = {r.doc_id: r for r in spoken.collect()}
    assert not {9001, 9002, 9003, 9006} & set(rows)
    assert np.mean([i in rows for i in kept if i is not None and 10 < i < 600]) > 0.99
    assert all(r.lang for r in rows.values())


def test_another_language_goes(spark, folder):  # noqa: F811
    path, docs, _ = folder
    moved = [(i, t, {"en": "fr", "fr": "de", "de": "en"}[lang] if lang and i % 40 == 5 else lang, s) for i, t, lang, s, *_ in docs[:600]]
    left = {r.doc_id for r in pipeline.language(spark, table(spark, moved), path).collect()}
    assert left == {i for i, _, lang, _ in moved if not (i % 40 == 5 and lang)}


def test_without_a_language_to_learn_texts_with_letters_stay(spark, tmp_path):
    docs = [(1, "some words", None, "s"), (2, "12 34 !", None, "s"), (3, None, None, "s")]
    assert [r.doc_id for r in pipeline.language(spark, table(spark, docs), str(tmp_path)).collect()] == [1]


def test_one_of_each_group_stays(spark, tmp_path):
    texts = [f"alpha{i} beta{i % 7} gamma{i * i} delta epsilon{i} zeta{i % 5} eta" for i in range(40)]
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(i + 100, t.upper(), "en", "s") for i, t in enumerate(texts[:25])]
    docs += [(3, texts[3], "en", "s"), (None, texts[4], "en", "s"), (None, "only null ids here", None, None), (None, "only null ids here", None, None), (500, None, None, None), (501, "", None, None)]
    out = pipeline.near_duplicates(spark, table(spark, docs), str(tmp_path))
    groups = {}
    for d, g in zip(docs, brute_labels([d[1] for d in docs])):
        groups.setdefault(g, []).append(d[0])
    want = sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=repr)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == want and out.columns == table(spark, docs).columns


def test_mix_repeats_whole_rows(spark, tmp_path):
    docs = [(i, "w " * (i % 9 + 1), "en", f"s{i % 4}") for i in range(300)] + [(1, None, None, None), (5, "w w", "en", "s1"), (5, "w w", "en", "s1")]
    given = table(spark, docs)
    out = pipeline.mix(spark, given, str(tmp_path))
    assert out.columns == given.columns
    want = Counter()
    for r in mixing.mix(given).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_whole_pipeline(spark, folder):  # noqa: F811
    path, docs, truth = folder
    got = pipeline.run(spark, path).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_model())
    text = {d[0]: d[1] for d in docs if d[0] != 1}
    assert got and all(r.n_tokens == len(library.encode(text[r.doc_id], add_bos=True, add_eos=True)) for r in got if r.doc_id in text and r.doc_id is not None)
    assert np.mean([truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id > 10]) > 0.97
    assert [name for name, _ in pipeline.STAGES] == ["quality", "language", "near_duplicates", "mix", "encode"]


@pytest.mark.parametrize("docs", [[], [(1, None, None, None)]])
def test_little_input(spark, tmp_path, docs):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = table(spark, docs)
    for _, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == table(spark, docs).columns
    assert rows.count() == 0


def test_columns_with_backticks(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "en", "a", 3), (2, "other words of another text", "en", "a", 4)], "doc_id long, text string, lang string, source string, `a``b.c` int")
    assert stages.mixed(docs).columns == docs.columns and sorted(set(stages.mixed(docs).toPandas()["a`b.c"])) in ([3], [4], [3, 4])
    assert rows(stages._whole(docs).select("row.*"), "doc_id") == [(1,), (2,)]
