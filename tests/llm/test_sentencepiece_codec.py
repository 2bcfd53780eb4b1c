import hashlib
import random
from array import array

import pytest
import sentencepiece

from regulith.llm import sentencepiece_codec as codec
from regulith.llm.queries import op4_sentencepiece, public_model


@pytest.fixture(scope="module")
def both():
    with open(public_model(), "rb") as f:
        model = f.read()
    return codec.MergeCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def test_random_texts_and_ids_agree_with_the_library(both):
    own, library = both
    rng = random.Random(5)
    letters = list(" \n\t▁aeinthr.,\x00é漢字😀<s>/0x41\r  ​ﬁ") + ["  ", "the", "<s>", "</s>", "<0x0A>"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert [array("I", ids).tobytes()] == own.encode_all([text])
        assert library.decode(ids) == own.decode(array("I", ids).tobytes())
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 9))]
        assert library.decode(ids) == own.decode(array("I", ids).tobytes())


def test_a_long_text_without_spaces(both):
    own, library = both
    text = "".join(random.Random(1).choices("abcdeéthen", k=50_000))
    assert [array("I", library.encode(text, add_bos=True, add_eos=True)).tobytes()] == own.encode_all([text])


def test_rows_of_agendas_and_heaps_agree(both):
    own, _ = both
    rng = random.Random(3)
    chunks = ["".join(rng.choices("▁aeinthrst.é漢\x00", k=rng.randint(1, 48))) for _ in range(500)]
    assert own.merge_rows(chunks) == [array("I", own.merge(c)).tobytes() for c in chunks]


def test_the_check_covers_chunks_of_any_length(both, monkeypatch):
    own, _ = both
    seen = []
    monkeypatch.setattr(own, "verify", lambda x, check=own.verify: (seen.extend(c for c, _ in x), check(x)))
    for chunk in ("▁wrongs", "▁" + "longer" * 50, "漢字" * 40):
        own.encode_all([chunk[1:] if chunk[0] == "▁" else "\n" + chunk])
        assert chunk in seen
        for ids in ([0], own.merge("▁right")):
            with pytest.raises(ValueError):
                own.verify([(chunk, array("I", ids).tobytes())])


def test_query(spark, tmp_path, both):
    _, library = both
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b"), (4, "é\n漢"), (5, "word and " * 60_000), (6, "x\u200b漢" * 30_000), (7, "\n" * 5000)]
    spark.createDataFrame([(*r, "ids") for r in rows], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op4_sentencepiece(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_sentencepiece(spark, str(tmp_path)).collect() == []


def test_a_small_cache_gives_the_same_ids(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(codec, "CACHE_ENTRIES", 4)
    own.cache.clear()
    rng = random.Random(7)
    for _ in range(200):
        text = " ".join(rng.choices(["the", "ring", "of", "Über", "x", "漢字", "thing."], k=12))
        assert [array("I", library.encode(text, add_bos=True, add_eos=True)).tobytes()] == own.encode_all([text])
        assert len(own.cache) <= 4
