import gzip
import io
import random

import pytest

from regulith.llm import warc
from regulith.llm.queries import op5_warc

from .helpers import oracle, rows, save

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages():
    rng = random.Random(3)
    out = [(i, "".join(rng.choices("aé<p>\r\n漢", k=rng.choice([0, 1, 50, 5000])))) for i in range(60)]
    return [(*r, "u") for r in out + [(i + 100, t) for i, t in out[:20]] + [(200, None), (201, ""), (None, "x"), (None, ""), (7, "WARC/1.1\r\n\r\n"), (7, "WARC/1.1\r\n\r\n"), (7, "another payload"), (3, "another payload")]]


def test_query_is_as_in_sql(spark, tmp_path):
    save(spark, tmp_path, "pages", pages(), "page_id long, html string, url string")
    assert rows(op5_warc(spark, str(tmp_path)), *COLUMNS) == oracle(tmp_path, warc.SQL, COLUMNS, "pages")


def test_small_chunks_give_the_same_rows_and_payloads(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, html string, url string")
    manifest = warc.archive(spark, df, "page_id", "html", f"{tmp_path}/a", chunk=7)
    back = warc.read_archives(manifest, chunk=5).collect()
    found = {}
    for r in sorted((r for r in back if r.record_type == "response" and r.record_id is not None), key=lambda r: (r.record_id, r.chunk_no)):
        if r.record_id != 7:
            found[r.record_id] = found.get(r.record_id, b"") + r.chunk
    assert all(len(r.chunk) <= 5 for r in back)
    texts = {i: (t or "").encode() for i, t, _ in pages()}
    assert found and all(texts[i] == payload for i, payload in found.items())
    last = [r for r in back if r.payload_digest is not None]
    assert len(last) == len(pages())


def test_min_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abc"), (4, "abc")], "page_id long, html string")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.through_archives(df, uri_col=None, min_bytes=3).collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_damaged_archives_are_noticed():
    head = warc._head("response", 0, 1, "http://a.net/\r\nx é", None, 3, warc.base32(__import__("hashlib").sha1(b"abc").digest()))
    good = gzip.compress(head + warc.HTTP + b"abc\r\n\r\n")
    assert [r[:5] for r in warc.records(io.BytesIO(good))] == [(1, "response", None, 3, "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5")]
    for bad in (good[:-9], gzip.compress(head + warc.HTTP + b"abd\r\n\r\n"), gzip.compress(b"junk\r\n")):
        with pytest.raises((ValueError, EOFError)):
            list(warc.records(io.BytesIO(bad)))


def test_large_payloads_go_through_in_chunks(spark, tmp_path):
    rng = random.Random(9)
    large = ["".join(rng.choices("abcdefgh é\n", k=2_500_000)) for _ in range(2)]
    data = [(1, large[0], "http://a.net/"), (2, large[1], None), (3, large[0], "http://b.net/"), (4, "small", "x y\nz")]
    save(spark, tmp_path, "pages", data, "page_id long, html string, url string")
    assert rows(op5_warc(spark, str(tmp_path)), *COLUMNS) == oracle(tmp_path, warc.SQL, COLUMNS, "pages")
    manifest = warc.archive(spark, spark.read.parquet(f"{tmp_path}/pages.parquet"), "page_id", "html", f"{tmp_path}/b", "url")
    back = warc.read_archives(manifest).collect()
    assert max(len(r.chunk) for r in back) <= warc.CHUNK and len([r for r in back if r.record_id == 2]) >= 3
    assert b"".join(r.chunk for r in sorted((r for r in back if r.record_id == 2), key=lambda r: r.chunk_no)) == large[1].encode()


def test_records_are_valid(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, html string, url string").repartition(3)
    manifest = warc.archive(spark, df, "page_id", "html", f"{tmp_path}/c", "url").collect()
    ids, kinds = [], []
    for r in manifest:
        with gzip.open(r.path.removeprefix("file:")) as f:
            heads = [h for h in f.read().split(b"WARC/1.1\r\nWARC-Type: ")[1:]]
        own = [dict(line.split(b": ", 1) for line in b"WARC-Type: ".join([b"", h]).split(b"\r\n\r\n")[0].split(b"\r\n")) for h in heads]
        assert own[0][b"WARC-Type"] == b"warcinfo" and all(f[b"WARC-Target-URI"] for f in own[1:])
        ids += [f[b"WARC-Record-ID"] for f in own[1:]]
        kinds += [(f[b"WARC-Type"], f.get(b"WARC-Refers-To")) for f in own[1:]]
    assert len(set(ids)) == len(ids) == len(pages()) and all(to in ids for kind, to in kinds if kind == b"revisit")


def test_empty_table(spark, tmp_path):
    save(spark, tmp_path, "pages", [], "page_id long, html string, url string")
    assert op5_warc(spark, str(tmp_path)).collect() == []
