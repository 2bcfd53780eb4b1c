import random
import re
from collections import Counter

from regulith.llm import source_audit
from regulith.llm.queries import op12_source_audit

from .helpers import oracle, rows, save

COLUMNS = ("lang", "source", "part", "item", "value", "rank")
SCHEMA = "doc_id long, text string, lang string, source string, term string, block int"


def brute(docs):
    groups, terms = {}, {}
    for _, text, lang, source, *_ in docs:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
        terms.setdefault(lang or "", Counter()).update(set(words))
    out = []
    for lang in terms:
        kept = sorted(t for t, n in terms[lang].items() if n >= 3)
        own = {s: c for (g, s), c in groups.items() if g == lang}
        share = lambda count, t: 1 + 1_000_000_000 * (count[t] + 1) // (sum(count[k] for k in kept) + len(kept))
        p = {s: {t: share(c, t) for t in kept} for s, c in own.items()}
        q = {t: share(sum(own.values(), Counter()), t) for t in kept}
        far = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(b, sum(far(p[s][t], p[b][t]) for t in kept)) for b in own if b != s]
            words = [(t, far(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < 200]
    return sorted(out, key=repr)


def documents(seed=3, n=160):
    rng = random.Random(seed)
    words = [f"w{a}{b}".translate(str.maketrans("0123456789", "abcdefghij")) for a in range(30) for b in range(20)] + ["Über", "ÉTÉ", "日本語", "it's", "a_b", "x" * 300, "é"]
    out = [(i, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.choice([0, 1, 30, 200]))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "ä", "", None, "c"]), "x", 1) for i in range(n)]
    out += [(i, "The same text, THE same", "fr", "hot", "x", 1) for i in range(60)] + [(1, None, "fr", "cold", "x", 1), (1, "", "fr", "hot", "x", 1), (None, "only once", "xx", "s", "x", 1), (None, "only twice", "xx", "t", "x", 1)]
    return out


def test_as_brute_force_and_sql(spark, tmp_path, monkeypatch):
    docs = documents()
    save(spark, tmp_path, "documents", docs, SCHEMA)
    got = rows(op12_source_audit(spark, str(tmp_path)), *COLUMNS)
    assert got == brute(docs)
    assert got == oracle(tmp_path, source_audit.SQL, COLUMNS, "documents")
    assert {r[2] for r in got} == {"pair", "term"} and max(r[5] for r in got) == 200


def test_small_blocks_and_parts_give_the_same(spark, monkeypatch):
    docs = documents(4, 60)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    monkeypatch.setattr(source_audit, "PART", 50)
    assert rows(source_audit.audit(df), *COLUMNS) == brute(docs)


def test_blocks_are_cut_by_size(monkeypatch):
    import pyarrow as pa

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(source_audit.TaskContext, "get", staticmethod(lambda: Task))
    monkeypatch.setattr(source_audit, "BLOCK", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 20), pa.array(["a"] * 40), pa.array(["Some words here 12 " * 5] * 40)], ["lang", "source", "text"])
    packed = pa.Table.from_batches(source_audit._pack(iter([batch])))
    assert len(set(packed.column("block").to_pylist())) > 3
    seen = pa.Table.from_batches(source_audit._frequencies(iter(packed.to_batches())))
    assert sum(seen.column("docs").to_pylist()) == 3 * 40
    kept = pa.table([["en", "de"], ["words", "some"]], ["lang", "term"])
    found = [source_audit._recount(packed.filter(pa.compute.equal(packed.column("block"), b)), kept) for b in set(packed.column("block").to_pylist())]
    assert sum(f["n"] for t in found for fs in t.column("found").to_pylist() for f in fs) == 5 * 40


def test_a_very_long_text(spark, tmp_path):
    docs = [(1, "Very long TEXT " * 300_000, "en", "a", "x", 1), (2, "very short text", "en", "b", "x", 1), (3, "text very long", "en", "b", "x", 1)]
    save(spark, tmp_path, "documents", docs, SCHEMA)
    assert rows(op12_source_audit(spark, str(tmp_path)), *COLUMNS) == brute(docs)


def test_empty_table(spark, tmp_path):
    save(spark, tmp_path, "documents", [], SCHEMA)
    assert op12_source_audit(spark, str(tmp_path)).collect() == []
