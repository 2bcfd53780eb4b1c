"""How far the sources of a language differ, by a vocabulary in two passes.

Texts are cut into terms (letters and characters beyond ASCII, A-Z lower-cased) once and packed:
a block holds the texts of some documents, as one compressed text for each language and source
in it. The first pass counts for each block in how many of its documents a term stands; their
sums are exact document frequencies, and terms in enough documents of their language are kept.
Each block then gets the kept terms that occur in it, as an automaton over the terms with a
delimiter on either side, and the second pass runs the automaton over its texts and counts
occurrences. So no task holds a vocabulary, only that of a block of bounded size.

Occurrences are postings: (language, source, term, n) for n > 0. All arithmetic is on whole
numbers: a term's weight is p = 1 + floor(10^9 (n + 1) / (N + V)), the distance of two weights
floor((p - q)^2 / q). All terms that don't stand in a source have one weight there, so a sum over
the whole vocabulary comes from postings alone: terms in both sources, term by term, within parts
of the vocabulary; terms in one, by how many have the same weight; terms in neither, by their number.

Defined results: null text, language or source is ''. Rows are documents, whether or not ids or texts
repeat. A language without a kept term has pairs of value 0 and no terms. Ties go to the smaller item in
UTF-8 order. Other columns are not looked at. An empty table has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, scratch, written

#: Bytes of the texts of a block.
BLOCK = 48 << 20
#: Rows of an Arrow batch, and postings of a part of the vocabulary.
ROWS, PART = 100_000, 20_000
SCALE = 1_000_000_000
#: What each byte of a text becomes: bytes that part terms become spaces.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, lang, source, texts: the terms of each document with a space on either side, a line for each document."""
    held: dict[tuple[str, str], list[bytes]] = {}
    task, number, size = TaskContext.get().partitionId(), 0, 0

    def packed() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        for (lang, source), lines in held.items():
            texts = zstandard.ZstdCompressor(level=3).compress(b"\n".join(lines))
            lines.clear()
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), pa.array([lang]), pa.array([source]), pa.array([texts], pa.binary())], ["block", "lang", "source", "texts"])
        held.clear()
        number, size = number + 1, 0

    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for key, text in zip(keys, as_bytes(batch.column("text"))):
            line = b" " + b" ".join(text.translate(FOLDED).split()) + b" "
            held.setdefault(key, []).append(line)
            size += len(line) + 64
            if size > BLOCK:
                yield from packed()
    yield from packed()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, lang, term, docs: documents of a block with the term. Neighbouring rows of a block are counted together."""
    at, seen = None, {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, times in seen.items():
            terms, docs = list(times), list(times.values())
            for i in range(0, len(terms), ROWS):
                part = _strings(terms[i : i + ROWS])
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int64()), pa.array([lang] * len(part)), part, pa.array(docs[i : i + ROWS], pa.int64())], ["block", "lang", "term", "docs"])
        seen.clear()

    for batch in batches:
        for i, (block, lang) in enumerate(zip(batch.column("block").to_pylist(), batch.column("lang").to_pylist())):
            if block != at:
                yield from counted()
                at = block
            times = seen.setdefault(lang, Counter())
            for line in zstandard.ZstdDecompressor().decompress(batch.column("texts")[i].as_py()).split(b"\n"):
                times.update(set(line.split()))
    yield from counted()


def _recount(block: pa.Table, kept: pa.Table) -> pa.Table:
    """lang, term, found: occurrences of kept terms in a block's sources, by an automaton over terms between spaces."""
    out = []
    for lang in sorted(set(kept.column("lang").to_pylist())):
        terms = kept.filter(pa.compute.equal(kept.column("lang"), lang)).column("term").combine_chunks()
        automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms.to_pylist()):
            automaton.add_word(f" {term} ", i)
        automaton.make_automaton()
        own = block.filter(pa.compute.equal(block.column("lang"), lang))
        each = []
        for i in range(len(own)):
            text = zstandard.ZstdDecompressor().decompress(own.column("texts")[i].as_py()).decode()
            found = Counter(map(itemgetter(1), automaton.iter(text)))
            each.append(np.array([list(found.keys()), [i] * len(found), list(found.values())], np.int64))
        term, source, n = np.concatenate(each, axis=1) if each else np.empty((3, 0), np.int64)
        order = np.argsort(term, kind="stable")
        some, starts = np.unique(term[order], return_index=True)
        items = pa.StructArray.from_arrays([own.column("source").combine_chunks().take(pa.array(source[order])), pa.array(n[order])], ["source", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), items)
        out.append(pa.table([pa.array([lang] * len(some), pa.string()), terms.take(pa.array(some)), lists], ["lang", "term", "found"]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], pa.string())] * 2 + [pa.array([], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))], ["lang", "term", "found"])


def postings(docs: DataFrame, folder: str, least: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, source) of all groups, and (lang, source, term, n): occurrences of the terms that ``least`` documents of the language have."""
    named = docs.select(F.coalesce(lang_col, F.lit("")).alias("lang"), F.coalesce(source_col, F.lit("")).alias("source"), F.col(text_col).alias("text"))
    blocks = written(named.mapInArrow(_pack, "block long, lang string, source string, texts binary"), f"{folder}/blocks")
    seen = blocks.select("block", "lang", "texts").mapInArrow(_frequencies, "block long, lang string, term string, docs long")
    whole = F.sum("docs").over(Window.partitionBy("lang", "term"))  # a term has a row for each block at most, and all move once
    kept = seen.withColumn("in_all", whole).where(F.col("in_all") >= least).select("block", "lang", "term")
    counted = blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(_recount, "lang string, term string, found array<struct<source: string, n: long>>")
    each = counted.repartition("lang", "term").select("lang", "term", F.explode("found").alias("f")).select("lang", "f.source", "term", "f.n")
    return blocks.select("lang", "source").distinct(), written(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), f"{folder}/postings")


def _weight(n: Column, total: str, vocabulary: str) -> Column:
    """1 + floor(10^9 (n + 1) / (N + V)), in decimals, as the product can leave 64 bits."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (F.col(total) + F.col(vocabulary)).cast("decimal(20,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(group: pa.Table) -> pa.Table:
    """lang, source, other, value: over terms of a part of the vocabulary that stand in both, what their distance adds to that of terms in one or none."""
    source, term = group.column("source").combine_chunks().dictionary_encode(), group.column("term").combine_chunks().dictionary_encode()
    names, at, word = source.dictionary.to_pylist(), source.indices.to_numpy(), term.indices.to_numpy()
    weight, absent = group.column("p").to_numpy(), group.column("absent").to_numpy()
    distance = lambda p, q: (p - q) ** 2 // q
    out: list[tuple[str, str, int]] = []
    for a, name in enumerate(names):
        own = np.zeros(len(term.dictionary), np.int64)
        own[word[at == a]] = weight[at == a]
        rows = np.flatnonzero((own[word] > 0) & (at != a))
        p, q, q0, p0 = own[word[rows]], weight[rows], absent[rows], absent[np.argmax(at == a)]
        sums, met = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        np.add.at(sums, at[rows], distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0))
        met[at[rows]] = True
        out += [(name, names[b], int(sums[b])) for b in np.flatnonzero(met)]
    columns = list(zip(*out)) or [(), (), ()]
    lang = group.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(out), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "source", "other", "value"])


def audit(docs: DataFrame, top: int = 200, **how) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` for the other sources of the language, ``term`` for the ``top`` terms that are more frequent than in the language."""
    folder = scratch(docs.sparkSession, "audit")
    groups, counts = postings(docs, folder, **how)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").select("lang", "source", *map(zero, ("total", "own", "v", "all")))
    groups = written(groups.withColumn("absent", F.when(F.col("v") > 0, _weight(F.lit(0), "total", "v"))), f"{folder}/groups")

    parts = max(1, math.ceil(counts.count() / PART))
    dealt = counts.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts))).repartition("lang", "part")
    weighed = dealt.join(groups, ["lang", "source"]).withColumn("p", _weight(F.col("n"), "total", "v"))

    whole = F.sum("n").over(Window.partitionBy("lang", "part", "term"))
    told = weighed.withColumn("in_all", whole).withColumn("q", _weight(F.col("in_all"), "all", "v")).where(F.col("p") > F.col("q"))
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))

    both = weighed.select("lang", "part", "source", "term", "p", "absent").groupBy("lang", "part").applyInArrow(_shared, "lang string, source string, other string, value long")
    here = groups.select("lang", "source", "own", "v", "absent")
    there = groups.select("lang", F.col("source").alias("other"), F.col("own").alias("other_own"), F.col("absent").alias("other_absent"))
    alike = weighed.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).join(there, "lang").where(F.col("source") != F.col("other"))
    alike = alike.groupBy("lang", "source", "other").agg(
        F.sum(F.col("n") * _distance(F.col("p"), F.col("other_absent"))).alias("to"), F.sum(F.col("n") * _distance(F.col("other_absent"), F.col("p"))).alias("of")
    )
    pairs = here.join(there, "lang").where(F.col("source") != F.col("other"))
    neither = (F.col("v") - F.col("own") - F.col("other_own")) * _distance(F.col("absent"), F.col("other_absent"))
    added = both.unionByName(alike.select("lang", "source", "other", F.col("to").alias("value"))).unionByName(alike.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("of").alias("value")))
    added = added.unionByName(pairs.select("lang", "source", "other", F.coalesce(neither, F.lit(0)).alias("value")))
    summed = added.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    first = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return summed.withColumn("rank", F.row_number().over(order)).unionByName(first)


#: The same for DuckDB, over a table ``documents``: each group with each kept term.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), found AS (
  SELECT r, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + s.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) d ON d.lang = a.lang AND d.source = a.source AND d.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""
