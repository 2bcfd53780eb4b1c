"""Near-duplicates by the Jaccard similarity of word shingles: SimHash groups, and an exact prefix join.

Words are as in ``simhash``: A-Z lower-cased, parted at ASCII white space. A
document is the set of XXH64 digests of its shingles of ``width`` words (the whole
sequence if there are fewer). Documents of equal set are one node; nodes link at a
similarity of ``least`` or more, and a component is what links reach.

Close copies are found by SimHash: fingerprints of the sets go through the trie
self-join of ``simhash``, and what it links is compared by the whole sets. Fingerprints
of documents that are similar in ``least`` differ in some 10 bits of 64, at which a trie
of random fingerprints would have to compare nearly all of them, so the rest is found
by a prefix join: every pair at ``least`` or more is. With the shingles of all documents in one
order, such a pair shares one of the first n - ceil(least * n) + 1 of each. Any order
is right; rare shingles first makes few candidates, so those that are common in a
sample come last, by their number. Entries (shingle, document) travel packed, by the
first bits of the shingle, and one that no other document holds ends there; those of
sampled shingles, which many documents may hold, go as rows, whose centre is found by
partial sums: the document in which the shingle stands first, as the fewest rare shingles
precede it there, so that most others may be like it (of equal ones, the smallest). A
shingle's documents are first held against its centre alone, and then, in pairs, only where
components still differ: a group of copies needs no pairs. Candidates first meet by
sketches, numbers of shingles by their first bits, whose smaller numbers add up to the most
that two sets can share; those that may reach ``least`` are compared by their whole sets.

Defined results: null, empty and blank texts are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop, scratch, share, written
from .simhash import components, labelled, links

WIDTH, LEAST = 5, 0.8
SLACK = 1e-9  # what products of LEAST may be off by
KEPT_BYTES = 1 << 13  # packed texts up to this size are kept with their sets while their pairs are compared


def shingles(text: bytes, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The set of shingles as ascending digests."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = len(words) - width + 1
    if n <= 1:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, stops)), np.uint64, n))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def sets(text: Column, width: int = WIDTH) -> Column:
    return F.arrow_udf(lambda texts: _lists([shingles(x, width) for x in as_bytes(texts)]), "array<long>")(text)


def signed(text: Column, common: np.ndarray, counts: np.ndarray, width: int = WIDTH, least: float = LEAST) -> Column:
    """(fp, sim, n, sketch, prefix): digest, SimHash, size and sketch of the set, and its first shingles in the order of all; ``common`` ascends."""

    def prefix(s: np.ndarray) -> np.ndarray:
        weight = np.zeros(len(s), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            weight = np.where(common[at] == s, counts[at], 0)
        return s[np.lexsort((s, weight))[: len(s) - math.ceil(least * len(s) - SLACK) + 1]]

    def batch(texts: pa.Array) -> pa.Array:
        found = [shingles(x, width) for x in as_bytes(texts)]
        fp = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in found], np.uint64).view(np.int64)
        sim = np.array([majority(s) for s in found], np.uint64).view(np.int64)
        size, counts = pa.array([len(s) for s in found], pa.int32()), pa.array(map(sketch, found), pa.binary())
        return pa.StructArray.from_arrays([pa.array(fp), pa.array(sim), size, counts, _lists([prefix(s) for s in found])], ["fp", "sim", "n", "sketch", "prefix"])

    return F.arrow_udf(batch, "struct<fp: long, sim: long, n: int, sketch: binary, prefix: array<long>>")(text)


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """SimHash of a set: the bits that are 1 in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def sketch(s: np.ndarray) -> bytes:
    """How many of the set's shingles begin with each number of some bits, so many that two to four share one; empty if a count doesn't fit."""
    bits = max(0, len(s).bit_length() - 2)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_like(a: bytes, b: bytes) -> float:
    """A bound on the similarity of the sets of two sketches."""
    if not a or not b:
        return 1.0
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    few = min(len(x), len(y))
    x, y = (v.reshape(few, -1).sum(1) for v in (x, y))
    common = int(np.minimum(x, y).sum())
    return common / max(1, int(x.sum() + y.sum()) - common)


def bounded(a: Column, b: Column) -> Column:
    """``most_like`` of two columns of sketches."""

    def batch(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(map(most_like, as_bytes(x), as_bytes(y)), pa.float64())

    return F.arrow_udf(batch, "double")(a, b)


def close_pairs(nodes: DataFrame, folder: str) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (fp, sim) that connect what fingerprints within 3 bits connect."""
    heads = written(nodes.groupBy("sim").agg(F.min("fp").alias("head")), f"{folder}/heads")
    same = nodes.join(heads, "sim").where(F.col("fp") != F.col("head")).select(F.col("head").alias("a"), F.col("fp").alias("b"))
    forest = written(links(heads, "sim"), f"{folder}/forest")
    end = lambda side: heads.select(F.col("sim").alias(side), F.col("head").alias(f"fp_{side}"))
    return same.union(forest.join(end("a"), "a").join(end("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))


ENTRIES = "part int, h binary, fp binary, n binary, at binary"
SHARED = "h long, fp long, n int, at int, first struct<fp: long, n: int, at: int>"


def _packed_entries(batches: Iterator[pa.RecordBatch], common: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Entries of shingles that aren't ``common``, by the first ``bits`` of the shingle."""
    for batch in batches:
        prefix = batch["prefix"]
        sizes = prefix.value_lengths().to_numpy(zero_copy_only=False)
        h = prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if len(common):
            rare = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
            h, doc, at = h[rare], doc[rare], at[rare]
        part = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange((1 << bits) + 1))
        fp, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("fp", "n"))
        rows = []
        for p in np.flatnonzero(np.diff(ends)).tolist():
            own = order[ends[p] : ends[p + 1]]
            rows.append((p, h[own].tobytes(), fp[doc[own]].tobytes(), n[doc[own]].astype("<u4").tobytes(), at[own].astype("<u4").tobytes()))
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "h", "fp", "n", "at"])


def _shared(table: pa.Table) -> pa.Table:
    """Entries of shingles that several documents hold, each with that of its shingle's centre: the document in which it stands first."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])
    h, fp, n, at = read("h", "<i8"), read("fp", "<i8"), read("n", "<u4").astype(np.int32), read("at", "<u4").astype(np.int32)
    by = np.argsort(h, kind="stable")
    several = np.zeros(len(h), bool)
    equal = h[by][1:] == h[by][:-1]
    several[1:] |= equal
    several[:-1] |= equal
    by = by[several]
    by = by[np.lexsort((fp[by], at[by], h[by]))]
    h, fp, n, at = h[by], fp[by], n[by], at[by]
    start = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
    first = pa.StructArray.from_arrays([pa.array(x[head]) for x in (fp, n, at)], ["fp", "n", "at"])
    return pa.table([pa.array(h), pa.array(fp), pa.array(n), pa.array(at), first], ["h", "fp", "n", "at", "first"])


def shared_entries(nodes: DataFrame, common: np.ndarray, bits: int, folder: str) -> DataFrame:
    """h, fp, n, at, first: entries of shingles that several of ``nodes`` (fp, n, prefix; fp distinct) hold, looked for in 2^``bits`` parts."""
    packed = nodes.select("fp", "n", "prefix").mapInArrow(partial(_packed_entries, common=common, bits=bits), ENTRIES)
    rare = written(packed.groupBy("part").applyInArrow(_shared, SHARED), f"{folder}/rare")
    listed = nodes.sparkSession.createDataFrame(pa.table({"l": common.view(np.int64)})) if len(common) else None
    if listed is None:
        return rare
    # a bounded list (``listed``); what it keeps is a small part of all entries
    often = nodes.select("fp", "n", F.posexplode("prefix").alias("at", "h")).join(F.broadcast(listed), F.col("h") == F.col("l")).select("h", "fp", "n", "at")
    often = written(often, f"{folder}/often")
    first = often.groupBy("h").agg(F.min(F.struct("at", "fp", "n")).alias("m"), F.count("*").alias("many")).where("many > 1").select(F.col("h").alias("fh"), F.struct("m.fp", "m.n", "m.at").alias("first"))
    first = written(first, f"{folder}/first")
    often = often.join(first, often.h == first.fh).select("h", "fp", "n", "at", "first")
    return rare.union(often)


def packed(text: Column) -> Column:
    """UTF-8 of texts, compressed: a text goes along with each pair that it is in. Null counts as empty."""

    def batch(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.array(map(pack, as_bytes(texts)), pa.binary())

    return F.arrow_udf(batch, "binary")(text)


def jaccard(a: Column, b: Column, width: int = WIDTH) -> Column:
    """Similarity of the whole sets of two packed texts."""

    def batch(x: pa.Array, y: pa.Array) -> pa.Array:
        unpack = zstandard.ZstdDecompressor().decompress
        out, known = [], lru_cache(maxsize=256)(lambda data: shingles(unpack(data), width))
        of = lambda data: known(data) if len(data) < KEPT_BYTES else shingles(unpack(data), width)
        for s, t in zip(x, y):
            s, t = of(s.as_py()), of(t.as_py())
            common = len(np.intersect1d(s, t, assume_unique=True))
            out.append(common / max(1, len(s) + len(t) - common))
        return pa.array(out, pa.float64())

    return F.arrow_udf(batch, "double")(a, b)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST, sampled: int = 20_000, listed: int = 200_000) -> DataFrame:
    """Per row: id, fp (digest of the set) and component_id, the smallest id that links reach. Ids are distinct."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "shingles")
    c = F.col
    some = docs.where(share(c(id_col)) < max(0.1, sampled / max(1, docs.count())))
    often = some.select(F.explode(sets(c(text_col), width)).alias("h")).groupBy("h").count().where("count >= 3")
    often = often.orderBy(F.desc("count"), "h").limit(listed).toArrow()
    common, counts = often["h"].to_numpy().view(np.uint64), often["count"].to_numpy()
    order = np.argsort(common)
    common, counts = common[order], counts[order]
    told = docs.select(c(id_col), signed(c(text_col), common, counts, width, least).alias("s"))
    signatures = written(told.select(id_col, "s.*"), f"{folder}/signed")
    fps = written(signatures.select(id_col, "fp"), f"{folder}/fps")
    distinct = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")), f"{folder}/distinct")
    nodes = signatures.join(distinct.select(c("least").alias(id_col)), id_col, "left_semi")
    close = written(close_pairs(nodes.select("fp", "sim"), folder), f"{folder}/close")
    shared = written(shared_entries(nodes, common, max(1, (docs.rdd.getNumPartitions() * 4 - 1).bit_length()), folder), f"{folder}/shared")
    for name in ("rare", "often", "first"):
        drop(spark, f"{folder}/{name}")

    def possible(n: Column, at: Column, m: Column, to: Column) -> Column:
        """Sets of n and m shingles whose first common ones stand at these places can reach ``least``."""
        need = F.ceil(F.lit(least / (1 + least)) * (n + m) - SLACK)
        return (F.least(n, m) >= F.greatest(n, m) * least - SLACK) & (F.least(n - at, m - to) >= need)

    stars = shared.where((c("fp") != c("first.fp")) & possible(c("n"), c("at"), c("first.n"), c("first.at")))
    stars = written(stars.select(c("first.fp").alias("a"), c("fp").alias("b")).distinct(), f"{folder}/stars")

    def met(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
        """``pairs`` with x and y, what ``values`` (least, own) hold for a and b."""
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(distinct, "fp"), f"{folder}/{name}-ends")
        held = written(values.join(ends, "least").select("fp", "own"), f"{folder}/{name}")
        return pairs.join(held.select(c("fp").alias("a"), c("own").alias("x")), "a").join(held.select(c("fp").alias("b"), c("own").alias("y")), "b")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that reach ``least``, by the whole sets."""
        likely = written(met(pairs, signatures.select(c(id_col).alias("least"), c("sketch").alias("own")), f"{name}-sketch").where(bounded(c("x"), c("y")) >= least - SLACK).select("a", "b"), f"{folder}/{name}-likely")
        both = met(likely, docs.select(c(id_col).alias("least"), packed(c(text_col)).alias("own")), f"{name}-text")
        found = written(both.select("a", "b", jaccard(c("x"), c("y"), width).alias("like")).where(c("like") >= least - SLACK).select("a", "b"), f"{folder}/{name}")
        for kind in ("sketch", "text"):
            drop(spark, f"{folder}/{name}-{kind}")
        return found

    near = linked(close, "close-links")
    one = written(components(near), f"{folder}/close-roots")
    root = lambda side: one.select(c("node").alias(side), c("root").alias(f"root_{side}"))
    apart = stars.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    edges = near.union(linked(written(apart, f"{folder}/apart"), "star-links"))
    roots = written(components(edges), f"{folder}/star-roots")
    held = shared.join(roots, shared.fp == roots.node, "left").select("h", "fp", "n", "at", F.coalesce("root", "fp").alias("root"), c("first.fp").alias("least"))
    held = written(held, f"{folder}/held")
    mixed = held.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("h")
    rest = written(held.where("fp <> least").join(mixed, "h", "left_semi").drop("least"), f"{folder}/rest")
    other = rest.select("h", *(c(x).alias(f"{x}2") for x in ("fp", "n", "at", "root")))
    pairs = rest.join(other, "h").where((c("fp") < c("fp2")) & (c("root") != c("root2")) & possible(c("n"), c("at"), c("n2"), c("at2")))
    pairs = written(pairs.select(c("fp").alias("a"), c("fp2").alias("b")).distinct(), f"{folder}/pairs")
    for name in ("shared", "held", "rest"):
        drop(spark, f"{folder}/{name}")
    if pairs.take(1):
        edges = edges.union(linked(pairs, "pair-links"))
    drop(spark, f"{folder}/signed")
    return labelled(fps, distinct, edges, id_col, folder)
