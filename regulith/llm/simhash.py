"""Near-duplicates by SimHash, with a binary trie self-join of the fingerprints.

A fingerprint is 64 bits: A-Z lower-cased, words parted at ASCII white space,
shingles of three words (repeats included; the whole sequence if there are
fewer), XXH64 with seed 42 of each; a bit is 1 if it is 1 in over half of the
hashes. Documents of equal fingerprint are one node. Nodes link at 3 differing
bits or fewer, and a component is what links reach.

The self-join walks a binary trie over sorted fingerprints: a pair of trie nodes
(two ranges of the sorted list) goes on to the pairs of their children, adds 1 to
its errors where the children's bits differ, and ends when the errors exceed the
budget. Small ranges are compared entry by entry, and pairs of ranges that are
one component already are left out.

Tasks get subtrees: two fingerprints that differ in at most 3 bits agree in one
of four blocks of 16 bits, so the trie is taken with each block in front, and the
subtree below each value of the block is a task's unit. A subtree with more than
``subtree`` fingerprints is dealt out again, as pairs of nodes so many levels deeper
that none holds more, if the two are within the budget. What a unit returns are edges of a spanning forest,
fewer than it has fingerprints, whatever the number of its links. Components of
all edges come from alternating star contractions.

Defined results: a null, empty or blank text has fingerprint 0 and links like any
other. Null ids don't count for the smallest id of a component; a component
without any other has null. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop, scratch, written

BUDGET, BLOCKS, WIDTH = 3, 4, 16
SMALL, MOST_PAIRS, UNIT_ROWS = 64, 1 << 17, 200_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(line)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, block):
        hashes = np.fromiter((digest(line[a:b]) for a, b in zip(starts[at : at + block], stops[at : at + block])), np.uint64, min(block, n - at))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed 64-bit number."""

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x) for x in as_bytes(texts)], np.uint64).view(np.int64))

    return F.arrow_udf(batch, "long")(text)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# The self-join inside a unit ------------------------------------------------------------


def _spread(lo1: np.ndarray, n1: np.ndarray, lo2: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of entries of pairs of ranges."""
    total = n1 * n2
    which = np.repeat(np.arange(len(total)), total)
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return lo1[which] + at // n2[which], lo2[which] + at % n2[which]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make the labels (smallest entry of each component) follow the links a-b."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def trie_join(values: np.ndarray, ranges: np.ndarray, budget: int = BUDGET, depth: int = 0) -> np.ndarray:
    """Label of each entry: the first entry that links within ``budget`` bits reach.

    ``ranges`` has rows (lo1, hi1, lo2, hi2): stretches of ``values`` to be joined, with
    themselves where both are the same. Values in a stretch are distinct, ascending
    and agree in their first ``depth`` bits.
    """
    label = np.arange(len(values))
    stack = [(depth, *ranges.T, np.zeros(len(ranges), np.int64))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, lo1, hi1, lo2, hi2, errors = stack.pop()
        if len(lo1) > MOST_PAIRS:
            half = len(lo1) // 2
            stack += [(depth, *(x[half:] for x in (lo1, hi1, lo2, hi2, errors))), (depth, *(x[:half] for x in (lo1, hi1, lo2, hi2, errors)))]
            continue
        same = lo1 == lo2
        keep = (hi1 > lo1) & (hi2 > lo2) & ~(same & (hi1 - lo1 < 2))
        # pairs of ranges that are one component already have nothing to add
        change = np.cumsum(np.concatenate([[0], label[1:] != label[:-1]])) if len(label) else label
        a, b = np.minimum(lo1, len(label) - 1), np.minimum(lo2, len(label) - 1)
        keep &= ~((change[a] == change[np.maximum(hi1 - 1, 0)]) & (change[b] == change[np.maximum(hi2 - 1, 0)]) & (label[a] == label[b]))
        lo1, hi1, lo2, hi2, errors, same = (x[keep] for x in (lo1, hi1, lo2, hi2, errors, same))
        small = ((hi1 - lo1) * (hi2 - lo2) <= SMALL) | (depth >= 64)
        s = np.flatnonzero(small)
        for part in np.array_split(s, max(1, len(s) * SMALL // (4 * MOST_PAIRS))):
            i, j = _spread(lo1[part], (hi1 - lo1)[part], lo2[part], (hi2 - lo2)[part])
            near = (i != j) & (label[i] != label[j])
            i, j = i[near], j[near]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            _join(label, i[near], j[near])
        big = np.flatnonzero(~small)
        if not len(big):
            continue
        lo1, hi1, lo2, hi2, errors, same = (x[big] for x in (lo1, hi1, lo2, hi2, errors, same))
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
        count = ones[depth]
        mid1, mid2 = hi1 - (count[hi1] - count[lo1]), hi2 - (count[hi2] - count[lo2])
        more, cross = errors < budget, (errors < budget) & ~same
        children = [
            (lo1, mid1, lo2, mid2, errors),
            (mid1, hi1, mid2, hi2, errors),
            tuple(x[more] for x in (lo1, mid1, mid2, hi2, errors + 1)),
            tuple(x[cross] for x in (mid1, hi1, lo2, mid2, errors + 1)),
        ]
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*children))))
    return label


def _units(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Edges of the spanning forests of units, from rows sorted by (block, value, p, q, side, turned)."""
    names = ("block", "value", "p", "q", "side", "turned")

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        values = rows[5].astype(np.int64).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], (rows[:5, 1:] != rows[:5, :-1]).any(0)]))
        stops = np.concatenate([starts[1:], [len(values)]])
        p, q, side = rows[2, starts], rows[3, starts], rows[4, starts]
        alone = p == q
        left = np.flatnonzero(~alone & (side == 0))
        left = left[left + 1 < len(starts)]
        left = left[(rows[:4, starts[left]] == rows[:4, starts[left + 1]]).all(0) & (side[left + 1] == 1)]
        own = np.flatnonzero(alone)
        ranges = np.concatenate([np.stack([starts[own], stops[own], starts[own], stops[own]], 1), np.stack([starts[left], stops[left], starts[left + 1], stops[left + 1]], 1)])
        label = trie_join(values, ranges, budget, WIDTH)
        tied = np.flatnonzero(label != np.arange(len(label)))
        turn = (rows[0] * WIDTH).astype(np.uint64)
        back = np.where(turn > 0, (values >> turn) | (values << ((np.uint64(64) - turn) % np.uint64(64))), values).view(np.int64)
        return pa.record_batch([pa.array(back[tied]), pa.array(back[label[tied]])], ["a", "b"])

    held, size, enough = [], 0, UNIT_ROWS
    for batch in batches:
        rows = np.stack([batch[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
        if rows.shape[1]:
            held.append(rows)
            size += rows.shape[1]
        if size >= enough:
            rows = np.concatenate(held, 1)
            last = int(np.flatnonzero((rows[:4] != rows[:4, -1:]).any(0)).max(initial=-1)) + 1  # the last unit may go on
            if last:
                yield edges(rows[:, :last])
                rows = rows[:, last:]
            held, size = [rows], rows.shape[1]
            enough = max(UNIT_ROWS, 2 * size)
    if size:
        yield edges(np.concatenate(held, 1))


def _node() -> Column:
    """Number of the node so many levels below the subtree's root."""
    return F.expr(f"shiftrightunsigned(shiftleft(turned, {WIDTH}), 64 - levels)")


def _few_bits(levels: Column, budget: int) -> Column:
    """All numbers of ``levels`` bits of which ``budget`` at most are 1."""
    bits = F.transform(F.sequence(F.lit(0), levels - 1), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    found, grown = F.array(F.lit(0).cast("long")), bits
    for n in range(budget):
        found = F.concat(found, grown)
        if n < budget - 1:
            lowest = lambda x: x.bitwiseAND(-x)
            grown = F.flatten(F.transform(grown, lambda x: F.transform(F.filter(bits, lambda b: b < lowest(x)), lambda b: x.bitwiseOR(b))))
    return found


def _deep_enough(rows: DataFrame, hot: DataFrame, subtree: int) -> DataFrame:
    """``hot`` with as many levels as it takes until no node holds more than ``subtree`` fingerprints. They are distinct, so an end comes."""
    folder, i = scratch(rows.sparkSession, "subtrees"), 0
    hot = written(hot, f"{folder}/0")
    while hot.take(1):
        held = rows.join(F.broadcast(hot), (F.col("block") == F.col("hb")) & (F.col("value") == F.col("hv"))).groupBy("hb", "hv", "levels", _node().alias("node")).count()
        fullest = written(held.groupBy("hb", "hv", "levels").agg(F.max("count").alias("most")), f"{folder}/{i}-fullest")
        if not fullest.where(F.col("most") > subtree).take(1):
            break
        more = F.when(F.col("most") > subtree, F.ceil(F.log2(F.col("most") / subtree)) + 1).otherwise(0)
        i += 1
        hot = written(fullest.select("hb", "hv", F.least(F.lit(64 - WIDTH), F.col("levels") + more).cast("int").alias("levels")), f"{folder}/{i}")
    return hot


def links(distinct: DataFrame, fp_col: str = "fp", budget: int = BUDGET, subtree: int = 20_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links within ``budget`` bits connect."""
    if budget >= BLOCKS:
        raise ValueError("the blocks find up to 3 differing bits")
    fp = F.col(fp_col)
    turned = F.array(*(F.struct(F.lit(k).alias("block"), (fp if k == 0 else F.shiftleft(fp, k * WIDTH).bitwiseOR(F.shiftrightunsigned(fp, 64 - k * WIDTH))).alias("turned")) for k in range(BLOCKS)))
    rows = distinct.select(F.explode(turned).alias("t")).select("t.block", F.shiftrightunsigned("t.turned", 64 - WIDTH).cast("int").alias("value"), "t.turned")
    # one row for each value of each block: 4 * 65,536 at most, however many fingerprints there are
    hot = rows.groupBy("block", "value").count().where(F.col("count") > subtree)
    hot = hot.select(F.col("block").alias("hb"), F.col("value").alias("hv"), (F.ceil(F.log2(F.col("count") / subtree)) + 1).cast("int").alias("levels"))
    hot = _deep_enough(rows, hot, subtree)
    rows = rows.join(F.broadcast(hot), (F.col("block") == F.col("hb")) & (F.col("value") == F.col("hv")), "left").withColumn("node", _node())
    other = F.when(F.col("levels").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(_few_bits(F.col("levels"), budget), lambda m: F.col("node").bitwiseXOR(m)))
    rows = rows.withColumn("other", F.explode(other)).withColumn("node", F.coalesce("node", F.lit(0)))
    rows = rows.select("block", "value", F.least("node", "other").alias("p"), F.greatest("node", "other").alias("q"), (F.col("node") > F.col("other")).cast("int").alias("side"), "turned")
    spread = rows.repartition("block", "value", "p", "q").sortWithinPartitions("block", "value", "p", "q", "side", "turned")
    return spread.mapInArrow(partial(_units, budget=budget), "a long, b long")


# Components ------------------------------------------------------------------------------


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternating large and small stars: each node ties its larger neighbours, then its smaller
    ones, to the smallest it knows, until nothing changes. A node's smallest neighbour is found by
    partial sums, and goes to ``salts`` places, so that a star of very many nodes isn't one task's.
    """
    spark, folder = edges.sparkSession, scratch(edges.sparkSession, "components")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())

    def star(pairs: DataFrame, keep: Column) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "salt"]).where(keep)

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/0")
    was, i = state(now), 0
    while was[0]:
        i += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large, F.lit(True))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        now = written(small, f"{folder}/{i}")
        drop(spark, f"{folder}/{i - 1}")
        is_now = state(now)
        if is_now == was:
            break
        was = is_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def labelled(fps: DataFrame, distinct: DataFrame, edges: DataFrame, id_col: str, folder: str) -> DataFrame:
    """Per row of ``fps``: id, fp and component_id, from edges between ``distinct`` (fp, least: its smallest id).

    Written tables on both sides leave the joins by fingerprint as plain exchanges, so that Spark
    splits the partition of a fingerprint that very many documents share.
    """
    roots = written(components(edges), f"{folder}/roots")
    member = written(roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least"), f"{folder}/members")
    smallest = written(member.groupBy("root").agg(F.min("least").alias("c")), f"{folder}/smallest")
    linked = member.join(smallest, "root").select(F.col("fp").alias("f"), "c")
    known = written(distinct.join(linked, distinct.fp == linked.f, "left").select(F.col("fp").alias("f"), F.coalesce("c", "least").alias("c")), f"{folder}/known")
    return fps.join(known, fps.fp == known.f).select(id_col, "fp", F.col("c").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, subtree: int = 20_000) -> DataFrame:
    """Per row: id, fp (a signed 64-bit number) and component_id, the smallest id that links reach."""
    folder = scratch(docs.sparkSession, "simhash")
    fps = written(docs.select(F.col(id_col), fingerprints(F.col(text_col)).alias("fp")), f"{folder}/fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min(id_col).alias("least")), f"{folder}/distinct")
    edges = written(links(distinct, "fp", budget, subtree), f"{folder}/links")
    return labelled(fps, distinct, edges, id_col, folder)
